"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from candlewright.llm import queries
from candlewright.llm.periodic import collapse_runs, digests, find_runs, re_pair

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_brute(w, least=12):
    """Stretches by every period; a period is the smallest if no smaller one holds for the whole stretch."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(s, e + q - p)) for p in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted((s, length, q) for s, length, q in out)


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def odd_text(draw):
    """Powers, powers with errors, Fibonacci words, runs in runs, and plain text."""
    say = lambda n, k: [draw.choice("abcdefghijklmnop"[:k]) for _ in range(n)]
    out = []
    for _ in range(draw.randint(1, 5)):
        kind = draw.randint(0, 5)
        if kind == 0:
            out += say(draw.randint(0, 40), draw.choice([1, 2, 3, 16]))
        elif kind == 1:
            out += say(draw.randint(1, 14), draw.choice([2, 16])) * draw.randint(2, 8)
        elif kind == 2:
            x = say(draw.randint(2, 9), 3) * draw.randint(3, 9)
            x[draw.randrange(len(x))] = "z"
            out += x
        elif kind == 3:
            x, y = ["a"], ["a", "b"]
            for _ in range(draw.randint(2, 7)):
                x, y = y, y + x
            out += y
        elif kind == 4:
            x = (say(draw.randint(1, 3), 2) * draw.randint(1, 9) + say(draw.randint(0, 3), 3)) * draw.randint(1, 5)
            out += x
        else:
            out += ["q"] * draw.randint(1, 30)
    return out


def test_runs_of_random_words():
    draw = random.Random(3)
    for _ in range(60):
        texts = [odd_text(draw) for _ in range(12)]
        names = {x: k for k, x in enumerate(sorted({x for t in texts for x in t}))}
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = find_runs(np.array([names[x] for t in texts for x in t], np.int64), first)
        want = [(k, *r) for k, t in enumerate(texts) for r in runs_brute(t)]
        assert [tuple(r) for r in got.tolist()] == want


def test_grammar_derives_its_segments():
    draw = random.Random(4)
    texts = [[ord(x) - 97 for x in odd_text(draw)] for _ in range(40)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    word = np.array([x for t in texts for x in t], np.int64)
    g = re_pair(word, first)

    def spell(x):
        return [x] if x < g.base else spell(g.left[x - g.base]) + spell(g.right[x - g.base])

    assert [spell(x) for x in g.root.tolist()] == texts and len(g.left) < 0.8 * len(word)
    for x in range(g.base, len(g.size)):
        assert word[g.place[x] : g.place[x] + g.size[x]].tolist() == spell(x)


def test_digests(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice([" ", "\n", " \t"]).join(odd_text(draw))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x"), (None, "a b " * 20), rows[3], (2**62, "a a b   é " * 9)]
    docs = spark.createDataFrame([(k, t, "clash", 1, 2.0) for k, t in rows], "doc_id long, text string, runs string, code int, n_words double").repartition(3)
    got = [tuple(r) for r in digests(collapse_runs(docs, wrap=True)).collect()]
    assert sorted(map(str, got)) == sorted(str(brute(*r)) for r in rows)
    assert collapse_runs(docs.limit(0)).count() == 0
    one = collapse_runs(docs.filter("doc_id is null")).first()
    assert one.kept_text == "a b" and one.runs[0].period == 2 and one.runs[0].length == 40 and one.n_words == 40


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_periodic_runs"](spark, data).collect()
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got) > 10
    short = [tuple(r) for r in rows if len(WORD.findall(r.text or "")) < 700]
    have = {r.doc_id: tuple(r) for r in got}
    assert len(short) > 150 and all(have[r[0]] == brute(*r) for r in short)


@pytest.mark.parametrize("unit", ["the ", "a b ", "x " * 50 + "y ", "one two three four five six seven "])
def test_long_periodic_texts(spark, unit):
    begun = time.time()
    text = "begin " + unit * (600_000 // len(unit)) + "end"
    row = collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = unit.split()
    assert max(r.length for r in row.runs) == len(words) * (600_000 // len(unit)) and time.time() - begun < 60
    assert row.kept_text.startswith("begin " + words[0]) and row.kept_text.endswith("end") and row.n_words == len(text.split())

"""Line, substring and near-duplicate removal against brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewright.llm import line_dedup, near_dedup, queries
from candlewright.llm.near_dedup import near_duplicates, without_near_duplicates
from candlewright.llm.shared import words
from candlewright.llm.substring_dedup import marks, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], "doc_id long, text string, tag string, n_words string")


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    say = lambda n, v: " ".join(draw.choice(v) for _ in range(n))
    names = [f"w{k}" for k in range(400)]
    out, k = [], 0

    def add(t):
        nonlocal k
        out.append((k, t))
        k += draw.randint(1, 3)

    for _ in range(5):
        base = say(draw.randint(60, 160), names).split()
        for _ in range(9):
            w = list(base)
            for _ in range(int(len(w) * draw.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                w[draw.randrange(len(w))] = draw.choice(names)
            add(draw.choice([" ", "\n", "  "]).join(w))
    passage = say(55, names)
    for _ in range(6):
        add(say(20, names) + "\n" + passage + " " + say(30, names))
        add(say(draw.randint(40, 150), ["a", "b"]))
        add("the " * draw.randint(45, 120))
        add("x y " * draw.randint(20, 60) + "z")
        add(" ".join(["p"] * 30 + ["q"] * 30 + ["r"] * draw.randint(1, 40)))
    for t in ("", "  ", "one", "one two", "One TWO", "one two three", "\n\t x", None):
        add(t)
    long = say(6000, names)
    add(long)
    add(say(10, names) + long[2000:20000])
    return out


def test_substrings(spark, corpus):
    rows = corpus + [corpus[3], (None, corpus[0][1])]  # a repeated row and one without id
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(make(spark, rows).repartition(3)).collect()]
    first, want = {}, []
    for k, t in sorted(corpus):
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), k) < k:
                gone.update(range(p, p + 50))
        want.append((k, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert sum(x[2] for x in want) > 500
    again = next(x for x in want if x[0] == corpus[3][0])
    whole = WORD.findall(corpus[0][1])
    assert sorted(map(str, got)) == sorted(map(str, [*want, again, (None, len(whole), 0, " ".join(whole))]))


def test_rows_of_one_id_and_parts_of_passages(spark):
    """Rows of one doc_id and text lengths apart, passages within passages, with and without Spark's own broadcasts."""
    draw = random.Random(9)
    say = lambda n: [draw.choice([f"v{k}" for k in range(900)]) for _ in range(n)]
    passage, rows = say(260), []
    for k in range(24):
        low = draw.randint(0, 120)
        part = passage[low : low + draw.randint(49, 140)]
        rows.append((k // 2, " ".join(say(draw.randint(0, 70)) + part + say(draw.randint(0, 70)))))
    rows += [(30, " ".join(passage)), (30, " ".join(passage[:51])), (30, "short"), (31, " ".join(passage + passage))]
    first, want = {}, []
    for k, t in sorted(rows):
        w = t.split()
        gone = {p + j for p in range(len(w) - 49) if first.setdefault(tuple(w[p : p + 50]), k) < k for j in range(50)}
        want.append((k, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    try:
        for limit in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = [tuple(r) for r in remove_repeats(make(spark, rows).repartition(3)).collect()]
            assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_one_id_with_equal_short_hashes(spark):
    """Two texts of one doc_id whose 32-bit hashes are equal: what goes from one of them doesn't go from the other."""
    old, new = (" ".join(f"{x}{k}" for k in range(60)) for x in "pq")
    texts = lambda head, name: spark.range(200_000).select(F.concat(F.lit(head + " "), "id").alias(name)).withColumn("h", F.hash(name))
    both = texts(old, "x").join(texts(new, "y"), "h").select("x", "y").first()
    rows = [(1, old), (2, both.x), (2, both.y)]
    got = {tuple(r) for r in remove_repeats(make(spark, rows)).collect()}
    assert got == {(1, 60, 0, old), (2, 61, 60, both.x.split()[-1]), (2, 61, 0, both.y)}


def test_equal_windows_have_equal_marks(corpus):
    """Whatever stands around it, a window's mark follows from its own words."""
    draw, seen = random.Random(2), {}
    for _, t in corpus:
        for text in (t or "", "q " * draw.randint(0, 9) + (t or "") + " r r"):
            w = words(pa.array([text]))
            start, _, mark = marks(w, 50)
            for s, m in zip(start, mark, strict=True):
                assert seen.setdefault(tuple(w.key[s : s + 50].tolist()), m) == m
    assert len(seen) > 1000


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, size, percent):
    rows = corpus + [corpus[3], (None, "one")]
    got = near_duplicates(make(spark, rows).repartition(3), size, percent).collect()
    sets = {}
    for k, t in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    want = [(k, len(sets[k]), label[k], label[k] == k) for k in sets]
    want += [w for w in want if w[0] == corpus[3][0]] + [(None, 1, None, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(set(label.values())) < len(label) - 15


def test_many_texts_just_under_the_similarity(spark):
    """2,000 texts of 60 words with three words of their own: nearly all share entries, and only a few link."""
    draw = random.Random(7)
    base, rows = [f"b{k}" for k in range(60)], []
    for k in range(2000):
        w, at = list(base), draw.randrange(2, 56)
        w[at : at + 3] = [f"own{k}x{j}" for j in range(3)] if k % 100 else ["one", f"own{k}", base[at + 2]]
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, t.replace("b1 ", "c1 ")) for k, t in rows[:5]]
    sets = [{tuple(w[p : p + 3]) for p in range(58)} for _, t in rows for w in [t.split()]]
    names = {g: j for j, g in enumerate({g for s in sets for g in s})}
    has = np.zeros((len(rows), len(names)), np.float32)
    for k, s in enumerate(sets):
        has[k, [names[g] for g in s]] = 1
    both = has @ has.T
    linked = 185 * both >= 85 * (has.sum(axis=1)[:, None] + has.sum(axis=1))
    label = np.arange(len(rows))
    while (least := np.array([label[x].min() for x in linked])).tolist() != label.tolist():
        label = least
    begun = time.time()
    got = near_duplicates(make(spark, rows).repartition(3), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: rows[j][0] for (k, _), j in zip(rows, label)}
    assert 1900 < len(set(label.tolist())) < len(rows) and time.time() - begun < 150


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 85), (2, 5, 80), (3, 2, 90)])
def test_texts_that_share_their_changes(spark, monkeypatch, seed, size, percent):
    """Texts of several lengths, changed in few places by few words: links against brute force, and few pairs are written."""
    draw, rows, written = random.Random(seed), [], []
    base = [f"b{k}" for k in range(70)]
    for k in range(600):
        w = base[draw.choice([0, 0, 0, 4, 9]) : draw.choice([70, 70, 66, 60])]
        for _ in range(draw.randint(1, 4)):
            w[draw.randrange(2, len(w) - 2)] = f"v{draw.randrange(12)}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(w[p : p + size]) for p in range(len(w) - size + 1)} for _, t in rows for w in [t.split()]]
    label = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            if 100 * len(x & sets[b]) >= percent * len(x | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    keep = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    monkeypatch.setattr(near_dedup, "discard", lambda *_: None)
    got = near_duplicates(make(spark, rows).repartition(3), size, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label)) and 1 < len(set(label)) < 590
    assert sum(df.count() for name, df in written if name == "meeting") < 1200


def test_stage_keeps_columns_and_one_of_each_group(spark, corpus):
    docs = make(spark, corpus)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == near_duplicates(docs).filter("kept").count() < docs.count()


def test_threshold_holds_its_chance():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        most = near_dedup.threshold(percent)
        assert (rng.binomial(64, 1 - percent / 100, 200_000) <= most).all()
        chunks = near_dedup.chunks(most)
        # any set of `most` differing symbols leaves a chunk with one at most
        for _ in range(500):
            off = rng.choice(64, most, replace=False)
            assert min(np.isin(c, off).sum() for c in chunks) <= near_dedup.ERRORS


def test_distance_counts_symbols(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 12, (2, 65))
    b[:40] = a[:40]
    a[64:] = b[64:] = 0
    packed = [[int(sum(int(s[5 * k + j]) << (12 * j) for j in range(5))) for k in range(13)] for s in (a, b)]
    df = spark.createDataFrame([tuple(packed)], "a array<long>, b array<long>")
    assert df.select(near_dedup.distance(F.col("a"), F.col("b"))).first()[0] == (a != b).sum()


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert all(r.label == (0 if r.id < 50 else 100) for r in got) and len(got) == 20 + 29


def test_nothing(spark):
    empty = make(spark, []).repartition(2)
    assert near_duplicates(empty).count() == remove_repeats(empty).count() == line_dedup.remove_repeated_lines(empty).count() == 0


def lines_brute(rows, size):
    seen, out = set(), []
    for k, t in sorted(rows):
        own = (t or "").split("\n")
        full = [p for p, x in enumerate(own) if WORD.search(x)]
        keys = [x.strip(" \t\n\v\f\r") for p in full for x in [own[p]]]
        gone = set()
        for p in range(len(full) - size + 1):
            run = tuple(keys[p : p + size])
            gone.update(full[p : p + size] if run in seen else ())
            seen.add(run)
        out.append((k, len(full), len(gone), "\n".join(x for p, x in enumerate(own) if p not in gone)))
    return out


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (1, 1), (2, 3)])
def test_lines(spark, gram, window):
    draw = random.Random(gram + window)
    names = ["a", "b b", " c ", "d", "", " \t", "e", "f", "g"]
    rows = [(k, draw.choice(["\n", "\n\n"]).join(draw.choice(names) for _ in range(draw.randint(0, 14)))) for k in range(60)]
    rows += [(70, None), (71, "z"), (72, "\n".join(["h"] * 9))]
    got = [tuple(r) for r in line_dedup.remove_repeated_lines(make(spark, rows).repartition(3), gram, window).collect()]
    assert sorted(got) == lines_brute(rows, gram + window - 1)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_substring_dedup", "op6_near_dedup"])
def test_queries_against_their_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = queries.QUERIES[name](spark, data).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    sort = lambda d: d.sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want))
    assert (~got.kept).sum() > 0 if "kept" in got else got.n_removed.sum() > 0

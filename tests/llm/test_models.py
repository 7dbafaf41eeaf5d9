"""Quality, toxicity, mixing, chat, decontamination and the pipeline."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from candlewright.llm import chat, decontamination, mixing, quality, toxicity
from candlewright.llm.line_dedup import remove_repeated_lines
from candlewright.llm.mixing import mix_sources, mixed, source_targets
from candlewright.llm.near_dedup import near_duplicates, without_near_duplicates
from candlewright.llm.shared import id_and_text
from candlewright.llm.substring_dedup import remove_repeats
from candlewright.llm.token_counts import token_counts
from candlewright.llm.token_ids import read_token_ids, write_token_ids

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# quality


def test_quality_statistics_and_verdict(spark):
    odd = ["", "\n", "a b\n\na b\n a b", "x\r\ny\r\n", None, "a " * 30, "|#*$ é\t|\v.\n\n\n|#*$ é\t|\v.", "a b c d e f g a b c d e h i"]
    docs = table(spark, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    labels = table(spark, "labels")
    got = quality.quality(docs.withColumn("n_words", F.lit("clash")), labels).toPandas().set_index("doc_id")
    for k, t in docs.toPandas().itertuples(index=False):
        t = t or ""
        w, own = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
        n = Counter(grams)
        repeated = len({q for p, g in enumerate(grams) if n[g] > 1 for q in range(p, p + 5)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), repeated)
        r = got.loc[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w)) and not (r.base_failed and r.kept)
    judged = got.join(labels.toPandas().set_index("doc_id"), how="inner")
    clean = judged[(judged.quality == 1) & ~judged.base_failed]
    assert clean.kept.mean() > 0.98 and judged[judged.quality == 0].kept.mean() < 0.05


def brute_path(field, x):
    paths = itertools.product((0, 1), repeat=len(x))
    total = lambda y: field.start[y[0]] + sum(field.emit[b] @ r for b, r in zip(y, x, strict=True)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))
    return max(paths, key=total)


def test_viterbi_and_training():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 7, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(sum(sizes), 4))
    field = quality.Field(rng.normal(size=(2, 4)), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = quality.viterbi(field, x, first)
    for a, b in itertools.pairwise(first):
        assert tuple(got[a:b]) == (brute_path(field, x[a:b]) if b > a else ())
    y = (x[:, 0] > 0).astype(int)
    fitted = quality.train(x, y, first, rounds=300, ridge=0.01)
    assert (quality.viterbi(fitted, x, first) == y).mean() > 0.9


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(docs, none).first()["kept"]
    assert quality.quality(docs.limit(0), none).count() == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(3)
    names = ["ba", "lo", "mi", "tek", "sar", "on"]
    word = lambda: "".join(draw.choice(names) for _ in range(draw.randint(1, 4)))
    made = []
    for k in range(600):
        w = [word() for _ in range(draw.randint(5, 80))]
        bad = k % 7 == 0
        for _ in range(3 * bad):
            w.insert(draw.randrange(len(w)), draw.choice(["Zxqword", "gruntle", "vexing"]))
        made.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in made], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, b) for k, _, b in made] + [(5, None), (10**7, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    truth = pd.Series({k: b for k, _, b in made})
    held = got[got.held_out]
    assert 100 < len(held) < 200 and (held.predicted == truth[held.index]).mean() > 0.97
    import zlib

    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == h for k, h in got.held_out.items())
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs, other).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), got.score.sort_index())


def places_of(text):
    """Hashed n-grams of a text by a plain loop over whole numbers."""
    own, out = [ord(c) for c in text.replace("\x00", " ").lower()], set()
    for n in toxicity.ORDERS:
        for at in range(len(own) - n + 1):
            h = 0
            for k, c in enumerate(own[at : at + n]):
                h = c if not k else (h * 0x01000193 + c) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x9E3779B1 + n * 0x85EBCA6B) & 0xFFFFFFFF
            out.add(h >> (32 - toxicity.BITS))
    return out


def test_ngrams_ratios_and_scores_against_plain_loops(spark, monkeypatch):
    draw = random.Random(6)
    monkeypatch.setattr(toxicity, "BLOCK", 64)  # texts take several turns here; the workers' own are taken at once
    texts = ["".join(draw.choice("abcé Z.\x00") for _ in range(draw.randint(0, 300))) for _ in range(30)] + ["", "ab", None]
    which, place = toxicity.hits(pa.array(texts), None)
    assert [set(place[which == k].tolist()) for k in range(len(texts))] == [places_of(t or "") for t in texts] and len(which) == len(set(zip(which, place)))
    rows = [(("bad words here " if k % 3 == 0 else "good words there ") + "".join(draw.choice("abcdef ") for _ in range(40)), int(k % 3 == 0)) for k in range(90)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), tasks=2)
    sets, labels = [places_of(t) for t, _ in rows], [y for _, y in rows]
    size, n = [labels.count(0), labels.count(1)], np.zeros((2, 1 << toxicity.BITS))
    for s, y in zip(sets, labels):
        n[y, list(s)] += 1
    sums = [sum(x) + (1 << toxicity.BITS) for x in n]
    ratio, chosen = toxicity.ratios(n, np.array(size, float), 5.0)
    for j in {j for s in sets[:4] for j in s}:
        a, b = n[1, j], n[0, j]
        assert np.isclose(ratio[j], np.log((a + 1) / sums[1]) - np.log((b + 1) / sums[0]))
        share = (a + b + 1) / (len(rows) + 2)
        gap = abs(a / size[1] - b / size[0]) / (share * (1 - share) * (1 / size[0] + 1 / size[1])) ** 0.5
        assert (gap >= 5) == (j in chosen)
    assert set(np.flatnonzero(model.weight)) <= set(chosen.tolist()) and (model.weight[chosen] * ratio[chosen] >= 0).mean() > 0.9
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts + [rows[0][0], rows[1][0]])], "doc_id long, text string")
    for r, t in zip(sorted(toxicity.score(asked, model).collect()), texts + [rows[0][0], rows[1][0]]):
        z = model.bias + sum(float(model.weight[j]) for j in places_of(t or ""))
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)), atol=1e-5)
    again = toxicity.fit(spark.createDataFrame(rows[::-1], "text string, label int").repartition(3), tasks=3)
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_toxicity_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "ab"), (3, "a" * 200_000 + "\x00b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert toxicity.toxicity(odd.limit(0), none).count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 1000, "d": 3, None: 7}, {"a": 0, "b": 10}, {"b": 5}, {"a": 0}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_flight_keeps_totals():
    draw = random.Random(1)
    size = [float(draw.randint(1, 500)) for _ in range(400)]
    share = [0.37] * 400
    got = mixing.flight(size, share, draw, land=False)
    open_ = [x for x in got if 0 < x < 1]
    assert len(open_) <= 2 and sum(got) == pytest.approx(0.37 * 400)
    assert sum(s * x for s, x in zip(size, got, strict=True)) == pytest.approx(0.37 * sum(size))
    assert set(mixing.flight(size, share, draw, land=True)) == {0.0, 1.0}
    assert abs(sum(s * (x - 0.37) for s, x in zip(size, mixing.flight(size, share, draw, land=True), strict=True))) < 5
    # the flight keeps each document's expectation
    hits = sum(mixing.flight([3.0, 5.0, 9.0, 4.0, 8.0], [0.3] * 5, random.Random(k), False)[0] for k in range(4000)) / 4000
    assert 0.27 < hits < 0.33


def test_mix(spark):
    docs = table(spark, "documents").select("doc_id", "text", "source", F.lit("x").alias("size"))
    odd = spark.createDataFrame([(10**6, None, "src1", ""), (10**6 + 1, "a b", None, ""), (10**6 + 1, "a b", None, ""), (None, "c", None, "")], docs.schema)
    docs = docs.union(odd)
    got = mix_sources(docs, group=40).toPandas()
    again = mix_sources(docs.repartition(5), group=40).toPandas()
    key = ["source", "doc_id", "size", "taken"]
    assert got[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    assert got["size"].sum() == sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    by = mix_sources(docs).toPandas().groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert by.target.sum() == pytest.approx(by["size"].sum() if (by.target < 3 * by["size"]).any() else by.target.sum())
    big = by[by["size"] > 1000]
    assert ((big.taken - big.target).abs() < 0.01 * big.target).all()
    rows = mixed(docs)
    assert rows.columns == docs.columns and rows.count() == mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert mix_sources(docs.limit(0)).count() == 0


def test_mix_of_repeated_rows(spark):
    """Equal rows in every source: words taken stay within one row of the target, and rows are numbered by all columns."""
    rows = [(k, "a b c d e", f"s{k}", k) for k in range(3) for _ in range(300)] + [(9, "one two", "s3", j) for j in range(7)] + [(None, "x y z", None, 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = mix_sources(docs).toPandas()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "first"), n=("size", "size"))
    assert by.n.tolist() == [300, 300, 300, 7, 5] and ((by.taken - by.target).abs() <= by["size"]).all() and by.taken.loc["s2"] > 0
    assert (got.groupby("source").copies.agg(lambda x: x.max() - x.min()) <= 1).all() and (got.taken <= 3 * got["size"]).all()
    kept = mixed(docs.repartition(5)).toPandas()
    assert Counter(kept.doc_id.fillna(-1)) == Counter({k: int(n) for k, n in got.fillna({"doc_id": -1}).groupby("doc_id").copies.sum().items() if n})
    again = mixed(docs.repartition(3)).toPandas()
    assert Counter(map(str, kept.itertuples(index=False))) == Counter(map(str, again.itertuples(index=False)))


def test_mix_keeps_large_ids_beside_a_null(spark):
    ids = [None, *range(2**53 + 1, 2**53 + 80, 2)]
    docs = spark.createDataFrame([(i, "a b c", f"s{k % 2}") for k, i in enumerate(ids)], "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    assert mixed(docs).count() == sum(r.copies for r in got)


def test_stages_keep_clashing_columns(spark):
    """Columns named as the operators' own stay as they are, in every stage that returns documents."""
    names = ["own", "size", "source_", "copies_", "key", "key_", "c0", "gone", "_gone", "_size", "_c", "item", "kept", "n", "label"]
    docs = spark.createDataFrame([(k, f"some words for number {k} and a few more of them to be kept here", f"s{k % 2}", *names) for k in range(20)], ["doc_id", "text", "source", *names])
    benchmark = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for rows, n in ((mixed(docs), None), (without_near_duplicates(docs), 20), (decontamination.without_leaks(docs, benchmark), 0), (quality.keep_good(docs, labels), 20)):
        got = rows.collect()
        assert rows.columns == docs.columns and (n is None or len(got) == n) and all(tuple(r)[3:] == tuple(names) for r in got)


# chat


def test_chat_sql_and_spans(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hello\nthere"), (1, 1, "bob", "hello\nthere"), (1, 2, "cid", None), (1, 600, "ann", "é"), (2, 0, None, ""), (None, None, "x", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    whole = chat.rotate_perspectives(df).collect()
    assert Counter((r.conv_id, r.speaker) for r in whole) == {(1, "ann"): 1, (1, "bob"): 1, (1, "cid"): 1, (2, "unknown"): 1, (None, "x"): 1}
    assert {r.part for r in whole} == {0} and all(r.n_messages == (4 if r.conv_id == 1 else 1) for r in whole)
    got = chat.rotate_perspectives(df, turns=3).collect()
    assert Counter((r.conv_id, r.speaker) for r in got) == {(1, "ann"): 2, (1, "bob"): 2, (1, "cid"): 2, (2, "unknown"): 1, (None, "x"): 1}
    for r in whole:  # parts add up to the whole
        own = sorted((x for x in got if (x.conv_id, x.speaker) == (r.conv_id, r.speaker)), key=lambda x: x.part)
        assert "".join(x.text for x in own) == r.text and ",".join(x.mask for x in own) == r.mask
    nulls = spark.createDataFrame([(1, None, "a", f"m{k}") for k in range(10)], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_messages for r in chat.rotate_perspectives(nulls, turns=4).collect()) == [2, 4, 4]
    one = next(r for r in got if r.speaker == "bob" and r.part == 0)
    assert one.text == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n<|im_start|>user name=cid\n<|im_end|>\n"
    for r in [*got, *whole]:
        at, learnt = 0, []
        for n, flag in (map(int, s.split(":")) for s in r.mask.split(",")):
            learnt += [r.text[at : at + n]] * flag
            at += n
        assert at == len(r.text) and len(learnt) == r.n_own and all(x.endswith("<|im_end|>\n") for x in learnt)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    mine = chat.rotate_perspectives(table(spark, "conversations")).withColumn("text_sha256", F.sha2("text", 256)).drop("text").toPandas()
    want = con.sql(chat.SQL).df()[list(mine.columns)]
    key = ["conv_id", "speaker", "part"]
    pd.testing.assert_frame_equal(mine.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


# decontamination


def spelt(text, names):
    """Words and canonical form of each template token, by a plain loop."""
    out, before, was_name = [], ".", False
    for t in regex.findall(decontamination.TOKEN, text or ""):
        low, after_number = t.lower(), before[0].isascii() and before[0].isdigit()
        if t[0] in ".!?":
            before, was_name = t, False
            continue
        name = False
        if t[0].isascii() and t[0].isdigit():
            c = decontamination.NUM
        elif after_number and low in decontamination.UNITS:
            c = decontamination.UNIT
        else:
            name = names and t != low and before[0] not in ".!?"
            c = decontamination.NAME if name else low
        if name and was_name:
            out[-1][0].append(low)
        else:
            out.append(([low], c))
        before, was_name = t, name
    return out


def brute_leaks(docs, items, words=8, share=0.5, enough=24):
    marks, found = (decontamination.NUM, decontamination.UNIT, decontamination.NAME), {}
    for (d, text), (i, item) in itertools.product(docs, items):
        covered, total = set(), 0
        for names in (True, False):
            mine, theirs = spelt(text, names), spelt(item, names)
            total = sum(len(x) for x, _ in theirs)
            size = min(words, len(theirs))
            if not size or (size < decontamination.LEAST and len(mine) != size):
                continue
            key = lambda w: " ".join(c for _, c in w) if any(c not in marks for _, c in w) else " ".join(sum((x for x, _ in w), ["bare"]))
            lines = defaultdict(list)
            there = defaultdict(list)
            for q in range(len(theirs) - size + 1):
                there[key(theirs[q : q + size])].append(q)
            for p in range(len(mine) - size + 1):
                for q in there[key(mine[p : p + size])]:
                    lines[p - q].append(q)
            for line, at in lines.items():
                slots = sorted({q + k for q in at for k in range(size) if theirs[q + k][1] in marks})
                wrong = set()
                for x in slots:
                    later = [y for y in slots if y > x and theirs[y] == theirs[x]][:1]
                    if later and later[0] - x < words and mine[x + line][0] != mine[later[0] + line][0]:
                        wrong |= {x, later[0]}
                for q in at:
                    if not wrong & set(range(q, q + size)):
                        first = sum(len(x) for x, _ in theirs[:q])
                        covered.update(first + k for k in range(sum(len(x) for x, _ in theirs[q : q + size])))
        if covered and (len(covered) >= share * total or len(covered) >= enough):
            found[d, i] = max(found.get((d, i), 0), len(covered))
    return {(*k, n) for k, n in found.items()}


def test_leaks_against_brute_force(spark):
    items = [(1, "The train number 17 left Paris at 9:30 with 250 kg of coal and John Smith paid 12 dollars for every ton"), (2, "A b c"), (3, None), (4, ""), (5, "she said that 5 and 5 make 10 while 5 is odd so we add 5 and 10 again to see")]
    draw = random.Random(4)
    filler = lambda n: " ".join(draw.choice(["lorem", "ipsum", "Dolor", "sit.", "7", "amet"]) for _ in range(n))
    docs = [
        (1, "So. the train number 23 left London at 8:15 with 900 lbs of coal, and Mary Jones paid 77 euros for every ton!"),
        (2, "x"), (3, None), (4, ""), (5, "a b c"),
        (6, filler(33) + " " + items[0][1].upper().replace("PARIS", "Paris") + " " + filler(20)),
        (7, "well she said that 6 and 6 make 12 while 6 is odd so we add 6 and 12 again to see"),
        (8, "well she said that 6 and 7 make 12 while 9 is odd so we add 6 and 12 again to see"),
        (9, filler(300)), (10, filler(9) + "\n" + items[4][1].replace(" ", "\n") + " " + filler(9)),
    ]
    benchmark = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    frame = spark.createDataFrame([(*d, "x") for d in [*docs, (None, items[0][1])]], "doc_id long, text string, item string")
    got = {tuple(r) for r in decontamination.leaks(frame, benchmark).collect()}
    assert got == brute_leaks(docs, items)
    assert {d for d, _, _ in got} >= {1, 5, 6, 7, 10} and 8 not in {d for d, _, _ in got} and 9 not in {d for d, _, _ in got}
    rows = decontamination.decontaminate(frame, benchmark).collect()
    assert len(rows) == len(docs) + 1 and {r.doc_id for r in rows if r.contaminated} == {d for d, _, _ in got}
    assert decontamination.decontaminate(frame.limit(0), benchmark).count() == 0
    assert not decontamination.decontaminate(frame, benchmark.limit(0)).filter("contaminated").count()


def test_leaks_of_random_texts_against_brute_force(spark):
    draw = random.Random(11)
    words = ["the", "a", "Paris", "New York", "3", "14", "kg", "km", "x.", "so", "%", "5kg", "Bob", "ate!", "rot"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(k, say(draw.randint(1, 22))) for k in range(12)] + [(20, "1 2 3 4 5 6 7 8 9 10"), (21, "so the")]
    docs = [(k, say(draw.randint(0, 60))) for k in range(40)]
    docs += [(100 + k, say(draw.randint(0, 9)) + " " + x + " " + say(draw.randint(0, 9))) for k, (_, x) in enumerate(items)]
    docs += [(200, " ".join(map(str, range(60)))), (201, "So the"), (202, " ".join("9" * 50))]
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in decontamination.leaks(frame.repartition(3), benchmark).collect()}
    assert got == brute_leaks(docs, items) and {(200, 20), (201, 21)} <= {x[:2] for x in got} and (202, 20) not in {x[:2] for x in got}


def test_verbatim_items_of_any_length_are_found_at_every_place(spark):
    draw = random.Random(12)
    say = lambda n, of: " ".join(draw.choice(of) + str(draw.randint(10, 99)) for _ in range(n))
    items = [(n, say(n, ["word", "term"])) for n in range(3, 13)]
    docs = [(100 * n + k, say(k, ["other"]) + " " + text + " " + say(draw.randint(0, 9), ["more"])) for n, text in items for k in range(9)]
    rows = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs) and all(r.contaminated and r.first_item == r.doc_id // 100 and r.covered == r.first_item for r in rows)


def test_what_many_texts_and_items_share_makes_no_pairs(spark, monkeypatch):
    """400 texts and 400 items with one stock sentence, 300 items of one template: few stored rows, and the same leaks."""
    draw, seen = random.Random(13), {}
    say = lambda n: " ".join(draw.choice(["oak", "elm", "ash", "fir", "yew"]) + str(draw.randint(100, 999)) + "x" for _ in range(n))
    stock = "please answer the question below with one short sentence of your own"
    items = [(k, f"{stock} {say(20)}") for k in range(400)] + [(1000 + k, f"how many apples are left if {k} of {k + 7} apples were eaten on the way home") for k in range(300)]
    docs = [(k, f"{say(15)} {stock} {say(15)}") for k in range(400)] + [(500, say(9) + " " + items[7][1]), (501, "so how many apples are left if 3 of 9 apples were eaten on the way home")]
    keep = decontamination.stored

    def counted(df, name):
        out = keep(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(decontamination, "stored", counted)
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: tuple(r)[1:4] for r in decontamination.decontaminate(frame, benchmark).collect()}
    assert {k: v for k, v in rows.items() if v[0]} == {500: (True, 1, 7), 501: (True, 300, 1000)}
    assert seen["candidates"] < 20 and seen["matches"] < 500 and seen["windows"] < 10_000
    some = [d for d in docs if d[0] % 100 == 0] + docs[-1:]
    own = items[:6] + items[-30:]
    got = decontamination.leaks(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_leaks(some, own)


def test_equal_slots_may_part(spark):
    item = "in the morning the shop on the corner sold 3 pens to every child who came in with a note from school and after lunch it also had rulers that cost 3 dollars so how much did the children pay"
    asked = item.replace("3 pens", "5 pens").replace("3 dollars", "8 dollars")
    docs = [(k, "x " * k + asked) for k in range(4)] + [(4 + k, "x " * k + item.replace("3 dollars", "4 dollars")) for k in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = decontamination.decontaminate(frame, benchmark).collect()
    assert all(r.contaminated and r.covered >= 20 for r in rows) and len(rows) == 8


def test_tokens_find_longer_names_and_other_case(spark):
    names = "after the visit to Paris my friend Anna paid 12 dollars and then went home with Bob to eat"
    long = "in the morning the shop of Anna Smith on the corner near Paris sold 3 pens to every child who came with Bob and after lunch it had rulers from Rome that cost 3 dollars so how much did Carl pay"
    other = names.replace("Paris", "New York").replace("Anna", "Mary Jane Lee").replace("Bob", "Tim Cook").replace("12 dollars", "950 euros")
    asked = long.replace("3 pens", "5 pens").replace("3 dollars", "8 dollars")
    near = "well she said that 5 and 5 make 10 while 5 is odd so we add 5 and 10 again to see"
    texts = {1: other, 2: names.lower(), 3: names.upper().replace(" ", " - "), 4: long.lower(), 5: asked, 6: asked.upper(), 7: near.replace("5 and 5", "6 and 7").replace("5 is", "9 is").replace("add 5", "add 6")}
    docs = [(10 * k + n, "x " * n + t) for k, t in texts.items() for n in range(4)]
    docs += [(k, t) for k, t in enumerate([None, "", "- !", "a b c", "x " * 300])]
    frame = spark.createDataFrame([*docs, (10, "y " * 50), (None, long)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, names), (2, long), (3, near[5:]), (4, None), (5, "...")], "item_id long, text string")
    rows = decontamination.decontaminate(frame, benchmark).collect()
    found = {r.doc_id: r.first_item for r in rows if r.contaminated}
    assert len(rows) == len(docs) + 2
    assert found == {10 * k + n: item for k, item in {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}.items() for n in range(4)}
    rows = decontamination._with_hashes(spark.createDataFrame([("He met Mary Jane, at 5kg - for 3 dollars. Paris",)], "text string"), F.col("text"))
    own, canon = rows.select(*decontamination._spelt(True)).first()
    assert len(own) == len(canon) and " ".join(canon) == "he met \x03 at \x01 \x02 for \x01 \x02 paris"


def test_planted_items_are_found(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    flat = {r.doc_id: " ".join(WORD.findall(r.text)) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in flat.items() if " ".join(WORD.findall(r.text)) in t}
    got = {(r.doc_id, r.item) for r in decontamination.leaks(docs, items).collect()}
    assert len(want) > 10 and got == want


# pipeline


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, DATA)
    field = quality.fit(id_and_text(docs), table(spark, "labels"))
    want = {r.doc_id for r in quality.judge(id_and_text(docs), field).filter("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want
    lone = corpus_pipeline.near_dedup(spark, good, DATA)
    ids = {r.doc_id for r in lone.collect()}
    sets = {k: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for k in want for w in [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), seen[k]))]}
    groups = {k: k for k in sets}
    where = defaultdict(list)
    for k in sorted(sets):
        n = Counter(j for g in sets[k] for j in where[g])
        for j, both in n.items():
            if 100 * both >= 80 * (len(sets[k]) + len(sets[j]) - both) and groups[j] != groups[k]:
                x, y = sorted((groups[j], groups[k]))
                groups = {a: x if b == y else b for a, b in groups.items()}
        for g in sets[k]:
            where[g].append(k)
    assert lone.columns == columns and ids == set(groups.values())
    clean = corpus_pipeline.decontamination(spark, lone, DATA)
    leaked = {r.doc_id for r in decontamination.leaks(lone, table(spark, "benchmark")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == ids - leaked
    mix = corpus_pipeline.source_mix(spark, clean, DATA)
    copies = {r.doc_id: r.copies for r in mix_sources(clean).collect()}
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == Counter({k: n for k, n in copies.items() if n})
    end = corpus_pipeline.token_ids(spark, mix, DATA).toPandas().sort_values("start")
    assert len(end) == sum(copies.values()) and end.doc_id.is_monotonic_increasing
    assert (end.start == end.n_tokens.cumsum() - end.n_tokens).all()


# all of them


def test_a_very_long_text(spark):
    """One text of 600,000 characters in 6,000 lines beside short ones, through every operator over documents."""
    draw = random.Random(13)
    long = "\n".join(" ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) + str(draw.randint(0, 999)) for _ in range(12)) for _ in range(6_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, "a short text of a few words, no more", "s"), (3, long[: len(long) // 2], None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    words = [len(WORD.findall(r.text)) for r in docs.orderBy("doc_id").collect()]
    by_id = lambda df: [r for r in df.orderBy("doc_id").collect()]
    assert [r.n_words for r in by_id(quality.quality(docs, labels))] == words
    assert all(0 <= r.score <= 1 for r in by_id(toxicity.toxicity(docs, labels)))
    kept = by_id(remove_repeats(docs))
    assert [r.n_words for r in kept] == words and kept[2].n_removed >= words[2] - 1 and kept[0].n_removed == 0
    lines = by_id(remove_repeated_lines(docs))
    assert [r.n_removed for r in lines][:2] == [0, 0] and lines[2].n_removed >= lines[2].n_lines - 1
    assert [r.component_id for r in by_id(near_duplicates(docs, 3, 85))] == [1, 2, 3]
    counts = by_id(token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert counts[0].n_bytes == len(long.encode()) and counts[0].n_tokens > 1.9 * counts[2].n_tokens and counts[0].over_limit
    ids = by_id(read_token_ids(*write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 1)))
    assert ids[0].n_tokens > words[0] and ids[2].start == ids[0].n_tokens + ids[1].n_tokens
    assert [r.size for r in by_id(mix_sources(docs))] == words
    item = spark.createDataFrame([(7, " ".join(long.split()[30_000:30_030]))], "item_id long, text string")
    assert [r.contaminated for r in by_id(decontamination.decontaminate(docs, item))] == [True, False, True]

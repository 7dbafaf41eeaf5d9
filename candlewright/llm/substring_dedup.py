"""Removal of long word sequences that an earlier document has, found by recompression.

Rounds name runs of equal words, then again and again pairs of neighbouring symbols, the first drawn from one half of
the alphabet and the second from the other. A name is a hash of what it stands for, and so is the half it belongs to:
names are global without a shuffle, and equal substrings are named alike except for a few symbols at their ends, which
neighbours outside may have taken. For each window of `size` words its own words tell which symbols are inside for
certain. Its mark is the longest certain symbol of the highest level that has one: equal windows have equal marks, and
windows in a row that share one are a run. Runs are about a tenth as many as words, and they carry the work.

Only runs whose mark two documents share can repeat. A run that a smaller document has too, as equal digests of all its
windows verify, goes as a whole. The first of equal runs stay open where their mark stands for several runs: there a
part of a run may stand in another one, as at the ends of a shared passage. Any window of an open run that a smaller
document has, the smallest such document has in an open run of its own, as else a still smaller one would have it. So
windows are digested one by one for open runs only, and words under a window that a smaller document has are removed.

All joins go by the keys' hashes, at every size of the table alike; each joined side is a stored table, so that a hot
mark, digest or document may be split between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import Words, discard, id_and_text, mix, pieces, stored, windows, within, words

#: Rounds of pairing; a window of 50 words has no certain symbol left after fewer.
ROUNDS = 9


def marks(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and mark of each window of `size` words."""
    start, owner = within(w.first, size)
    if not len(start):
        return start, owner, np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    # runs of equal words; the first and the last of a window may go on outside
    fresh = np.append(True, (w.key[1:] != w.key[:-1]) | (own[1:] != own[:-1]))
    at, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    length = np.diff(np.append(at, len(w.key)))
    symbol, own = np.where(length > 1, mix(w.key[at] ^ mix(length.astype(np.uint64))), w.key[at]), own[at]
    low, high = (run[start] + 1).astype(np.int32), run[start + size - 1].astype(np.int32)
    mark = mix(w.key[start] ^ mix(w.key[start + size - 1], 1))  # where nothing is certain: the ends
    live = np.flatnonzero(low < high)
    low, high = low[live], high[live]
    for level in range(ROUNDS):
        second = (mix(symbol, 100 + level) & np.uint64(1)).astype(bool)
        paired = np.zeros(len(symbol) + 1, bool)  # a pair's second half
        paired[1:-1] = ~second[:-1] & second[1:] & (own[1:] == own[:-1])
        # a second half may go with a symbol before the window, a first half with one after it
        low_, high_ = low + second[low], high - ~second[high - 1]
        keep = low_ < high_
        done = ~keep if level < ROUNDS - 1 else np.ones(len(keep), bool)
        mark[live[done]] = symbol[_longest(low[done], high[done], length)]
        live, low, high = live[keep], low_[keep], high_[keep]
        if not len(live):
            break
        place = np.cumsum(~paired[:-1]) - 1
        at = np.flatnonzero(~paired[:-1])
        after, two = np.minimum(at + 1, len(symbol) - 1), paired[at + 1]
        with np.errstate(over="ignore"):
            pair = mix(symbol[at] * np.uint64(0x9E3779B97F4A7C15) + symbol[after], level)
        length = length[at] + np.where(two, length[after], 0)
        symbol, own = np.where(two, pair, symbol[at]), own[at]
        low, high = place[low].astype(np.int32), (place[high - 1] + 1).astype(np.int32)
    return start, owner, mark


def _longest(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
    """In each range of symbols the first of those that stand for most words."""
    best, k = low.copy(), low + 1
    open_ = np.flatnonzero(k < high)
    while len(open_):
        here = k[open_]
        longer = open_[length[here] > length[best[open_]]]
        best[longer] = k[longer]
        k[open_] += 1
        open_ = open_[k[open_] < high[open_]]
    return best


def _digests(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window from each word on."""
    return windows(w.key, size, 0xD1342543DE82EF95), windows(mix(w.key, 3), size, 0xA0761D6478BD642F)


def _runs(docs: DataFrame, size: int) -> DataFrame:
    """mark, a, b, doc_id, tag, start, n: runs of windows with one mark; digests of all n windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column("text"))
            start, text, mark = marks(w, size)
            new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])) if len(mark) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(mark)))
            turn = mix((np.arange(len(mark)) - np.repeat(at, n)).astype(np.uint64))
            with np.errstate(over="ignore"):
                a, b = (np.add.reduceat(mix(x[start] ^ turn), at) if len(at) else turn for x in _digests(w, size))
            start, text = start[at], text[at]
            yield pa.record_batch({"mark": mark[at].view(np.int64), "a": a.view(np.int64), "b": _half(b), "doc_id": batch.column("doc_id").take(pa.array(text)), "tag": batch.column("tag").take(pa.array(text)), "start": (start - w.first[text]).astype(np.int32), "n": n.astype(np.int32)})

    return stored(docs.filter("doc_id is not null").mapInArrow(find, "mark long, a long, b int, doc_id long, tag long, start int, n int"), "runs")


def _half(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _open_windows(docs: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """a, b, doc_id, tag, start of every window of the open runs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words(batch.column("text"))
            own = batch.column("runs")
            text = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            low, n = flat.field("s").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            inside = low + n + size - 1 <= np.diff(w.first)[text]  # rows whose tags are equal by chance have no windows here
            low, n, text = low[inside], n[inside], text[inside]
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            text = np.repeat(text, n)
            a, b = (x[start + w.first[text]] for x in _digests(w, size)) if len(start) else np.zeros((2, 0), np.uint64)
            yield pa.record_batch({"a": a.view(np.int64), "b": _half(b), "doc_id": batch.column("doc_id").take(pa.array(text)), "tag": batch.column("tag").take(pa.array(text)), "start": start.astype(np.int32)})

    by_row = stored(open_.groupBy("doc_id", "tag").agg(F.collect_set(F.struct(F.col("start").alias("s"), "n")).alias("runs")), "open-runs")
    rows = docs.join(by_row.hint("merge"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs")
    return stored(rows.mapInArrow(digest, "a long, b int, doc_id long, tag long, start int"), "windows")


def _earlier(rows: DataFrame, name: str) -> DataFrame:
    """a, b, at: the smallest document of each digest that several have. Stored, so that a join may split a hot digest."""
    both = rows.groupBy("a", "b").agg(F.min("doc_id").alias("at"), F.max("doc_id").alias("z"))
    return stored(both.filter("at < z").select("a", "b", "at"), name)


def _repeats(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tag, lows, highs: from where to where windows of each row start that a smaller document has too."""
    every = _runs(docs, size)
    by_mark = every.groupBy("mark").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), (F.min("a") < F.max("a")).alias("several"))
    by_mark = stored(by_mark.filter("x < y").select("mark", "several"), "marks")
    shared = stored(every.join(by_mark.hint("merge"), "mark").drop("mark"), "shared-runs")
    discard(every, by_mark)
    runs = stored(shared.join(_earlier(shared, "first-runs").hint("merge"), ["a", "b"], "left").select("doc_id", "tag", "start", "n", "several", (F.col("doc_id") > F.coalesce("at", "doc_id")).alias("later")), "judged-runs")
    discard(shared)
    found = _open_windows(docs, runs.filter("several and not later"), size)
    later = found.join(_earlier(found, "first-windows").hint("merge"), ["a", "b"]).filter("doc_id > at").select("doc_id", "tag", "start", F.lit(1).alias("n"))
    rows = later.union(runs.filter("later").select("doc_id", "tag", "start", "n"))
    span = F.struct(F.col("start").alias("low"), (F.col("start") + F.col("n") - 1).alias("high"))
    rows = rows.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(span)).alias("s"))
    low = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["high"], F.lit(-2)) != x["low"] - 1)
    high = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1)["low"], F.lit(-2)) != x["high"] + 1)
    out = stored(rows.select("doc_id", "tag", F.transform(low, lambda x: x["low"]).alias("lows"), F.transform(high, lambda x: x["high"]).alias("highs")), "repeats")
    discard(runs, found)
    return out


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row: words joined by one space, without repeated ones.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if it is in a window of `size` words that also starts in a
    document with a smaller doc_id; windows are judged on the input. Null and empty texts have no words and an empty kept
    text. Rows that share a doc_id are never earlier than each other; a 64-bit hash of the text tells them
    apart. A null doc_id is neither earlier nor later than any, so that its row stays whole. Other columns play no part; an empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    rows = docs.join(_repeats(docs, size).hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "lows", "highs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, gone, kept = [], [], []
            for text, low, high in zip(batch.column("text"), batch.column("lows"), batch.column("highs"), strict=True):
                own = (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D
                n.append(len(own))
                if low.is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, np.minimum(low.values.to_numpy(), len(own)), 1)
                    np.add.at(edge, np.minimum(high.values.to_numpy() + size, len(own)), -1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own).decode())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


#: The same for DuckDB, with windows of 50 words.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS p, words FROM w WHERE len(words) >= 50),
hashed AS (SELECT doc_id, p, md5_number(array_to_string(words[p:p + 49], ' ')) AS h FROM starts),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM hashed) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM later),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
  GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

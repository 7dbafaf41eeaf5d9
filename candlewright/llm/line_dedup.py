"""Removal of runs of lines that stand earlier already, found by winnowing.

A document is the sequence of its lines with a word, each stripped of white space at its ends. Grams of `gram` lines are
hashed; of every `window` grams in a row the smallest is kept as a fingerprint, the last of equals. Any run of
gram + window - 1 lines that stands twice has a kept fingerprint in common, so that positions joined on fingerprints
miss no such run. Positions are joined on fingerprints that stand more than once, and a row keeps those of its own. A
match is not walked from pair to pair, as a line that many documents share would make all their pairs. Instead, from each
shared fingerprint all runs of the guaranteed length that hold its gram are taken, to both sides. Each is grouped by its
full digest with its equals, and goes where it isn't the first of them. A longer match is a chain of such runs that
overlap, each with a fingerprint of its own, so that the whole of it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import discard, id_and_text, mix, pieces, span_hash, stored, text_bytes, windows, within, words


def line_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each stripped line with a word, and each text's first (one more at the end)."""
    w, at = words(text), text_bytes(text)[1]
    new = np.ones(len(w.start), bool)  # the first word of a line
    feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
    if len(new):
        new[1:] = feeds[w.start[1:]] != feeds[w.end[:-1]]
        new[w.first[:-1][np.diff(w.first) > 0]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(new)) - 1
    key = span_hash(w.data, w.start[start], w.end[end]) if len(start) else np.zeros(0, np.uint64)
    return key, np.searchsorted(w.start[start], at)


def winnow(key: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of the fingerprints: in each text, the smallest of every `window` grams in a row, the last of equals."""
    place, _ = within(first, gram + window - 1)
    if not len(place):
        return place
    grams = windows(key, gram, 0xA24BAED4963EE407)
    best = place.copy()
    for k in range(1, window):
        best = np.where(grams[place + k] <= grams[best], place + k, best)
    return np.unique(best)


def _shared(docs: DataFrame, gram: int, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, tag, places: places of those fingerprints of each row that stand more than once; and tables it reads."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            key, first = line_keys(batch.column("text"))
            place = winnow(key, first, gram, window)
            text = np.searchsorted(first, place, side="right") - 1
            owner = pa.array(text)
            print_ = windows(key, gram, 0xA24BAED4963EE407)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
            yield pa.record_batch({"print": print_, "doc_id": batch.column("doc_id").take(owner), "tag": batch.column("tag").take(owner), "place": (place - first[text]).astype(np.int32)})

    found = stored(docs.filter("doc_id is not null").mapInArrow(find, "print long, doc_id long, tag long, place int"), "prints")
    # stored, as are the first runs below, so that a join may split the rows of a hot key
    twice = stored(found.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "shared-prints")
    return found.join(twice, "print").groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")), [found, twice]


def remove_repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of every row.

    Lines are cut at line feeds; those without a word stay and do not count. With t = gram + window - 1, a line goes if
    it is in a run of t lines that also starts at a smaller (doc_id, line); runs are judged on the input. Kept lines are
    joined by line feeds, as they were. Null and empty texts have no lines. Rows equal in doc_id and text count once and
    share their fate; a null doc_id is neither earlier nor later than any. Other columns play no part.
    """
    size = gram + window - 1
    docs = id_and_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    shared, spent = _shared(docs, gram, window)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            key, first = line_keys(batch.column("text"))
            places = batch.column("places")
            text = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            at = places.flatten().to_numpy() + first[text]
            start = np.unique((at[:, None] - np.arange(size - gram + 1)).ravel())
            text = np.searchsorted(first, np.maximum(start, 0), side="right") - 1
            inside = (start >= 0) & (start + size <= first[np.minimum(text + 1, batch.num_rows)])
            start, text = start[inside], text[inside]
            owner = pa.array(text)
            a, b = windows(key, size, 0xD1342543DE82EF95), windows(mix(key, 3), size, 0xA0761D6478BD642F)
            yield pa.record_batch({"a": a[start].view(np.int64), "b": b[start].view(np.int64), "doc_id": batch.column("doc_id").take(owner), "tag": batch.column("tag").take(owner), "start": (start - first[text]).astype(np.int32)})

    marked = docs.join(shared, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places")
    runs = stored(marked.mapInArrow(extend, "a long, b long, doc_id long, tag long, start int"), "runs")
    discard(*spent)
    first_of = runs.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.max(F.struct("doc_id", "start")).alias("z"))
    first_of = stored(first_of.filter("at < z").select("a", "b", "at"), "first-runs")
    later = runs.join(first_of, ["a", "b"]).filter(F.struct("doc_id", "start") > F.col("at"))
    rows = docs.join(later.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts")), ["doc_id", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, gone, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                own = (text.as_py() or "").split("\n")
                full = [k for k, x in enumerate(own) if x.encode().strip()]
                out = {s + k for s in starts.as_py() or () for k in range(size)}
                drop = {full[k] for k in out}
                n.append(len(full))
                gone.append(len(drop))
                kept.append("\n".join(x for k, x in enumerate(own) if k not in drop))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return rows.select("doc_id", "text", "starts").mapInArrow(cut, "doc_id long, n_lines long, n_removed long, kept_text string")


#: The same for DuckDB, with runs of three lines.
SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
full_lines AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT doc_id, p, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM runs WHERE run IS NOT NULL)
  WHERE k > 1),
gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM full_lines f JOIN later l ON f.doc_id = l.doc_id AND f.p BETWEEN l.p AND l.p + 2),
kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) AS text
  FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

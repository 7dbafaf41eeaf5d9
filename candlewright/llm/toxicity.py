"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of lower-case characters that a text has at least once. Its log-count ratio compares how
often toxic and other texts have it; a logistic regression over features scaled by these ratios gives the score. A
ratio that chance may explain counts as 0: one whose shares among toxic and other texts differ by less than `sure`
standard errors. No other n-gram is left out, and there is no bound on their number.

Fitting reads a sample of labelled rows with a bound on its size, in two parallel jobs that bring counts, and then the
features of each text, to the driver; scoring covers every whole text on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import id_and_text, pieces, stored

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Characters that are hashed together; longer texts take several turns.
BLOCK = 1 << 20


class Model(NamedTuple):
    """A weight for each hashed n-gram, already scaled by its log-count ratio; 0 for those left out."""

    weight: np.ndarray
    bias: float


def hits(text: pa.Array, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which text has which hashed n-gram, each pair once; only n-grams that `keep` marks, if given."""
    joined = "\x00".join(x.replace("\x00", " ") for x in text.fill_null("").to_pylist()).lower()
    every = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.flatnonzero(every == 0)
    pairs = [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for start in range(0, len(every), BLOCK):  # n-grams that start in the block
            codes = every[start : start + BLOCK + max(ORDERS) - 1]
            found, h, inside = [], codes, codes != 0
            for n in range(2, max(ORDERS) + 1):
                if len(codes) < n:
                    break
                h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
                inside = inside[:-1] & (codes[n - 1 :] != 0)
                if n not in ORDERS:
                    continue
                place = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
                at = np.flatnonzero((inside & keep[place] if keep is not None else inside)[:BLOCK])
                found.append(np.searchsorted(bounds, at + start) << BITS | place[at])
            pairs.append(np.unique(np.concatenate(found)) if found else pairs[0])
    one = np.unique(np.concatenate(pairs)) if len(pairs) > 2 else pairs[-1]
    return one >> BITS, one & ((1 << BITS) - 1)


def ratios(n: np.ndarray, texts: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each place, and those places whose ratio is sure. n: other and toxic texts with it; texts: all."""
    p, q = n[1] + 1, n[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = (n.sum(axis=0) + 1) / (texts.sum() + 2)
    gap = np.abs(n[1] / texts[1] - n[0] / texts[0]) / np.sqrt(share * (1 - share) * (1 / texts[0] + 1 / texts[1]))
    return ratio, np.flatnonzero(gap >= sure)


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """text, label of at most `bound` labelled rows, those with the smallest hashes of doc_id."""
    some = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    return docs.join(F.broadcast(some), docs["doc_id"] == F.col("id")).select("text", "label")


def fit(rows: DataFrame, sure: float = 5.0, rounds: int = 200, ridge: float = 3.0, tasks: int = 8) -> Model:
    """Fit on text, label rows of a bounded sample. Without both labels every text gets the labels' mean.

    Counts are whole numbers and texts are put in order, so that reruns give the same weights.
    """
    rows = stored(rows.repartition(tasks), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in pieces(batches, 1 << 20):
            label = (batch.column("label").to_numpy() > 0).astype(np.int64)
            which, place = hits(batch.column("text"), None)
            texts += np.bincount(label, minlength=2)
            for k in (0, 1):
                n[k] += np.bincount(place[label[which] == k], minlength=1 << BITS).astype(np.int32)
        yield pa.record_batch({"texts": pa.array([texts.tolist()], pa.list_(pa.int64())), "n": pa.array([n.tobytes()], pa.binary())})

    n, texts = np.zeros((2, 1 << BITS)), np.zeros(2)
    for x in rows.mapInArrow(count, "texts array<long>, n binary").collect():  # a row for each task
        n += np.frombuffer(x.n, np.int32).reshape(2, -1)
        texts += x.texts
    if not texts.all():
        p = (texts[1] + 1) / (texts.sum() + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    ratio, chosen = ratios(n, texts, sure)
    keep = np.zeros(1 << BITS, bool)
    keep[chosen] = True
    sent = rows.sparkSession.sparkContext.broadcast(keep)

    def have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            which, place = hits(batch.column("text"), sent.value)
            edge = np.searchsorted(which, np.arange(batch.num_rows + 1)).tolist()
            raw = place.astype("<i4").tobytes()
            yield pa.record_batch({"label": batch.column("label"), "have": pa.array([raw[4 * a : 4 * b] for a, b in zip(edge, edge[1:])], pa.binary())})

    got = rows.mapInArrow(have, "label int, have binary").collect()  # a row for each text of the sample
    got.sort(key=lambda x: (x.label, x.have))
    column = [np.searchsorted(chosen, np.frombuffer(x.have, "<i4")) for x in got]
    owner = np.repeat(np.arange(len(got)), [len(x) for x in column])
    column, y = np.concatenate([*column, np.zeros(0, np.int64)]), np.array([x.label > 0 for x in got], float)
    scale = ratio[chosen]
    w, bias = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, t = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    for t in range(1, rounds + 1):  # Adam on all rows of the sample
        z = bias + np.bincount(owner, (scale * w)[column], minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.append(scale * np.bincount(column, off[owner], minlength=len(w)) + ridge / len(y) * w, off.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = scale * w
    return Model(weight, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of doc_id, text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        keep = weight != 0
        for batch in pieces(batches, 2 << 20):
            which, place = hits(batch.column("text"), keep)
            z = bias + np.bincount(which, weight[place], minlength=batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.mapInArrow(give, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 6_000, threshold: float = 0.3, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`.

    Labels count only where crc32(doc_id as text) mod `folds` is not `held`; at most `bound` of them are used, those of
    the smallest hashes of doc_id. Null and
    empty texts have no n-gram, so that the bias alone scores them; a null doc_id is not held out. Repeated rows score
    alike; labels that are null, or of documents that are not there, play no part, and of several labels of a document
    the largest does. Without labels all scores are 0.5. Other columns play no part.
    """
    docs = id_and_text(docs, id_col, text_col)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).filter(fold != held)
    out = score(docs, fit(sample(docs, known, "label", bound)))
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

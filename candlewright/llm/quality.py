"""Quality rules: text statistics, and a linear-chain conditional random field over a document's lines.

Viterbi decoding marks each line with a word as content or boilerplate; a document whose content lines hold too small a
share of its words goes. The field is fitted to labelled documents, of which a bounded sample is used: every line of a
document takes its document's label, and the transitions carry the evidence of plain lines from their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import Words, id_and_text, mix, pieces, span_hash, stored, text_bytes, windows, within, words

#: Characters that count as symbols. Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
#: Names of a line's features, in the order of the columns.
FEATURES = ("always", "symbols over 2%", "symbols over 6%", "capitals over 30%", "digits over 15%", "marks over 8%", "ends a sentence", "under 4 words", "over 40 words", "long words", "repeats a line", "bars")


class Field(NamedTuple):
    """Weights of a two-label chain (1: content): features by label, transitions, and starts."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


class Lines(NamedTuple):
    """Features, words and text of every line with a word, and each text's first line (one more at the end)."""

    x: np.ndarray
    n_words: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    repeat: np.ndarray


def lines(w: Words, at: np.ndarray) -> Lines:
    """Lines of the texts whose words `w` has and that start at the bytes `at`."""
    data = w.data
    feed = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([at[:-1], feed + 1]))
    edge = edge[edge < len(data)]
    end = np.minimum(np.append(edge[1:], len(data)), feed[np.minimum(np.searchsorted(feed, edge), len(feed) - 1)] if len(feed) else len(data))
    end = np.where(end < edge, np.append(edge[1:], len(data)), end)
    # no line reaches over the start of the next text
    after = at[np.minimum(np.searchsorted(at, edge, side="right"), len(at) - 1)]
    end = np.minimum(end, np.maximum(after, edge))
    n = np.searchsorted(w.start, end) - np.searchsorted(w.start, edge)
    edge, end, n = edge[n > 0], end[n > 0], n[n > 0]
    owner = np.searchsorted(at, edge, side="right") - 1
    key = mix(span_hash(data, edge, end) ^ mix(owner.astype(np.uint64)))
    _, place, back = np.unique(key, return_index=True, return_inverse=True)
    repeat = place[back] != np.arange(len(key))

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[end] - sums[edge]

    size = np.maximum(end - edge, 1)
    symbols, capitals = count(np.isin(data, list(SYMBOLS))), count((data >= 65) & (data <= 90))
    letters, digits = count(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)), count((data >= 48) & (data <= 57))
    marks, bars = count((data == 33) | (data == 63) | (data == 64)), count(data == 124)
    last = data[end - 1]
    x = np.stack([np.ones(len(size)), symbols > 0.02 * size, symbols > 0.06 * size, capitals > 0.3 * np.maximum(letters, 1), digits > 0.15 * size, marks > 0.08 * size, (last == 46) | (last == 33) | (last == 63), n < 4, n > 40, letters > 12 * n, repeat, bars > 0], axis=1).astype(np.float64)
    return Lines(x, n, owner, np.searchsorted(owner, np.arange(len(at))), repeat)


def _steps(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place in a chain, the chains that reach it and their rows there; the longest chains come first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    reach = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    for t, k in enumerate(reach):
        yield order[:k], first[:-1][order[:k]] + t


def viterbi(field: Field, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The likeliest labels of all chains' rows; ties go to content."""
    score, back = x @ field.emit.T, np.zeros((len(x), 2), np.int8)
    best = np.zeros_like(score)
    for t, (_, rows) in enumerate(_steps(first)):
        if not t:
            best[rows] = score[rows] + field.start
            continue
        step = best[rows - 1][:, :, None] + field.move[None]
        back[rows] = 1 - (step[:, 0] > step[:, 1])
        best[rows] = score[rows] + step.max(axis=1)
    label = np.zeros(len(x), np.int8)
    has = np.diff(first) > 0
    last = first[1:][has] - 1
    label[last] = best[last, 1] >= best[last, 0]
    for t, (_, rows) in reversed(list(enumerate(_steps(first)))):
        if t:
            label[rows - 1] = back[rows, label[rows]]
    return label


def train(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> Field:
    """Maximum likelihood of the labels by gradient ascent (Adam), with forward-backward sums over all chains."""
    k, n = x.shape[1], max(len(first) - 1, 1)
    theta = np.zeros(2 * k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    steps = list(_steps(first))
    inner = np.ones(len(x), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.concatenate([(np.eye(2)[y].T @ x).ravel(), np.bincount(2 * y[at - 1] + y[at], minlength=4), np.bincount(y[~inner], minlength=2)])
    for t in range(1, rounds + 1):
        emit, move, start = theta[: 2 * k].reshape(2, k), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :]
        score = x @ emit.T
        fore, rear = np.zeros_like(score), np.zeros_like(score)
        for j, (_, rows) in enumerate(steps):
            fore[rows] = score[rows] + (np.logaddexp(fore[rows - 1, :1] + move[0], fore[rows - 1, 1:] + move[1]) if j else start)
        for j, (_, rows) in reversed(list(enumerate(steps))):
            if j:
                ahead = rear[rows] + score[rows]
                rear[rows - 1] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        total = np.logaddexp(*(fore + rear).T)
        p = np.exp(fore + rear - total[:, None])
        pair = np.exp(fore[at - 1][:, :, None] + move + (score[at] + rear[at])[:, None, :] - total[at][:, None, None]).sum(axis=0)
        slope = (np.concatenate([(p.T @ x).ravel(), pair.ravel(), p[~inner].sum(axis=0)]) - seen + ridge * theta) / n
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(theta[: 2 * k].reshape(2, k), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :])


def fit(docs: DataFrame, labels: DataFrame, bound: int = 2_000, label_col: str = "quality") -> Field:
    """Fit to at most `bound` labelled documents, those with the smallest hashes of doc_id. `docs`: doc_id, text.

    Without both labels, or without documents, the field is all zeros and finds every line to be content.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = stored(docs.join(F.broadcast(some), docs["doc_id"] == F.col("id")).select("text", "label"), "quality-sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = lines(words(batch.column("text")), text_bytes(batch.column("text"))[1])
            edge = got.first.tolist()
            raw = got.x.astype(np.uint8)
            yield pa.record_batch({"label": batch.column("label"), "x": pa.array([raw[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())})

    got = list(rows.mapInArrow(features, "label int, x binary").toLocalIterator())
    got.sort(key=lambda r: (r.label, r.x))
    if len({r.label > 0 for r in got}) < 2:
        return Field(np.zeros((2, len(FEATURES))), np.zeros((2, 2)), np.zeros(2))
    x = [np.frombuffer(r.x, np.uint8).reshape(-1, len(FEATURES)) for r in got]
    y = np.repeat([int(r.label > 0) for r in got], [len(a) for a in x])
    return train(np.concatenate(x).astype(float), y, np.concatenate([[0], np.cumsum([len(a) for a in x])]))


def repeated_words(w: Words, size: int = 5) -> np.ndarray:
    """For each text, its words in windows of `size` words that it has twice or more, the first included."""
    start, owner = within(w.first, size)
    if not len(start):
        return np.zeros(len(w.first) - 1, np.int64)
    key = mix(windows(w.key, size, 0x9E6C63D0876A9A47)[start] ^ mix(owner.astype(np.uint64)))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = start[n[back] > 1]
    edge = np.zeros(len(w.key) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return sums[w.first[1:]] - sums[w.first[:-1]]


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long"


def quality(docs: DataFrame, labels: DataFrame, bound: int = 2_000, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept of every row.

    Words are `[^\\x20\\x09-\\x0D]+`. base_failed: under 10 words, or over 20% of words in repeated 5-word windows. kept:
    not base_failed, and lines marked as content hold at least `share` of the words. Null and empty texts have no words
    and fail; repeated rows and null ids have a row each. Other columns play no part; texts are read whole.
    """
    docs = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    return judge(docs, fit(docs, known, bound, "label"), share)


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = 2_000, share: float = 0.5) -> DataFrame:
    """The rows of `docs` (with doc_id and text) that `quality` keeps, in one pass; columns as they are."""
    field = fit(id_and_text(docs), labels, bound)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    if dict(docs.dtypes)["text"] != "string":
        raise TypeError("the column text has to be a string")
    rest = docs.toDF(*names).withColumn("doc_id", F.lit(None).cast("long"))
    return judge(rest, field, share, text).filter("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def judge(docs: DataFrame, field: Field, share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The columns of `quality` for doc_id and a text by a fitted field; further columns of `docs` stay beside them, and
    so does the text if it has another name than `text`.
    """
    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    out = _OUT + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column=text_col):
            text = batch.column(text_col)
            w, at = words(text), text_bytes(text)[1]
            data = w.data
            symbol = np.concatenate([[0], np.cumsum(np.isin(data, list(SYMBOLS)), dtype=np.int64)])
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])
            got = lines(w, at)
            label = viterbi(field, got.x, got.first)

            def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                return sums[first[1:]] - sums[first[:-1]]

            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": np.diff(w.first), "word_chars": chars[w.first[1:]] - chars[w.first[:-1]], "n_symbols": symbol[at[1:]] - symbol[at[:-1]], "n_dup_lines": by_text(got.repeat, got.first), "n_repeat_words": repeated_words(w), "content_words": by_text(got.n_words * (label == 1), got.first)} | {f.name: batch.column(f.name) for f in more})

    rows = docs.mapInArrow(measure, out)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("content_words") >= share * F.col("n_words")))

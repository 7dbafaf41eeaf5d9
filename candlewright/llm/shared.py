"""Helpers that several text operators share: shared-folder tables, size-checked joins, word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text that a worker looks at together; temporary arrays are several times as large.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and its Python workers, at most, in jobs that write helper tables.
BATCH_BYTES = 8 << 20
#: Regular expression (Java) of one word.
WORD = r"[^\x20\x09-\x0D]+"

_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; local mode gets a scratch one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            import tempfile

            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: work is cut there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for the jobs inside; the session's own setting comes back afterwards."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave, once no job reads them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, values: Column | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows, else as it is. Give it stored tables.

    For rows with arrays, `values` is their number of elements, and eight times `limit` of them may go along.
    """
    n, sum_ = df.agg(F.count("*"), F.sum(F.lit(0) if values is None else values)).head()
    return F.broadcast(df) if n <= limit and (sum_ or 0) <= 8 * limit else df


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is not in `gone` (doc_id, each once); columns as they are, whatever their names."""
    name = private(docs)
    return docs.join(sized(gone.toDF(name)), docs[id_col].cast("long") == F.col(name), "left_anti")


def private(df: DataFrame, stem: str = "own") -> str:
    """A name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, as `doc_id` long and `text` string; clashing others fall away."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about `limit` bytes of text, one row at least."""
    for number, batch in enumerate(batches):
        if number:
            give_back()
        sizes = batch.column(column).nbytes if batch.num_rows else 0
        if sizes <= limit:
            if batch.num_rows:
                yield batch
            continue
        each = np.diff(_offsets(batch.column(column)))
        at, end = 0, np.cumsum(each)
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    give_back()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, as workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's start (one more at the end). Nulls are empty."""
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(text)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: near-random values from any distinct ones."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> np.uint64(33)
        x *= _MIX_1
        x ^= x >> np.uint64(29)
        x *= _MIX_2
        x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if (have := _powers.get(0)) is None or len(have[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        _powers[0] = have
    return have


class Words(NamedTuple):
    """Words of several texts: byte ranges in `data`, 64-bit hashes, and each text's first word (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges ascend and do not overlap. Works in blocks of about a megabyte."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            base = start[at]
            upto = max(at + 1, int(np.searchsorted(end, base + _BLOCK, side="right")))
            block = data[base : end[upto - 1]]
            up, down = _power(len(block) + 1)
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1:])
            s, e = start[at:upto] - base, end[at:upto] - base
            out[at:upto] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            at = upto
    return mix(out)


def words(text: pa.Array, lower: bool = False) -> Words:
    """The words of each text: runs of bytes other than space and 0x09 to 0x0D; `lower` folds A-Z first."""
    data, at = text_bytes(text)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, span_hash(data, start, end), np.searchsorted(start, at))


def windows(key: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of each `size` neighbours of `key`, by doubling; none for the last `size` - 1 places."""
    if len(key) < size:
        return np.zeros(0, np.uint64)
    out, have, power, length, shift = None, 0, key, 1, factor
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                if out is None:
                    out, have, scale = power, length, shift
                else:
                    n = len(key) - have - length + 1
                    out = out[:n] + power[have : have + n] * np.uint64(scale)
                    have, scale = have + length, scale * shift % (1 << 64)
            if length * 2 > size:
                return mix(out, size)
            n = len(power) - length
            power = power[:n] + power[length : length + n] * np.uint64(shift)
            length, shift = length * 2, shift * shift % (1 << 64)


def within(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of `size` words that stay in one text, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner], owner


def coded(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Parts of texts between single spaces: the distinct parts, each part's place among them, and parts per text."""
    parts = pc.split_pattern(text, " ")
    flat = parts.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), pc.list_value_length(parts).to_numpy().astype(np.int64)


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `values` over runs of the given lengths, which may be 0."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return sums[edge[1:]] - sums[edge[:-1]]

"""Token ids of whole texts as files of frequency-ranked ids in a byte-aligned variable-length code.

The file format. A folder of Parquet files; each row is a block of whole documents, in ascending doc_id order by
(shard, block). A block holds `doc_ids` and `counts` (int64, one for each document), `control` and `data`. Ids are
replaced by their rank in the table's own frequency order (`ranks` beside the blocks: id and rank), so that frequent
ids have small ranks. A rank takes 1 to 4 bytes, little-endian, in `data`; its length less one is a 2-bit field in
`control`, four to a byte from the low bits. As the control bytes stand apart, a numpy table lookup turns each of them
into four lengths at once, and the places in `data` follow from a running sum.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.shared import coded, discard, id_and_text, pieces, stored, totals

#: Four lengths for each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


#: Stands for a null doc_id, before all others.
_NO_ID = -(1 << 63)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; `ranks`, under 2**32, of all in a row, `counts` of each."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    field = np.zeros(int(quads.sum()) * 4, np.uint8)
    field[_places(counts, quads)] = size - 1
    control = (field.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()
    c, d = np.concatenate([[0], np.cumsum(quads)]).tolist(), np.concatenate([[0], np.cumsum(totals(size, counts))]).tolist()
    return [control[x:y] for x, y in zip(c, c[1:])], [data[x:y] for x, y in zip(d, d[1:])]


def _places(counts: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Where each id's field stands, as every document starts with a new control byte."""
    return np.arange(counts.sum()) + np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts), counts)


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents of a block, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[_places(counts, -(-counts // 4))]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


#: A text in which letters part from all else wherever they meet: ASCII, composed Latin letters, common marks; no "<|".
_PLAIN = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ¡¿«»–—‘’“”…]*$"
#: Words with an apostrophe, or runs without a letter, of a plain text in lower case.
_CUT = "([^ ]*'[^ ]*)|([^ a-zß-öø-ÿ]+)"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: What the tokenizer has to be like for texts to be cut.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_tokenizer(path: str) -> None:
    """Refuse a tokenizer whose normaliser, splitter or word ends are others than `Encoder` relies on."""
    spec = json.loads(Path(path).read_text())
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = (spec.get("normalizer") or {}).get("normalizers") == _NORMAL and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("invert") is True
    if not (same and spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and all(x["content"].startswith("<|") for x in spec["added_tokens"])):
        raise ValueError(f"{path}: token ids need lower-casing, a split into letters, digits and other marks, and word ends")


class Encoder:
    """Ids of texts by the tokenizers library, each part of a text once while it is in use.

    The tokenizer turns white space into single spaces and keeps no space, so that a text's ids are its parts' ids in
    turn if it is cut at spaces. Its splitter also parts letters from all else, except around an apostrophe. Plain texts
    are therefore put in lower case and cut there too; all else is cut at spaces only and left to the library. Letters
    met for the first time go to the library together: the last id of each word tells where it ends.

    Parts that are not met again go: of two halves, the old one is dropped when the new one has `words` parts, and what
    is met again moves to the new one.
    """

    def __init__(self, path: str, words: int = 120_000):
        from tokenizers import Tokenizer

        check_tokenizer(path)
        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        n = self.of.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.last = np.zeros(n, bool)
        self.last[[k for x, k in self.of.get_vocab().items() if x.endswith("</w>")]] = True
        self.most, self.new, self.old = words, {"": b""}, {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        letters = [x for x in parts if _LETTERS.fullmatch(x)]
        known: dict[str, bytes] = {}
        size = np.dtype(self.kind).itemsize
        for at in range(0, len(letters), 2_000):
            group = letters[at : at + 2_000]
            ids = np.array(self.of.encode(" ".join(group), add_special_tokens=False).ids, self.kind)
            edge = [0, *(size * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            known.update((x, raw[a:b]) for x, a, b in zip(group, edge[:-1], edge[1:], strict=True))
        rest = [x for x in parts if x not in known]
        got = self.of.encode_batch_fast(rest, add_special_tokens=False)
        known.update((x, np.array(e.ids, self.kind).tobytes()) for x, e in zip(rest, got, strict=True))
        return [known[x] for x in parts]

    def ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each of these distinct parts, packed as `kind`."""
        new, old, fresh = self.new, self.old, []
        out = list(map(new.get, parts))
        for k in [k for k, x in enumerate(out) if x is None]:
            out[k] = have = old.get(parts[k])
            if have is None:
                fresh.append(k)
            else:
                new[parts[k]] = have
        words = [parts[k] for k in fresh]
        for k, x, have in zip(fresh, words, self._encode(words), strict=True):
            out[k] = new[x] = have
        if len(new) > self.most:
            self.old, self.new = new, {"": b""}
        return out

    @staticmethod
    def cut(text: pa.Array) -> pa.Array:
        """Texts with a space wherever they may be cut."""
        text = pc.replace_substring(text.fill_null(""), "\n", " ")
        plain = pc.and_(pc.match_substring_regex(text, _PLAIN), pc.invert(pc.match_substring(text, "<|")))
        if not pc.any(plain).as_py():
            return text
        return pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(text), _CUT, r" \1\2 "), text)

    def __call__(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row with `end` after every text, and how many each text has."""
        distinct, place, each = coded(self.cut(text))
        ids = self.ids(distinct)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        start, sizes = np.cumsum(size) - size, size[place]
        n = totals(sizes, each)
        at = np.repeat(start[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out, last = np.full(len(at) + len(n), end, self.kind), np.cumsum(n + 1) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = flat[at]
        return out, n + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def id_type(path: str) -> str:
    """The little-endian unsigned type that raw ids are kept in."""
    return _encoder(path).kind


def encoded(docs: DataFrame, path: str, end: int, kind: str) -> DataFrame:
    """doc_id, count and the ids themselves (of type `kind`, still unranked) of every row."""
    size = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            ids, counts = _encoder(path)(batch.column("text"), end)
            raw, edge = ids.astype(kind).tobytes(), np.concatenate([[0], size * np.cumsum(counts)]).tolist()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "count": counts, "ids": pa.array([raw[a:b] for a, b in zip(edge, edge[1:])], pa.binary())})

    return docs.mapInArrow(encode, "doc_id long, count long, ids binary")


def _joined(ids: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(ids.to_pylist()), kind)


def id_ranks(rows: DataFrame, kind: str) -> DataFrame:
    """id, rank: every id in `rows` by falling frequency, ties by id. One row an id, so bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(_joined(batch.column("ids"), kind), minlength=len(total))
            got[: len(total)] += total
            total = got
        have = np.flatnonzero(total)
        yield pa.record_batch({"id": have.astype(np.int64), "n": total[have].astype(np.int64)})

    n = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return n.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"))


def write_token_ids(docs: DataFrame, path: str, end: int, name: str = "token-ids", shards: int | None = None, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write blocks and ranks in the file format above into the shared folder; return (blocks, ranks) as read back.

    Null and empty texts have the end id alone. Repeated rows and equal doc_ids each have a document of their own, in
    the order of their code's checksum and bytes; a null doc_id comes first. Other columns play no part. An empty table
    makes no blocks. `shards`: files, cut at doc_id quantiles, so that each has about as many documents; the rows of a
    doc_id that takes several quantiles are cut by the checksum. A document is never split.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    kind = id_type(path)
    raw = stored(encoded(docs, path, end, kind), f"{name}-raw")
    ranks = stored(id_ranks(raw, kind), f"{name}-ranks")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    cuts = raw.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5])).head()[0] or []
    table = {x.id: x.rank for x in ranks.collect()}  # bounded by the vocabulary
    order = np.zeros(max(table, default=0) + 1, np.uint32)
    order[list(table)] = list(table.values())
    sent = spark.sparkContext.broadcast((order, np.sort(np.array(cuts, np.int64))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bounds = sent.value
        for batch in batches:
            counts = batch.column("count").to_numpy()
            control, data = pack(rank[_joined(batch.column("ids"), kind)], counts)
            key = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            sums = np.array([zlib.crc32(y, zlib.crc32(x)) for x, y in zip(control, data, strict=True)], np.int64)
            low, high = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
            shard = low + (sums * np.maximum(high - low, 1) >> 32)
            yield pa.record_batch({"shard": shard.astype(np.int32), "doc_id": batch.column("doc_id"), "sum": sums, "count": counts, "control": pa.array(control, pa.binary()), "data": pa.array(data, pa.binary())})

    coded_rows = raw.mapInArrow(code, "shard int, doc_id long, sum long, count long, control binary, data binary")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, size, held = None, 0, 0, []

        def flush() -> pa.RecordBatch:
            ids = pa.array([x[0] for x in held], pa.int64())
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([[x[1] for x in held]], pa.list_(pa.int64())), "control": pa.array([b"".join(x[2] for x in held)], pa.binary()), "data": pa.array([b"".join(x[3] for x in held)], pa.binary())})

        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "count", "control", "data")), strict=True):
                if held and (s != shard or size >= block_bytes):
                    yield flush()
                    block, size, held = (block + 1) * (s == shard), 0, []
                shard = s
                held.append(row)
                size += len(row[2]) + len(row[3])
        if held:
            yield flush()

    rows = coded_rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "sum", "data", "control")
    blocks = rows.mapInArrow(gather, "shard int, block long, doc_ids array<long>, counts array<long>, control binary, data binary")
    blocks = stored(blocks, f"{name}-blocks")
    discard(raw)
    return blocks, ranks


def read_token_ids(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the blocks; start counts ids before it."""
    spark = blocks.sparkSession
    table = {x.rank: x.id for x in ranks.collect()}  # bounded by the vocabulary
    sent = spark.sparkContext.broadcast(np.array([table[k] for k in range(len(table))], "<u4"))
    sums = blocks.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    by_shard = sums.groupBy("shard").agg(F.sum("n").alias("n"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = by_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("off"))
    starts = starts.join(by_shard, "shard").select("shard", "block", (F.col("base") + F.col("off")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = sent.value
        for batch in batches:
            for ids, counts, control, data, start in zip(*(batch.column(c) for c in ("doc_ids", "counts", "control", "data", "start")), strict=True):
                counts = np.array(counts.as_py(), np.int64)
                control, data = control.as_py(), data.as_py()
                got = ids_of[unpack(control, data, counts)].tobytes()
                sizes = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(got[4 * a : 4 * b]) for a, b in zip(sizes.tolist(), sizes[1:].tolist())]
                yield pa.record_batch({"doc_id": ids.values, "start": sizes[:-1] + start.as_py(), "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "counts", "control", "data", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")

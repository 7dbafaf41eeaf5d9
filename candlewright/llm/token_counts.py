"""Token counts of whole texts by a two-tier lookup on the map side; no pre-token is shuffled.

The most frequent pre-tokens of a small sample of texts and their lengths are broadcast as a table of bounded size. One
pass over the texts then adds up the lengths of each text's pre-tokens: from the broadcast table first, then from a
cache of its worker, and by the tokenizer for the rest. The sample decides what is looked up where and nothing else.

A pre-token is a run of spaces with the word after it, or a line feed with the rest of the word after it. No piece of
the vocabulary has a space mark after another character or any line feed, so that no merge reaches over a pre-token's
start and lengths add up exactly; `check_vocabulary` holds
the model to that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import coded, id_and_text, pieces, totals

#: The model's mark for a space.
MARK = "▁"
_PRE_TOKEN = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n[^ {MARK}\n]*")


def check_vocabulary(pieces: list[str]) -> None:
    """Refuse a vocabulary in which a merge could join two pre-tokens."""
    if bad := [x for x in pieces if MARK in x.lstrip(MARK) or " " in x or "\n" in x]:
        raise ValueError(f"pieces hold a space mark after another character, or a line feed: {bad[:5]}")


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_vocabulary([model.id_to_piece(i) for i in range(model.get_piece_size())])
    return model


_caches: dict[str, tuple[str, Lengths]] = {}


def _kept(path: str, key: str, make: Callable[[], Lengths]) -> Lengths:
    """The cache of this worker, which later tasks of the same table find filled."""
    if path not in _caches or _caches[path][0] != key:
        _caches[path] = key, make()
    return _caches[path][1]


class Lengths:
    """Lengths of pre-tokens, written without their first space. Those met for the first time are encoded together.

    A pre-token that begins with a line feed has no space: the mark that the model puts before it is taken off again.
    The cache has two halves of `cache` / 2: a full new one becomes the old one, and what is met again moves on.
    """

    def __init__(self, path: str, frequent: dict[str, int], cache: int):
        self.model, self.frequent, self.most, self.new, self.old = _model(path), frequent, cache // 2, {}, {}

    def __call__(self, parts: list[str]) -> list[int]:
        first, new, old = self.frequent, self.new, self.old
        out = [n if (n := first.get(x)) is not None else new.get(x) for x in parts]
        fresh = []
        for k in [k for k, n in enumerate(out) if n is None]:
            if (n := old.get(parts[k])) is None:
                fresh.append(k)
            else:
                out[k] = new[parts[k]] = n
        words = [parts[k] for k in fresh]
        for k, x, ids in zip(fresh, words, self.model.encode(words, num_threads=1) if words else (), strict=True):
            out[k] = new[x] = len(ids) - (x[:1] == "\n") if x else 1
        if len(new) > self.most:
            self.old, self.new = new, {}
        return out


def _plain(text: pa.Array) -> np.ndarray:
    """Texts in which each space starts a pre-token: no two spaces in a row, none at an end or before a line feed."""
    odd = pc.match_substring(text, MARK)
    for pattern in ("  ", " \n"):
        odd = pc.or_(odd, pc.match_substring(text, pattern))
    odd = pc.or_(odd, pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))
    return ~odd.to_numpy(zero_copy_only=False)


def pre_tokens(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of texts, each pre-token's place among them, and how many each text has."""
    text, plain = text.fill_null(""), None
    plain = _plain(text)
    if not plain.all():
        # the odd ones are cut by a regular expression; their pre-tokens may hold spaces
        cut = [[x if x[0] == "\n" else x[1:] for x in _PRE_TOKEN.findall(MARK + t)] if t else [] for t in text.filter(pa.array(~plain)).to_pylist()]
        more, counts = pa.array([x for y in cut for x in y], pa.string()).dictionary_encode(), np.zeros(len(text), np.int64)
        counts[~plain] = [len(x) for x in cut]
    distinct, place, n = coded(pc.replace_substring(text, "\n", " \n"))
    n[pc.equal(text, "").to_numpy(zero_copy_only=False)] = 0
    if pc.any(pc.equal(text, "")).as_py() or not plain.all():
        whole = pc.list_value_length(pc.split_pattern(pc.replace_substring(text, "\n", " \n"), " ")).to_numpy()
        keep = plain & (n > 0)
        place, n = place[np.repeat(keep, whole)], np.where(keep, n, 0)
    if plain.all():
        return distinct, place, n
    at = np.repeat(np.arange(len(text)), n)
    also = np.repeat(np.arange(len(text)), counts)
    order = np.argsort(np.concatenate([at, also]), kind="stable")
    return distinct + more.dictionary.to_pylist(), np.concatenate([place, more.indices.to_numpy() + len(distinct)])[order], n + counts


def frequent_lengths(docs: DataFrame, path: str, table: int, sample: int, longest: int = 20_000) -> list[tuple[str, int]]:
    """The `table` most frequent pre-tokens, and their lengths, of `sample` texts of up to `longest` characters."""
    texts = [x.text for x in docs.select("text").filter(F.length("text") <= longest).head(sample)]
    parts, place, _ = pre_tokens(pa.array(texts, pa.string()))
    n = np.bincount(place, minlength=len(parts))
    names = [parts[k] for k in np.argsort(-n, kind="stable")[:table] if n[k] > 1 and len(parts[k]) <= 64]
    return list(zip(names, Lengths(path, {}, 2 * len(names) + 2)(names), strict=True))


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    table: int = 65_536,
    sample: int = 1_000,
    cache: int = 600_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the sentencepiece model at `path`.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, ties and null ids give a row each, as they came;
    other columns of `docs` play no part, whatever their names. Texts are taken whole, however long. An empty table gives
    no rows. `table`, `sample` and `cache` bound memory and only change the speed.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    top = frequent_lengths(docs, path, table, sample)
    # compact form: the words in one string, a byte for each length
    top = [(w, n) for w, n in top if " " not in w and n < 256]
    run, packed = uuid4().hex, spark.sparkContext.broadcast((" ".join(w for w, _ in top), bytes(n for _, n in top)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = packed.value
        frequent = dict(zip(names.split(" "), sizes, strict=True)) if sizes else {}
        lengths = _kept(path, run, lambda: Lengths(path, frequent, cache))
        for batch in pieces(batches, 4 << 20):
            parts, place, each = pre_tokens(batch.column("text"))
            n = totals(np.array(lengths(parts), np.int64)[place], each)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": n})

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A document's signature has 64 symbols of 12 bits. The threshold on signatures is the smallest number of differing
symbols that sets as similar as asked exceed with a chance below one in a million. The symbols are split into so many
chunks that two signatures within the threshold have a chunk in which they differ in one symbol at most (pigeonhole).
Every chunk is therefore filed once for each symbol left out, and two signatures within the threshold share a file entry
for certain.

A second test is exact: each set has a bitmap in which every shingle flips one bit, so that the bits in which two bitmaps
differ are at most the shingles that are in one set only. Pairs whose bitmaps differ in more bits than sets as similar as
asked can have such shingles are out, which spares the full comparison of nearly all pairs below the similarity.

Equal sets are one class from the start. Members of an entry are compared with its leader, the member that shares
entries with most others, as the text that copies were made from does; links are confirmed on full sets, and linked
classes get one label. After that only members of entries with several labels are left to look at. Their pairs are not
made within entries, as an entry of texts just under the similarity would yield all of them. Instead every set is put in
order from its rarest shingle to its most common one. Sets as similar as asked share one of their first few shingles,
and from the place of the first one that they share follows how many they can share at all; a shingle that only one set
has can't be shared. Texts that each have more words of their own than the similarity allows therefore meet nowhere, and
of texts that meet by a change that many others share too, folded bitmaps rule out most before a pair is written.
Pairs that meet, have different labels and pass both tests above are confirmed on full sets like the others, so that no
link between groups is lost, while a group of copies, which has one label by then, never yields its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import discard, id_and_text, mix, pieces, sized, stored, windows, within, without_ids, words

SYMBOLS, BITS, LANES = 64, 12, 5
#: Differing symbols allowed in a chunk, and the chance that sets as similar as asked exceed the threshold.
ERRORS, MISS = 1, 1e-6
#: Longs of a bitmap, and of a folded one that travels with every rare shingle.
MAP, FOLD = 32, 8
_LONGS = -(-SYMBOLS // LANES)
_FACTORS = np.random.default_rng(64).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def threshold(percent: int) -> int:
    """The smallest number of differing symbols that sets of this similarity exceed with a chance below MISS."""
    off, tail = 1 - percent / 100, 0.0
    for d in range(SYMBOLS, 0, -1):
        tail += math.comb(SYMBOLS, d) * off**d * (1 - off) ** (SYMBOLS - d)
        if tail >= MISS:
            return d
    return 0


def chunks(distance: int) -> list[np.ndarray]:
    """The symbols in so many chunks that one of them has ERRORS differences at most."""
    return np.array_split(np.arange(SYMBOLS), min(SYMBOLS // (ERRORS + 1), -(-(distance + 1) // (ERRORS + 1))))


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, and each text's first (one more at the end)."""
    w = words(text, lower=True)
    start, owner = within(w.first, size)
    key = windows(w.key, size, 0xD1342543DE82EF95)[start]
    first = np.searchsorted(owner, np.arange(len(text) + 1))
    short = {}
    for n in range(1, size):  # a text of fewer words is one shingle
        got = windows(w.key, n, 0xD1342543DE82EF95)
        short |= {k: got[w.first[k] : w.first[k] + 1] for k in np.flatnonzero(np.diff(w.first) == n)}
    sets = [short[k] if k in short else np.unique(key[first[k] : first[k + 1]]) for k in range(len(text))]
    return (np.concatenate(sets) if sets else key), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, two order-free hashes of the set, the signature and the bitmap packed into longs; zeros if empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            key, first = shingle_sets(batch.column("text"), size)
            n = np.diff(first)
            has, at = n > 0, first[:-1][n > 0]
            sums = np.zeros((2, len(n)), np.uint64)
            packed = np.zeros((len(n), _LONGS), np.int64)
            if len(at):
                with np.errstate(over="ignore"):
                    for k in (0, 1):
                        sums[k, has] = np.add.reduceat(mix(key, 7 + k), at)
                    for j, factor in enumerate(_FACTORS):
                        symbol = mix(np.minimum.reduceat(key * factor, at), j) & np.uint64((1 << BITS) - 1)
                        packed[has, j // LANES] |= symbol.astype(np.int64) << (BITS * (j % LANES))
            owner, flips = np.repeat(np.arange(len(n)), n), (mix(key, 9) & np.uint64(64 * MAP - 1)).astype(np.int64)
            bits = np.bincount(owner * (64 * MAP) + flips, minlength=len(n) * 64 * MAP).astype(np.uint8) & 1
            maps = np.packbits(bits, bitorder="little").view(np.int64)
            bitmap = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * MAP, maps)
            sig = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * _LONGS, packed.reshape(-1))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": n, "set_a": sums[0].view(np.int64), "set_b": sums[1].view(np.int64), "sig": sig, "bitmap": bitmap})

    return docs.mapInArrow(sign, "doc_id long, n long, set_a long, set_b long, sig array<long>, bitmap array<long>")


def _entries(reps: DataFrame, most: int) -> DataFrame:
    """key, id: the file entries of each signature, one for each symbol left out of its chunk."""
    split = chunks(most)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = part.column("sig").flatten().to_numpy().reshape(part.num_rows, _LONGS)
                symbol = np.stack([sig[:, j // LANES] >> (BITS * (j % LANES)) & ((1 << BITS) - 1) for j in range(SYMBOLS)]).astype(np.uint64)
                keys = []
                with np.errstate(over="ignore"):
                    for c, chunk in enumerate(split):
                        for left in chunk:
                            key = np.full(part.num_rows, c * SYMBOLS + left, np.uint64)
                            for j in chunk:
                                if j != left:
                                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbol[j])
                            keys.append(key)
                yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "id": np.tile(part.column("id").to_numpy(), len(keys))})

    return reps.select("id", "sig").mapInArrow(enter, "key long, id long")


def distance(a: Column, b: Column) -> Column:
    """In how many symbols two packed signatures differ."""
    low = sum(((1 << (BITS - 1)) - 1) << (BITS * k) for k in range(LANES))
    top = sum(1 << (BITS * k + BITS - 1) for k in range(LANES))
    total = F.lit(0)
    for k in range(_LONGS):
        x = a[k].bitwiseXOR(b[k])
        total = total + F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top)))
    return total


def may_link(x: str, y: str, most: int, percent: int) -> Column:
    """Whether two sets (n_, sig_ and bitmap_ columns) are within the signatures' threshold and their bitmaps allow it."""
    apart = F.lit(0)
    for k in range(MAP):
        apart = apart + F.bit_count(F.col(f"bitmap_{x}")[k].bitwiseXOR(F.col(f"bitmap_{y}")[k]))
    room = (100 - percent) * (F.col(f"n_{x}") + F.col(f"n_{y}"))
    return (distance(F.col(f"sig_{x}"), F.col(f"sig_{y}")) <= most) & ((100 + percent) * apart <= room)


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable over links (a, b); ids without a link have no row.

    Large-star and small-star rounds in turn; every round is stored, so that a lost executor costs no more than one, and
    the round before is deleted.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = F.expr("struct(count(*), bit_xor(xxhash64(u, v)))")
    now = edges.agg(mark).head()[0]
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(sized(near), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        far = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(sized(far), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        spent, edges = edges, stored(small.distinct(), "edges")
        before, now = now, edges.agg(mark).head()[0]
        discard(spent, large, near, far)
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, has: the shingles of the documents in `ids` (id and maybe more columns, which stay)."""

    more = [f for f in ids.schema.fields if f.name != "id"]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            key, first = shingle_sets(batch.column("text"), size)
            has = pa.ListArray.from_arrays(first.astype(np.int32), key.view(np.int64))
            yield pa.record_batch({"id": batch.column("doc_id"), "has": has} | {f.name: batch.column(f.name) for f in more})

    wanted = docs.join(sized(ids), docs["doc_id"] == ids["id"]).drop("id")
    return wanted.mapInArrow(collect, "id long, has array<long>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more))


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = stored(_full_sets(docs, ids, size), "sets")
    left, right = (sets.select(F.col("id").alias(x), F.col("has").alias(f"has_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("has_a", "has_b"))
    return both.filter((100 + percent) * shared >= percent * (F.size("has_a") + F.size("has_b"))).select("a", "b").distinct()


def _meeting(docs: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: pairs of the ids in `named` (id, label, bitmap) with different labels that may be similar enough by rare shingles.

    Sets are in order of (how many of these sets have a shingle, the shingle). Similar sets of x and y shingles, x <= y,
    share at least percent * (x + y) / (100 + percent). The first that they share therefore has a place among the first
    x - 2 * percent * x / (100 + percent) + 1 of the smaller set, its head, and among the first y - percent * y / 100 + 1
    of the larger one; what stands from there on in either set bounds what they share at all. Heads meet the longer
    beginnings only, so that a shingle that is in no head meets nothing. In a group around a shingle, heads of its most
    common label meet the other labels only. Folded bitmaps are compared where pairs meet, and no pair that they rule
    out is written.
    """
    parts = [f"m{k}" for k in range(FOLD)]
    folded = [reduce(Column.bitwiseXOR, [F.col("bitmap")[j] for j in range(k, MAP, FOLD)]).alias(m) for k, m in enumerate(parts)]
    sets = stored(_full_sets(docs, stored(named.select("id", "label", *folded), "open-ids"), size), "open-sets")
    each = sets.select("id", F.explode("has").alias("g"))
    often = each.groupBy("g").agg(F.count("*").alias("times")).filter("times > 1")
    order = each.join(often, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "g"))).alias("o"))
    rows = sets.select("id", "label", *parts, F.size("has").alias("n")).join(order, "id")
    before = F.size("o") + 1  # shingles of no other set come first
    take = before - F.ceil(percent * F.col("n") / 100).cast("int")
    head = before - F.ceil(2 * percent * F.col("n") / (100 + percent)).cast("int")
    kept = ["id", "label", "n", *parts]
    rows = rows.filter(take > 0).select(*kept, head.alias("head"), F.size("o").alias("all"), F.posexplode(F.slice("o", F.lit(1), take)).alias("k", "x"))
    rows = stored(rows.select(F.col("x.g").alias("g"), *kept, (F.col("all") - F.col("k")).alias("rest"), (F.col("k") < F.col("head")).alias("head")), "prefixes")
    most = rows.groupBy("g", "label").agg(F.count("*").alias("c"), F.max("head").alias("head"))
    most = most.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("c"), F.max("head").alias("any"))
    groups = stored(most.filter("c > 1 and any").select("g", "top"), "labels-of-shingles")
    rows = rows.join(sized(groups), "g").withColumn("other", F.col("label") != F.col("top"))
    x = rows.filter("head").select("g", "other", *(F.col(c).alias(f"{c}_x") for c in (*kept, "rest")))
    # a head of the top label (other is false) meets the other labels, any other head meets all
    meets = F.when(F.col("other"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    y = rows.select("g", F.explode(meets).alias("other"), *(F.col(c).alias(f"{c}_y") for c in (*kept, "rest")))
    total = F.col("n_x") + F.col("n_y")
    room = (100 + percent) * F.least("rest_x", "rest_y") >= percent * total
    apart = sum((F.bit_count(F.col(f"{m}_x").bitwiseXOR(F.col(f"{m}_y"))) for m in parts), F.lit(0))
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    pairs = stored(x, "heads").join(stored(y, "beginnings"), ["g", "other"])
    pairs = pairs.filter((F.col("label_x") != F.col("label_y")) & once & room & ((100 + percent) * apart <= (100 - percent) * total))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (with doc_id and text) of one document of each group; columns as they are."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct()
    return without_ids(docs, stored(gone, "gone"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z folded; a document's set has its distinct shingles of `size` words, or its
    whole sequence if that is shorter. Documents are linked if 100 * intersection >= `percent` * union; component_id is
    the smallest doc_id reachable, kept says whether that is its own. Null, empty and wordless texts have empty sets and
    are linked with nothing. Rows with a null doc_id are in no group: their component_id is null and they are kept.
    Rows that share a doc_id are one document, with the links of all its texts, and have a row each. Other columns play no part; an empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    signed = stored(_signatures(docs, size), "signatures")
    of, most = ["set_a", "set_b", "n"], threshold(percent)
    classes = signed.filter("n > 0 and doc_id is not null").groupBy(*of).agg(F.min(F.struct("doc_id", "sig", "bitmap")).alias("x"))
    reps = stored(classes.select(*of, F.col("x.doc_id").alias("id"), "x.sig", "x.bitmap"), "classes")

    entries = _entries(reps, most)
    shared = entries.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("key")
    members = stored(entries.join(shared, "key").select("key", "id"), "members")
    met = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("id").agg(F.sum("n").alias("met"))
    leaders = members.join(sized(stored(met, "met")), "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("id"))).alias("x"))
    led = members.join(leaders.select("key", (-F.col("x.id")).alias("lead")), "key").filter("id <> lead")
    led = led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    left, right = (reps.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "bitmap"))) for x in "ab")
    near = led.join(left, "a").join(right, "b")
    pairs = stored(near.filter(may_link("a", "b", most, percent)).select("a", "b"), "pairs")
    nodes = stored(signed.select("doc_id", *of).join(reps.select(*of, "id"), of, "left").select("doc_id", "n", "id"), "nodes")
    same = nodes.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z")
    same = nodes.join(same, "doc_id").filter("id > a").select("a", F.col("id").alias("b"))
    links = stored(_confirmed(docs, pairs, size, percent).union(same), "links")
    labels = sized(components(links))

    named = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    open_ = stored(named.join(mixed, "key").select("id", "label").distinct(), "open")
    more = stored(_meeting(docs, reps.select("id", "bitmap").join(sized(open_), "id"), size, percent), "meeting").join(left, "a").join(right, "b").filter(may_link("a", "b", most, percent))
    more = stored(more.select("a", "b").join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.union(stored(_confirmed(docs, more, size, percent), "links"))
        labels = sized(components(links))

    discard(signed, reps, members, open_)
    out = nodes.join(labels, "id", "left")
    own = F.when(F.col("n") > 0, F.coalesce("label", "id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


#: The same for DuckDB, with three-word shingles and 85%, by counting shared shingles of all pairs.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(words[p:p + 2], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS p FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents WHERE doc_id IN (SELECT a FROM both_ways)
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
labels AS (SELECT doc_id, min(other) AS label FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(l.label, d.doc_id) AS component_id, coalesce(l.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN labels l USING (doc_id)
"""

"""Benchmark decontamination by template windows, in DataFrame operations alone.

A text becomes tokens: words and numbers, whatever stands between them. Two kinds of templates are made of them. In both,
numbers and units after numbers turn into typed placeholders and case goes; in the first, names (words with a capital
inside a sentence, a row of them as one) do too, so that copies with other names are found, and in the second they do
not, so that copies in other case are. Windows of `words` tokens start at every token. They are joined with the windows
of the benchmark items by hash; an item with fewer tokens is one window of its own length, which long texts are searched
for as well. A window of placeholders alone keeps its values, as its template tells nothing.

Where windows match, the placeholders' values are compared: along one alignment of document and item, equal values of
the item that stand near each other have to be equal in the document. Windows that carry one of two such slots with
different values do not count, while others of the alignment do, so that a question asked with other numbers or names is
found, while one template filled at random is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.shared import discard, sized, stored, without_ids

#: Ends of sentences, numbers, words and percent signs, in this order.
TOKEN = r"[.!?]+|\d+(?:[.,:/]\d+)*|[\p{L}\p{M}\p{N}]+|%"
#: Units of measure that count as such after a number. Fixed values.
UNITS = (
    "%", "cent", "cents", "centimeter", "centimeters", "cm", "day", "days", "dollar", "dollars", "euro", "euros", "feet", "foot", "g", "gram", "grams",
    "hour", "hours", "inch", "inches", "kg", "kilogram", "kilograms", "kilometer", "kilometers", "km", "lb", "lbs", "liter", "liters", "m", "meter",
    "meters", "mile", "miles", "minute", "minutes", "ml", "mm", "month", "months", "ounce", "ounces", "oz", "percent", "pound", "pounds", "second",
    "seconds", "week", "weeks", "yard", "yards", "year", "years",
)
#: What stands for a number, a unit and a name in templates, and the mark between the words of a name.
NUM, UNIT, NAME, INNER = "\x01", "\x02", "\x03", "\x04"
#: Items of fewer tokens only match texts that have no others.
LEAST = 3


def _number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _end(t: Column) -> Column:
    return (t < "A") & ~_number(t) & (t != "%")


def _before(values: Column, first: Column) -> Column:
    """Each element's predecessor; `first` for the first."""
    return F.slice(F.concat(F.array(first), values), 1, F.size(values))


def _canonical(t: Column, p: Column, put, word, named) -> Column:
    """`put` of a placeholder, `word` of a lower-case word, or null for an end of sentence; `p` is the token before.

    `named` decides on words with a capital.
    """
    unit = _number(p) & F.lower(t).isin(*UNITS)
    plain = F.when(unit, put(UNIT)).when(t == F.lower(t), word(t)).otherwise(named(t, p))
    return F.when(t >= "A", plain).when(_number(t), put(NUM)).when(t == "%", F.when(_number(p), put(UNIT)).otherwise(word(t)))


def _with_hashes(rows: DataFrame, text: Column) -> DataFrame:
    """Add t, p (tokens and those before) and a, b: the hashes of the templates' tokens with and without names.

    Each token is looked at once: m has its hash without names and, in the lowest bit, whether it is part of a name.
    """
    rows = rows.withColumn("t", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("p", _before(F.col("t"), F.lit(".")))
    code = {NUM: 2, UNIT: 4}
    put, part = (lambda mark: F.lit(code[mark]).cast("long")), F.lit(1).cast("long")
    word = lambda t: F.shiftleft(F.xxhash64(t), 1)
    named = lambda t, p: F.when(_end(p), word(F.lower(t))).otherwise(word(F.lower(t)).bitwiseOR(part))
    rows = rows.withColumn("m", F.filter(F.zip_with("t", "p", lambda t, p: _canonical(t, p, put, word, named)), lambda x: x.isNotNull()))
    rows = rows.withColumn("q", _before(F.col("m"), F.lit(0).cast("long")))
    name = lambda x: x.bitwiseAND(part) == 1
    first = F.zip_with("m", "q", lambda x, y: F.when(~name(x), F.shiftright(x, 1)).when(~name(y), F.lit(3).cast("long")))
    return rows.withColumns({"a": F.filter(first, lambda x: x.isNotNull()), "b": F.transform("m", lambda x: F.shiftright(x, 1))}).drop("m", "q")


def _with_windows(rows: DataFrame, tokens: str, size: int, name: str) -> DataFrame:
    """Add `name`: hashes of all windows of `size` tokens, by doubling; of short ones, only that of a text without others."""
    n, length, power, out, have = F.size(tokens), 1, tokens, None, 0
    joined = lambda left, right, skip, by: F.zip_with(left, F.slice(right, skip + 1, F.greatest(F.size(right) - skip, F.lit(0))), lambda x, y: F.shiftleft(x, by).bitwiseXOR(y))
    while True:
        if size & length:
            rows = rows.withColumn(f"{name}_o{length}", F.col(power) if out is None else joined(out, power, have, length))
            out, have = f"{name}_o{length}", have + length
        if 2 * length > size:
            break
        rows = rows.withColumn(f"{name}_p{length}", joined(power, power, length, length))
        power, length = f"{name}_p{length}", 2 * length
    enough = n >= size if size >= LEAST else n == size
    return rows.withColumn(name, F.when(enough, F.slice(out, F.lit(1), F.greatest(n - size + 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))


def _spelt(names: bool) -> tuple[Column, Column]:
    """Tokens t as they stand and as templates have them, two arrays of as many elements as a or b."""
    named = lambda t, p: F.when(_end(p), F.lower(t)).otherwise(F.lit(NAME)) if names else F.lower(t)
    marks = F.zip_with("t", "p", lambda t, p: _canonical(t, p, F.lit, lambda x: x, named))
    three = F.arrays_zip(F.col("t").alias("t"), marks.alias("c"), _before(marks, F.lit("")).alias("q"))
    inner = lambda x: (x["c"] == NAME) & F.coalesce(x["q"] == NAME, F.lit(False))
    raw = F.transform(three, lambda x: F.when(x["c"].isNull(), "").when(inner(x), F.concat(F.lit(INNER), x["t"])).otherwise(F.concat(F.lit(" "), x["t"])))
    canon = F.transform(three, lambda x: F.when(x["c"].isNull() | inner(x), "").otherwise(F.concat(F.lit(" "), x["c"])))
    return tuple(F.split(F.ltrim(F.array_join(x, "")), " ") for x in (raw, canon))


def _key(canon: Column, raw: Column) -> Column:
    """What windows are joined by: the template, or the values where it has placeholders alone."""
    bare = F.forall(canon, lambda x: x.isin(NUM, UNIT, NAME))
    return F.when(bare, F.lower(F.array_join(raw, " "))).otherwise(F.array_join(canon, " "))


def item_windows(benchmark: DataFrame, words: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, names, size, at, h, key, raw, kinds, first, n, n_words, slots: windows of items; first and n count words, at
    tokens. slots: for each placeholder of the item, which is the first with its value."""
    rows = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[text_col].cast("string").alias("text")).distinct()
    rows = _with_hashes(rows.filter("item is not null"), F.col("text")).filter(F.size("b") > 0)
    kind = lambda names: F.struct(F.lit(names).alias("names"), *(c.alias(n) for c, n in zip(_spelt(names), ("r", "c"), strict=True)), F.col("a" if names else "b").alias("h"))
    rows = rows.select("item", F.explode(F.array(kind(True), kind(False))).alias("x")).select("item", "x.*")
    length = lambda tokens: F.aggregate(tokens, F.lit(0), lambda n, x: n + F.size(F.split(x, INNER)))
    rows = rows.withColumns({"size": F.least(F.size("h"), F.lit(words)), "n_words": length(F.col("r"))})
    value = F.zip_with("c", "r", lambda c, r: F.when(c.isin(NUM, UNIT, NAME), F.concat(c, F.lower(r))).otherwise(""))
    rows = rows.withColumn("slots", F.transform(value, lambda x: F.array_position(value, x)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("size"))).alias("at"))
    part = lambda c: F.slice(c, F.col("at") + 1, F.col("size"))
    rows = rows.withColumns({"raw": part("r"), "kinds": part("c"), "first": length(F.slice("r", F.lit(1), F.col("at")))})
    # the same hash as of a document's windows
    power = F.aggregate(part("h"), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseXOR(x))
    return rows.select("item", "names", "size", "at", power.alias("hash"), _key(F.col("kinds"), F.col("raw")).alias("key"), "raw", "kinds", "first", length(F.col("raw")).alias("n"), "n_words", "slots")


def item_classes(windows: DataFrame) -> DataFrame:
    """class, item, n_items: items that no document can tell apart, with the smallest as their class.

    These are items whose windows have the same keys at the same places and whose equal values stand at the same places,
    as what is found of one of them is found of all. n_items is the number of a class.
    """
    row = F.struct("names", "size", "at", "key", "first", "n", "n_words", "slots")
    marks = windows.groupBy("item").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(row))), 256).alias("mark"))
    every = Window.partitionBy("mark")
    return marks.select(F.min("item").over(every).alias("class"), "item", F.count("*").over(every).alias("n_items"))


def _needed(items: DataFrame, windows: DataFrame, share: float, enough: int) -> DataFrame:
    """item, names, size, key: windows of which a document has one at least if it leaks the item.

    A leak covers so many words of the item. Its windows are taken by falling frequency in the documents as long as their
    words together are too few for that; a document with no other window covers too little. So what many documents
    share with many items makes no pairs.
    """
    often = windows.groupBy("names", "size", "key").agg(F.count("*").alias("often"))
    rows = items.select("item", "n_words", "names", "size", "key", "at", "first", "n").join(often, ["names", "size", "key"])
    kind = "array<struct<names:boolean,size:int,key:string>>"
    each = F.sort_array(F.collect_list(F.struct("often", "names", "size", "at", "first", "n", "key")), asc=False)
    rows = rows.groupBy("item", "n_words").agg(each.alias("each"))
    least = F.least(F.lit(float(share)) * F.col("n_words"), F.lit(float(enough)))

    def take(acc: Column, w: Column) -> Column:
        words = F.array_union(acc["words"], F.sequence(w["first"], w["first"] + w["n"] - 1))
        few = F.size(words) < least
        other = F.struct(w["names"].alias("names"), w["size"].alias("size"), w["key"].alias("key"))
        return F.struct(F.when(few, words).otherwise(acc["words"]).alias("words"), F.when(few, acc["rest"]).otherwise(F.array_append(acc["rest"], other)).alias("rest"))

    start = F.struct(F.array().cast("array<int>").alias("words"), F.array().cast(kind).alias("rest"))
    return rows.select("item", F.explode(F.aggregate("each", start, take)["rest"]).alias("w")).select("item", "w.*").distinct()


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, tag, found: places (names, size, at) of each text's windows that have the hash of an item's window.

    A first pass looks at hashes alone, so that what is joined is small and no text goes through a shuffle.
    """
    sizes = [(r.names, r.size) for r in items.select("names", F.col("size")).distinct().orderBy("names", "size").collect()]  # two kinds, at most `words` lengths
    keys = stored(items.select("hash", "names", "size").distinct(), "item-hashes")
    rows = _with_hashes(docs, F.col("text"))
    for k, (names, size) in enumerate(sizes):
        rows = _with_windows(rows, "a" if names else "b", size, f"w{k}")
    ends = [sum((F.size(f"w{j}") for j in range(k)), F.lit(0)) for k in range(len(sizes) + 1)]
    every = F.concat(*(F.col(f"w{k}") for k in range(len(sizes)))) if sizes else F.array().cast("array<bigint>")
    rows = rows.select("doc_id", "tag", *(c.alias(f"s{k}") for k, c in enumerate(ends)), F.posexplode(every).alias("place", "hash"))
    found = rows.join(sized(keys, 4_000_000), "hash")
    # windows of one kind and length may have the hash of another kind's
    own = [(F.col("names") == names) & (F.col("size") == size) & (F.col("place") >= F.col(f"s{k}")) & (F.col("place") < F.col(f"s{k + 1}")) for k, (names, size) in enumerate(sizes)]
    at = F.coalesce(*(F.when(x, F.col("place") - F.col(f"s{k}")) for k, x in enumerate(own)), F.lit(None).cast("int"))
    found = found.withColumn("at", at).filter("at is not null")
    found = stored(found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("names", "size", "at")).alias("found")), "hits")
    discard(keys)
    return found


def _class_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 8, share: float = 0.5, enough: int = 24, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, class, covered of documents and the classes of items that they leak, and `item_classes`."""
    text = docs[text_col].cast("string")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag")).filter("doc_id is not null")
    every = stored(item_windows(benchmark, words, item_col, item_text), "items")
    classes = stored(item_classes(every), "item-classes")
    items = stored(every.join(sized(classes.filter("class = item").select("item")), "item").drop("slots"), "class-items")
    places = _hits(docs, items)
    own = docs.join(sized(places, values=F.size("found")).select("doc_id", "tag", F.col("found").alias("found")), ["doc_id", "tag"])
    own = own.withColumn("t", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).withColumn("p", _before(F.col("t"), F.lit(".")))
    spelt = {names: _spelt(names) for names in (True, False)}
    own = own.withColumns({f"{c}{int(names)}": x for names, both in spelt.items() for c, x in zip("rc", both, strict=True)})

    def window(f: Column) -> Column:
        part = lambda c: F.slice(F.when(f["names"], F.col(f"{c}1")).otherwise(F.col(f"{c}0")), f["at"] + 1, f["size"])
        return F.struct(f["names"].alias("names"), f["size"].alias("size"), f["at"].alias("doc_at"), part("r").alias("doc_raw"), _key(part("c"), part("r")).alias("key"))

    # repeated rows are left out once texts have gone
    own = stored(own.select("doc_id", "tag", F.explode(F.transform("found", window)).alias("w")).select("doc_id", "tag", "w.*").distinct(), "windows")
    rows_of = ["doc_id", "tag"]
    needed = stored(_needed(items, own.select(*rows_of, "names", "size", "key").distinct(), share, enough), "needed")
    pairs = stored(own.join(sized(needed), ["names", "size", "key"]).select(*rows_of, "item").distinct(), "candidates")
    hits = pairs.join(sized(items), "item").join(own, [*rows_of, "names", "size", "key"]).withColumn("line", F.col("doc_at") - F.col("at"))
    of = [*rows_of, "item", "names", "line"]
    slot = lambda kind, i: F.struct((F.col("at") + i).alias("pos"), kind.alias("kind"), F.lower(F.get("raw", i)).alias("x"), F.lower(F.get("doc_raw", i)).alias("y"))
    found = F.filter(F.transform("kinds", slot), lambda x: x["kind"].isin(NUM, UNIT, NAME))
    hits = stored(hits.select(*of, "at", "size", "first", "n", "n_words", found.alias("slots")), "matches")
    slots = hits.select(*of, F.explode("slots").alias("p")).select(*of, "p.*").distinct()
    order = Window.partitionBy(*of, "kind", "x").orderBy("pos")
    parts = lambda move: F.coalesce((move("y").over(order) != F.col("y")) & (F.abs(move("pos").over(order) - F.col("pos")) < words), F.lit(False))
    wrong = slots.withColumn("wrong", parts(F.lag) | parts(F.lead)).filter("wrong").groupBy(*of).agg(F.collect_set("pos").alias("wrong"))
    sound = hits.join(wrong, of, "left").filter(~F.coalesce(F.exists("wrong", lambda p: (p >= F.col("at")) & (p < F.col("at") + F.col("size"))), F.lit(False)))
    word = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    text_of = [*rows_of, "item", "n_words"]
    covered = sound.select(*text_of, word.alias("word")).distinct().groupBy(*text_of).agg(F.count("*").alias("covered"))
    covered = covered.filter((F.col("covered") >= share * F.col("n_words")) | (F.col("covered") >= enough))
    found = stored(covered.groupBy("doc_id", F.col("item").alias("class")).agg(F.max("covered").alias("covered")), "class-leaks")
    discard(every, items, places, own, needed, pairs, hits)
    return found, classes


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item, covered: documents and the items that they leak.

    covered: words of the item (a number, a unit or a word of a name is one) under sound windows of either kind. A leak
    covers `share` (0.5) of the item or `enough` (24) words. Equal values of an item are held to be one only where they
    stand less than `words` (8) tokens apart: a window is not sound if it carries one of two such slots of which the
    document's values differ. An item of LEAST tokens or more is found in any text, a shorter one only where it is the
    whole text. Other parameters: the columns' names id_col, text_col, item_col, item_text.
    """
    found, classes = _class_leaks(docs, benchmark, **how)
    return found.join(sized(classes), "class").select("doc_id", "item", "covered")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, n_items, first_item, covered of every row of `docs`; see `leaks` for the parameters.

    Null and empty texts have no window and are clean, as are rows with a null doc_id; rows that share a doc_id share
    their verdict. Items without words match nothing, repeated items count once. Other columns play no part.
    """
    found, classes = _class_leaks(docs, benchmark, **how)
    found = found.join(sized(classes.filter("class = item")), "class")
    found = found.groupBy("doc_id").agg(F.sum("n_items").alias("n_items"), F.min("class").alias("first_item"), F.max("covered").alias("covered"))
    own = docs.select(docs[how.get("id_col", "doc_id")].cast("long").alias("doc_id"))
    out = own.join(found, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), "first_item", F.coalesce("covered", zero).alias("covered"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` (with doc_id and text) that leak no item; columns as they are."""
    gone = stored(_class_leaks(docs, benchmark, **how)[0].select("doc_id").distinct(), "leaks")
    return without_ids(docs, gone, how.get("id_col", "doc_id"))

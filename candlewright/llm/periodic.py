"""Runs of periodic words (stretches that repeat themselves), found in a grammar of each text.

A run is a stretch of words with a period of at most half its length that neither neighbour extends. Re-Pair turns the
word ids into a grammar: of the pairs of symbols that stand twice or more, those with the greatest counts among their
neighbours become new symbols, round after round, and what is left is joined pairwise into one symbol. Every run crosses
the boundary between the two halves of the smallest symbol that contains it, so that the runs across each symbol's
boundary are computed once, where the symbol first stands, carried to all places where the derivation has the symbol, and
merged where intervals of one period overlap by a period or more.

Two things keep this cheap. Words of a run lie under windows of half the least length that stand twice in the text, as
its second half repeats its first; other words are left out before the grammar is made. And how far two places agree is
told by names of blocks of 1, 2, 4, ... words, which are equal for equal blocks and for no others.

Texts are independent of each other: there is no exchange, and a worker looks at about a megabyte of text at a time.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.shared import id_and_text, mix, pieces, windows

#: Boundaries are looked at in groups of so many words.
GROUP = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Grammar(NamedTuple):
    """Symbols from `base` on are rules: `left` and `right` symbol of each. `size` and `place` (where it first stands)
    are of all symbols, `root` has a symbol for each segment, and `rounds` the first rule of each round."""

    base: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    place: np.ndarray
    root: np.ndarray
    rounds: list[int]


def _flat(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several stretches in a row, and the stretch of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def _busiest(symbol: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: repeated pairs that outrank their neighbours by count; every second one of a row of equals."""
    key = symbol[:-1] * (int(symbol.max()) + 1) + symbol[1:]
    unique, inverse, counts = np.unique(key[same], return_inverse=True, return_counts=True)
    rank = np.empty(len(unique), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(unique))
    own = np.full(len(key), -1)
    own[same] = np.where(counts > 1, rank, -1)[inverse]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    level = own[edge[:-1]]
    before, after = np.concatenate([[-1], level[:-1]]), np.concatenate([level[1:], [-1]])
    top = (level >= 0) & (level > before) & (level > after)
    at, owner = _flat(edge[:-1][top], np.diff(edge)[top])
    return at[(at - edge[:-1][top][owner]) % 2 == 0]


def re_pair(word: np.ndarray, first: np.ndarray) -> Grammar:
    """A grammar of the segments of `word` that begin at `first` (one more at the end)."""
    base = int(word.max(initial=-1)) + 1
    symbol, place, segment = word.copy(), np.arange(len(word)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    left, right, size, start, rounds = [], [], [np.ones(base, np.int64)], [np.zeros(base, np.int64)], []
    total, pairing = base, True
    length = np.ones(len(word), np.int64)
    while len(symbol) > len(first) - 1:
        same = segment[1:] == segment[:-1]
        if pairing:
            pick = _busiest(symbol, same)
            pairing = len(pick) * 100 > len(symbol)
        if not pairing:
            begin = np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=len(first) - 1))])
            pick = np.flatnonzero(same & ((np.arange(len(symbol) - 1) - begin[segment[:-1]]) % 2 == 0))
        pair = symbol[pick] * total + symbol[pick + 1]
        _, one, name = np.unique(pair, return_index=True, return_inverse=True)
        rounds.append(total)
        left.append(symbol[pick[one]])
        right.append(symbol[pick[one] + 1])
        start.append(place[pick[one]])
        length[pick] += length[pick + 1]
        size.append(length[pick[one]])
        symbol[pick] = total + name
        total += len(one)
        keep = np.ones(len(symbol), bool)
        keep[pick + 1] = False
        symbol, place, segment, length = symbol[keep], place[keep], segment[keep], length[keep]
    none = [np.zeros(0, np.int64)]
    return Grammar(base, np.concatenate(left or none), np.concatenate(right or none), np.concatenate(size), np.concatenate(start), symbol, rounds)


def block_names(word: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ... a name of each block of 2^k words, as long as `longest` is not shorter."""
    names, span = [word], 1
    while span * 2 <= longest:
        last = names[-1]
        pair = last[:-span] * (int(last.max()) + 1) + last[span:]
        names.append(np.unique(pair, return_inverse=True)[1])
        span *= 2
    return names


def agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from places `i` and `j` on are equal in order, `most` at most; `back`: before them."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        span = 1 << k
        at = np.flatnonzero(got + span <= most)
        move = -got[at] - span if back else got[at]
        got[at[names[k][i[at] + move] == names[k][j[at] + move]]] += span
    return got


def _crossing(word: np.ndarray, names: list[np.ndarray], begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Rows (stretch, start, end, period): runs within stretches begin..end of `word` that cross their `middle`.

    With a period or more on the right of the middle, the last word of the left half stands again a period later; else
    the first word of the right half stands a period earlier. Such pairs of places are taken with an equal neighbour.
    """
    at, owner = _flat(begin, end - begin)
    b = middle[owner]
    later = at >= b
    i, j = np.where(later, b - 1, at), np.where(later, at, b)
    hit = np.flatnonzero(word[i] == word[j])
    i, j, owner = i[hit], j[hit], owner[hit]
    low, high = begin[owner], end[owner]
    near = (j + 1 < high) & (word[np.minimum(i + 1, len(word) - 1)] == word[np.minimum(j + 1, len(word) - 1)])
    near |= (i > low) & (word[i - 1] == word[j - 1])
    i, j, owner, low, high = (x[near] for x in (i, j, owner, low, high))
    s = i - agree(names, i, j, i - low, True)
    e = j + 1 + agree(names, i + 1, j + 1, high - j - 1, False)
    period = j - i
    long = e - s >= np.maximum(least, 2 * period)
    rows = np.stack([owner, s, e, period], axis=1)[long]
    # of several periods of one stretch the smallest counts
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])] if len(rows) else rows


def runs_of_segments(word: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` words in the segments of `word`."""
    grammar = re_pair(word, first)
    rules = np.flatnonzero(grammar.size[grammar.base :] >= least) + grammar.base
    if not len(rules):
        return np.zeros((0, 3), np.int64)
    names = block_names(word, int(grammar.size[rules].max()))
    begin = grammar.place[rules]
    middle, end = begin + grammar.size[grammar.left[rules - grammar.base]], begin + grammar.size[rules]
    group, found, at = np.cumsum(end - begin), [], 0
    while at < len(rules):
        upto = max(at + 1, int(np.searchsorted(group, (group[at - 1] if at else 0) + GROUP, side="right")))
        rows = _crossing(word, names, begin[at:upto], middle[at:upto], end[at:upto], least)
        rows[:, 0] += at
        found.append(rows)
        at = upto
    found = np.concatenate(found)
    found[:, 0] = rules[found[:, 0]]
    return _merged(_everywhere(grammar, found, first[:-1]))


def _everywhere(grammar: Grammar, found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) for each place of the derivation at which a rule with runs stands."""
    count = np.bincount(found[:, 0], minlength=len(grammar.size))
    begin = np.cumsum(count) - count
    live, base = count > 0, grammar.base
    bounds = [*grammar.rounds, len(grammar.size)]
    for lo, hi in itertools.pairwise(bounds):
        live[lo:hi] |= live[grammar.left[lo - base : hi - base]] | live[grammar.right[lo - base : hi - base]]
    symbol, place, out = grammar.root, first, []
    for lo in reversed(grammar.rounds):
        keep = live[symbol]
        symbol, place = symbol[keep], place[keep]
        new = symbol >= lo
        rule, at = symbol[new], place[new]
        which, owner = _flat(begin[rule], count[rule])
        shift = (at - grammar.place[rule])[owner]
        out.append(np.stack([found[which, 1] + shift, found[which, 2] + shift, found[which, 3]], axis=1))
        one, two = grammar.left[rule - base], grammar.right[rule - base]
        symbol, place = np.concatenate([symbol[~new], one, two]), np.concatenate([place[~new], at, at + grammar.size[one]])
    return np.concatenate(out)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Intervals of one period become one where they overlap by a period or more."""
    if not len(rows):
        return rows
    s, e, period = rows[np.lexsort((rows[:, 0], rows[:, 2]))].T
    step = int(e.max()) + 1
    kind = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * step  # a period's ends are beyond those before
    reach = np.maximum.accumulate(e + kind)
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (s[1:] + kind[1:] > reach[:-1] - period[1:])])
    begin = np.flatnonzero(new)
    return np.stack([s[begin], np.maximum.reduceat(e, begin), period[begin]], axis=1)


def segments(word: np.ndarray, first: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of `least` words or more under windows of `gram` words that stand twice within them."""
    begin, end, key = first[:-1], first[1:], mix(word.astype(np.uint64))
    covered = len(word)
    while True:
        at, owner = _flat(begin, np.maximum(end - begin - gram + 1, 0))
        if not len(at):
            return at, at
        own = windows(key, gram, 0xA24BAED4963EE407)[at] ^ mix(owner.astype(np.uint64), 7)
        _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        at, owner = at[again], owner[again]
        # windows of one stretch that touch or overlap make one
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + gram)
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(at)) - 1
        begin, end = (at[lead], at[last] + gram) if len(at) else (at, at)
        long = end - begin >= least
        begin, end = begin[long], end[long]
        if (left := int((end - begin).sum())) == covered or not left:
            return begin, end
        covered = left


def find_runs(word: np.ndarray, first: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts of word ids, by text, start and period."""
    begin, end = segments(word, first, -(-least // 2), least)
    if not len(begin):
        return np.zeros((0, 4), np.int64)
    at, _ = _flat(begin, end - begin)
    own = np.unique(word[at], return_inverse=True)[1]
    rows = runs_of_segments(own, np.concatenate([[0], np.cumsum(end - begin)]), least)
    start = at[rows[:, 0]]
    text = np.searchsorted(first, start, side="right") - 1
    rows = np.stack([text, start - first[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def wrapped(n: int, code: int | None) -> np.ndarray:
    """Places of the words that stand at 0 .. n - 1 once a tail is made periodic: where `code`, a document's crc32, is
    divisible by 10, words from g % n on repeat with period 1 + (n - g % n) // (3 + g % 8); g is code // 10."""
    at = np.arange(n)
    if n and code is not None and code % 10 == 0:
        g = code // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def collapse_runs(docs: DataFrame, least: int = 12, wrap: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period), kept_text of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; a run has `least` words or more, at least two periods of its smallest
    period, and no neighbour that extends it. kept_text has the words that no run contains after its first period,
    joined by one space. Null and empty texts have no words, no runs and an empty kept_text. Rows stand for themselves:
    repeated rows and null ids give as many rows, and an empty table none. Other columns play no part. With `wrap`, each
    tenth document by crc32 of its id first gets a periodic tail, see `wrapped`; a null id gets none.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("code", F.crc32(F.col("doc_id").cast("string")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            names: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
            order = [wrapped(len(t), code if wrap else None) for t, code in zip(texts, batch.column("code").to_pylist(), strict=True)]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            word = np.concatenate([np.fromiter(map(names.__getitem__, t), np.int64, len(t))[at] for t, at in zip(texts, order, strict=True)])
            runs = find_runs(word, first, least)
            edge = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            drop = np.zeros(len(word) + 1, np.int64)
            start = first[runs[:, 0]] + runs[:, 1]
            np.add.at(drop, start + runs[:, 3], 1)
            np.add.at(drop, start + runs[:, 2], -1)
            keep = np.cumsum(drop[:-1]) == 0
            kept = [b" ".join(map(t.__getitem__, at[keep[a:b]].tolist())) for t, at, a, b in zip(texts, order, first[:-1], first[1:], strict=True)]
            fields = [pa.array(runs[:, k]) for k in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(edge.astype(np.int32), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": np.diff(first), "runs": lists, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, kept_text string")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of `collapse_runs`' rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = rows.withColumns({"best": best, "lines": F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor((1000 * length).cast("decimal(38,0)") / period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )

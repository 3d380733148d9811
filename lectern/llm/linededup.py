"""Removal of lines that are similar to an earlier line, by an exact set-similarity join.

A line is the set of its five-word shingles (one of all words if it has fewer). Lines meet in
blocks found by prefix filtering (``setjoin``). In a block every line looks up the lines that
share a prefix shingle, drops those that come later, that are too short or long, or whose first
common shingle leaves too little on either side, and verifies the others' Jaccard similarity.

The order of lines is the order of (id, hash of the text, number of the line); a line goes if
any earlier line of the table is similar to it, whether or not that one is itself removed.

Defined results: null ids come first; null and empty texts and lines without words stay; rows
that repeat id and text are one document and are treated alike; repeated lines within a text go
too; a very long text is handled whole by one task; an empty table gives no rows; columns named
n_lines or n_removed in the table are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.arrays import let
from lectern.llm import setjoin, words
from lectern.llm.setjoin import SHARE, WIDTH
from lectern.llm.shared import free_names, staged

#: An id before all others, for rows without one.
NO_ID = -(2**63)
VERIFY = 64


def matched_lines(sets: list[np.ndarray], rank: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Places of the sets that are similar to one of smaller rank; sets are distinct and in global order."""
    n = np.array([len(s) for s in sets])
    prefix = n - setjoin.required(n, share) + 1
    owners = np.repeat(np.arange(len(sets)), prefix)
    at = np.concatenate([np.arange(p) for p in prefix])
    grams = np.concatenate([s[:p] for s, p in zip(sets, prefix.tolist(), strict=True)])
    order = np.argsort(grams, kind="stable")
    grams, owners, at = grams[order], owners[order], at[order]
    out = []
    for x in range(len(sets)):
        own = sets[x][: prefix[x]]
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        count = high - low
        entries = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = np.repeat(np.arange(len(own)), count)
        # Entries come by place in this line, so the first of each owner is the first common shingle.
        others, first = np.unique(owners[entries], return_index=True)
        here, there = place[first], at[entries[first]]
        need = -(-share * (n[x] + n[others]) // (100 + share))
        can = (rank[others] < rank[x]) & (100 * np.minimum(n[x], n[others]) >= share * np.maximum(n[x], n[others]))
        can &= 1 + np.minimum(n[x] - here - 1, n[others] - there - 1) >= need
        others = others[can]
        others = others[np.argsort(rank[others])]
        for k in range(0, len(others), VERIFY):
            some = others[k : k + VERIFY]
            every = np.concatenate([sets[y] for y in some.tolist()])
            spot = np.minimum(np.searchsorted(sets[x], every), n[x] - 1)
            common = np.add.reduceat((sets[x][spot] == every).astype(np.int64), np.cumsum(n[some]) - n[some])
            if setjoin.similar(common, n[x], n[some], share).any():
                out.append(x)
                break
    return np.array(out, np.int64)


#: Groups of so few lines are compared pair by pair.
FEW = 8


def _any_earlier(sets: list[np.ndarray], rank: np.ndarray, share: int) -> list[int]:
    """As ``matched_lines``, for a handful of sets."""
    out = []
    for x, own in enumerate(sets):
        for y, other in enumerate(sets):
            n, m = len(own), len(other)
            if rank[y] < rank[x] and 100 * min(n, m) >= share * max(n, m):
                spot = np.minimum(np.searchsorted(own, other), n - 1)
                if setjoin.similar(np.count_nonzero(own[spot] == other), n, m, share):
                    out.append(x)
                    break
    return out


_UNIT = pa.schema([("unit", pa.int64())])


def _matches(share: int):
    def made(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        units, sets = np.asarray(rows["unit"]), setjoin.unpack(rows["grams"])
        rank = np.empty(len(units), np.int64)
        rank[np.lexsort([np.asarray(rows[c]) for c in ("line", "tie", "key")])] = np.arange(len(units))
        out: list[int] = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a > 1:
                found = _any_earlier if b - a <= FEW else matched_lines
                out += [a + x for x in found(sets[a:b], rank[a:b], share)]
        return pa.Table.from_arrays([pa.array(units[np.array(out, np.int64)])], schema=_UNIT)

    return made


def removed_lines(texts: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(key, tie, lines): the numbers of the removed lines per document of a (key, tie, text) table."""

    def make(data, offsets):
        return setjoin.line_units(data, offsets, width)

    found = setjoin.find_candidates(texts, make, share, copies=True)
    wanted_units = found.blocks.select("unit").unionByName(found.copied)
    bits, rarity = texts.sparkSession.sparkContext.broadcast(setjoin.unit_filter(wanted_units)), found.rarity

    def look_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = setjoin.Seen()
        for batch in batches:
            for first, _, data, offsets in words.chunks(batch.column("text")):
                units = make(data, offsets)
                sets = setjoin.order_sets(units, rarity.value.level)
                rows = setjoin.passes(bits.value, sets.signature) & (np.diff(sets.firsts) > 0)
                if not rows.any():
                    continue
                first_seen = rows & seen.first(sets.signature)
                kept = pa.array(np.flatnonzero(rows))
                packed = [pa.array(np.diff(sets.firsts)), setjoin.pack_bitmaps(sets, first_seen), setjoin.pack_sets(sets, first_seen)]
                owner = pa.array(first + units.owner[rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(owner), batch.column("tie").take(owner), pa.array(units.number[rows]), pa.array(sets.signature[rows].view(np.int64)), *(x.take(kept) for x in packed)],
                    names=["key", "tie", "line", "unit", "n", "bits", "grams"],
                )

    lines = staged(texts.select("key", "tie", "text").mapInArrow(look_again, "key long, tie long, line long, unit long, n long, bits binary, grams binary"), "lines")
    place = F.struct("key", "tie", "line")
    first = lines.groupBy("unit").agg(F.min(place).alias("first"))
    chosen = lines.where(F.col("bits").isNotNull())
    blocks = setjoin.refine(found.blocks, chosen.select("unit", "n", "bits"), share)
    sets = chosen.select("unit", "grams").join(first, "unit").select("unit", "grams", "first.*")
    groups = setjoin.pair_groups(blocks, sets)
    matched = setjoin.in_groups(groups, _matches(share), "unit long").distinct()
    judged = first.join(matched.withColumn("matched", F.lit(True)), "unit", "left")
    gone = lines.select("unit", *["key", "tie", "line"]).join(judged, "unit").where(F.col("matched") | (place > F.col("first")))
    return gone.groupBy("key", "tie").agg(F.collect_set("line").alias("lines"))


def _without(x: Column) -> Column:
    """The text of ``parts`` without the lines numbered in ``gone`` (sorted): what stands between them, and behind the last."""

    def between(ends: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(ends, k - 1))
        return F.transform(ends, lambda end, k: F.slice(x["parts"], (before(k) + 2).cast("int"), (end - before(k) - 1).cast("int")))

    return F.array_join(F.flatten(let(F.concat(x["gone"], F.array(F.size(x["parts"]).cast("long"))), between)), "\n")


def dedup_lines(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with the later similar lines taken out, plus ``n_lines`` (before) and ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    text = F.col(f"`{text_col}`")
    keyed = {"key": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), "tie": F.xxhash64(text)}
    texts = docs.select(*[c.alias(n) for n, c in keyed.items()], text.cast("string").alias("text"))
    key, tie, lines = free_names(docs, "key", "tie", "lines")
    gone = staged(removed_lines(texts, width, share), "removed-lines").select(F.col("key").alias(key), F.col("tie").alias(tie), F.sort_array("lines").alias(lines))
    joined = docs.join(gone, (keyed["key"] == F.col(key)) & (keyed["tie"] == F.col(tie)), "left")
    parts = F.split(text, "\n")
    cleaned = F.when(F.col(lines).isNull(), text).otherwise(let(F.struct(parts.alias("parts"), F.col(lines).alias("gone")), _without))
    columns = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size(lines), F.lit(0)).alias("n_removed"))


def without_repeated_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with their own columns; one that loses all its words to the removal goes."""
    names = docs.columns
    left = dedup_lines(docs, text_col=text_col)
    return left.where((F.col("n_removed") == 0) | F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in names])

"""Candidate blocks of an exact set-similarity join on word shingles.

A unit (a text or a line) is a set of shingles, globally ordered by rarity and then by hash.
Two sets of Jaccard similarity ``SHARE``/100 or more have a shingle in common among the first
``n - ceil(SHARE n / 100) + 1`` of each. So units go to the runs of these shingles, every run
names its smallest unit its leader, and a block (all units with one leader in common) holds
every similar pair of the run. Units are identified by a signature of their set, so equal sets
are one unit, and copies within a task are sent once.

Rarity comes from counts in a fixed number of hash buckets, summed over all units: any global
order gives exact results, a good one keeps common passages out of the runs. Runs of buckets
that stand out are split by salt, and the leaders of the parts meet in a second, small step.
Large blocks are cut into chunks, and every pair of chunks is a group of its own. Bitmaps of the
sets, a bit or two per shingle, first rule out the units that cannot be similar to any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm import words
from lectern.llm.shared import ragged, staged

WIDTH, SHARE = 5, 80
BUCKET_BITS, SLICES = 20, 256
#: Rows that a run of one bucket may have beyond its even share before it is split.
RUN_ROWS = 20_000
#: Bits of the filter that says which units are worth a second look.
FILTER_BITS = 23
#: Units and shingles (at most) in one chunk of a block.
CHUNK_UNITS, CHUNK_SHINGLES = 1024, 1 << 20
#: Signatures that a task remembers to send copies once.
SEEN_BITS = 18


@dataclass
class Units:
    """The units of a chunk: shingle hashes, shingles before each unit, owning text, number within it."""

    hashes: np.ndarray
    firsts: np.ndarray
    owner: np.ndarray
    number: np.ndarray


def text_units(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Units:
    """Every text is a unit."""
    starts, ends, firsts = words.find_words(data, offsets, words.SPACED)
    hashes, before = words.shingles(words.hash_spans(data, starts, ends), firsts, width)
    n = len(offsets) - 1
    return Units(hashes, before, np.arange(n), np.zeros(n, np.int64))


def line_units(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Units:
    """Every line is a unit, numbered from 0 in its text."""
    breaks = np.flatnonzero(data == 0x0A)
    bounds = np.unique(np.concatenate([offsets, breaks + 1]))
    starts, ends, firsts = words.find_words(data, bounds, words.SPACED)
    hashes, before = words.shingles(words.hash_spans(data, starts, ends), firsts, width)
    owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
    number = np.searchsorted(breaks, bounds[:-1]) - np.searchsorted(breaks, offsets[owner])
    return Units(hashes, before, owner, number)


def required(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Shingles a set of n has in common with any similar set, at least."""
    return -(-share * n // 100)


@dataclass
class Ordered:
    """Distinct shingles per unit in global order, their bounds, and the signature of every unit."""

    grams: np.ndarray
    firsts: np.ndarray
    signature: np.ndarray


def order_sets(units: Units, level: np.ndarray) -> Ordered:
    """Put the rarity level into the top bits, so that numeric order is the global order."""
    n = len(units.firsts) - 1
    grams = (level[(units.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (units.hashes >> np.uint64(6))
    owner = np.repeat(np.arange(n), np.diff(units.firsts))
    if n < 1 << 16:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16)))
        grams, sorted_owner = grams[order], owner[order]
        if len(grams) > 1 and ((grams[1:] < grams[:-1]) & (sorted_owner[1:] == sorted_owner[:-1])).any():
            order = np.lexsort((grams, sorted_owner))
            grams = grams[order]
    else:
        order = np.lexsort((grams, owner))
        grams, sorted_owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    grams, sorted_owner = grams[new], sorted_owner[new]
    firsts = np.searchsorted(sorted_owner, np.arange(n + 1))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words.mix(grams), dtype=np.uint64)))
    size = np.diff(firsts)
    # The low six bits say how long the set is; they serve to weigh blocks.
    signature = (words.mix(sums[firsts[1:]] - sums[firsts[:-1]] + size.astype(np.uint64)) & ~np.uint64(63)) | bit_length(size).astype(np.uint64)
    return Ordered(grams, firsts, signature)


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.asarray(values, float) + 1)).astype(np.int64)


class Seen:
    """Remembers recent signatures; ``first`` is true where one was not seen (false answers only repeat work)."""

    def __init__(self):
        self.table = np.zeros(1 << SEEN_BITS, np.uint64)

    def first(self, signatures: np.ndarray) -> np.ndarray:
        slots = (signatures >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        fresh = self.table[slots] != signatures
        _, where = np.unique(signatures, return_index=True)
        once = np.zeros(len(signatures), bool)
        once[where] = True
        self.table[slots] = signatures
        return fresh & once


UnitMaker = Callable[[np.ndarray, np.ndarray], Units]


def count_shingles(texts: DataFrame, make: UnitMaker) -> np.ndarray:
    """Shingles of all units by hash bucket: a fixed number of counts, summed on the executors."""
    size = (1 << BUCKET_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column("text")):
                total += np.bincount((make(data, offsets).hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * size : (k + 1) * size].tobytes() for k in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(number, np.zeros(size, np.int64))
                own += np.frombuffer(counts.as_buffer(), np.int32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    counted = texts.select("text").mapInArrow(count, "slice int, counts binary").repartition(F.col("slice")).mapInArrow(add, "slice int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in counted.collect():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return out


@dataclass
class Rarity:
    """What workers need of the counts: a level and a number of salts per bucket."""

    level: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Rarity:
        beyond = np.maximum(0, counts - 2 * int(counts.mean()))
        # Half-octave levels up to 2**31, of six bits.
        level = np.minimum(63, np.round(2 * np.log2(counts + 1.0))).astype(np.uint8)
        return cls(level, np.minimum(1 + beyond // RUN_ROWS, 2**14 - 1).astype(np.int16))


#: Kinds of posting, the two low bits of a run's number: a shingle, a shingle of a split run, a unit's own signature.
PLAIN, SPLIT, OWN = 0, 1, 2
#: A run's number: 48 bits of hash, 14 bits of salt, the kind. Equal hashes only add candidates.
_HASHED = np.uint64(2**64 - 2**16)
_POSTINGS = pa.schema([("run", pa.int64()), ("unit", pa.int64())])
_PAIRS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
#: Kinds of row a run makes: (leader, unit); (shingle, leader of a split part); (unit that has copies, itself).
BLOCK, PART, COPIED = 0, 1, 2
#: Postings that are read at once.
READ_ROWS = 1 << 18


def _postings(make: UnitMaker, rarity, share: int, copies: bool):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = Seen(), Seen()
        level, salts = rarity.value.level, rarity.value.salts
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column("text")):
                sets = order_sets(make(data, offsets), level)
                size = np.diff(sets.firsts)
                first = seen.first(sets.signature) & (size > 0)
                wanted = np.where(first, size - required(size, share) + 1, 0)
                at = np.repeat(sets.firsts[:-1] - (np.cumsum(wanted) - wanted), wanted) + np.arange(int(wanted.sum()))
                grams, unit = sets.grams[at], np.repeat(sets.signature, wanted)
                parts = salts[((grams << np.uint64(6)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
                run = words.mix(grams) & _HASHED
                split = parts > 1
                if split.any():
                    run[split] |= (words.mix(unit[split]) % parts[split] << np.uint64(2)) | np.uint64(SPLIT)
                if copies:
                    # A unit tells of itself once, and once more for all its copies in the task.
                    copy = ~first & (size > 0)
                    own = sets.signature[first | (copy & again.first(np.where(copy, sets.signature, np.uint64(0))))]
                    run = np.concatenate([run, (words.mix(~own) & _HASHED) | np.uint64(OWN)])
                    unit = np.concatenate([unit, own])
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(unit.view(np.int64))], schema=_POSTINGS)

    return post


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by run become rows of ``_PAIRS``. Salts bound what one run holds."""
    held: list[np.ndarray] = []
    count = 0

    def read(run: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(at, len(run)))
        leader = np.minimum.reduceat(unit, at)
        own, kind = np.repeat(leader, size), run & 3
        out = []
        gives = (unit != own) & (kind != OWN)
        if gives.any():
            pairs = _distinct_pairs(own[gives], unit[gives])
            heads = np.unique(pairs[0])
            out += [(BLOCK, *pairs), (BLOCK, heads, heads)]
        split = run[at] & 3 == SPLIT
        if split.any():
            heads = leader[split]
            out += [(BLOCK, heads, heads), (PART, run[at][split] >> 16, heads)]
        copied = (size > 1) & (run[at] & 3 == OWN)
        if copied.any():
            out.append((COPIED, leader[copied], leader[copied]))
        for k, a, b in out:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int8)), pa.array(a), pa.array(b)], schema=_PAIRS)

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
        count += batch.num_rows
        if count >= READ_ROWS:
            run, unit = np.concatenate(held, 1)
            done = int(np.searchsorted(run, run[-1]))  # the last run may go on
            if done:
                yield from read(run[:done], unit[:done])
            held, count = [np.stack([run[done:], unit[done:]])], 0
    if held:
        run, unit = np.concatenate(held, 1)
        if len(run):
            yield from read(run, unit)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new]


@dataclass
class Candidates:
    """``blocks``: leader, unit. ``copied``: units with copies. ``rarity``: broadcast."""

    blocks: DataFrame
    copied: DataFrame
    rarity: object
    make: UnitMaker


def find_candidates(texts: DataFrame, make: UnitMaker, share: int = SHARE, copies: bool = False) -> Candidates:
    """Blocks that hold every pair of similar units of a ``text`` column."""
    context = texts.sparkSession.sparkContext
    rarity = context.broadcast(Rarity.of(count_shingles(texts, make)))
    posted = texts.select("text").mapInArrow(_postings(make, rarity, share, copies), "run long, unit long")
    rows = posted.repartition(F.col("run")).sortWithinPartitions("run").mapInArrow(_read_runs, "kind byte, a long, b long").distinct()
    rows = staged(rows, "runs")
    plain = rows.where(F.col("kind") == BLOCK).select(F.col("a").alias("leader"), F.col("b").alias("unit"))
    parts = rows.where(F.col("kind") == PART)
    # All parts of a split run join the block of the smallest of their leaders.
    first = parts.groupBy("a").agg(F.min("b").alias("first"))
    moved = parts.join(first, "a").select(F.col("b").alias("leader"), "first").distinct()
    blocks = plain.unionByName(plain.join(moved, "leader").select(F.col("first").alias("leader"), "unit")).distinct()
    return Candidates(staged(blocks, "blocks"), rows.where(F.col("kind") == COPIED).select(F.col("a").alias("unit")), rarity, make)


def unit_filter(units: DataFrame) -> np.ndarray:
    """A bit per hash of a unit, of fixed size; it may say yes too often, never no too often."""
    bit = f"shiftrightunsigned(unit, {64 - FILTER_BITS})"
    packed = units.select(F.expr(f"shiftright({bit}, 6)").alias("place"), F.expr(f"shiftleft(1L, cast({bit} & 63 AS int))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in packed.groupBy("place").agg(F.bit_or("bits").alias("bits")).collect():
        out[row["place"]] = row["bits"]
    return out


def passes(bits: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    place = signatures >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) > 0


def pair_groups(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks with the columns of ``units``, dealt so that every two units of a block meet in a ``group``.

    A block is one group unless it is too large; then it is cut into chunks, and every pair of
    chunks is a group. Groups are numbered by hash: two that share a number only compare more.
    """
    weight = F.sum(F.expr("shiftleft(1L, cast(unit & 63 AS int))"))
    sized = blocks.groupBy("leader").agg(F.count("*").alias("n"), weight.alias("weight")).where(F.col("n") > 1)
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_UNITS), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    # Neither side has a bound, and the plan should be the same at every size.
    members = blocks.join(sized.select("leader", chunks.alias("chunks")), "leader").join(units.hint("merge"), "unit")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = F.xxhash64("leader", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return members.withColumn("group", group).drop("other", "chunk", "chunks")


#: Rows of complete groups that are handled at once, and bytes.
GROUP_ROWS, GROUP_BYTES = 1 << 12, 16 << 20


def in_groups(members: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], ddl: str) -> DataFrame:
    """Apply ``work`` to tables of whole groups: sorted rows and where each group begins (and the end).

    Every unit is once in a group; chunks bound what a group holds.
    """

    def ready(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, unit = np.asarray(rows["group"]), np.asarray(rows["unit"])
        order = np.lexsort((unit, group))
        new = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (unit[order][1:] != unit[order][:-1])))
        rows = rows.take(pa.array(order[new]))
        group = group[order[new]]
        bounds = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group))
        yield from work(rows, bounds).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = size = 0
        for batch in batches:
            held.append(batch)
            count, size = count + batch.num_rows, size + batch.nbytes
            if count >= GROUP_ROWS or size >= GROUP_BYTES:
                rows = pa.Table.from_batches(held)
                group = np.asarray(rows["group"])
                done = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
                if done:
                    yield from ready(rows.slice(0, done))
                    rows = rows.slice(done).combine_chunks()
                held, count, size = rows.to_batches(), rows.num_rows, 0
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield from ready(rows)

    return members.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(run, ddl)


def pack_bitmaps(sets: Ordered, wanted: np.ndarray) -> pa.Array:
    """Per wanted unit a bitmap of its hashed shingles, of a power of two of bits, at least one per shingle."""
    n = np.diff(sets.firsts)
    bits = np.where(wanted, 1 << np.maximum(6, bit_length(np.maximum(n - 1, 0))), 0)
    places = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(n)), np.where(wanted, n, 0))
    grams = sets.grams[np.repeat(wanted, n)]
    flags = np.zeros(int(places[-1]), bool)
    flags[places[owner] + (words.mix(grams) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    return _binary(np.packbits(flags, bitorder="little"), places // 8, wanted)


def may_be_similar(n: np.ndarray, bitmaps: list[np.ndarray], share: int = SHARE) -> np.ndarray:
    """Which units have a partner that lengths and bitmaps do not rule out.

    Every bit that differs stands for a shingle that one side lacks, and similar sets differ in
    at most (100 - share) / (100 + share) of their shingles. A bitmap of twice the size folds.
    """
    size = np.array([len(b) for b in bitmaps])
    out = np.zeros(len(n), bool)
    for c in np.unique(size).tolist():
        small, large = np.flatnonzero(size == c), np.flatnonzero(size == 2 * c)
        rows = np.stack([bitmaps[k] for k in small])
        if len(large):
            double = np.stack([bitmaps[k] for k in large])
            rows = np.concatenate([rows, double[:, :c] | double[:, c:]])
        both = np.concatenate([small, large])
        for k, x in enumerate(small.tolist()):
            differ = np.bitwise_count(rows[k + 1 :] ^ rows[k]).sum(1, dtype=np.int64)
            others = both[k + 1 :]
            near = (100 + share) * differ <= (100 - share) * (n[others] + n[x])
            near &= 100 * np.minimum(n[others], n[x]) >= share * np.maximum(n[others], n[x])
            if near.any():
                out[x] = True
                out[others[near]] = True
    return out


_MEMBERS = pa.schema([("leader", pa.int64()), ("unit", pa.int64())])
#: Groups of at most so many units are compared together, pair by pair.
SMALL_GROUP = 48


def similar_pairs(n: np.ndarray, bitmaps: list[np.ndarray], a: np.ndarray, b: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Which pairs of places lengths and bitmaps do not rule out."""
    size = np.array([len(x) for x in bitmaps])
    firsts = np.cumsum(size) - size
    flat = np.concatenate(bitmaps)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    out = 100 * np.minimum(n[a], n[b]) >= share * np.maximum(n[a], n[b])
    for c in np.unique(size[a[out]]).tolist():
        for times in (1, 2):
            at = np.flatnonzero(out & (size[a] == c) & (size[b] == times * c))
            span = np.arange(c)
            other = flat[firsts[b[at]][:, None] + span]
            if times == 2:
                other = other | flat[firsts[b[at]][:, None] + span + c]
            differ = np.bitwise_count(flat[firsts[a[at]][:, None] + span] ^ other).sum(1, dtype=np.int64)
            out[at] = (100 + share) * differ <= (100 - share) * (n[a[at]] + n[b[at]])
    return out


def refine(blocks: DataFrame, sketches: DataFrame, share: int = SHARE) -> DataFrame:
    """Blocks without the units that cannot be similar to any other; ``sketches`` has unit, n and bits."""

    def kept(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        n, bitmaps = np.asarray(rows["n"]), unpack(rows["bits"])
        good = np.zeros(len(n), bool)
        size = np.diff(bounds)
        ends = np.repeat(np.where(size <= SMALL_GROUP, bounds[1:], 0), size)
        here = np.arange(len(n))
        partners = np.maximum(0, ends - here - 1)
        a = np.repeat(here, partners)
        b = ragged(here + 1, partners)
        near = similar_pairs(n, bitmaps, a, b, share)
        good[a[near]] = True
        good[b[near]] = True
        for k in np.flatnonzero(size > SMALL_GROUP).tolist():
            span = slice(bounds[k], bounds[k + 1])
            good[span] = may_be_similar(n[span], bitmaps[span], share)
        return rows.select(["leader", "unit"]).filter(pa.array(good)).cast(_MEMBERS)

    return staged(in_groups(pair_groups(blocks, sketches), kept, "leader long, unit long").distinct(), "refined")


def unpack(grams: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(g.as_buffer(), np.uint64) for g in grams]  # values of 8-byte steps


def _binary(data: np.ndarray, places: np.ndarray, valid: np.ndarray) -> pa.Array:
    valid = np.packbits(valid, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [pa.py_buffer(valid.tobytes()), pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def pack_sets(sets: Ordered, wanted: np.ndarray) -> pa.Array:
    """The shingles of the wanted units as binary values, null for the others."""
    n = np.diff(sets.firsts)
    places = np.concatenate(([0], np.cumsum(np.where(wanted, 8 * n, 0))))
    return _binary(sets.grams[np.repeat(wanted, n)], places, wanted)


def similar(common: Column | np.ndarray, n: np.ndarray, m: np.ndarray, share: int = SHARE) -> np.ndarray:
    return 100 * common >= share * (n + m - common)

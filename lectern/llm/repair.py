"""Token-id files compressed by pair grammars (Re-Pair), one grammar per shard.

Documents are range-partitioned by id and encoded in ascending order. Every partition cuts its
stream into shards of about ``SHARD_TOKENS`` ids; in a shard, rounds of frequent neighbouring
pairs become nonterminals until no pair is frequent. A shard is one row of the written table:

    part, shard     place in the global order
    documents       count; doc_ids: their ids; doc_tokens / doc_symbols: cumulative counts
    rule_left, rule_right, rule_length   the grammar, rule i standing for symbol base + i
    low, high       the symbol sequence, 16 low bits and 8 high bits of each symbol apart

Pairs never cross documents, so a document is a run of symbols, and expansion lengths let a
reader skip to any token of it without expanding what comes before.

Defined results: a null or empty text is a document of the end id alone; repeated rows are kept,
in the order of id and then of a hash of the text; null ids come first; a very long text is a
shard of its own, beyond the usual size; an empty table gives an empty file set; further columns
of the table are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lectern.llm.shared import id_and_text, ragged, rows_of, staged, table_of
from lectern.llm.tokens import encoded

END_ID = 2
SHARD_TOKENS = 1 << 21
#: Most pairs that one round replaces (others wait for the next), and the least count of a pair worth a rule.
ROUND_RULES = 8192
LEAST_COUNT = 16
#: Ids of every vocabulary are below; nonterminals start here.
BASE = 1 << 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Pairs are counted by slot first; only those of a slot with enough occurrences are sorted.
_SLOT_BITS = 18

SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64()))]
    + [("rule_left", pa.list_(pa.int32())), ("rule_right", pa.list_(pa.int32())), ("rule_length", pa.list_(pa.int32())), ("low", pa.binary()), ("high", pa.binary())]
)
SHARDS_DDL = "part int, shard int, tokens long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, rule_left array<int>, rule_right array<int>, rule_length array<int>, low binary, high binary"
DIGEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def frequent_pairs(codes: np.ndarray, most: int, least: int) -> np.ndarray:
    """The most frequent pair codes, each at least ``least`` times, most frequent first."""
    codes = np.sort(codes)
    if not len(codes):
        return codes
    firsts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(firsts, len(codes)))
    good = np.flatnonzero(counts >= least)
    return codes[firsts[good[np.argsort(-counts[good], kind="stable")][:most]]]


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def compress(symbols: np.ndarray, firsts: np.ndarray, most: int = ROUND_RULES, least: int = LEAST_COUNT):
    """Grammar of one shard. ``firsts``: ids before each document, and in all.

    Returns symbols, symbols before each document, rule sides and rule lengths. A round counts all pairs, picks the
    frequent ones and replaces their occurrences from the left; rounds go on until no pair is frequent. Every round
    shortens the sequence, and its pairs that overlap others everywhere get no rule.
    """
    symbols = symbols.astype(np.uint32)
    left, right, length = (np.zeros(0, np.int64) for _ in range(3))
    while len(symbols) > 1:
        codes = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        inside = np.ones(len(codes), bool)
        borders = firsts[1:-1]
        inside[borders[(borders > 0) & (borders < len(symbols))] - 1] = False
        slots = _slot(codes)
        counts = np.bincount(slots[inside], minlength=1 << _SLOT_BITS)
        may = np.flatnonzero((counts >= least)[slots] & inside)
        pairs = np.sort(frequent_pairs(codes[may], most, least))
        if not len(pairs):
            break
        found = np.minimum(np.searchsorted(pairs, codes[may]), len(pairs) - 1)
        hit = pairs[found] == codes[may]
        at, name = may[hit], found[hit]
        # Of touching occurrences every second one is replaced, from the left.
        begins = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at, name = at[place % 2 == 0], name[place % 2 == 0]
        used, name = np.unique(name, return_inverse=True)
        pairs, names = pairs[used], (BASE + len(left) + name).astype(np.uint32)
        sides = [(pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(2**32 - 1)).astype(np.int64)]
        size = [np.where(s >= BASE, np.append(length, 1)[np.where(s >= BASE, s - BASE, len(length))], 1) for s in sides]
        left, right, length = np.append(left, sides[0]), np.append(right, sides[1]), np.append(length, size[0] + size[1])
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols[at] = names
        gone = np.concatenate(([0], np.cumsum(~kept)))
        symbols, firsts = symbols[kept], firsts - gone[firsts]
    return symbols, firsts, left, right, length


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All ids that a run of symbols stands for."""
    while len(symbols):
        nonterminal = symbols >= BASE
        if not nonterminal.any():
            break
        size = np.where(nonterminal, 2, 1)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[at] = symbols
        names = symbols[nonterminal] - BASE
        out[at[nonterminal]], out[at[nonterminal] + 1] = left[names], right[names]
        symbols = out
    return symbols


def expand_all(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As ``expand``, for whole shards: every rule is expanded once, symbols then copy their spans."""
    pool = np.concatenate((expand(np.arange(BASE, BASE + len(left)), left, right), np.zeros(0, np.int64)))
    starts = np.cumsum(length) - length
    nonterminal = symbols >= BASE
    names = np.where(nonterminal, symbols - BASE, 0)
    if not nonterminal.any():
        return symbols
    size = np.where(nonterminal, length[names], 1)
    owner_start = np.where(nonterminal, starts[names], len(pool) + np.cumsum(~nonterminal) - 1)
    return np.concatenate((pool, symbols[~nonterminal]))[ragged(owner_start, size)]


def shard_symbols(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) | (np.frombuffer(high, np.uint8).astype(np.int64) << 16)


def read_range(shard: dict, document: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start:stop`` of a shard's n-th document: skips by lengths, expands only what overlaps."""
    a, b = shard["doc_symbols"][document : document + 2]
    left, right, length = (np.asarray(shard[f"rule_{k}"], np.int64) for k in ("left", "right", "length"))
    symbols = shard_symbols(shard["low"][2 * a : 2 * b], shard["high"][a:b])
    sizes = np.ones(len(symbols), np.int64)
    sizes[symbols >= BASE] = length[symbols[symbols >= BASE] - BASE]
    ends = np.cumsum(sizes)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[first - 1]) if first else 0
    return expand(symbols[first:last], left, right)[start - skipped : stop - skipped]


def _shards(batches: Iterable[pa.RecordBatch], path: str, rule: str, shard_tokens: int, added_tokens: bool = False) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    tokens: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal number, held
        firsts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        symbols, places, left, right, length = compress(np.concatenate(tokens), firsts)
        row = {
            "part": [part], "shard": [number], "tokens": [int(firsts[-1])], "doc_ids": [pa.concat_arrays(ids).to_pylist()],
            "doc_tokens": [firsts], "doc_symbols": [places], "rule_left": [left], "rule_right": [right], "rule_length": [length],
            "low": [(symbols & 0xFFFF).astype("<u2").tobytes()], "high": [(symbols >> 16).astype(np.uint8).tobytes()],
        }
        number, held = number + 1, 0
        for x in (ids, tokens, counts):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in SHARDS], schema=SHARDS)

    for own, out, before in encoded(rows_of(batches), path, rule, END_ID, added_tokens):
        ids.append(own)
        tokens.append(out)
        counts.append(np.diff(before))
        held += len(out)
        if held >= shard_tokens:
            yield close()
    if held:
        yield close()


def write_shards(docs: DataFrame, path: str, rule: str = "spaces", shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Encode and compress a table into the shared folder; returns the written shards."""
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return staged(ordered.select("doc_id", "text").mapInArrow(lambda b: _shards(b, path, rule, shard_tokens, added_tokens), SHARDS_DDL), "token-shards")


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode written shards: per document its place, token count, checksum and, if asked, ids."""
    schema = DIGEST.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else DIGEST

    def decoded(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
                rules = (np.asarray(shard[f"rule_{k}"].values, np.int64) for k in ("left", "right", "length"))
                ids = expand_all(shard_symbols(shard["low"].as_py(), shard["high"].as_py()), *rules).astype("<u4")
                firsts = np.asarray(shard["doc_tokens"].values, np.int64)
                bounds = firsts.tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                n = len(sums)
                columns = {"part": np.full(n, shard["part"].as_py(), np.int32), "shard": np.full(n, shard["shard"].as_py(), np.int32), "doc_id": shard["doc_ids"].values, "inner": firsts[:-1], "n_tokens": np.diff(firsts), "ids_crc32": np.array(sums, np.int64)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield table_of(schema, **columns)

    ddl = "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # A shard is a large row; a few at a time keep the worker small.
    return shards.select("part", "shard", "doc_ids", "doc_tokens", "rule_left", "rule_right", "rule_length", "low", "high").mapInArrow(decoded, ddl)


def with_starts(decoded: DataFrame, shards: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. One total per partition passes the driver."""
    from pyspark.sql import Window

    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    offsets, sums = [], 0
    for part, n in totals:
        offsets.append((part, sums))
        sums += n
    spark = decoded.sparkSession
    parts = spark.createDataFrame(offsets, "part int, part_start long")
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("shard_start")).join(parts, "part")
    places = places.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    return decoded.join(places, ["part", "shard"]).withColumn("start", F.col("base") + F.col("inner")).drop("part", "shard", "base", "inner")

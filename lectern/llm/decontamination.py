"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton holds the word sequences of all items of a block. Documents stream through it;
at every word it knows the longest stretch ending there that occurs in some item. A stretch of
``window`` words or more, or a whole shorter item, marks its words as hit. Words that cannot be part of
any hit are skipped beforehand: a stretch of k words needs k - 1 neighbouring pairs in a row
that are pairs of some item. Items shorter than a window are looked up by the hash of their words.

Defined results: null or empty texts have no words and hit nothing; items without words have no
window; repeated items count each by its own id (null ids count as one item, left out of lists);
an empty benchmark marks nothing; repeated documents give repeated rows; a very long text is
scanned whole by one task; further columns of either table are not read (``clean`` keeps them).
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from lectern.llm import words
from lectern.llm.shared import free_names, id_and_text, numbered, staged, table_of

WINDOW = 10
#: Words of the items in one automaton, besides its last item: the bound of what is sent to the workers at once.
BLOCK_WORDS = 1 << 19
#: In ``clean``: hit stretches of at least so many words go, and whole documents hit beyond this share.
REMOVE_WORDS = 1
DROP_SHARE = 0.5


class SuffixAutomaton:
    """Generalised suffix automaton of word-number sequences; states know their items.

    ``top[s]``: the state whose stretches include the last ``window`` words of those of ``s``,
    or -1. ``items[t]``: the sequences in which these words occur.
    """

    def __init__(self, sequences: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                ends.append((last, item))
        self.top = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.top[s] = self.top[up] if self.length[up] >= window else (s if self.length[s] >= window else -1)
        self.items: dict[int, set[int]] = {}
        for s, item in ends:
            if self.top[s] >= 0:
                self.items.setdefault(self.top[s], set()).add(item)

    def _extend(self, last: int, word: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, word, to)
        state = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            to = self.next[p][word]
            self.link[state] = to if self.length[to] == self.length[p] + 1 else self._clone(p, word, to)
        return state

    def _clone(self, p: int, word: int, to: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[to]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[to])
        self.link[to] = clone
        while p != -1 and self.next[p].get(word) == to:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def match(self, sequence: Iterable[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches (start, end) of ``window`` words or more of a sequence that occur in items, and those items."""
        state = length = 0
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        for at, word in enumerate(sequence, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= self.window:
                hits.append((at - length, at))
                items |= self.items[self.top[state]]
        return hits, items


@dataclass
class ItemIndex:
    """What a worker needs of one block of items.

    ``short`` has, by number of words, the sorted hashes of items shorter than a window and their places.
    """

    item_ids: list
    window: int
    vocabulary: np.ndarray
    pairs: np.ndarray
    automaton: SuffixAutomaton
    short: dict[int, tuple[np.ndarray, list[list[int]]]]


def index_items(ids: list, texts: list, window: int = WINDOW) -> ItemIndex:
    sequences: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for first, n, data, offsets in words.chunks(pa.array(texts, pa.large_string())):
        starts, ends, firsts = words.find_words(data, offsets, words.ALPHANUMERIC)
        hashes = words.hash_spans(data, starts, ends)
        for k in range(n):
            sequences[first + k] = hashes[firsts[k] : firsts[k + 1]]
    long = [(k, s) for k, s in enumerate(sequences) if len(s) >= window]
    vocabulary = np.unique(np.concatenate([s for _, s in long] or [np.zeros(0, np.uint64)]))
    numbered = [(k, np.searchsorted(vocabulary, s)) for k, s in long]
    pairs = np.unique(np.concatenate([s[:-1] * len(vocabulary) + s[1:] for _, s in numbered] or [np.zeros(0, np.int64)]))
    whole: dict[int, dict[int, list[int]]] = {}
    for k, s in enumerate(sequences):
        if 0 < len(s) < window:
            whole.setdefault(len(s), {}).setdefault(int(words.runs(s, len(s))[0]), []).append(k)
    short = {n: (np.array(sorted(found), np.uint64), [found[h] for h in sorted(found)]) for n, found in whole.items()}
    return ItemIndex(ids, window, vocabulary, pairs, SuffixAutomaton([(k, s.tolist()) for k, s in numbered], window), short)


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return at, (known[at] == values) if len(known) else np.zeros(len(values), bool)


def find_hits(index: ItemIndex, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Hit words of a chunk of documents, and per document (by place) the items found."""
    hit = np.zeros(len(hashes) + 1, np.int64)
    found: dict[int, set[int]] = {}
    borders = firsts[1:-1]
    borders = borders[(borders > 0) & (borders < len(hashes))]

    number, known = _among(hashes, index.vocabulary)
    joined = np.zeros(len(hashes), bool)  # this word and the next one are a pair of some item
    if len(hashes) > 1:
        both = np.flatnonzero(known[:-1] & known[1:])
        _, pair = _among(number[both] * len(index.vocabulary) + number[both + 1], index.pairs)
        joined[both[pair]] = True
        joined[borders - 1] = False
    edges = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
    begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
    long = (stops - begins) >= index.window
    for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
        spans, items = index.automaton.match(number[a:b].tolist())
        for x, y in spans:
            hit[a + x] += 1
            hit[a + y] -= 1
        if items:
            found.setdefault(int(np.searchsorted(firsts, a, "right")) - 1, set()).update(items)

    for size, (known_hashes, items_of) in index.short.items():
        at, same = _among(words.runs(hashes, size), known_hashes)
        for a in np.flatnonzero(same).tolist():
            owner = int(np.searchsorted(firsts, a, "right")) - 1
            if a + size <= firsts[owner + 1]:
                hit[a] += 1
                hit[a + size] -= 1
                found.setdefault(owner, set()).update(items_of[at[a]])
    return np.cumsum(hit)[:-1] > 0, found


class Block:
    """One block's index, broadcast as bytes; a worker holds one block at a time."""

    _loaded: dict[str, ItemIndex] = {}

    def __init__(self, shared: Broadcast):
        self.shared, self.name = shared, uuid.uuid4().hex

    def index(self) -> ItemIndex:
        if self.name not in Block._loaded:
            Block._loaded.clear()
            Block._loaded[self.name] = pickle.loads(self.shared.value)
        return Block._loaded[self.name]


class ItemBlocks:
    """The benchmark cut into blocks of about ``block_words`` words, their indexes built in tasks and written.

    Sums of sizes per partition and the block numbers pass the driver, and one index at a time.
    """

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, window: int = WINDOW):
        self.spark, self.window = benchmark.sparkSession, window
        items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

        def sized(batches):
            part, held = TaskContext.get().partitionId(), 0
            for batch in batches:
                sizes = np.array([len(t) // 2 + 1 for t in batch.column("text").to_pylist()], np.int64)  # no text has more words than that
                before = held + np.cumsum(sizes) - sizes
                held += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(sizes)], names=["id", "text", "part", "before", "size"])

        def built(group: pa.Table) -> pa.Table:
            index = pickle.dumps(index_items(group["id"].to_pylist(), group["text"].to_pylist(), window), pickle.HIGHEST_PROTOCOL)
            return pa.table({"block": group["block"].slice(0, 1), "index": pa.array([index], pa.binary())})

        kind = items.schema["id"].dataType.simpleString()
        rows = staged(items.mapInArrow(sized, f"id {kind}, text string, part int, before long, size long"), "items")
        offsets, total = [], 0
        for part, size in sorted((r["part"], r["size"]) for r in rows.groupBy("part").agg(F.sum("size").alias("size")).collect()):
            offsets.append((part, total))
            total += size
        parts = self.spark.createDataFrame(offsets, "part int, offset long")
        block = F.floor((F.col("offset") + F.col("before")) / block_words).cast("long")
        blocks = rows.join(F.broadcast(parts), "part").select("id", "text", block.alias("block"))
        self.table = staged(blocks.groupBy("block").applyInArrow(built, "block long, index binary"), "indexes")
        self.numbers = sorted(r["block"] for r in self.table.select("block").collect())

    def block(self, k: int) -> Block:
        """The k-th block, or an index of nothing if the benchmark has no items."""
        if self.numbers:
            index = bytes(self.table.where(F.col("block") == self.numbers[k]).first()["index"])
        else:
            index = pickle.dumps(index_items([], [], self.window))
        return Block(self.spark.sparkContext.broadcast(index))

    def runs(self, rows: DataFrame) -> DataFrame:
        """Runs of hit words and items of every block, written one block after another.

        Only the first block's rows include those that it doesn't hit.
        """
        parts = None
        for k in range(len(self.numbers)):
            block = self.block(k)
            found = _find_in_block(rows, block)
            part = staged(found if parts is None else found.where(F.col("n_items") > 0), "runs")
            block.shared.destroy()
            parts = part if parts is None else parts.unionByName(part)
        return parts


def _scan(batches: Iterable[pa.RecordBatch], index: ItemIndex) -> Iterator[tuple]:
    """Per document chunk: ids, data, offsets, word bounds, firsts, hit words, items per document."""
    for batch in batches:
        for first, n, data, offsets in words.chunks(batch.column("text")):
            starts, ends, firsts = words.find_words(data, offsets, words.ALPHANUMERIC)
            hashes = words.hash_spans(data, starts, ends)
            hit, found = find_hits(index, hashes, firsts)
            items = {k: {index.item_ids[i] for i in v} for k, v in found.items()}
            yield batch, first, n, data, offsets, starts, ends, firsts, hit, items


_RUNS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string())), ("n_items", pa.int64())])
_RUNS_DDL = "row_id long, doc_id long, n_words long, runs array<long>, item_ids array<string>, n_items long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("item_ids", pa.list_(pa.string()))])
_FOUND_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>"


def _digest(ids: pa.Array, n_words, n_hit, n_items, names: list[list[str]]) -> pa.RecordBatch:
    sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return table_of(_FOUND, doc_id=ids, n_words=n_words, n_hit=n_hit, n_items=n_items, items_sha256=pa.array(sums, pa.string()), item_ids=pa.array(names, pa.list_(pa.string())))


def _names(items: dict[int, set], n: int) -> tuple[list[list[str]], np.ndarray]:
    """Item ids as sorted strings per document, and how many items (one without id counts too)."""
    return [sorted(str(i) for i in items.get(k, ()) if i is not None) for k in range(n)], np.array([len(items.get(k, ())) for k in range(n)], np.int64)


def _find_once(texts: DataFrame, block: Block) -> DataFrame:
    """All columns of the result in one pass, where one block holds the whole benchmark."""

    def scan(batches):
        for batch, first, n, _, _, _, _, firsts, hit, items in _scan(batches, block.index()):
            total = np.concatenate(([0], np.cumsum(hit)))[firsts]
            names, counts = _names(items, n)
            yield _digest(batch.column("doc_id").slice(first, n), np.diff(firsts), np.diff(total), counts, names)

    return texts.mapInArrow(scan, _FOUND_DDL)


def _find_in_block(rows: DataFrame, block: Block) -> DataFrame:
    """Runs of hit words and items of one block, per row of a table with row numbers."""

    def scan(batches):
        for batch, first, n, _, _, _, _, firsts, hit, items in _scan(batches, block.index()):
            names, counts = _names(items, n)
            runs = [np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))) for a, b in zip(firsts, firsts[1:])]
            yield table_of(_RUNS, row_id=batch.column("row_id").slice(first, n), doc_id=batch.column("doc_id").slice(first, n), n_words=np.diff(firsts), runs=pa.array(runs, pa.list_(pa.int64())), item_ids=pa.array(names, pa.list_(pa.string())), n_items=counts)

    return rows.mapInArrow(scan, _RUNS_DDL)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the union of the blocks' runs (each a list of starts and ends in turn)."""
    for batch in batches:
        hits = []
        for n, lists in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            marks = np.zeros(n + 1, np.int64)
            for runs in lists:
                np.add.at(marks, runs[::2], 1)
                np.add.at(marks, runs[1::2], -1)
            hits.append(int(np.count_nonzero(np.cumsum(marks)[:-1])))
        names = [sorted(x) for x in batch.column("item_ids").to_pylist()]
        yield _digest(batch.column("doc_id"), batch.column("n_words"), np.array(hits, np.int64), batch.column("n_items"), names)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the item ids.

    A benchmark of one block takes one pass; of more blocks each takes a pass of its own, so a
    worker never holds more than one, and the hit runs of a document are merged afterwards.
    """
    texts = id_and_text(docs, id_col, text_col)
    blocks = ItemBlocks(benchmark, window=window, block_words=block_words)
    if len(blocks.numbers) <= 1:
        found = _find_once(texts, blocks.block(0))
    else:
        parts = blocks.runs(staged(texts.withColumn("row_id", F.monotonically_increasing_id()), "numbered"))
        merged = parts.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max(F.col("n_items") - F.size("item_ids")).alias("unnamed"))
        found = merged.select("doc_id", "n_words", "runs", "item_ids", (F.size("item_ids") + F.col("unnamed")).cast("long").alias("n_items")).mapInArrow(_merge_runs, _FOUND_DDL)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove_words: int = REMOVE_WORDS, drop_share: float = DROP_SHARE, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    A hit stretch of ``remove_words`` words or more is cut out; a document of which more than
    ``drop_share`` of the words are hit goes altogether. Of several blocks the hit words are
    gathered on the whole text first, so the result does not depend on the size of a block.
    """
    blocks = ItemBlocks(benchmark, window=window, block_words=block_words)
    schema, place = docs.schema, docs.schema.names.index(text_col)

    if len(blocks.numbers) <= 1:
        block = blocks.block(0)

        def cleaned(batches):
            for batch in batches:
                renamed = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
                for _, first, n, data, offsets, starts, ends, firsts, hit, _ in _scan([renamed], block.index()):
                    yield _cut(batch.slice(first, n), place, data, offsets, starts, ends, firsts, hit, remove_words, drop_share)

        return docs.mapInArrow(cleaned, schema)

    row, hits = free_names(docs, "row", "hits")
    rows = numbered(docs, row, "numbered")
    runs = blocks.runs(rows.select(F.col(row).alias("row_id"), F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    runs = runs.where(F.size("runs") > 0).groupBy(F.col("row_id").alias(row)).agg(F.collect_list("runs").alias(hits))
    marked = rows.join(runs, row, "left").select(*[f"`{c}`" for c in schema.names], hits)

    def cut(batches):
        for batch in batches:
            own = batch.select(schema.names)
            for first, n, data, offsets in words.chunks(batch.column(place)):
                starts, ends, firsts = words.find_words(data, offsets, words.ALPHANUMERIC)
                hit = np.zeros(len(starts), bool)
                for k, lists in enumerate(batch.column(hits).slice(first, n).to_pylist()):
                    for found in lists or ():
                        for x, y in zip(found[::2], found[1::2], strict=True):
                            hit[firsts[k] + x : firsts[k] + y] = True
                yield _cut(own.slice(first, n), place, data, offsets, starts, ends, firsts, hit, remove_words, drop_share)

    return marked.mapInArrow(cut, schema)


def _cut(rows: pa.RecordBatch, place: int, data, offsets, starts, ends, firsts, hit: np.ndarray, remove_words: int, drop_share: float) -> pa.RecordBatch:
    """The rows of a chunk without their hit stretches and without those hit beyond the share."""
    if not hit.any():
        return rows
    total = np.concatenate(([0], np.cumsum(hit)))[firsts]
    share = np.diff(total) / np.maximum(1, np.diff(firsts))
    texts = rows.column(place).to_pylist()
    for k in np.flatnonzero(np.diff(total)).tolist():
        a, b = firsts[k], firsts[k + 1]
        flags = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
        raw, at, kept = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
        for x, y in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True):
            if y - x < remove_words:
                continue
            kept.append(raw[at : starts[a + x] - offsets[k]])
            at = int(ends[a + y - 1] - offsets[k])
        texts[k] = b"".join([*kept, raw[at:]]).decode()
    columns = list(rows.columns)
    columns[place] = pa.array(texts, rows.schema.field(place).type)
    return pa.RecordBatch.from_arrays(columns, schema=rows.schema).filter(pa.array(share <= drop_share))

"""Near-duplicate documents by a prefix-tree join on their n-gram sets.

Within a block of candidates the globally ordered sets form a trie. One walk over the trie
serves all sets at once: a node carries the overlap of its path with every set still alive, so
sets below it share that part of the work; a subtree is left as soon as no set can reach the
overlap it needs with what remains, by length, of either side.

Links join documents into components. Equal sets are one unit throughout, and only links that
join something new leave a block, so a group of copies costs links in proportion to its size.

Defined results: a null or empty text, or one without words, has no shingle and no link; a text
of fewer words than a shingle is one shingle; rows that repeat an id are documents of their own
with one id, which then joins their components' smallest id as usual; a null id never becomes a
component's id unless the component has no other; a very long text is one set of shingles, held
whole by the task that reads it; an empty table gives no rows; columns of the
table named n_shingles or component_id are replaced where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import setjoin, words
from lectern.llm.setjoin import SHARE, WIDTH
from lectern.llm.shared import free_names, id_and_text, numbered, staged
from lectern.operators.graph import connected_components

_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def trie_links(sets: list[np.ndarray], share: int = SHARE) -> list[tuple[int, int]]:
    """Links (of places) that span the components of similar sets; sets are distinct and in global order."""
    n = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), n)
    _, ranks, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set alone adds to no overlap; only lengths know of it.
    shared = count[ranks] > 1
    owners, ranks = owners[shared], ranks[shared]
    kept = np.bincount(owners, minlength=len(sets))
    bounds = np.concatenate(([0], np.cumsum(kept)))
    paths = [ranks[bounds[k] : bounds[k + 1]] for k in range(len(sets))]
    by_gram = np.argsort(ranks, kind="stable")
    holders = owners[by_gram]
    gram_bounds = np.searchsorted(ranks[by_gram], np.arange(len(count) + 1))

    order = sorted(range(len(sets)), key=lambda k: paths[k].astype(">u4").tobytes())
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(order))
    component = np.arange(len(sets))
    links: list[tuple[int, int]] = []

    # A node: the sorted sets low..high that share a path of ``depth``, sets alive, their overlaps.
    nodes = [(0, len(order), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
    while nodes:
        low, high, depth, alive, overlap = nodes.pop()
        first, last = paths[order[low]], paths[order[high - 1]]
        end = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:end] != last[depth:end])
        end = depth + int(differ[0]) if len(differ) else end
        if end > depth:
            spans = [holders[gram_bounds[g] : gram_bounds[g + 1]] for g in first[depth:end].tolist()]
            overlap = overlap + np.bincount(np.concatenate(spans), minlength=len(sets))[alive]
        inside = np.array(order[low:high])
        least, rest = n[inside].min(), kept[inside].max() - end
        need = -(-share * (n[alive] + least) // (100 + share))
        can = (overlap + np.minimum(rest, kept[alive] - overlap) >= need) & (place[alive] > low) & (100 * n[alive] >= share * least)
        alive, overlap = alive[can], overlap[can]
        if not len(alive):
            continue
        start = low
        while start < high and len(paths[order[start]]) == end:
            own = order[start]
            near = alive[(place[alive] > start) & setjoin.similar(overlap, n[alive], n[own], share)]
            for label in np.unique(component[near]).tolist() if len(near) else ():
                if label != component[own]:
                    links.append((own, int(near[component[near] == label][0])))
                    component[component == label] = component[own]
            start += 1
        heads = [paths[order[k]][end] for k in range(start, high)]
        cuts = [k for k in range(len(heads)) if k == 0 or heads[k] != heads[k - 1]] + [len(heads)]
        nodes += [(start + a, start + b, end, alive, overlap) for a, b in zip(cuts, cuts[1:])]
    return links


def _links(share: int):
    def made(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        units, sets = np.asarray(rows["unit"]), setjoin.unpack(rows["grams"])
        src: list[int] = []
        dst: list[int] = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            for x, y in trie_links(sets[a:b], share) if b - a > 1 else ():
                src.append(units[a + x])
                dst.append(units[a + y])
        return pa.Table.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=_EDGES)

    return made


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    texts = id_and_text(docs, id_col, text_col)

    def make(data, offsets):
        return setjoin.text_units(data, offsets, width)

    found = setjoin.find_candidates(texts, make, share)
    bits = texts.sparkSession.sparkContext.broadcast(setjoin.unit_filter(found.blocks))
    rarity = found.rarity

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = setjoin.Seen()
        for batch in batches:
            for first, n, data, offsets in words.chunks(batch.column("text")):
                sets = setjoin.order_sets(make(data, offsets), rarity.value.level)
                wanted = setjoin.passes(bits.value, sets.signature) & (np.diff(sets.firsts) > 0)
                wanted &= seen.first(sets.signature)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.diff(sets.firsts)), pa.array(sets.signature.view(np.int64)), setjoin.pack_bitmaps(sets, wanted)],
                    names=["doc_id", "n_shingles", "unit", "bits"],
                )

    measured = staged(texts.mapInArrow(measure, "doc_id long, n_shingles long, unit long, bits binary"), "shingle-bits")
    sketches = measured.where(F.col("bits").isNotNull()).select("unit", F.col("n_shingles").alias("n"), "bits")
    blocks = setjoin.refine(found.blocks, sketches, share)
    left = texts.sparkSession.sparkContext.broadcast(setjoin.unit_filter(blocks))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the few units that are left; cheaper to make again than to keep for all candidates."""
        seen = setjoin.Seen()
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column("text")):
                sets = setjoin.order_sets(make(data, offsets), rarity.value.level)
                wanted = setjoin.passes(left.value, sets.signature) & (np.diff(sets.firsts) > 0)
                wanted &= seen.first(sets.signature)
                if wanted.any():
                    kept = pa.array(np.flatnonzero(wanted))
                    yield pa.RecordBatch.from_arrays([pa.array(sets.signature[wanted].view(np.int64)), setjoin.pack_sets(sets, wanted).take(kept)], names=["unit", "grams"])

    groups = setjoin.pair_groups(blocks, texts.select("text").mapInArrow(fetch, "unit long, grams binary"))
    links = staged(setjoin.in_groups(groups, _links(share), "src long, dst long").distinct(), "links")
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    components = connected_components(links, nodes)
    members = measured.select("doc_id", "n_shingles", "unit").join(components.withColumnRenamed("node", "unit"), "unit", "left")
    # A text without shingles is a component of its own.
    label = F.when(F.col("n_shingles") > 0, F.coalesce("component", "unit"))
    members = members.select("doc_id", "n_shingles", label.alias("label"))
    smallest = members.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("smallest"))
    joined = members.join(smallest, "label", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one of the smallest id (null ids last), of equal ids the first as the table was read.

    Rows are told apart by a number written with them, so repeated and null ids neither save nor cost a row. All columns stay.
    """
    row, head = free_names(docs, "row", "head")
    rows = numbered(docs, row, "numbered-documents")
    found = staged(near_duplicates(rows, width, share, row, text_col).select(F.col("doc_id").alias(row), F.col("component_id").alias(head)), "components")
    # Most components are one row: only the others are looked at.
    shared = found.groupBy(head).count().where(F.col("count") > 1).select(head)
    members = found.join(shared, head).join(rows.select(row, F.col(f"`{id_col}`").cast("long").alias("own_id")), row)
    place = F.struct(F.col("own_id").isNull(), "own_id", row)
    first = members.groupBy(head).agg(F.min(place)[row].alias("first"))
    dropped = members.join(first, head).where(F.col(row) != F.col("first")).select(row)
    return rows.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

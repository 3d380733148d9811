"""Walks over the graphs of many documents at once.

nodes(doc_id, id, ...) and edges(doc_id, src, dst, ...) hold one small graph per document, as a rule. Such graphs are
gathered into one row each and walked in Arrow batches: all graphs of a batch are one graph in offset arrays, and a
round of a walk is a few array operations for all of them. A document with more than ``IN_ROW`` nodes and edges is
walked by frontier joins keyed by document instead, which spread over the cluster. Both ways give equal rows.

Ends of edges count as nodes. Null ids are left out. A document without the asked nodes has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from lectern.operators import graph as G
from lectern.operators.cleaning import running_total
from lectern.session import cut_lineage

#: Nodes and edges of a document that is walked inside a row.
IN_ROW = 200_000


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every span, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Graphs:
    """The graphs of some documents as one: nodes in order of document and id, neighbours in offset arrays."""

    def __init__(self, ids: pa.ListArray, src: pa.ListArray, dst: pa.ListArray) -> None:
        self.n_docs = len(ids)
        size = np.diff(ids.offsets.to_numpy())
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.doc = np.repeat(np.arange(self.n_docs), size)
        self.names = ids.flatten()
        self.codes = pa.chunked_array([self.names, src.flatten(), dst.flatten()]).combine_chunks().dictionary_encode()
        code = self.codes.indices.to_numpy()
        n, m = len(self.names), int(np.diff(src.offsets.to_numpy()).sum())
        self.width = len(self.codes.dictionary) + 1
        keys = self.doc * self.width + code[:n]
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        owner = np.repeat(np.arange(self.n_docs), np.diff(src.offsets.to_numpy()))
        self.src = self._at(owner * self.width + code[n : n + m])
        self.dst = self._at(owner * self.width + code[n + m :])

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return self._order[np.searchsorted(self._keys, keys)]

    def find(self, names: pa.Array) -> np.ndarray:
        """The node of each document's name; -1 where there is none."""
        index = pa.compute.index_in(names, self.codes.dictionary)
        code = index.fill_null(self.width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.arange(self.n_docs) * self.width + code
        at = np.minimum(np.searchsorted(self._keys, keys), max(len(self._keys) - 1, 0))
        return np.where(self._keys[at] == keys, self._order[at], -1) if len(self._keys) else np.full(self.n_docs, -1)

    def find_all(self, names: pa.ListArray) -> np.ndarray:
        """The nodes of all names, document by document; each must be there."""
        code = pa.compute.index_in(names.flatten(), self.codes.dictionary).to_numpy()
        owner = np.repeat(np.arange(self.n_docs), np.diff(names.offsets.to_numpy()))
        return self._at(owner * self.width + code)

    def neighbours(self, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per node and distinct neighbours in order; along the edges only, unless ``both``."""
        a, b = (np.concatenate((self.src, self.dst)), np.concatenate((self.dst, self.src))) if both else (self.src, self.dst)
        pairs = np.unique(a * len(self.doc) + b) if len(a) else np.zeros(0, np.int64)
        a, b = np.divmod(pairs, max(len(self.doc), 1))
        return np.searchsorted(a, np.arange(len(self.doc) + 1)), b

    def distances(self, starts: np.ndarray, offsets: np.ndarray, to: np.ndarray, most: int | None = None) -> np.ndarray:
        """Steps from the nearest start, -1 where none leads."""
        steps = np.full(len(self.doc), -1, np.int64)
        steps[starts] = 0
        front, step = np.unique(starts), 0
        while len(front) and (most is None or step < most):
            step += 1
            reached = to[spans(offsets[front], offsets[front + 1] - offsets[front])]
            front = np.unique(reached[steps[reached] < 0])
            steps[front] = step
        return steps

    def components(self) -> np.ndarray:
        """The first node of every node's component: labels are hooked onto lower ones and pointers doubled."""
        label = np.arange(len(self.doc))
        while True:
            low = np.minimum(label[self.src], label[self.dst])
            new = label.copy()
            for ends in (self.src, self.dst):
                np.minimum.at(new, label[ends], low)
                np.minimum.at(new, ends, low)
            while (up := new[new]).tobytes() != new.tobytes():
                new = up
            if (new == label).all():
                return label
            label = new


def gathered(nodes: DataFrame, edges: DataFrame, in_row: int = IN_ROW) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows, nodes, links): small documents as rows(doc_id, ids, src, dst), and the other documents' (doc_id, id) and
    (doc_id, src, dst), or None if there are no others.

    Rows hold distinct ids in order, ends of edges among them, and edges in no particular order.
    """
    listed = nodes.select("doc_id", "id").filter(F.col("id").isNotNull())
    links = edges.select("doc_id", "src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    size = listed.select("doc_id").unionByName(links.select("doc_id")).groupBy("doc_id").count()
    large = cut_lineage(size.filter(F.col("count") > in_row).select("doc_id"))
    big_nodes = big_links = None
    if not large.isEmpty():
        ends = links.select("doc_id", F.explode(F.array("src", "dst")).alias("id"))
        big_nodes = cut_lineage(listed.unionByName(ends).join(large, "doc_id", "left_semi").distinct())
        big_links = cut_lineage(links.join(large, "doc_id", "left_semi"))
        listed, links = listed.join(large, "doc_id", "left_anti"), links.join(large, "doc_id", "left_anti")
    own = listed.groupBy("doc_id").agg(F.collect_list("id").alias("own"))
    pairs = links.groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    none = F.array().cast("array<string>")
    src, dst = F.coalesce("e.src", none), F.coalesce("e.dst", none)
    ids = F.sort_array(F.array_distinct(F.concat(F.coalesce("own", none), src, dst)))
    return own.join(pairs, "doc_id", "full").select("doc_id", ids.alias("ids"), src.alias("src"), dst.alias("dst")), big_nodes, big_links


def _walk(rows: DataFrame, schema: str, walk: Callable[[Graphs, pa.RecordBatch], list], *extra: str) -> DataFrame:
    """Apply ``walk(graphs, batch)``, which gives the columns of ``schema`` behind doc_id and each row's document number first."""
    names = ["doc_id", *[f.split()[0] for f in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                graphs = Graphs(batch.column("ids"), batch.column("src"), batch.column("dst"))
                doc, *columns = walk(graphs, batch)
                arrays = [batch.column("doc_id").take(pa.array(doc)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids", "src", "dst", *extra).mapInArrow(run, f"doc_id {kind}, {schema}")


def _both_ways(links: DataFrame) -> DataFrame:
    out = links.select("doc_id", F.col("src").alias("node"), F.col("dst").alias("other"))
    return out.unionByName(links.select("doc_id", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def _fronts(links: DataFrame, starts: DataFrame, name: str, most: int | None = None, undirected: bool = True) -> DataFrame:
    """(doc_id, node, ``name``) by frontier joins. Each front is written once and joined with its edges.

    Along undirected links a new front can only meet the last two, so no round reads what lies further back.
    """
    links = cut_lineage(links.select("doc_id", "node", "other"))
    fronts, step = [cut_lineage(starts.select("doc_id", "node").distinct())], 0
    found = fronts[0].withColumn(name, F.lit(0))
    while (most is None or step < most) and not fronts[-1].isEmpty():
        step += 1
        reached = fronts[-1].join(links, ["doc_id", "node"]).select("doc_id", F.col("other").alias("node")).distinct()
        for seen in fronts[-2:] if undirected else fronts:
            reached = reached.join(seen, ["doc_id", "node"], "left_anti")
        fronts.append(cut_lineage(reached))
        found = found.unionByName(fronts[-1].withColumn(name, F.lit(step)))
    return found


def bfs(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int | None = None, in_row: int = IN_ROW) -> DataFrame:
    """(doc_id, node, distance): undirected steps from starts(doc_id, id), one start per document; no start, no rows."""
    rows, large, links = gathered(nodes, edges, in_row)
    start = starts.groupBy("doc_id").agg(F.min("id").alias("start"))

    def walk(g: Graphs, batch: pa.RecordBatch) -> list:
        at = g.find(batch.column("start"))
        steps = g.distances(at[at >= 0], *g.neighbours(), max_depth)
        seen = np.flatnonzero(steps >= 0)
        return [g.doc[seen], g.names.take(pa.array(seen)), steps[seen].astype(np.int32)]

    small = _walk(rows.join(start, "doc_id"), "node string, distance int", walk, "start")
    if large is None:
        return small
    first = large.join(start, "doc_id").filter(F.col("id") == F.col("start")).select("doc_id", F.col("id").alias("node"))
    return small.unionByName(_fronts(_both_ways(links), first, "distance", max_depth))


def shortest_path(nodes: DataFrame, edges: DataFrame, asked: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(doc_id, path, labels, length) of asked(doc_id, start, goal), one row per document with a path.

    Of equally short undirected paths the one with the smallest ids from the start on. Distances to the goal
    are found first; the path then follows, from the start, the smallest neighbour one step nearer.
    Labels come from nodes(doc_id, id, label), a node without one shows its id.
    """
    rows, large, links = gathered(nodes, edges, in_row)
    asked = asked.groupBy("doc_id").agg(F.min(F.struct("start", "goal")).alias("a")).select("doc_id", "a.start", "a.goal")

    def walk(g: Graphs, batch: pa.RecordBatch) -> list:
        start, goal = g.find(batch.column("start")), g.find(batch.column("goal"))
        offsets, to = g.neighbours()
        steps = g.distances(goal[(goal >= 0) & (start >= 0)], offsets, to)
        doc = np.flatnonzero((start >= 0) & (goal >= 0) & (steps[start] >= 0)) if len(steps) else np.zeros(0, np.int64)
        at, docs, nodes, place = start[doc], [doc], [start[doc]], [np.zeros(len(doc), np.int64)]
        while (on := steps[at] > 0).any():
            doc, at = doc[on], at[on]
            counts = offsets[at + 1] - offsets[at]
            near = to[spans(offsets[at], counts)]
            owner = np.repeat(np.arange(len(at)), counts)
            nearer = steps[near] == steps[at][owner] - 1
            _, first = np.unique(owner[nearer], return_index=True)
            at = near[nearer][first]
            docs.append(doc), nodes.append(at), place.append(np.full(len(at), len(docs) - 1))
        doc, at, place = (np.concatenate(x) for x in (docs, nodes, place))
        return [doc, place.astype(np.int32), g.names.take(pa.array(at))]

    small = _walk(rows.join(asked, "doc_id"), "place int, node string", walk, "start", "goal")
    steps = small if large is None else small.unionByName(_large_paths(large, _both_ways(links), asked))
    label = nodes.groupBy("doc_id", F.col("id").alias("node")).agg(F.min("label").alias("label")) if "label" in nodes.columns else None
    steps = steps.join(label, ["doc_id", "node"], "left") if label is not None else steps.withColumn("label", F.lit(None).cast("string"))
    path = F.sort_array(F.collect_list(F.struct("place", "node", F.coalesce("label", "node").alias("label"))))
    found = steps.groupBy("doc_id").agg(path.alias("p"))
    return found.select("doc_id", F.col("p.node").alias("path"), F.col("p.label").alias("labels"), (F.size("p") - 1).alias("length"))


def _large_paths(large: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, place, node) of documents walked by joins: distances to the goal give every node its pointer."""
    both = large.join(asked, "doc_id").groupBy("doc_id").agg(F.max((F.col("id") == F.col("start")).cast("int")).alias("s"), F.max((F.col("id") == F.col("goal")).cast("int")).alias("g"))
    asked = cut_lineage(asked.join(both.filter("s = 1 AND g = 1").select("doc_id"), "doc_id"))
    steps = cut_lineage(_fronts(links, asked.select("doc_id", F.col("goal").alias("node")), "steps"))
    nearer = steps.select("doc_id", F.col("node").alias("other"), (F.col("steps") + 1).alias("steps"))
    pointer = links.join(steps, ["doc_id", "node"]).join(nearer, ["doc_id", "other", "steps"]).groupBy("doc_id", "node").agg(F.min("other").alias("next"))
    pointer = cut_lineage(pointer)
    reached = steps.select("doc_id", F.col("node").alias("start"))
    at = cut_lineage(asked.join(reached, ["doc_id", "start"]).select("doc_id", F.lit(0).alias("place"), F.col("start").alias("node")))
    found = at
    while not at.isEmpty():
        at = cut_lineage(at.join(pointer, ["doc_id", "node"]).select("doc_id", (F.col("place") + 1).alias("place"), F.col("next").alias("node")))
        found = found.unionByName(at)
    return found


def connected_components(nodes: DataFrame, edges: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(doc_id, node, component) for every node and end, with the smallest id as component."""
    rows, large, links = gathered(nodes, edges, in_row)

    def walk(g: Graphs, batch: pa.RecordBatch) -> list:
        return [g.doc, g.names, g.names.take(pa.array(g.components()))]

    small = _walk(rows, "node string, component string", walk)
    if large is None:
        return small
    # Ids of one document stay apart from those of others, and in order within it, as pairs.
    pair = lambda c: F.struct("doc_id", F.col(c).alias("id"))
    found = G.connected_components(links.select(pair("src").alias("src"), pair("dst").alias("dst")), large.select(pair("id").alias("id")))
    return small.unionByName(found.select("node.doc_id", F.col("node.id").alias("node"), F.col("component.id").alias("component")))


def layer_levels(nodes: DataFrame, edges: DataFrame, root_type: str = "paper", in_row: int = IN_ROW) -> DataFrame:
    """(doc_id, node, level) of nodes(doc_id, id, type, pos): steps along the edges from the document's roots.

    Roots are nodes of ``root_type``, else nodes without incoming edges, else the first node. Nodes that no root leads to
    follow one by one, in order of pos and id, below the deepest level. Edges to ids that are no nodes are not followed.
    """
    nodes = nodes.filter(F.col("id").isNotNull())
    place = nodes.groupBy("doc_id", "id").agg(F.min(F.struct("pos", "id")).alias("place"), F.max(F.coalesce((F.col("type") == root_type).cast("int"), F.lit(0))).alias("root"))
    inside = edges.select("doc_id", "src", "dst").join(place.select("doc_id", F.col("id").alias("src")), ["doc_id", "src"], "left_semi")
    inside = inside.join(place.select("doc_id", F.col("id").alias("dst")), ["doc_id", "dst"], "left_semi")
    rows, large, links = gathered(nodes, inside, in_row)
    ordered = place if large is None else place.join(large.select("doc_id").distinct(), "doc_id", "left_anti")
    ordered = ordered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "root"))).alias("n"), F.sort_array(F.collect_list("place")).alias("o"))
    rows = rows.join(ordered.select("doc_id", F.col("n.root").alias("root"), F.col("o.id").alias("order")), "doc_id")

    def walk(g: Graphs, batch: pa.RecordBatch) -> list:
        root = batch.column("root").flatten().to_numpy() > 0
        entered = np.bincount(g.dst, minlength=len(g.doc)) > 0
        has = lambda mark: np.bincount(g.doc[mark], minlength=g.n_docs) > 0
        rooted, free = has(root), has(~entered)
        order = g.find_all(batch.column("order"))
        first = np.zeros(len(g.doc), bool)
        first[order[g.first[:-1][g.first[:-1] < g.first[1:]]]] = True
        starts = np.where(rooted[g.doc], root, np.where(free[g.doc], ~entered, first))
        steps = g.distances(np.flatnonzero(starts), *g.neighbours(both=False))
        deepest = np.zeros(g.n_docs, np.int64)
        np.maximum.at(deepest, g.doc, steps)
        rest = order[steps[order] < 0]
        before = np.searchsorted(g.doc[rest], np.arange(g.n_docs))
        steps[rest] = deepest[g.doc[rest]] + 1 + np.arange(len(rest)) - before[g.doc[rest]]
        return [g.doc, g.names, steps.astype(np.int32)]

    small = _walk(rows, "node string, level int", walk, "root", "order")
    if large is None:
        return small
    place = place.join(large.select("doc_id").distinct(), "doc_id", "left_semi")
    entered = links.select("doc_id", F.col("dst").alias("id"), F.lit(True).alias("entered")).distinct()
    marked = place.join(entered, ["doc_id", "id"], "left")
    rule = marked.groupBy("doc_id").agg(F.max("root").alias("rooted"), F.max(F.col("entered").isNull().cast("int")).alias("free"), F.min("place").alias("first"))
    is_root = F.when(F.col("rooted") == 1, F.col("root") == 1).when(F.col("free") == 1, F.col("entered").isNull()).otherwise(F.col("place") == F.col("first"))
    roots = marked.join(rule, "doc_id").filter(is_root).select("doc_id", F.col("id").alias("node"))
    along = links.select("doc_id", F.col("src").alias("node"), F.col("dst").alias("other")).distinct()
    seen = cut_lineage(_fronts(along, roots, "level", undirected=False))
    deepest = seen.groupBy("doc_id").agg(F.max("level").alias("deepest"))
    rest = place.join(seen.select("doc_id", F.col("node").alias("id")), ["doc_id", "id"], "left_anti")
    dealt = rest.select("doc_id", "id", "place.pos").repartitionByRange("doc_id", "pos", "id").sortWithinPartitions("doc_id", "pos", "id")
    numbered = cut_lineage(dealt.withColumn("row", F.monotonically_increasing_id()))
    counted = running_total(numbered.select("doc_id", "id", "row"), "doc_id", "row", F.lit(1))
    extra = counted.join(deepest, "doc_id").select("doc_id", F.col("id").alias("node"), (F.col("deepest") + 1 + F.col("start")).cast("int").alias("level"))
    return small.unionByName(seen.select("doc_id", "node", "level")).unionByName(extra)

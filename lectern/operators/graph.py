"""Graph operators on edges(src, dst, type, ...) and nodes(id, ...) tables.

Iterations join the frontier with the edges, checkpoint each round and stop when
nothing is new; hubs are only ever reduced by aggregation, never collected.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from lectern.operators.dedupe import keep_first
from lectern.operators.ontology import RELATION_WEIGHT, ontology_context
from lectern.session import cut_lineage, stored


def edge_dedupe(edges: DataFrame, order: list[str]) -> DataFrame:
    """First edge per (src, type, dst)."""
    return keep_first(edges, ["src", "type", "dst"], [F.col(c) for c in order])


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) for either end; a self-loop once per direction."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    return out.unionByName(back)


def incident_edges(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    near = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return near.filter(F.col("type") == kind) if kind else near


def neighbors(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Distinct other ends of each node in ``nodes``."""
    ends = both_ways(edges).filter(F.col("node") != F.col("other")).distinct()
    return ends.join(nodes.select(F.col(key).alias("node")), "node", "left_semi")


def node_connections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of every node with direction and the other end's label."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
    labels = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    return out.unionByName(back).join(labels, "other").select("node", "direction", "type", "other", "other_label")


def degree_count(edges: DataFrame) -> DataFrame:
    """Connections per node, each edge counted at both ends."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree over the largest degree of the document's graph; a self-loop counts once. Both tables carry doc_id."""
    ends = edges.select("doc_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    degrees = ends.groupBy("doc_id", "node").agg(F.count("*").alias("_d"))
    top = degrees.groupBy("doc_id").agg(F.max("_d").alias("_top"))
    full = nodes.select("doc_id", F.col("id").alias("node")).join(degrees, ["doc_id", "node"], "left").join(top, "doc_id", "left")
    return full.select(
        "doc_id", "node", (F.coalesce("_d", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("_top", F.lit(1)))).alias("centrality")
    )


def _grow(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges, "node").select("other", *[c for c in frontier.columns if c != "node"])


def bfs(edges: DataFrame, nodes: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """Undirected distances from ``start``; a missing start gives no rows."""
    links = cut_lineage(both_ways(edges).distinct())
    seen = cut_lineage(nodes.filter(F.col("id") == start).select(F.col("id").alias("node"), F.lit(0).alias("distance")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = _grow(frontier.select("node"), links).distinct().withColumnRenamed("other", "node")
        fresh = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen, frontier = cut_lineage(seen.unionByName(fresh)), fresh
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """One row (path, length) of a shortest undirected path, smallest path on ties; no row if none."""
    links = cut_lineage(both_ways(edges).distinct())
    seen = cut_lineage(
        links.filter(F.col("node") == start).select("node").distinct().withColumn("path", F.array("node"))
    )
    frontier = seen
    while not frontier.isEmpty():
        found = seen.filter(F.col("node") == goal)
        if not found.isEmpty():
            return found.select("path", (F.size("path") - 1).alias("length"))
        step = frontier.join(links, "node").select(
            F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")
        )
        best = step.groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut_lineage(best.join(seen.select("node"), "node", "left_anti"))
        seen = cut_lineage(seen.unionByName(frontier))
    return seen.filter(F.col("node") == goal).select("path", (F.size("path") - 1).alias("length"))


def edge_digest(links: DataFrame) -> tuple:
    """Number and combined hashes of distinct edges: equal before and after a round that changed nothing."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) with the smallest node id as component.

    Alternating large-star and small-star rounds: each shrinks the edge set
    towards stars in a logarithmic number of rounds, whatever the diameter.
    """
    links = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct())
    after = edge_digest(links)
    while True:
        ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = ends.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large.filter(F.col("u") != F.col("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        small = cut_lineage(small.filter(F.col("u") != F.col("v")).distinct())
        before, after = after, edge_digest(small)
        links = small
        if before == after:
            break
    return nodes.select(F.col("id").alias("node")).join(links.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def layer_levels(edges: DataFrame, nodes: DataFrame, root_type: str = "paper") -> DataFrame:
    """Directed level of every node from the roots; unreachable nodes follow in order below.

    Roots are document nodes, else nodes without incoming edges, else the smallest id.
    """
    pos = "pos"
    roots = nodes.filter(F.col("type") == root_type).select("id")
    if roots.isEmpty():
        roots = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
    if roots.isEmpty():
        roots = nodes.orderBy(pos).limit(1).select("id")
    links = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct())
    seen = cut_lineage(roots.select(F.col("id").alias("node"), F.lit(0).alias("level")))
    frontier, level = seen, 0
    while not frontier.isEmpty():
        level += 1
        reached = frontier.select("node").join(links, "node").select(F.col("other").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = cut_lineage(seen.unionByName(frontier))
    deepest = seen.agg(F.max("level").alias("_max"))
    rest = nodes.join(seen.select(F.col("node").alias("id")), "id", "left_anti").select("id", pos)
    from lectern.operators.cleaning import running_total

    ranked = running_total(rest.withColumn("_g", F.lit(0)), "_g", pos, F.lit(1)).select("id", "start")
    extra = ranked.crossJoin(F.broadcast(deepest)).select(
        F.col("id").alias("node"), (F.col("_max") + 1 + F.col("start")).cast("int").alias("level")
    )
    return seen.unionByName(extra)


def subgraph_filter(nodes: DataFrame, edges: DataFrame, min_confidence: float, types: list[str] | None = None, needle: str | None = None, edge_types: list[str] | None = None):
    """(nodes, edges) after confidence, type and text filters; a search keeps direct neighbours of hits."""
    keep = (F.col("type") == "paper") | (F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    if types:
        keep = keep & F.col("type").isin(*types)
    passed = nodes.filter(keep)
    usable = edges.filter(F.col("type").isin(*edge_types)) if edge_types else edges
    if needle:
        hits = passed.filter(F.contains(F.lower("label"), F.lit(needle.lower()))).select("id")
        near = both_ways(usable).join(hits.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("other").alias("id"))
        passed = passed.join(hits.unionByName(near).distinct(), "id", "left_semi")
    ids = passed.select("id")
    inside = usable.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return passed, inside


def collect_evidence(nodes: DataFrame) -> DataFrame:
    """Evidence of nodes(doc_id, pos, evidence array<struct<id, text>>), distinct by id, blank text dropped."""
    rows = nodes.select("doc_id", "pos", F.posexplode("evidence").alias("i", "e")).filter(F.trim("e.text") != "")
    return keep_first(
        rows.select("doc_id", F.col("e.id").alias("evidence_id"), F.col("e.text").alias("text"), "pos", "i"),
        ["doc_id", "evidence_id"], [F.col("pos"), F.col("i")],
    ).select("doc_id", "evidence_id", "text")


def merge_properties(rows: DataFrame, keys: tuple[str, ...] = ("id",), deal: tuple[str, ...] | None = None) -> DataFrame:
    """Node rows(keys, pos, label, props map): later fields win, property maps merge by key.

    ``deal`` names the keys that rows are dealt by, all unless given: those a join behind asks for spare it another exchange.
    """
    types = {f.name: f.dataType for f in rows.schema}
    key, value = types["props"].keyType, types["props"].valueType
    entries = F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.lit(None).cast(types["label"]).alias("l")))
    # The label travels as the entry without a name.
    label = F.array(F.struct(F.lit(None).cast(key).alias("k"), F.lit(None).cast(value).alias("v"), F.col("label").alias("l")))
    # Rows are dealt once and by the keys alone, before they become entries; both aggregations stay in that dealing.
    dealt = rows.select(*keys, "pos", "label", "props").repartition(*(deal or keys))
    each = dealt.select(*keys, "pos", F.inline(F.concat(label, F.coalesce(entries, F.array().cast(f"array<struct<k:{key.simpleString()},v:{value.simpleString()},l:{types['label'].simpleString()}>>")))))
    last = each.groupBy(*keys, "k").agg(F.max_by("v", "pos").alias("v"), F.max_by("l", "pos").alias("l"))
    found = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    merged = last.groupBy(*keys).agg(F.any_value("l", True).alias("label"), F.sort_array(found).alias("_found"))
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return merged.select(*keys, "label", F.when(named & (F.size("_found") > 0), F.map_from_entries("_found")).alias("props"))


# Edge from the document by claim type, and typed nodes.
CLAIM_EDGES = {
    "method": "uses", "tool": "uses_tool", "sample": "evaluated_on", "data_source": "evaluated_on",
    "problem": "has_problem", "definition": "defines", "result": "reports", "metric": "reports",
}
TYPED_NODES = {"method": "method", "tool": "tool", "data_source": "dataset", "sample": "sample", "metric": "metric"}


def build_graph(claims: DataFrame, concepts: DataFrame, ontology: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every document from its valid claims and resolved concepts.

    ``ontology`` is (concepts, relations, ancestors): a concept found in it brings its relations and the chain of its
    ancestors into the document's graph, each end a node with its label and domain.

    Claims that name one node merge their properties, later claims win; of equal edges the
    first claim's stays.

    claims(doc_id, id, type, object, value, metric, confidence, evidence_id);
    concepts(doc_id, rank, norm, term, score, concept_id, label).
    """
    from lectern.functions import text as T

    paper = F.concat(F.lit("paper:"), F.col("doc_id").cast("string"))
    claim_id = F.concat(F.lit("claim:"), F.col("id"))
    edge = F.lit("contains")
    for kind, name in CLAIM_EDGES.items():
        edge = F.when(F.col("type") == kind, name).otherwise(edge)
    typed = F.create_map(*[F.lit(x) for pair in TYPED_NODES.items() for x in pair])
    prefix = F.try_element_at(typed, F.col("type"))
    slug = T.slugify(F.col("object"), "_")
    typed_id = F.concat(prefix, F.lit(":"), slug)
    value = F.col("value").cast("string")

    # A claim's id ends with its number in the document.
    number = F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("int")

    def place(stage, order):
        return F.struct(F.lit(stage).alias("stage"), order.cast("int").alias("order")).alias("pos")

    def node(ident, kind, label, props, pos):
        return [F.col("doc_id"), ident.alias("id"), kind.alias("type"), label.alias("label"), props.alias("props"), pos]

    def props(**fields):
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    def link(src, kind, dst, weight, evidence, pos):
        return [F.col("doc_id"), src.alias("src"), kind.alias("type"), dst.alias("dst"), weight.alias("weight"), evidence.alias("evidence_id"), pos]

    papers = claims.select("doc_id").unionByName(concepts.select("doc_id")).distinct()
    nodes = papers.select(*node(paper, F.lit("paper"), F.lit("Document"), props(noteId=F.col("doc_id")), place(0, F.lit(0))))
    nodes = nodes.unionByName(
        claims.select(
            *node(
                claim_id, F.when(F.col("type") == "result", "result").otherwise("claim"), F.col("object"),
                props(claimType=F.col("type"), numericValue=value, metric=F.col("metric"), confidence=F.col("confidence")), place(1, number),
            )
        )
    )
    with_type = claims.filter(prefix.isNotNull())
    nodes = nodes.unionByName(
        with_type.select(*node(typed_id, prefix, F.col("object"), props(value=value, metric=F.col("metric")), place(2, number)))
    )
    local = F.concat(F.lit("local-"), T.slugify(F.col("norm"), "_"))
    concept = F.concat(F.lit("concept:"), F.coalesce(F.col("concept_id"), local))
    nodes = nodes.unionByName(
        concepts.select(
            *node(concept, F.lit("concept"), F.coalesce("label", "term"), props(status=F.when(F.col("concept_id").isNull(), "document_local").otherwise("ontology"), score=F.col("score"), rawInput=F.col("term")), place(3, F.col("rank")))
        )
    )
    weight, evidence = F.col("confidence"), F.col("evidence_id")
    edges = claims.select(*link(paper, edge, claim_id, weight, evidence, place(1, number)))
    edges = edges.unionByName(with_type.select(*link(paper, edge, typed_id, weight, evidence, place(2, number))))
    edges = edges.unionByName(with_type.select(*link(claim_id, F.lit("supports"), typed_id, weight, evidence, place(2, number))))
    edges = edges.unionByName(
        concepts.select(*link(paper, F.lit("mentions"), concept, F.col("score"), F.lit(None).cast("string"), place(3, F.col("rank"))))
    )
    if ontology is not None:
        known, relations, ancestors = ontology
        found = concepts.filter(F.col("concept_id").isNotNull()).select("doc_id", "concept_id")
        # Edges and nodes both read the context.
        context = stored(ontology_context(found, known, relations, ancestors), "context")
        prefixed = lambda c: F.concat(F.lit("concept:"), F.col(c))
        # A concept's own relation comes before the same edge of a chain.
        late = place(4, F.when(F.col("weight") == RELATION_WEIGHT, 0).otherwise(1))
        edges = edges.unionByName(context.select(*link(prefixed("src"), F.col("type"), prefixed("dst"), F.col("weight"), F.lit(None).cast("string"), late)))
        ends = context.select("doc_id", F.explode(F.array("src", "dst")).alias("concept_id")).unionByName(found).distinct()
        named = ends.join(known.select(F.col("id").alias("concept_id"), F.col("label").alias("own_label"), "domain"), "concept_id")
        nodes = nodes.unionByName(named.select(*node(prefixed("concept_id"), F.lit("concept"), F.col("own_label"), props(domain=F.col("domain")), place(4, F.lit(0)))))
    merged = merge_properties(nodes, ("doc_id", "id", "type"), ("doc_id", "id")).select("doc_id", "id", "type", "label", "props")
    # Edges of one target are dealt together, as nodes are: few are equal, so sorting them before the exchange combined next to nothing.
    return merged, keep_first(edges.repartition("doc_id", "dst"), ["doc_id", "src", "type", "dst"], [F.col("pos")]).drop("pos")


# Names that document facts use, so concept relations are prefixed.
RESERVED = ("paper", "method", "dataset", "accuracy", "solves", "mentions", "claim", "result", "metric", "sample", "tool", "problem")


def graph_to_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """facts(doc_id, functor, args) by edge type and node type; concept edges keep their relation name."""
    n = nodes.select("doc_id", F.col("id").alias("dst"), F.col("type").alias("_t"), F.col("label").alias("_l"), "props")
    j = edges.join(n, ["doc_id", "dst"])
    doc = F.col("doc_id").cast("string")
    own = F.col("src") == F.concat(F.lit("paper:"), doc)
    slug = F.regexp_replace("dst", "^[^:]*:", "")
    kind, t = F.col("type"), F.col("_t")

    def prop(k):
        return F.try_element_at("props", F.lit(k))

    def fact(name, *args):
        return F.struct(F.lit(name).alias("functor"), F.array(*args).alias("args"))

    accuracy = F.lower(F.coalesce(prop("metric"), F.col("_l"))) == "accuracy"
    unknown, unspecified = F.lit("unknown"), F.lit("unspecified")
    value, number = prop("value"), prop("numericValue")
    claim_kind = F.coalesce(prop("claimType"), t)
    claim_fact = fact("claim", doc, claim_kind, slug)
    listed = (
        F.when((kind == "uses") & (t == "method"), F.array(fact("method", doc, slug)))
        .when(kind.isin("trained_on", "evaluated_on") & (t == "dataset"), F.array(fact("dataset", doc, slug)))
        .when((kind == "evaluated_on") & (t == "sample"), F.array(fact("sample", doc, slug, F.coalesce(value, unknown))))
        .when((kind == "uses_tool") & (t == "tool"), F.array(fact("tool", doc, slug)))
        .when(kind == "has_problem", F.array(fact("problem", doc, slug)))
        .when((kind == "mentions") & (t == "concept"), F.array(fact("mentions", doc, slug)))
        .when((kind == "achieves") & (t == "metric") & value.isNotNull(), F.array(fact("accuracy", doc, value)))
        .when(
            (kind == "reports") & (t == "metric"),
            F.when(accuracy & value.isNotNull(), F.array(fact("metric", doc, slug), fact("accuracy", doc, value))).otherwise(
                F.array(fact("metric", doc, slug))
            ),
        )
        .when(
            kind.isin("reports", "contains") & (t == "result"),
            F.concat(
                F.array(claim_fact, fact("result", doc, slug, F.coalesce(number, unknown), F.coalesce(prop("metric"), unspecified))),
                F.when((F.lower(prop("metric")) == "accuracy") & number.isNotNull(), F.array(fact("accuracy", doc, number))).otherwise(
                    F.filter(F.array(claim_fact), lambda x: F.lit(False))
                ),
            ),
        )
        .when(kind.isin("reports", "contains") & (t == "claim"), F.array(claim_fact))
    )
    source = F.regexp_replace("src", "^[^:]*:", "")
    name = F.when(kind.isin(*RESERVED), F.concat(F.lit("concept_"), kind)).otherwise(kind)
    related = F.when(~own & (source != slug), F.array(F.struct(name.alias("functor"), F.array(source, slug).alias("args"))))
    # One join for both: nodes are merged and dealt once.
    stated = j.select("doc_id", F.inline(F.when(own, listed).otherwise(related)))
    papers = nodes.filter(F.col("type") == "paper").select("doc_id", F.lit("paper").alias("functor"), F.array(doc).alias("args"))
    return papers.unionByName(stated).distinct()

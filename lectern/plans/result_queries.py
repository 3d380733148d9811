"""Stored results: orders as analysed documents, their parts as concepts and their suppliers as methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import nlp
from lectern.plans.registry import query
from lectern.session import stored
from lectern.sources import results as R
from lectern.sources import tables as S

_KINDS = [*R.MATCH_TYPES, "guessed"]


def analysed(spark, sf):
    """In-memory results: one match per line, one node per supplier, an edge from the document to each."""
    li = S.table(spark, sf, "lineitem")
    part = F.col("l_partkey").cast("string")
    match = F.struct(
        F.col("l_linenumber"), F.struct(F.concat(F.lit("part-"), part).alias("id"), F.concat(F.lit("Part "), part).alias("label")).alias("concept"),
        (F.col("l_linenumber") / 10).alias("confidence"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 6 + 1).cast("int")).alias("match_type"),
        F.col("l_returnflag").alias("raw_input"),
    )
    lines = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sort_array(F.collect_list(match)).alias("m"), F.sort_array(F.collect_set("l_suppkey")).alias("s"), F.max("l_shipdate").alias("processed_at")
    )
    paper = F.concat(F.lit("paper:"), F.col("doc_id").cast("string"))
    name = lambda k: F.concat(F.lit("supplier:"), k.cast("string"))
    node = lambda ident, kind: F.struct(ident.alias("id"), F.lit(kind).alias("type"), F.upper(ident).alias("label"))
    every = F.concat(F.array(node(paper, "paper")), F.transform("s", lambda k: node(name(k), "method")))
    edges = F.transform("s", lambda k: F.struct(paper.alias("from"), name(k).alias("to"), F.lit("uses").alias("type"), F.lit(0.5).alias("weight")))
    return lines.select(
        "doc_id", F.transform("m", lambda m: F.struct(m["concept"], m["confidence"], m["match_type"], m["raw_input"])).alias("ontology"),
        F.struct(F.map_from_entries(F.transform(every, lambda n: F.struct(n["id"].alias("key"), n.alias("value")))).alias("nodes"), edges.alias("edges")).alias("graph"),
        F.transform("s", lambda k: F.concat(F.lit("method("), k.cast("string"), F.lit(")"))).alias("facts"),
        F.lit(0.75).alias("confidence"), F.col("processed_at").cast("string").alias("processed_at"),
    )


def mixed(spark, sf):
    """The same results as rows of different ages: lists, maps, nested concepts, wrong types, missing parts."""
    shape = F.col("doc_id") % 6
    rows = analysed(spark, sf)
    text = lambda c: F.to_json(c)
    nodes = F.when(shape.isin(0, 3), text(F.map_values("graph.nodes"))).when(shape.isin(1, 4), text(F.col("graph.nodes"))).when(shape == 2, F.lit('"none"'))
    edges = F.when(shape == 4, text(F.struct("graph.edges"))).otherwise(text("graph.edges"))
    graph = F.when(shape == 5, "null").otherwise(F.concat(F.lit('{"nodes":'), F.coalesce(nodes, F.lit("null")), F.lit(',"edges":'), edges, F.lit("}")))
    flat = F.transform("ontology", lambda m: F.struct(m["concept"]["id"].alias("conceptId"), m["confidence"], m["match_type"].alias("matchType"), m["raw_input"].alias("rawInput")))
    nested = F.transform("ontology", lambda m: F.struct(F.lit(7).alias("conceptId"), m["concept"], m["match_type"].alias("matchType"), F.lit("high").alias("confidence")))
    matches = F.when(shape.isin(0, 1), text(flat)).when(shape.isin(2, 3), text(nested)).when(shape == 4, text(F.struct(flat.alias("list"))))
    matches = F.coalesce(matches, F.lit('[1, {"conceptId":""}, {"conceptId":"kept"}, null, {"concept":{"label":"no id"}}]'))
    whole = F.concat(F.lit('{"graph":'), graph, F.lit(',"ontologyMatches":'), matches, F.lit("}"))
    return rows.select("doc_id", F.parse_json(whole).alias("result"))


_A = f"""li AS (SELECT l_orderkey AS doc_id, l_linenumber AS no, 'part-' || l_partkey AS concept_id, 'Part ' || l_partkey AS label,
 list_extract({_KINDS}, CAST(l_partkey % 6 + 1 AS BIGINT)) AS kind, l_returnflag AS raw_input FROM lineitem),
su AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS s FROM lineitem),
no AS (SELECT DISTINCT doc_id, 'paper:' || doc_id AS id, 'paper' AS type, 'PAPER:' || doc_id AS label FROM su UNION ALL SELECT doc_id, 'supplier:' || s, 'method', 'SUPPLIER:' || s FROM su),
ed AS (SELECT doc_id, 'paper:' || doc_id AS src, 'uses' AS type, 'supplier:' || s AS dst FROM su)"""


@query(
    "result_serialize",
    f"""WITH {_A}, m AS (SELECT doc_id, string_agg(concept_id || '/' || kind || '/' || raw_input || '/' || no, ';' ORDER BY no, concept_id, raw_input) AS matches FROM li GROUP BY 1),
n AS (SELECT doc_id, string_agg(id || '/' || type || '/' || label, ';' ORDER BY id) AS nodes FROM no GROUP BY 1),
e AS (SELECT doc_id, string_agg(src || '>' || dst || '/' || type, ';' ORDER BY dst) AS edges FROM ed GROUP BY 1),
f AS (SELECT doc_id, string_agg('method(' || s || ')', ';' ORDER BY s) AS facts FROM su GROUP BY 1),
p AS (SELECT l_orderkey AS doc_id, strftime(max(l_shipdate), '%Y-%m-%d') AS processed_at FROM lineitem GROUP BY 1)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS note_id, 'complete' AS stage, CAST(0.75 AS DOUBLE) AS confidence, matches, nodes, edges, facts, processed_at
FROM m JOIN n USING (doc_id) JOIN e USING (doc_id) JOIN f USING (doc_id) JOIN p USING (doc_id)""",
)
def result_serialize(spark, sf):
    """Results written as one VARIANT column and read back typed."""
    v = F.col("result")
    read = stored(R.result_serialize(analysed(spark, sf)), "results").select(
        "doc_id", F.variant_get(v, "$.noteId", "string").alias("note_id"), F.variant_get(v, "$.stage", "string").alias("stage"),
        F.variant_get(v, "$.confidence", "double").alias("confidence"),
        F.variant_get(v, "$.ontologyMatches", "array<struct<conceptId string, matchType string, rawInput string, confidence double>>").alias("m"),
        F.variant_get(v, "$.graph.nodes", "array<struct<id string, type string, label string>>").alias("n"),
        F.variant_get(v, "$.graph.edges", "array<struct<`from` string, `to` string, type string>>").alias("e"),
        F.variant_get(v, "$.prologFacts", "array<string>").alias("f"), F.substring(F.variant_get(v, "$.processedAt", "string"), 1, 10).alias("processed_at"),
    )
    tenth = lambda m: F.round(m["confidence"] * 10).cast("int").cast("string")
    matches = F.transform("m", lambda m: F.concat_ws("/", m["conceptId"], m["matchType"], m["rawInput"], tenth(m)))
    return read.select(
        "doc_id", "note_id", "stage", "confidence", F.array_join(matches, ";").alias("matches"),
        F.array_join(F.array_sort(F.transform("n", lambda n: F.concat_ws("/", n["id"], n["type"], n["label"]))), ";").alias("nodes"),
        F.array_join(F.array_sort(F.transform("e", lambda e: F.concat(e["from"], F.lit(">"), e["to"], F.lit("/"), e["type"]))), ";").alias("edges"),
        F.array_join("f", ";").alias("facts"), "processed_at",
    )


@query(
    "graph_normalize_read",
    f"""WITH {_A}, n AS (SELECT doc_id, string_agg(id || '/' || type || '/' || label, ';' ORDER BY id) AS nodes FROM no WHERE doc_id % 6 IN (0, 1, 3, 4) GROUP BY 1),
e AS (SELECT doc_id, string_agg(src || '>' || dst || '/' || type, ';' ORDER BY dst) AS edges FROM ed WHERE doc_id % 6 NOT IN (4, 5) GROUP BY 1)
SELECT doc_id, coalesce(nodes, '') AS nodes, coalesce(edges, '') AS edges FROM (SELECT DISTINCT doc_id FROM su) LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)""",
)
def graph_normalize_read(spark, sf):
    """Nodes and edges of every stored graph, whichever shape its row has."""
    g = R.normalize_graph(R.member(F.col("result"), "$.graph"))
    read = stored(mixed(spark, sf), "mixed-results").select("doc_id", g.alias("g"))
    node = lambda n: F.concat_ws("/", *[R.text_member(n, f"$.{k}") for k in ("id", "type", "label")])
    edge = lambda e: F.concat(R.text_member(e, "$.from"), F.lit(">"), R.text_member(e, "$.to"), F.lit("/"), R.text_member(e, "$.type"))
    return read.select(
        "doc_id", F.array_join(F.array_sort(F.transform("g.nodes", node)), ";").alias("nodes"), F.array_join(F.array_sort(F.transform("g.edges", edge)), ";").alias("edges")
    )


@query(
    "stored_graph_rows",
    f"WITH {_A} SELECT doc_id, src, ed.type AS type, dst, label, CAST(0.5 AS DOUBLE) AS weight FROM ed JOIN no USING (doc_id) WHERE no.id = dst AND doc_id % 6 IN (0, 1, 3)",
)
def stored_graph_rows(spark, sf):
    """Edges of the stored graphs with the label of their target."""
    nodes, edges = R.graph_rows(stored(mixed(spark, sf), "mixed-results"))
    labels = nodes.select("doc_id", F.col("id").alias("dst"), "label")
    return edges.join(labels, ["doc_id", "dst"]).select("doc_id", "src", "type", "dst", "label", "weight")


@query(
    "ontology_normalize_read",
    f"""WITH {_A} SELECT doc_id, CAST(no - 1 AS INTEGER) AS pos, concept_id, CASE WHEN kind = 'guessed' THEN 'unknown' ELSE kind END AS match_type,
 CASE WHEN doc_id % 6 < 2 THEN raw_input ELSE label END AS raw_input, CASE WHEN doc_id % 6 < 2 THEN round(line / 10.0, 6) ELSE 0 END::DOUBLE AS confidence
 FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY no, concept_id, raw_input) AS no), no AS line FROM li) WHERE doc_id % 6 < 4
 UNION ALL SELECT doc_id, 0, 'kept', 'unknown', '', 0.0::DOUBLE FROM (SELECT DISTINCT doc_id FROM su) WHERE doc_id % 6 = 5""",
)
def ontology_normalize_read(spark, sf):
    """Matches of every stored result, whichever shape its row has."""
    read = stored(mixed(spark, sf), "mixed-results").select("doc_id", F.posexplode(R.normalize_ontology(R.member(F.col("result"), "$.ontologyMatches"))).alias("pos", "m"))
    return read.select("doc_id", "pos", "m.concept_id", "m.match_type", "m.raw_input", F.round("m.confidence", 6).alias("confidence"))


@query(
    "max_normalise",
    """WITH t AS (SELECT o_custkey AS doc_id, max(o_totalprice - 100000) AS top FROM orders GROUP BY 1)
SELECT o_orderkey AS item, o_custkey AS doc_id, round(CAST(o_totalprice - 100000 AS DOUBLE) / greatest(CAST(top AS DOUBLE), 0.0001), 6) AS score FROM orders JOIN t ON t.doc_id = o_custkey""",
)
def max_normalise(spark, sf):
    """Orders scored against the best of their customer; some customers have no positive score."""
    scored = S.owned_items(spark, sf).select(F.col("id").alias("item"), F.col("user_id").alias("doc_id"), (F.col("score") - 100000).cast("double").alias("score"))
    return nlp.max_normalise(scored, "doc_id", "score").select("item", "doc_id", F.round("score", 6).alias("score"))

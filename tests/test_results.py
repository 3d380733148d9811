"""Stored results of every shape."""

import json

from pyspark.sql import functions as F

from lectern.session import stored
from lectern.sources import results

ROWS = {
    1: {"graph": {"nodes": [{"id": "b"}, {"id": "a", "type": "t", "label": 3}], "edges": [{"from": "a", "to": "b", "type": "x", "weight": 1}]}},
    2: {"graph": {"nodes": {"k2": {"id": "z"}, "k1": {"id": "y"}}, "edges": {"0": {"from": "z", "to": "y"}}}},
    3: {"graph": {"nodes": "text"}}, 4: {"graph": []}, 5: {}, 6: {"graph": {"nodes": [1, None, {"type": "no id"}], "edges": [{"from": "a"}, {"from": "p", "to": "q"}]}},
}
MATCHES = {
    1: [{"conceptId": "a", "confidence": 0.5, "matchType": "exact", "rawInput": "A"}, {"concept": {"id": "b", "label": "Bee"}, "confidence": 1}],
    2: [{"conceptId": 7, "concept": {"id": "c"}, "matchType": "odd", "confidence": "0.9"}, {"conceptId": "", "concept": {"id": "gone"}}, "text", None, {}],
    3: {"conceptId": "a"}, 4: [{"conceptId": "d", "concept": "text", "rawInput": 5, "matchType": None}], 5: None, 6: [],
}


def variants(spark, rows):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [(9, None)], "doc_id long, j string")
    return stored(df.select("doc_id", F.try_parse_json("j").alias("result")), "test-results")


def test_graphs(spark):
    nodes, edges = results.graph_rows(variants(spark, ROWS))
    assert sorted((r["doc_id"], r["pos"], r["id"], r["type"], r["label"]) for r in nodes.collect()) == [(1, 0, "b", None, None), (1, 1, "a", "t", None), (2, 0, "y", None, None), (2, 1, "z", None, None)]
    assert sorted((r["doc_id"], r["src"], r["dst"], r["weight"]) for r in edges.collect()) == [(1, "a", "b", 1.0), (6, "p", "q", None)]
    empty = variants(spark, ROWS).select("doc_id", results.normalize_graph(results.member(F.col("result"), "$.graph")).alias("g"))
    assert {r["doc_id"]: (len(r["g"]["nodes"]), len(r["g"]["edges"])) for r in empty.collect()} == {1: (2, 1), 2: (2, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (3, 2), 9: (0, 0)}


def test_matches(spark):
    got = {r["doc_id"]: [tuple(m) for m in r["m"]] for r in variants(spark, MATCHES).select("doc_id", results.normalize_ontology(F.col("result")).alias("m")).collect()}
    assert got == {
        1: [("a", 0.5, "exact", "A"), ("b", 1.0, "unknown", "Bee")], 2: [("c", 0.0, "unknown", "")], 3: [],
        4: [("d", 0.0, "unknown", "")], 5: [], 6: [], 9: [],
    }


def test_what_is_written_is_read_back(spark):
    kinds = "ontology array<struct<concept:struct<id:string,label:string>,confidence:double,match_type:string,raw_input:string>>"
    graph = "graph struct<nodes:map<string,struct<id:string,type:string>>,edges:array<struct<`from`:string,`to`:string>>>"
    rows = [
        (1, [(("c", "C"), 0.6, "fuzzy", "see")], ({"n": ("n", "x")}, [("n", "m")]), ["f(a)"], 0.5, "2026-01-01", {"missing": 2}),
        (2, None, None, None, None, None, None), (3, [], ({}, []), [], 0.0, "", {}),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, {kinds}, {graph}, facts array<string>, confidence double, processed_at string, gaps map<string,int>")
    back = stored(results.result_serialize(df), "test-results")
    v = F.col("result")
    read = back.select("doc_id", F.variant_get(v, "$.gaps.missing", "int").alias("gap"), results.normalize_ontology(results.member(v, "$.ontologyMatches")).alias("m"), F.variant_get(v, "$.stage", "string").alias("stage"))
    got = {r["doc_id"]: r for r in read.collect()}
    assert got[1]["gap"] == 2 and tuple(got[1]["m"][0]) == ("c", 0.6, "fuzzy", "see") and {r["stage"] for r in got.values()} == {"complete"}
    assert got[2]["m"] == got[3]["m"] == []
    nodes, edges = results.graph_rows(back)
    assert [(r["doc_id"], r["id"]) for r in nodes.collect()] == [(1, "n")] and [(r["doc_id"], r["src"], r["dst"]) for r in edges.collect()] == [(1, "n", "m")]

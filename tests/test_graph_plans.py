"""Exchanges of the graph's steps: what they write to disk grows with them."""

from lectern.operators import graph


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_properties_merge_in_one_exchange(spark):
    rows = [("a", 1, "old", {"x": "1", "y": "2"}), ("a", 2, None, {"y": "3"}), ("b", 1, "b", {}), ("c", 5, "c", None), (None, 1, "none", {"x": "4"}), ("d", 1, "first", {"z": None})]
    df = spark.createDataFrame(rows, "id string, pos int, label string, props map<string,string>").repartition(3)
    merged = graph.merge_properties(df.localCheckpoint())
    planned = exchanges(merged)
    got = {r["id"]: (r["label"], r["props"]) for r in merged.collect()}
    assert got == {"a": (None, {"x": "1", "y": "3"}), "b": ("b", None), "c": ("c", None), None: ("none", None), "d": ("first", {"z": None})}
    assert planned == 1


def test_facts_read_nodes_once(spark):
    claims = [(1, "c-1", "method", "Net", 3.0, None, 0.5, "e"), (1, "c-2", "result", "Good", 97.0, "accuracy", 0.6, "e"), (2, "c-3", "metric", "accuracy", 81.0, "accuracy", 0.7, "e")]
    claims = spark.createDataFrame(claims, "doc_id long, id string, type string, object string, value double, metric string, confidence double, evidence_id string").localCheckpoint()
    concepts = spark.createDataFrame([(1, 0, "deep net", "Deep Net", 0.4, "net", "Net")], "doc_id long, rank int, norm string, term string, score double, concept_id string, label string").localCheckpoint()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nodes, edges = graph.build_graph(claims, concepts)
        facts = graph.graph_to_facts(nodes, edges)
        planned = exchanges(facts)
        got = sorted((r["doc_id"], r["functor"], tuple(r["args"])) for r in facts.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [
        (1, "accuracy", ("1", "97.0")), (1, "claim", ("1", "result", "c-2")), (1, "mentions", ("1", "net")), (1, "method", ("1", "net")), (1, "paper", ("1",)),
        (1, "result", ("1", "c-2", "97.0", "accuracy")), (1, "supports", ("c-1", "net")), (2, "accuracy", ("2", "81.0")), (2, "claim", ("2", "metric", "c-3")),
        (2, "metric", ("2", "accuracy")), (2, "paper", ("2",)), (2, "supports", ("c-3", "accuracy")),
    ]
    # Nodes, edges, the facts; papers are distinct documents and merged for themselves.
    assert planned <= 6

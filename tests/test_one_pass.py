"""Sentences read in one Arrow pass: tokens, scores, phrases and key words as their separate operators give them; headers among short lines alone."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import cleaning, nlp

TERMS = {"METHOD": ["neural network", "of the", "random forest model"], "METRIC": ["learning"], "TOOL": ["in"]}
TEXTS = [
    "Deep neural network of the random forest model, was learned in 12.5% of cases. Deep neural network NN (AB) isn't K-means in The Forest. "
    "The deep neural networks are learning quickly; deep Neural Network models and random forest model again.",
    "One sentence of twenty signs alone.", "", None, "Ünïcode words of the Straße 100 and MP3 files use 5a 7.% well-known forms- always. Straße words of the forms again, 3.14 times.",
]


def _docs(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return rows.select("doc_id", nlp.plain_sentences(F.col("text")).alias("sentences")).repartition(1)


def test_one_pass_gives_what_the_operators_give(spark):
    docs = _docs(spark)
    read = nlp.annotate(docs, TERMS, scores=True, phrases="phrases", words="words")
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r for r in read.collect()}
    apart = nlp.with_key_phrases(nlp.with_scores(nlp.annotate(docs, TERMS)), TERMS)
    tagged = F.transform("sentences", lambda s: T.tagged_tokens(s["text"]))
    sets = nlp.overlap_scores(F.transform("sentences", lambda s: T.word_set(s["text"])))
    for r in apart.select("*", tagged.alias("tagged"), nlp.keywords(F.col("sentences")).alias("words"), sets.alias("sets")).collect():
        own = got[r["doc_id"]]
        assert own["sentences"] == r["sentences"] and own["phrases"] == r["phrases"] and own["words"] == r["words"]
        assert (own["sentences"] and [s["tokens"] for s in own["sentences"]]) == r["tagged"]
        assert (own["sentences"] and [s["score"] for s in own["sentences"]]) == r["sets"]
    assert got[3]["sentences"] is None and ("deep neural", 4) in [(p["value"], p["n"]) for p in got[0]["phrases"]]
    assert ("neural network", 15) in [(p["value"], p["n"]) for p in got[0]["phrases"]]


def test_large_documents_score_the_same_by_either_way(spark, monkeypatch):
    from lectern.operators import terms

    docs = [[f"words number {i % 7} and {i % 3} stand with others{i % 5} here" for i in range(40)]]
    import pyarrow as pa

    read = lambda: terms.Batch(pa.array(docs), terms.reader(())).scores().to_pylist()
    dense = read()
    monkeypatch.setattr(terms, "DENSE", 0)
    assert read() == dense


def test_header_lines_are_joined_once(spark):
    lines = spark.createDataFrame([("a", 1, "head"), ("a", 2, "head"), ("b", 3, "head"), ("a", 4, "line"), ("a", 5, None)], "unit string, n int, line_key string")
    headers = spark.createDataFrame([("a", "head"), ("b", "none")], "unit string, line_key string")
    kept = cleaning.first_header_only(lines, headers, "unit", ["n"])
    assert {r["n"] for r in kept.collect()} == {1, 3, 4, 5}
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_line_keys_number_only_whole_numbers(spark):
    rows = ["Page 12 of 30", "subpage 3", "page 4a page 5", "a1 1a 22 3_ -4- 5.6", "Page 7", "no digits"]
    keys = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(T.line_key(F.col("x"))).collect()]
    assert keys == ["page # of #", "subpage #", "page 4a page #", "a1 1a # 3_ -#- #.#", "page #", "no digits"]


def test_walk_graphs_join_their_tables_once(spark, tmp_path):
    from lectern.plans.walk_queries import graphs

    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 4, 5), (1, 4, 5), (3, 5, 6), (2, 2, 9)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges = graphs(spark, str(tmp_path))
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, edges.collect())) == sorted(
        [(7, "order:000000001", "supplier:4")] * 2 + [(7, "supplier:4", "part:5")] * 2 + [(8, "order:000000003", "supplier:5"), (8, "supplier:5", "part:6")]
    )
    assert {(r["doc_id"], r["id"], r["type"]) for r in nodes.collect()} == {
        (7, "order:000000001", "order"), (7, "order:000000002", "order"), (8, "order:000000003", "paper"),
        (7, "supplier:4", "supplier"), (7, "part:5", "part"), (8, "supplier:5", "supplier"), (8, "part:6", "part"),
    }

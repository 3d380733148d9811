"""Queries that once left out part of their table or of their operator's work."""

from pyspark.sql import functions as F

from lectern.operators import cleaning
from lectern.plans import catalog


def test_bfs_documents_walks_over_every_line(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 4, 5), (1, 5, 6), (2, 5, 7), (2, 6, 8), (3, 3, 9), (3, None, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.queries()["bfs_documents"](spark, str(tmp_path)).collect()}
    assert got == {
        (7, "order:000000001", 0), (7, "supplier:4", 1), (7, "supplier:5", 1), (7, "part:5", 2), (7, "part:6", 2), (7, "part:7", 2), (7, "order:000000002", 2), (7, "supplier:6", 3),
        (8, "order:000000003", 0), (8, "supplier:3", 1), (8, "part:9", 2),
    }
    assert "% 3" not in catalog.oracles()["bfs_documents"]


def test_clean_document_judges_every_page_and_keeps_spans_and_counts(spark, tmp_path):
    text = "\n".join(["Some plain words stand here.", "12", "More words [3] follow.", "\ufffd\ufffd\ufffd\ufffd broken \ufffd\ufffd\ufffd", "Last line of a page.", "Second page, first line."])
    spark.createDataFrame([(1, text, "a"), (2, None, "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalog.queries()["clean_document"](spark, str(tmp_path)).collect()}
    one, pages = rows[1], rows[1]["source_pages"]
    assert one["pages"] == len(pages) == 2 and one["stats"]["page_numbers"] == 1 and one["stats"]["citations"] == 1
    assert [one["display_text"][p["start"] : p["end"]] for p in pages] == [p["display_text"] for p in pages]
    laid = [(cleaning.normalise_layout(F.lit(t), a)) for t, a in (("\n".join(x for x in text.split("\n")[:5] if x != "12"), False), ("Second page, first line.", False))]
    want = spark.range(1).select(*[cleaning.reliable(t)["quality"].alias(f"q{i}") for i, t in enumerate(laid)]).first()
    assert [p["display_quality"] for p in pages] == list(want)
    assert pages[0]["analysis_quality"]["score"] is not None and "Too little usable text remains after cleaning." in pages[1]["analysis_quality"]["warnings"]


def test_extract_knowledge_returns_claims_concepts_and_every_headline_field(spark, tmp_path):
    text = "We saw that the thing stands in the middle of the road. Nobody in the town was the owner of it. The thing was in the town from the first day of the year. Und die Sache this is what comes in the end."
    spark.createDataFrame([(1, text, "a"), (2, None, "a"), (3, "", "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalog.queries()["extract_knowledge"](spark, str(tmp_path)).collect()}
    one = rows[1]
    assert one["claims"] == len(one["claim_list"]) > 3 and {"contribution", "limitation", "future_work"} <= {c["type"] for c in one["claim_list"]}
    first = {k: [c["object"] for c in one["claim_list"] if c["type"] == k] for k in ("method", "data_source", "problem", "limitation", "future_work", "contribution")}
    assert (one["limitations"], one["future_work"], one["problem"]) == (first["limitation"][0], first["future_work"][0], first["problem"][0])
    assert one["contributed"].split("|") == first["contribution"] and one["contributions"] == len(first["contribution"])
    assert one["topic"] and one["keywords"].split("|")[0] == one["topic"]
    assert "in the" in {c["norm"] for c in one["concepts"]} and one["entities"].split("|") == [c["term"] for c in one["concepts"] if c["valid"]]
    assert rows[3]["topic"] is None and rows[3]["concepts"] == [] == rows[3]["claim_list"] and rows[3]["claims"] == 0

"""Pages whose shown and read text are one are cleaned once, and judged only where the judgement is read."""

from pyspark.sql import functions as F

from lectern.operators import cleaning


def test_page_readings(spark):
    page = "struct<page_no:int,raw_text:string>"
    same, cited = "A plain page of text.", "Seen before [3].\nReferences\nSome entry"
    docs = spark.createDataFrame([(1, "", [(1, same), (2, cited)])], f"doc_id int, raw_text string, pages array<{page}>")
    cleaned = cleaning.clean_documents(docs)
    plan = cleaned._jdf.queryExecution().analyzed().toString()
    row = cleaned.select(F.transform("source_pages", lambda p: F.struct(p["display_text"].alias("d"), p["analysis_text"].alias("a"))).alias("p")).first()["p"]
    assert [tuple(p) for p in row] == [(same, same), (cited, "Seen before.")]
    assert "unusual symbol ratio" not in plan

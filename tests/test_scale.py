"""Work per row that must not be done twice or grow with the square of a row, and tables that are folders."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import finance, grounding
from lectern.streaming import flow


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_amount_is_searched_once(spark):
    patterns = [("Seats", "seats", "once", "QQ([0-9]+)")]
    df = spark.createDataFrame([("It has QQ70 seats.", ["a", "It has qq70 seats."])], "text string, pages array<string>")
    found = df.select(F.explode(finance.amounts(F.col("text"), patterns, F.col("pages"))).alias("a"))
    # Once in the text and once in the match, where the number is read.
    assert plan(found).count("QQ([0-9]+)") == 2
    assert [(r["a"]["value"], r["a"]["evidence"], r["a"]["page"]) for r in found.collect()] == [(70.0, "It has QQ70 seats.", 2)]


@pytest.mark.parametrize("line", ["plain", " a  b\t", "a\x00b\x07", " x　", "x \u0085", "", "\t", "a � b", None])
def test_tidy_line_leaves_only_tidy_lines_alone(spark, line):
    x = F.col("l")
    whole = T.strip(F.regexp_replace(T.drop_unreadable(x), r"[ \t]+", " "))
    row = spark.createDataFrame([(line,)], "l string").select(T.tidy_line(x).alias("a"), whole.alias("b")).first()
    assert row["a"] == row["b"]


def test_draft_points_of_a_long_source(spark):
    points = [f"Sentence about wordnr{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} and thingsof{chr(97 + i % 26)}{chr(97 + i // 676)}x{chr(97 + i // 26 % 26)} here" for i in range(6000)]
    rows = [("Short", "foreign material unknown elsewhere", *points[:1], points[0].upper() + " ", *points[1:])]
    docs = spark.createDataFrame([(list(rows[0]), ". ".join(points))], "points array<string>, text string")
    begin = time.time()
    got = docs.select(grounding._first_grounded(F.col("points"), grounding.meaningful_tokens(F.col("text")), 10).alias("p")).first()["p"]
    assert got == points[:10] and time.time() - begin < 20


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "b").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "b" / "documents.parquet")
    (tmp_path / "b" / "documents.parquet.old").write_text("not a table")
    for sf in ("a", "b"):
        assert flow.drain(flow.file_stream(spark, f"{tmp_path}/{sf}", "documents"), "t").count() == 20

"""Corpus-wide validation aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def metric_values(claims: DataFrame) -> DataFrame:
    """Distinct accuracy values per document and whether they contradict each other.

    Rows(doc_id, metric, value) reduce to distinct values before counting, so a
    document with very many claims combines on the map side.
    """
    accuracy = claims.filter((F.lower("metric") == "accuracy") & F.col("value").isNotNull())
    values = accuracy.select("doc_id", "value").distinct().groupBy("doc_id").agg(F.count("*").alias("values"))
    return values.withColumn("contradiction", F.when(F.col("values") > 1, 1).otherwise(0))

"""Batch view of analysis progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.operators import rules


def status_join(notes: DataFrame, results: DataFrame, progress: DataFrame) -> DataFrame:
    """Stored result where there is one, else what live progress says."""
    r = results.select(
        F.col("note_id"), F.lit(True).alias("_has"), "stage", "error", "confidence"
    )
    joined = notes.select(F.col("id").alias("note_id")).join(r, "note_id", "left").join(
        progress.select("note_id", "state"), "note_id", "left"
    )
    has = F.col("_has").isNotNull()
    failed = F.col("error").isNotNull()
    done = (F.col("stage") == "complete") & ~failed
    state = F.coalesce("state", F.lit(""))
    return joined.select(
        "note_id",
        has.alias("exists_result"),
        "stage",
        F.when(has, done).otherwise(state == "complete").alias("is_complete"),
        F.when(has, failed).otherwise(state == "failed").alias("has_failed"),
        "confidence",
        F.when(has, rules.confidence_mode(F.when(done, F.col("confidence")))).alias("mode"),
    )

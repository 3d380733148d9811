"""Analysis progress from stage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The stages of an analysis in order.
STAGES = (
    "queued", "cleaning", "sectioning", "classification", "chunking", "nlp", "extraction", "validation", "ontology",
    "graph", "reasoning", "gaps", "confidence", "repair", "complete",
)
TTL_SECONDS = 3600


def snapshots(events: DataFrame) -> DataFrame:
    """Latest state per document from events(note_id, seq, stage, status, progress, message, ts)."""
    last = events.groupBy("note_id").agg(
        F.max_by(F.struct("seq", "stage", "status", "progress", "message", "ts"), F.struct("ts", "seq")).alias("e"),
        F.count("*").alias("events"),
    )
    running = F.col("e.status") == "running"
    done = (F.col("e.stage") == "complete") & (F.col("e.status") == "complete")
    state = F.when(F.col("e.status") == "failed", "failed").when(done, "complete").otherwise("running")
    return last.select(
        "note_id", state.alias("state"), F.col("e.stage").alias("current_stage"),
        F.when(running, F.greatest(F.lit(0), F.col("e.progress") - 3)).otherwise(F.col("e.progress")).alias("progress"),
        F.when(F.col("e.status") == "failed", F.col("e.message")).alias("error"),
        F.when(state.isin("failed", "complete"), F.col("e.ts")).alias("completed_at"), F.col("e.ts").alias("updated_at"), "events",
    )


def live(snaps: DataFrame, now) -> DataFrame:
    """Snapshots not older than one hour."""
    return snaps.filter(F.col("updated_at") > now - F.expr(f"INTERVAL {TTL_SECONDS} SECONDS"))


def stage_funnel(events: DataFrame) -> DataFrame:
    """Latest status per (document, stage), counted per stage in catalogue order."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    last = events.groupBy("note_id", "stage").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    return last.groupBy("stage", "status").agg(F.count("*").alias("documents")).withColumn("place", place)


def fold_stream(events: DataFrame, path: str, checkpoint: str):
    """Each micro-batch writes the newest event per document that it has; ``folded`` reads them as one table.

    A batch that runs again replaces its own folder, and no batch reads or rewrites another's.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def newest(events: DataFrame) -> DataFrame:
    """The last event per document, with map-side combine."""
    fields = [c for c in events.columns if c != "note_id"]
    return events.groupBy("note_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("e")).select("note_id", "e.*")


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The newest event per document over all batches so far."""
    return newest(spark.read.parquet(path).drop("epoch"))

"""Running streams to their current end, and the upload flow."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="lectern-stream-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream with the table's own schema.

    The path is a pattern: a plain one would have to be a folder, and a filter by name passes no file inside one.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}[.]parquet")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream's rows so far to parquet and read them back."""
    spark = stream.sparkSession
    out, mark = work_path(spark, name), work_path(spark, f"{name}-mark")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def usage_windows(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily counts per provider on a stream or table of usage rows; later rows are dropped."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    return timed.groupBy(F.window("created_at", "1 day"), "provider").agg(
        F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"), F.count_if(~F.col("success")).alias("failures")
    )


def current_windows(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The usage table after all rows so far: each batch adds the windows it changed, and a window's last version counts.

    Windows behind the watermark leave the state; rows that come later still are dropped.
    """
    spark = events.sparkSession
    out, mark = work_path(spark, "usage"), work_path(spark, "usage-mark")
    windows = usage_windows(events, lateness)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = windows.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    versions = spark.read.schema(StructType([*windows.schema.fields, StructField("epoch", LongType())])).parquet(out)
    values = [c for c in windows.columns if c not in ("window", "provider")]
    last = versions.groupBy("window", "provider").agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return last.select("window", "provider", "v.*")


def upload_flow(uploads: DataFrame, features: dict[str, Callable[[DataFrame], DataFrame]], name: str = "uploads") -> DataFrame:
    """New documents build every feature; a document that fails a feature is marked there alone.

    A feature gives (doc_id, items) and leaves ``items`` null for a document it cannot serve. An
    error of the job itself is no verdict on any document: the batch stops and runs again.
    """
    spark = uploads.sparkSession
    out, mark = work_path(spark, name), work_path(spark, f"{name}-mark")

    def build(batch: DataFrame, epoch: int) -> None:
        for feature, make in features.items():
            failed = F.col("items").isNull()
            made = make(batch).select(
                "doc_id", F.lit(feature).alias("feature"), F.when(failed, 0).otherwise(F.col("items")).alias("items"),
                F.when(failed, "failed").otherwise("ready").alias("status"),
            )
            made.write.mode("overwrite").parquet(f"{out}/feature_name={feature}/epoch={epoch}")

    query = uploads.writeStream.foreachBatch(build).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "feature", "items", "status")

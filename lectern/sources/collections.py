"""Collection scans and the append, upsert, patch and delete sinks.

Writes return the new table state as a DataFrame; the caller writes it to a new
location or partition, since Spark tables are replaced rather than edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern.schema import COLLECTIONS


def scan(spark: SparkSession, path: str, collection: str, fmt: str = "parquet") -> DataFrame:
    """Read a collection with its fixed schema; nothing is inferred."""
    return spark.read.schema(COLLECTIONS[collection]).format(fmt).load(path)


def conform(df: DataFrame, collection: str) -> DataFrame:
    """Rows in the fixed schema of a collection: its columns in order and type, null where ``df`` has none, others left out."""
    schema = StructType.fromDDL(COLLECTIONS[collection])
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key by aggregation: map-side combine means a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keyed_upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the newest version; on a tie the update wins."""
    both = base.withColumn("_rank", F.lit(0)).unionByName(updates.withColumn("_rank", F.lit(1)))
    newest = latest_per_key(both, [key], [F.col(version), F.col("_rank")])
    return newest.drop("_rank")


def failed_rows(failures: DataFrame, like: DataFrame, key: str, stage: str, reason: str) -> DataFrame:
    """Rows that record a failed analysis: stage and reason set, every payload column null."""
    keep = {key, "stage", "failed_stage", "failed_reason", "processed_at"}
    full = failures.withColumn("failed_stage", F.col(stage)).withColumn("failed_reason", F.col(reason)).withColumn(
        "stage", F.col(stage)
    )
    return full.select(
        *[
            (F.col(f.name) if f.name in keep else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def init_if_absent(existing: DataFrame, defaults: DataFrame, key: str, reset: bool = False) -> DataFrame:
    """Add default rows for new keys; with ``reset`` defaults replace existing rows."""
    if reset:
        kept = existing.join(defaults.select(key), key, "left_anti")
        return kept.unionByName(defaults)
    return existing.unionByName(defaults.join(existing.select(key), key, "left_anti"))


def patch_column(base: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Replace one column where a patch row exists."""
    new = patches.select(key, F.col(column).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def patch_nested(base: DataFrame, patches: DataFrame, key: str, feature: str, fields: list[str]) -> DataFrame:
    """Patch the given fields of ``features.<feature>``; absent fields keep their value."""
    new = patches.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields], F.col("updatedAt").alias("_p_at"))
    joined = base.join(new, key, "left")
    state = F.col("features")[feature]
    for f in fields:
        state = state.withField(f, F.coalesce(F.col(f"_p_{f}"), F.col("features")[feature][f]))
    state = state.withField("updatedAt", F.coalesce(F.col("_p_at"), F.col("features")[feature]["updatedAt"]))
    patched = F.when(F.col("_p_at").isNotNull(), F.col("features").withField(feature, state)).otherwise(
        F.col("features")
    )
    return joined.withColumn("features", patched).select(*base.columns)


# Stages that end a generation run.
FINAL_STAGES = ("complete", "partial", "failed")


def patch_stage(df: DataFrame, stage: Column, now: Column) -> DataFrame:
    """Set the stage; completion time only for final stages."""
    patched = df.withColumn("_stage", stage)
    done = F.when(F.col("_stage").isin(*FINAL_STAGES), now)
    return patched.withColumn("completed_at", done).withColumn("stage", F.col("_stage")).drop("_stage")


def apply_reviews(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fold review(card_id, difficulty, ts, seq) rows: last difficulty and time, one count each."""
    folded = reviews.groupBy("card_id").agg(
        F.count("*").alias("_n"),
        F.max_by("difficulty", F.struct("ts", "seq", "difficulty")).alias("_difficulty"),
        F.max("ts").alias("_at"),
    )
    return (
        cards.join(folded, cards["id"] == folded["card_id"], "left")
        .withColumn("review_count", F.col("review_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("difficulty", F.coalesce("_difficulty", "difficulty"))
        .withColumn("last_reviewed_at", F.coalesce("_at", "last_reviewed_at"))
        .select(*cards.columns)
    )


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, key: str = "id") -> DataFrame:
    """Child rows whose parent was not deleted."""
    gone = deleted.select(F.col(key).alias(child_key))
    return child.join(gone, child_key, "left_anti")

"""Session helpers: a builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# Spark guards an inner explode with a filter that evaluates the exploded array a
# second time below the projection that builds it. Here those arrays are whole
# document analyses, so the guard costs more than everything it saves.
SKIPPED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


# A batch of documents becomes Python objects many times its size, in every worker of an executor.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of at most ``BATCH_BYTES``, or one row: what Python and the buffers of the exchange with it hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: UTC dates, arrays built once, batches of bounded size."""
    bound_batches(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rules = [r for r in (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",") if r]
    if SKIPPED_RULE not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, SKIPPED_RULE]))
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's table so the next round does not replan the last."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: lineage ends, columns stay apart."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

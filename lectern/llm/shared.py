"""What the operators of this package share: columns, staged tables and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.session import use_checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table into the shared checkpoint folder, one folder per value of ``by``, and read it back.

    Cuts lineage like ``checkpoint()``, but column by column and compressed. A lost
    executor costs only the files that were not yet committed.
    """
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """The table written with a number per row in column ``row``: fixed once written, whatever is run again."""
    return staged(df.withColumn(row, F.monotonically_increasing_id()), name)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns the text operators read, whatever else the table has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from numpy arrays or Arrow arrays, cast to ``schema``."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (columns[n] for n in schema.names)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple]:
    """The chunks of an (id, text) stream: ids of the chunk, its bytes, its offsets."""
    from lectern.llm import words

    for batch in batches:
        ids = batch.column(0)
        for first, n, data, offsets in words.chunks(batch.column(1), size):
            yield ids.slice(first, n), data, offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)

"""Running sums over a whole table in order, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lectern.session import stored


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers) over all rows that come earlier by ``order``, which must be unique.

    Rows are dealt to ranges whose bounds Spark takes from the data; a range is summed as it streams by in order, and
    the sums of whole ranges, one number per task, are added afterwards.
    """
    columns = df.columns
    place = columns.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(place).fill_null(0).to_numpy().astype(np.int64)
            sums = np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(total + sums - own)], names=[*columns, "_part", name])
            total += int(sums[-1]) if len(own) else 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = stored(ordered.mapInArrow(add, f"{fields}, _part int, `{name}` bigint"), "running-sums")
    base, bases = 0, []
    for part, total in sorted(tuple(r) for r in summed.groupBy("_part").agg(F.sum(F.coalesce(value, F.lit(0)))).collect()):
        bases.append((part, base))
        base += total
    starts = df.sparkSession.createDataFrame(bases, "_part int, _base bigint")
    return summed.join(F.broadcast(starts), "_part").select(*columns, (F.col(name) + F.col("_base")).alias(name))

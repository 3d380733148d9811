"""Stages that cannot end a job: each gives a value or a reason per row, and a row stops at its first reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Guard:
    """A stage: ``value`` by functions that give null where others would raise, and the ``reason`` of a null."""

    stage: str
    value: Column
    reason: Column | str | Callable[[], Column]


def guarded(docs: DataFrame, guards: list[Guard], key: str = "doc_id") -> DataFrame:
    """``key``, a column for every stage, failed_stage and failed_reason.

    A stage sees the columns of ``docs`` and of the stages before it. A row without a value at a stage carries that
    stage and its reason; later stages are null for it, and all other rows go on.
    """
    rows = docs.withColumn("failed_stage", F.lit(None).cast("string")).withColumn("failed_reason", F.lit(None).cast("string"))
    for guard in guards:
        reason = guard.reason() if callable(guard.reason) else guard.reason
        going = F.col("failed_stage").isNull()
        rows = rows.withColumn(guard.stage, F.when(going, guard.value))
        failed = going & F.col(guard.stage).isNull()
        why = F.coalesce(F.lit(reason) if isinstance(reason, str) else reason, F.lit("unknown"))
        rows = rows.withColumn("failed_reason", F.when(failed, why).otherwise(F.col("failed_reason"))).withColumn("failed_stage", F.when(failed, guard.stage).otherwise(F.col("failed_stage")))
    return rows.select(key, *[g.stage for g in guards], "failed_stage", "failed_reason")

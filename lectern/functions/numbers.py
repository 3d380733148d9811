"""Number parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp_unit(value: Column) -> Column:
    """Into [0, 1]; missing, infinite or not-a-number counts as 0."""
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0.0)).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite))


def parse_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def plain_number(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    whole = value.cast("bigint")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def grouped_number(value: Column) -> Column:
    """Thousands separators and at most two decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_number(value, 2), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def amount_text(value: Column, unit: Column) -> Column:
    number = grouped_number(value)
    return (
        F.when(unit == "USD", F.concat(F.lit("$"), number))
        .when(unit == "percent", F.concat(number, F.lit("%")))
        .otherwise(F.concat(number, F.lit(" "), unit))
    )

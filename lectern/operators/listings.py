"""Listing reads: optional filters, search, pages, newest-per-key and joins to owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import text as T

# Page sizes.
DEFAULT_LIMIT, MAX_LIMIT, MAX_AUDIT_LIMIT = 10, 50, 100


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Equality filters for the options that are given."""
    tests = [F.col(name) == value for name, value in equals.items() if value is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def search(df: DataFrame, columns: list[str], needle: str, regex: bool = False) -> DataFrame:
    """Case-insensitive search over several columns; literal unless ``regex``."""
    if regex:
        tests = [F.col(c).rlike(f"(?i){needle}") for c in columns]
    else:
        tests = [F.contains(F.lower(c), F.lit(needle.lower())) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, tests))


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Text keys compare trimmed and lower-cased."""
    tests = [
        (F.lower(T.strip(F.col(k))) == v.strip().lower()) if isinstance(v, str) else (F.col(k) == v)
        for k, v in keys.items()
    ]
    return df.filter(reduce(lambda a, b: a & b, tests))


def exists_flags(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Each parent key with a flag whether any child row has it."""
    seen = children.select(F.col(child_key).alias(key)).distinct().withColumn("present", F.lit(True))
    return parents.select(key).join(seen, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def in_list(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in the id frame; an empty frame gives an empty result."""
    return df.join(ids.select(key), key, "left_semi")


def clamp_page(page: int | None, limit: int | None, max_limit: int = MAX_LIMIT) -> tuple[int, int]:
    page = max(1, page or 1)
    limit = min(max_limit, max(1, limit or DEFAULT_LIMIT))
    return page, limit


def paginate(
    df: DataFrame, order: list[Column], page: int | None = 1, limit: int | None = None, max_limit: int = MAX_LIMIT
) -> DataFrame:
    """One page; ``order`` must end in a unique key."""
    page, limit = clamp_page(page, limit, max_limit)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def beyond(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after the row with the key values ``last`` in an order of (column, descending).

    Nulls come last where values descend and first where they ascend, as Spark sorts them. The leading column's
    bound stands by itself too, so that the scan can leave out what lies before it.
    """
    found, equal = F.lit(False), F.lit(True)
    for name, down in order:
        c, value = F.col(name), F.lit(last[name])
        after = (c.isNotNull() if not down else F.lit(False)) if last[name] is None else ((c < value) | c.isNull() if down else c > value)
        found = found | (equal & after)
        equal = equal & c.eqNullSafe(value)
    name, down = order[0]
    if last[name] is None:
        return found
    first = (F.col(name) <= F.lit(last[name])) | F.col(name).isNull() if down else F.col(name) >= F.lit(last[name])
    return first & found


def page_token(page: DataFrame, order: list[tuple[str, bool]], limit: int) -> dict | None:
    """The key values of a page's last row, for the next ``seek``; None behind the last page. A page is at most ``limit`` rows."""
    rows = page.select(*[name for name, _ in order]).limit(limit).collect()
    return rows[-1].asDict() if len(rows) == limit else None


def seek(df: DataFrame, order: list[tuple[str, bool]], last: dict | None = None, limit: int | None = None, max_limit: int = MAX_LIMIT) -> DataFrame:
    """The page that follows the row with the key values ``last`` (the first page without them); ``order`` must end in a unique key.

    What comes before is filtered at the scan, not sorted and skipped: a deep page keeps at most a page per task.
    """
    _, limit = clamp_page(1, limit, max_limit)
    rest = df if last is None else df.filter(beyond(order, last))
    return rest.orderBy(*[F.desc(name) if down else F.asc(name) for name, down in order]).limit(limit)


def page_meta(df: DataFrame, page: int | None, limit: int | None, max_limit: int = MAX_LIMIT) -> DataFrame:
    """Total, page count and neighbours of a page as one row."""
    page, limit = clamp_page(page, limit, max_limit)
    total = df.agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / limit)
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Newest ``n`` rows per key.

    The rank filter lets Spark keep only n rows per key before the exchange, so
    a hot key never sends its history to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def content_listing(notes: DataFrame, owners: DataFrame, stages: DataFrame) -> DataFrame:
    """Notes with owner address and processing status.

    Owners and stages join without hints: adaptive execution broadcasts them when
    their measured size allows and splits a hot owner otherwise.
    """
    return (
        notes.join(owners.select(F.col("id").alias("user_id"), F.col("email").alias("_email")), "user_id", "left")
        .join(stages.select(F.col("note_id").alias("id"), F.col("stage").alias("_stage")), "id", "left")
        .withColumn("owner_email", F.coalesce("_email", F.lit("Unknown")))
        .withColumn(
            "status",
            F.when(F.col("_stage") == "complete", "Indexed")
            .when(F.col("_stage").isNotNull(), "Processing")
            .otherwise("Unknown"),
        )
        .drop("_email", "_stage")
    )

"""Array helpers that keep per-document work inside the document's row.

A document is one row, so grouping its own words or lines needs no shuffle:
sort the array and look at neighbours. Everything here is O(n log n) and native.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so ``body`` can use it many times for one evaluation.

    A derived column used inside another column's lambda must be bound this way
    too: projections may be merged, and the expression would run per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tagged_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """Sorted (key, index) pairs of an array."""
    return F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """Drop later elements whose key was seen before; order is kept."""

    def pick(source: Column) -> Column:
        firsts = let(
            tagged_of(source, key),
            lambda s: F.filter(s, lambda t, j: (j == 0) | ~t["k"].eqNullSafe(F.get(s, j - 1)["k"])),
        )
        order = F.sort_array(F.transform(firsts, lambda t: t["i"]))
        return F.transform(order, lambda i: F.get(source, i))

    return let(items, pick)


def run_counts(items: Column) -> Column:
    """Distinct values with count and first position: array<struct<value, n, first>>."""
    tagged = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("value"), i.alias("i"))))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda t, j: F.when((j == 0) | (t["value"] != F.get(s, j - 1)["value"]), j)),
            lambda j: j.isNotNull(),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, r: F.struct(
                    F.get(s, p)["value"].alias("value"),
                    (F.coalesce(F.get(st, r + 1), F.size(s)) - p).alias("n"),
                    F.get(s, p)["i"].alias("first"),
                ),
            ),
        )

    return let(tagged, runs)


def repeated_values(items: Column, times: Column | int) -> Column:
    """Distinct values that occur at least ``times`` times."""
    need = times if isinstance(times, Column) else F.lit(times)
    return let(
        F.sort_array(items),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + need - 1))),
    )


def top_n(items: Column, order: Callable[[Column], Column], n: int) -> Column:
    """First ``n`` elements by ``order`` (a struct of sort keys, ascending)."""
    ranked = F.sort_array(F.transform(items, lambda x: F.struct(order(x).alias("o"), x.alias("x"))))
    return F.transform(F.slice(ranked, 1, n), lambda t: t["x"])


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """First element that passes ``test``, else null."""
    return F.get(F.filter(items, test), F.lit(0))


def grouped(items: Column, key: Callable[[Column], Column]) -> Column:
    """array<struct<key, first, items>>: elements by key in first-seen order, each group in order."""
    def runs(s: Column, source: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda t, j: F.when((j == 0) | ~t["k"].eqNullSafe(F.get(s, j - 1)["k"]), j)),
            lambda j: j.isNotNull(),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, r: F.struct(
                    F.get(s, p)["i"].alias("first"),
                    F.get(s, p)["k"].alias("key"),
                    F.transform(
                        F.slice(s, p + 1, F.coalesce(F.get(st, r + 1), F.size(s)) - p),
                        lambda t: F.get(source, t["i"]),
                    ).alias("items"),
                ),
            ),
        )

    return F.sort_array(let(items, lambda source: let(tagged_of(source, key), lambda s: runs(s, source))))

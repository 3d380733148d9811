"""Document titles: ranked candidates, reasons to reject, a generated fallback."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from lectern.functions import text as T
from lectern.functions.arrays import first_where, let

# Headings and words that make no title, with the order of reasons.
SECTION_NAMES = (
    "abstract", "introduction", "background", "methodology", "methods", "results", "discussion", "conclusion",
    "references", "bibliography", "case study", "overview",
)
GENERIC_WORDS = ("case", "study", "series", "document", "paper", "report", "chapter", "notes", "untitled")


#: Multiplier of the hashes of word runs.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def longest_repeat(numbers: np.ndarray) -> tuple[int, int] | None:
    """First place and size of the longest run that stands twice in a row, or None.

    A run of at least 2k words holds whole stretches of k words that begin at multiples of k, and each stands again
    ``size`` words on. Hashes of stretches are compared at those places only, 2n pairs for all sizes from 2k to 4k - 1,
    and a size is searched in full only where enough of them agree.
    """

    def place(size: int) -> tuple[int, int] | None:
        differ = np.flatnonzero(numbers[:-size] != numbers[size:])
        gaps = np.diff(np.concatenate(([-1], differ, [n - size]))) - 1
        long = np.flatnonzero(gaps >= size)
        if len(long):
            return (int(differ[long[0] - 1]) + 1 if long[0] else 0), size
        return None

    n = len(numbers)
    codes, width, levels = (numbers.astype(np.uint64) + np.uint64(1)) * _STEP, 1, []
    while 4 * width <= n // 2:
        codes = codes[:-width] * _STEP + (codes[width:] ^ (codes[width:] >> np.uint64(29)))
        width *= 2
        levels.append((width, codes))
    for width, codes in reversed(levels):
        sizes = np.arange(2 * width, min(4 * width, n // 2 + 1))
        starts = np.arange(0, len(codes), width)[:, None]
        again = starts + sizes
        same = (codes[np.minimum(again, len(codes) - 1)] == codes[starts]) & (again < len(codes))
        for size in sizes[same.sum(0) >= (sizes + 1) // width - 1][::-1].tolist():
            if (hit := place(size)) is not None:
                return hit
    for size in range(min(3, n // 2), 0, -1):
        if (hit := place(size)) is not None:
            return hit
    return None


@pandas_udf(ArrayType(StringType()))
def collapse_phrases(titles: pd.Series) -> pd.Series:
    """Drop word runs that repeat back to back, longest first, until nothing repeats.

    Every round searches in about n log n steps, whatever the length of the text (``longest_repeat``).
    """

    def collapse(title: str) -> str:
        words, known = (title or "").split(), {}
        numbers = np.array([known.setdefault(w.lower(), len(known)) for w in words], np.int64)
        while (hit := longest_repeat(numbers)) is not None:
            at, size = hit
            del words[at + size : at + 2 * size]
            numbers = np.delete(numbers, slice(at + size, at + 2 * size))
        return " ".join(words)

    return titles.map(lambda ts: [collapse(t) for t in ts] if ts is not None else None)


def file_title(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.(?:pdf|docx|txt)$", ""), "[_-]+", " ")
    return T.title_case(T.squeeze_strip(bare))


def reject_reason(title: Column) -> Column:
    """Why a collapsed candidate cannot be the title, or null."""

    def test(t: Column) -> Column:
        low = F.lower(t)
        telling = F.filter(T.words(low), lambda w: (F.char_length(w) >= 3) & ~w.isin(*GENERIC_WORDS))
        return (
            F.when(F.char_length(t) < 8, "too short")
            .when(F.char_length(t) > 150, "too long")
            .when(T.corrupt_ratio(t) > 0.05, "contains corrupted symbols")
            .when(T.greek_ratio(t) > 0.18, "contains likely encoding noise")
            .when(T.repeated_bigram_ratio(t) > 0.32, "contains repeated phrases")
            .when(low.isin(*SECTION_NAMES), "is a section heading")
            .when(F.size(telling) < 2, "is too generic")
            .when(t.rlike("(?i)^(?:case study series|research article|noname manuscript)"), "is a publication header")
        )

    return let(T.squeeze_strip(F.regexp_replace(title, r"^[0-9.\-–— ]+", "")), test)


def take_while_other(sections: Column, n: int = 8) -> Column:
    """The first sections up to the first with a known title."""
    head = F.slice(sections, 1, n)
    at = F.array_position(F.transform(head, lambda s: s["title"] != "other"), True)
    return F.when(at > 0, F.slice(head, 1, at.cast("int") - 1)).otherwise(head)


def fragments(sections: Column) -> Column:
    """Heading and first lines of the opening sections, distinct, ten at most."""
    def of(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s["body"], "\n"), T.tidy_line), lambda l: F.char_length(l).between(3, 150))
        return F.concat(F.array(T.tidy_line(s["heading"])), F.slice(lines, 1, 4))

    every = F.flatten(F.transform(take_while_other(sections), of))
    return F.slice(F.array_distinct(F.filter(every, lambda f: f != "")), 1, 10)


def joined_candidates(frags: Column) -> Column:
    """Runs of three, then two adjacent fragments, then single ones of eight characters."""

    def build(fs: Column) -> Column:
        def runs(k: int) -> Column:
            head = F.slice(fs, 1, 6)
            joined = F.transform(
                head, lambda _, i: F.when(i + k <= F.size(head), F.array_join(F.slice(head, i + 1, k), " "))
            )
            return F.filter(F.array_compact(joined), lambda t: F.char_length(t).between(12, 150))

        return F.concat(runs(3), runs(2), F.filter(fs, lambda f: F.char_length(f) >= 8))

    return let(frags, build)


def title_candidates(sections: Column, file_name: Column, metadata: Column) -> Column:
    """array<struct<value, source, confidence>> in order of trust."""
    heads = F.transform(
        joined_candidates(fragments(sections)),
        lambda v, i: F.struct(v.alias("value"), F.lit("heading").alias("source"), F.greatest(F.lit(0.72), 0.94 - i * 0.04).alias("confidence")),
    )
    given = F.array(F.struct(metadata.alias("value"), F.lit("metadata").alias("source"), F.lit(0.98).alias("confidence")))
    named = F.array(F.struct(file_title(file_name).alias("value"), F.lit("filename").alias("source"), F.lit(0.62).alias("confidence")))
    return F.concat(F.filter(given, lambda c: F.coalesce(c["value"], F.lit("")) != ""), heads, named)


def resolve_titles(docs, kind: str = "kind", domain: str = "domain"):
    """Add ``title`` struct to documents(sections, file_name, metadata_title, kind, domain, class_confidence)."""
    df = docs.withColumn("_c", title_candidates(F.col("sections"), F.col("file_name"), F.col("metadata_title")))
    generated = T.title_case(F.concat_ws(" ", F.replace(domain, F.lit("_"), F.lit(" ")), F.replace(kind, F.lit("_"), F.lit(" "))))
    fallback = F.struct(
        generated.alias("value"), F.lit("generated").alias("source"),
        F.when(F.col("class_confidence") >= 0.7, 0.84).otherwise(0.72).alias("confidence"),
    )
    df = df.withColumn("_c", F.concat("_c", F.array(fallback)))
    df = df.withColumn("_v", collapse_phrases(F.transform("_c", lambda c: c["value"])))
    judged = F.zip_with(
        "_c", "_v",
        lambda c, v: F.struct(v.alias("value"), c["source"].alias("source"), c["confidence"].alias("confidence"), reject_reason(v).alias("reason")),
    )
    default = F.struct(
        F.lit("Generated Study Notes").alias("value"), F.lit("generated").alias("source"), F.lit(0.45).alias("confidence"),
        F.lit(None).cast("string").alias("reason"),
    )

    def choose(cs: Column) -> Column:
        best = F.coalesce(first_where(cs, lambda c: c["reason"].isNull()), default)
        return F.struct(
            best["value"].alias("value"), best["source"].alias("source"), best["confidence"].alias("confidence"),
            (best["source"] == "generated").alias("generated"),
            F.filter(cs, lambda c: c["reason"].isNotNull()).alias("rejected"),
        )

    return df.withColumn("title", let(judged, choose)).drop("_c", "_v")

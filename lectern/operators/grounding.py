"""Drafts from an outside text generator, kept only as far as the source supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import drafts as D
from lectern.functions import text as T
from lectern.functions.arrays import let
from lectern.operators.claims import contains_number
from lectern.operators.concepts import is_valid_concept
from lectern.operators.study import unique

# Claim types, grounding thresholds and words without evidence value.
CLAIM_TYPES = (
    "problem", "objective", "method", "tool", "data_source", "sample", "metric", "result", "contribution",
    "limitation", "future_work", "definition",
)
OVERVIEW_MIN, POINT_MIN, TERM_MIN = 0.36, 0.32, 0.28
WEAK_TOKENS = ("this", "that", "these", "those", "with", "from", "have", "will")


def flat(text: Column) -> Column:
    return T.squeeze_strip(F.lower(text))


def ground_claims(drafts: DataFrame, documents: DataFrame) -> DataFrame:
    """Drafts(doc_id, payload) joined with documents(doc_id, text): each claim with why it fails, if it does."""
    claims = drafts.select("doc_id", F.posexplode(D.parse_claims(F.col("payload"))).alias("pos", "c"))
    joined = claims.join(documents.select("doc_id", flat(F.col("text")).alias("_source")), "doc_id")
    c, low = F.col("c"), F.lower("c.evidenceText")
    at = F.instr("_source", flat(F.col("c.evidenceText")))
    metric_ok = (
        c["metric"].isNull()
        | (T.strip(c["metric"]) == "")
        | F.contains(low, F.lower(c["metric"]))
        | ((F.lower(c["metric"]) == "accuracy") & low.rlike("accurate|accuracy"))
    )
    blank = F.coalesce(T.strip(c["object"]), F.lit("")) == ""
    reason = (
        F.when(~F.coalesce(c["type"].isin(*CLAIM_TYPES), F.lit(False)) | blank, "incomplete")
        .when(F.coalesce(T.strip(c["evidenceText"]), F.lit("")) == "", "incomplete")
        .when(at == 0, "not_in_source")
        .when(c["numericValue"].isNotNull() & ~contains_number(c["evidenceText"], c["numericValue"]), "number")
        .when(~metric_ok, "metric")
    )
    return joined.select(
        "doc_id", "pos", c["type"].alias("type"), T.strip(c["object"]).alias("object"), c["metric"].alias("metric"),
        c["numericValue"].alias("value"), c["evidenceText"].alias("evidence"),
        F.when(at > 0, at - 1).alias("start"), F.when(at > 0, at - 1 + F.char_length(c["evidenceText"])).alias("end"),
        F.greatest(F.lit(0.5), F.least(F.lit(0.9), F.coalesce(c["confidence"], F.lit(0.7)))).alias("confidence"),
        reason.alias("rejected"),
    )


def repair_merge(claims: DataFrame, grounded: DataFrame, missing: DataFrame) -> DataFrame:
    """Claims plus accepted drafts whose type is missing and not yet present."""
    keys = ["doc_id", "type"]
    useful = (
        grounded.filter(F.col("rejected").isNull())
        .join(missing.select(*keys), keys, "left_semi")
        .join(claims.select(*keys).distinct(), keys, "left_anti")
    )
    return claims.select("doc_id", "type", "object", F.lit("symbolic").alias("source")).unionByName(
        useful.select("doc_id", "type", "object", F.lit("ai").alias("source"))
    )


def meaningful_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*WEAK_TOKENS)))


def grounding_ratio(candidate: Column, source_tokens: Column) -> Column:
    """Share of the candidate's content words that the source has."""
    return let(
        meaningful_tokens(candidate),
        lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, source_tokens)) / F.size(t)).otherwise(0.0),
    )


def copy_ratio(output: Column, source: Column) -> Column:
    """Share of long output sentences that stand word for word in the source."""

    def judge(flat_source: Column) -> Column:
        parts = F.transform(F.split(output, r"(?<=[.!?])" + T.WS + r"+|\n+"), T.compare_form)
        long = F.filter(parts, lambda s: F.char_length(s) >= 100)
        return let(
            long,
            lambda ls: F.when(
                F.size(ls) > 0, F.size(F.filter(ls, lambda s: F.contains(flat_source, s))) / F.size(ls)
            ).otherwise(0.0),
        )

    return let(T.compare_form(source), judge)


def _first_grounded(points: Column, tokens: Column, n: int) -> Column:
    """First ``n`` points, trimmed and case-insensitively distinct, that are long enough and have their words in the source.

    A look at all words of the source is the cost of a point, so none is tested once ``n`` stand.
    """

    def add(acc: Column, p: Column) -> Column:
        def fresh(t: Column) -> Column:
            new = (F.char_length(p) >= 18) & (t != "") & ~F.exists(acc, lambda kept: F.lower(kept) == F.lower(t))
            # Cheap tests first: each branch is looked at only if the one before does not hold.
            return F.when(~F.coalesce(new, F.lit(False)), acc).when(grounding_ratio(p, tokens) >= POINT_MIN, F.concat(acc, F.array(t))).otherwise(acc)

        return F.when(F.size(acc) >= n, acc).otherwise(let(T.strip(p), fresh))

    return F.aggregate(points, F.array().cast("array<string>"), add)


def validate_draft(draft: Column, source: Column) -> Column:
    """Summary draft struct reduced to its grounded parts, or null."""

    def check(tokens: Column) -> Column:
        overview = T.strip(draft["overview"])
        points = _first_grounded(draft["keyPoints"], tokens, 10)
        concepts = unique(F.filter(draft["importantConcepts"], is_valid_concept), 14)
        terms = F.filter(
            draft["keyTerms"],
            lambda t: is_valid_concept(t["term"])
            & (F.char_length(t["definition"]) >= 20)
            & (grounding_ratio(F.concat(t["term"], F.lit(" "), t["definition"]), tokens) >= TERM_MIN),
        )
        sound = (
            F.char_length(overview).between(80, 1500)
            & (T.corrupt_ratio(overview) <= 0.03)
            & (T.greek_ratio(overview) <= 0.12)
            & (grounding_ratio(overview, tokens) >= OVERVIEW_MIN)
        )
        return let(
            F.struct(points.alias("p"), concepts.alias("c")),
            lambda x: F.when(
                sound & (F.size(x["p"]) >= 2) & (F.size(x["c"]) >= 2),
                F.struct(
                    overview.alias("overview"), x["p"].alias("key_points"), x["c"].alias("concepts"), terms.alias("key_terms"),
                    unique(draft["unresolvedAssumptions"], 8).alias("assumptions"),
                ),
            ),
        )

    return let(meaningful_tokens(source), check)


def merge_draft(summary: Column, draft: Column, status: Column) -> Column:
    """Summary struct with the draft's overview and lists folded in."""
    points = unique(F.concat(summary["key_points"], draft["key_points"]), 14)
    concepts = unique(F.filter(F.concat(summary["concepts"], draft["concepts"]), is_valid_concept), 18)
    score = F.least(F.lit(0.97), summary["confidence"] + F.when(status == "ready", 0.035).otherwise(0.015))
    quoted = F.regexp_replace(draft["overview"], r"([\\$])", r"\\$1")
    text = F.regexp_replace(summary["summary"], r"(?s)## Overview\n\n.*?(?=\n\n## )", F.concat(F.lit("## Overview\n\n"), quoted))
    return F.when(
        draft.isNotNull(),
        F.struct(
            text.alias("summary"), points.alias("key_points"), concepts.alias("concepts"), score.alias("confidence"),
            F.when((score >= 0.85) & (status != "rejected"), "ready").otherwise("partial").alias("status"),
        ),
    ).otherwise(summary)

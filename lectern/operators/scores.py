"""Confidence, coverage, gaps and quality profiles from per-document measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numbers import clamp_unit

# Weights of the confidence and coverage components.
CONFIDENCE_WEIGHTS = {
    "grounding": 0.24, "numeric": 0.18, "consistency": 0.14, "sections": 0.14, "concepts": 0.10, "ontology": 0.06,
    "graph": 0.06, "reasoning": 0.08,
}
COVERAGE_WEIGHTS = {
    "text": 0.18, "title": 0.10, "concepts": 0.12, "structure": 0.22, "grounding": 0.13, "numeric": 0.10,
    "consistency": 0.07, "sections": 0.08,
}
RESEARCH_SECTIONS = ("abstract", "methodology", "results", "conclusion")
PAPER_CHECKS = ("problem", "method", "evidence", "concepts", "findings", "limitations")
GENERAL_CHECKS = ("overview", "concepts", "keyPoints")


def composite_confidence(components: dict[str, Column] | None = None) -> Column:
    """Weighted sum of the eight components, each clamped to [0, 1]."""
    parts = components or {name: F.col(name) for name in CONFIDENCE_WEIGHTS}
    return sum((clamp_unit(parts[n]) * w for n, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0))


def concept_quality(n: Column, valid: Column, strong: Column) -> Column:
    """Valid share and number of strong concepts (two occurrences and evidence)."""
    return F.when(n > 0, clamp_unit(valid / n * 0.65 + F.least(F.lit(1.0), strong / 8) * 0.35)).otherwise(0.0)


def ontology_score(matches: DataFrame) -> DataFrame:
    """Mean match score per document; matches(doc_id, match_type, confidence)."""
    value = (
        F.when(F.col("match_type") == "unknown", 0.35).when(F.col("match_type") == "generated", 0.65).otherwise(F.col("confidence"))
    )
    return matches.groupBy("doc_id").agg(F.avg(value).alias("ontology"))


def graph_score(valid_claims: Column, claim_nodes: Column, evidence_edges: Column) -> Column:
    nodes = F.least(F.lit(1.0), claim_nodes / valid_claims)
    edges = F.least(F.lit(1.0), evidence_edges / valid_claims)
    return F.when(valid_claims > 0, nodes * 0.65 + edges * 0.35).otherwise(0.0)


def missing_sections(kind: Column, present: Column) -> Column:
    """Sections a paper lacks; experiments stand in for methodology, later parts for results."""
    def lacks(*names: str) -> Column:
        return ~F.arrays_overlap(present, F.array(*[F.lit(n) for n in names]))

    wanted = F.array_compact(
        F.array(
            F.when(lacks("abstract"), F.lit("abstract")),
            F.when(lacks("methodology", "experiments"), F.lit("methodology")),
            F.when(lacks("results", "discussion", "conclusion"), F.lit("results")),
            F.when(lacks("conclusion"), F.lit("conclusion")),
        )
    )
    return F.when(kind == "research_paper", wanted).otherwise(F.array().cast("array<string>"))


def gap_coverage(kind: Column, required: Column, missing: Column, sections_missing: Column) -> Column:
    """1 minus the missing share of required fields and expected sections."""
    expected = F.when(kind == "research_paper", len(RESEARCH_SECTIONS)).otherwise(0)
    return F.greatest(F.lit(0.0), 1 - (missing + sections_missing) / F.greatest(F.lit(1), required + expected))


def checks(kind: Column, flags: dict[str, Column]) -> Column:
    """array<struct<name, met>> that apply to the kind; flags name each check."""
    def rows(names):
        return F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(flags[n], F.lit(False)).alias("met")) for n in names])

    return F.when(kind == "research_paper", rows(PAPER_CHECKS)).otherwise(rows(GENERAL_CHECKS))


def coverage_report(check_list: Column, components: dict[str, Column], text_passed: Column) -> Column:
    """struct<score, status, missing, structure> from a check list and seven other components."""
    n = F.size(check_list)
    missing = F.transform(F.filter(check_list, lambda c: ~c["met"]), lambda c: c["name"])
    structure = (n - F.size(missing)) / F.greatest(F.lit(1), n)
    parts = {**components, "structure": structure}
    score = clamp_unit(sum((parts[k] * w for k, w in COVERAGE_WEIGHTS.items()), F.lit(0.0)))
    status = (
        F.when(~text_passed | (score < 0.55), "rejected")
        .when((score >= 0.85) & (F.size(missing) <= 1), "ready")
        .otherwise("partial")
    )
    return F.struct(score.alias("score"), status.alias("status"), missing.alias("missing"), structure.alias("structure"))


def calibrated(overall: Column, quality: Column, status: Column, text_passed: Column) -> Column:
    """Confidence blended with quality and capped by status."""
    blend = clamp_unit(overall * 0.58 + quality * 0.42)
    capped = F.when(status == "partial", F.least(blend, F.lit(0.84))).when(status == "rejected", F.least(blend, F.lit(0.59))).otherwise(blend)
    return F.when(~text_passed, F.least(capped, F.lit(0.54))).otherwise(capped)


def status_rollup(rows: DataFrame, key: str, status: str) -> DataFrame:
    """All ready: complete; any ready or partial: partial; else failed."""
    ready, usable = F.col(status) == "ready", F.col(status).isin("ready", "partial")
    agg = rows.groupBy(key).agg(F.bool_and(ready).alias("_all"), F.bool_or(usable).alias("_any"))
    return agg.select(key, F.when(F.col("_all"), "complete").when(F.col("_any"), "partial").otherwise("failed").alias("stage"))


def profile_merge(core: DataFrame, profile: DataFrame) -> DataFrame:
    """Core(doc_id, topic, method, problem) with profile values where the profile has them."""
    p = profile.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("topic", "method", "problem")])
    joined = core.join(p, "doc_id", "left")
    return joined.select("doc_id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("topic", "method", "problem")])

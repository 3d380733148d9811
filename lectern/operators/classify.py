"""Document kind and domain from wording and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let

# Signals of each profile; "headings" tests any heading, "text" the whole text.
PROFILE_SIGNALS = {
    "research_paper": [
        ("abstract", ""),
        ("headings", "references|bibliography"),
        ("headings", "method|approach|model|validation|experiment"),
        ("text", "(?:this paper|we propose|we present|our approach|experimental validation)"),
    ],
    "lecture_notes": [
        ("text", "learning objectives?"),
        ("headings", "lecture|lesson|week +[0-9]+"),
        ("text", "(?:exercise|quiz|review questions?)"),
    ],
    "textbook_chapter": [
        ("headings", "^chapter +[0-9]+"),
        ("text", "chapter summary"),
        ("text", "worked example"),
    ],
    "technical_documentation": [
        ("text", "(?:api reference|installation|configuration|usage example)"),
        ("text", "(?:parameter|return value|endpoint|command line)"),
    ],
    "project_report": [
        ("text", "executive summary"),
        ("headings", "recommendation|project overview|business objective"),
        ("text", "(?:prepared for|prepared by)"),
    ],
    "assignment": [
        ("text", "(?:assignment|student id|submission date|answer sheet)"),
        ("headings", "question +[0-9]+|task +[0-9]+"),
    ],
}
# Fixed values: (field, required, applicable) expected per profile.
EXPECTED_FIELDS = {
    "research_paper": [
        ("problem", True, True), ("method", True, True), ("data_source", False, True), ("sample", False, True),
        ("metric", False, True), ("result", True, True), ("limitation", False, True), ("future_work", False, True),
    ],
    "lecture_notes": [
        ("objective", False, True), ("definition", True, True), ("method", False, True), ("result", False, False),
        ("data_source", False, False),
    ],
    "technical_documentation": [
        ("objective", True, True), ("method", False, True), ("tool", False, True), ("definition", True, True),
        ("result", False, False),
    ],
    "project_report": [
        ("problem", True, True), ("objective", True, True), ("method", False, True), ("result", True, True),
        ("limitation", False, True),
    ],
    "assignment": [
        ("objective", False, True), ("definition", False, True), ("method", False, True), ("result", False, True),
    ],
    "unknown": [
        ("problem", False, True), ("method", False, True), ("definition", False, True), ("result", False, True),
    ],
}
EXPECTED_FIELDS["textbook_chapter"] = EXPECTED_FIELDS["lecture_notes"]

# Phrases that vote for a kind or a domain.
KIND_PHRASES = {
    "case_study": [
        "case study", "best-case", "best case", "worst-case", "worst case", "scenario analysis",
        "sensitivity analysis", "should invest", "should the company", "calculate the npv", "calculate npv",
        "calculate irr", "decision problem", "assume that",
    ],
    "research_paper": [
        "abstract", "introduction", "methodology", "related work", "we propose", "we evaluate", "our results",
        "references", "dataset", "experiment",
    ],
    "lecture_notes": ["learning objectives", "lecture", "week 1", "week 2", "slide", "course outline", "lesson"],
    "assignment": ["assignment", "submit", "marks", "answer all questions", "question 1", "task 1", "due date"],
    "textbook_chapter": ["chapter", "review questions", "chapter summary", "learning outcomes", "worked example"],
    "report": ["executive summary", "recommendations", "findings", "scope of the report", "prepared for"],
}
DOMAIN_PHRASES = {
    "finance": [
        "net present value", "npv", "internal rate of return", "irr", "cash flow", "capital budgeting",
        "working capital", "discount rate", "cost of capital", "depreciation", "salvage value", "tax rate",
        "terminal cash flow",
    ],
    "software_engineering": [
        "software defect", "fault prediction", "software testing", "class imbalance", "code smell",
        "software metrics", "bug prediction",
    ],
    "data_science": [
        "machine learning", "classification", "regression", "dataset", "model training", "feature selection",
        "data mining",
    ],
    "computer_science": [
        "algorithm", "database", "network", "operating system", "computer vision", "natural language processing",
        "cybersecurity",
    ],
    "business": ["business model", "customer", "market analysis", "operations", "strategy", "revenue", "cost structure"],
    "health": ["patient", "clinical", "healthcare", "diagnosis", "treatment", "medical"],
}


def best_and_margin(scored: Column) -> Column:
    """Best of array<struct<name, score>>: struct<name, score, margin>; ties keep list order."""
    ranked = F.sort_array(F.transform(scored, lambda s, i: F.struct((-s["score"]).alias("neg"), i.alias("i"), s.alias("s"))))
    return let(
        ranked,
        lambda r: F.struct(
            F.get(r, F.lit(0))["s"]["name"].alias("name"),
            F.get(r, F.lit(0))["s"]["score"].alias("score"),
            (F.get(r, F.lit(0))["s"]["score"] - F.coalesce(F.get(r, F.lit(1))["s"]["score"], F.lit(0))).alias("margin"),
        ),
    )


def profile(text: Column, headings: Column, has_abstract: Column, signals=None) -> Column:
    """struct<kind, confidence> from counted yes/no signals. Alternatives in a pattern are whole words."""

    def score(low: Column, heads: Column) -> Column:
        def met(where: str, pattern: str) -> Column:
            if where == "abstract":
                return has_abstract
            if where == "headings":
                return F.exists(heads, lambda h: h.rlike(pattern))
            return low.rlike(T.BEFORE + pattern + T.AFTER)

        counted = [
            F.struct(
                F.lit(kind).alias("name"),
                sum((F.when(met(*t), 1).otherwise(0) for t in tests), F.lit(0)).alias("score"),
            )
            for kind, tests in (signals or PROFILE_SIGNALS).items()
        ]
        return let(
            best_and_margin(F.array(*counted)),
            lambda b: F.when(
                b["score"] > 0,
                F.struct(
                    b["name"].alias("kind"),
                    F.least(F.lit(0.98), 0.55 + b["score"] * 0.1 + b["margin"] * 0.05).alias("confidence"),
                ),
            ).otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(0.45).alias("confidence"))),
        )

    return let(F.lower(text), lambda low: let(F.transform(headings, F.lower), lambda heads: score(low, heads)))


def expected_fields(spark) -> DataFrame:
    """Dimension (kind, field, pos, required, applicable); its size is fixed."""
    rows = [(k, f, i, r, a) for k, fields in EXPECTED_FIELDS.items() for i, (f, r, a) in enumerate(fields)]
    return spark.createDataFrame(rows, "kind string, field string, pos int, required boolean, applicable boolean")


def phrase_votes(low: Column, groups: dict[str, list[str]], fallback: str) -> Column:
    """struct<name, confidence, evidence> of the best group of phrases found in a lower-cased text."""
    scored, evidence = [], []
    for name, phrases in groups.items():
        parts = F.array(
            *[
                F.struct(
                    F.lit(p).alias("phrase"),
                    F.regexp_count(low, F.lit(T._quote(p))).alias("n"),
                    F.lit(1.35 if " " in p else 1.0).alias("w"),
                )
                for p in phrases
            ]
        )
        scored.append((name, parts))
    found = F.array(*[F.struct(F.lit(n).alias("name"), p.alias("parts")) for n, p in scored])

    def judge(groups_found: Column) -> Column:
        scores = F.transform(
            groups_found,
            lambda g: F.struct(
                g["name"].alias("name"),
                F.aggregate(g["parts"], F.lit(0.0), lambda acc, p: acc + F.least(F.lit(3), p["n"]) * p["w"]).alias("score"),
            ),
        )
        return let(
            best_and_margin(scores),
            lambda b: F.when(
                b["score"] > 0,
                F.struct(
                    b["name"].alias("name"),
                    F.greatest(F.lit(0.45), F.least(F.lit(0.98), 0.52 + b["score"] * 0.035 + b["margin"] * 0.025)).alias(
                        "confidence"
                    ),
                    F.slice(
                        F.transform(
                            F.filter(
                                F.get(F.filter(groups_found, lambda g: g["name"] == b["name"]), F.lit(0))["parts"],
                                lambda p: p["n"] > 0,
                            ),
                            lambda p: p["phrase"],
                        ),
                        1,
                        8,
                    ).alias("evidence"),
                ),
            ).otherwise(
                F.struct(
                    F.lit(fallback).alias("name"), F.lit(0.25).alias("confidence"),
                    F.array().cast("array<string>").alias("evidence"),
                )
            ),
        )

    return let(found, judge)


def kind_and_domain(text: Column, kinds=None, domains=None) -> Column:
    """struct<kind, domain, task, confidence, evidence> by phrase votes."""

    def classify(low: Column) -> Column:
        votes = F.struct(
            phrase_votes(low, kinds or KIND_PHRASES, "unknown").alias("k"),
            phrase_votes(low, domains or DOMAIN_PHRASES, "general").alias("d"),
        )

        def task(v: Column) -> Column:
            k, d = v["k"]["name"], v["d"]["name"]
            has = lambda p: low.rlike(T.BEFORE + p + T.AFTER)
            return (
                F.when(
                    (k == "case_study") & (d == "finance") & has("(?:npv|net present value)")
                    & has("(?:irr|internal rate of return)"),
                    "capital_budgeting_decision",
                )
                .when((d == "software_engineering") & low.rlike("software defect|fault prediction"), "software_defect_prediction_analysis")
                .when(k == "research_paper", "research_evidence_analysis")
                .when(k == "assignment", "assessment_task")
                .when(k.isin("lecture_notes", "textbook_chapter"), "concept_learning")
            )

        return let(
            votes,
            lambda v: F.struct(
                v["k"]["name"].alias("kind"), v["d"]["name"].alias("domain"), task(v).alias("task"),
                F.least(v["k"]["confidence"], v["d"]["confidence"] + 0.05).alias("confidence"),
                F.slice(F.array_distinct(F.concat(v["k"]["evidence"], v["d"]["evidence"])), 1, 12).alias("evidence"),
            ),
        )

    return let(F.lower(text), classify)

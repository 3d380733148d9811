"""Record rules: field checks, readiness flags and status columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import text as T

# Field limits.
NOTE_LIMITS = {"title": 200, "file_name": 255, "content": 500_000, "summary": 30_000}
CARD_LIMITS = {"front": 500, "back": 1000}
CHAT_LIMITS = {"question": 2000, "answer": 10_000}
QUESTION_TYPES = ("multiple_choice", "true_false", "short_answer")
MAX_QUESTIONS = 20
# Confidence bands of stored results and of the read view.
RESULT_BANDS = (0.85, 0.70)
VIEW_BANDS = (0.81, 0.61)


def blank(value: Column) -> Column:
    return F.coalesce(T.strip(value), F.lit("")) == ""


def errors(*checks: tuple[str, Column]) -> Column:
    """Names of the failed checks in order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]))


def note_errors() -> Column:
    title, summary = F.col("title"), F.col("summary")
    return errors(
        ("title", blank(title) | (F.char_length(T.strip(title)) > NOTE_LIMITS["title"])),
        ("file_name", blank(F.col("file_name")) | (F.char_length("file_name") > NOTE_LIMITS["file_name"])),
        ("content", blank(F.col("content")) | (F.char_length("content") > NOTE_LIMITS["content"])),
        ("summary", summary.isNotNull() & (blank(summary) | (F.char_length(summary) > NOTE_LIMITS["summary"]))),
    )


def card_errors() -> Column:
    return errors(
        ("front", blank(F.col("front")) | (F.char_length("front") > CARD_LIMITS["front"])),
        ("back", blank(F.col("back")) | (F.char_length("back") > CARD_LIMITS["back"])),
    )


def chat_errors() -> Column:
    return errors(
        ("question", blank(F.col("question")) | (F.char_length("question") > CHAT_LIMITS["question"])),
        ("answer", F.char_length("answer") > CHAT_LIMITS["answer"]),
    )


def question_error(q: Column) -> Column:
    """First failed rule of one question struct, or null."""
    kind, answer, options = q["questionType"], q["answer"], q["options"]
    return (
        F.when(blank(q["question"]), "question")
        .when(kind.isNull() | ~kind.isin(*QUESTION_TYPES), "questionType")
        .when(options.isNull(), "options")
        .when((kind == "multiple_choice") & ~F.size(options).between(2, 6), "options")
        .when((kind == "multiple_choice") & ~F.coalesce(F.array_contains(options, answer), F.lit(False)), "answer")
        .when((kind == "true_false") & ~F.coalesce(answer.isin("True", "False"), F.lit(False)), "answer")
        .when((kind == "short_answer") & blank(answer), "answer")
    )


def knowledge_errors() -> Column:
    """Rules of a stored result row (stage, confidence, has_core, has_facts, has_graph, has_gaps)."""
    done = F.col("stage") == "complete"
    score = F.col("confidence")
    return errors(
        ("early_confidence", ~done & score.isNotNull()),
        ("confidence", done & (score.isNull() | ~score.between(0, 1))),
        ("core", done & ~F.col("has_core")),
        ("facts", done & ~F.col("has_facts")),
        ("graph", done & ~F.col("has_graph")),
        ("gaps", done & ~F.col("has_gaps")),
    )


def readiness() -> dict[str, Column]:
    """Flags from per-document counts (stage, error, method, dataset, n_entities, n_nodes, n_facts,
    n_missing_fields, n_missing_sections, n_unresolved, n_key_points, n_keywords, coverage)."""
    done = F.col("stage") == "complete"
    full = (
        done
        & F.col("method").isNotNull()
        & F.col("dataset").isNotNull()
        & (F.col("n_entities") > 0)
        & (F.col("n_nodes") > 0)
        & (F.col("n_facts") > 0)
    )
    gaps = (F.col("n_missing_fields") + F.col("n_missing_sections") + F.col("n_unresolved")) > 0
    return {
        "is_complete": done,
        "has_failed": ~done & F.col("error").isNotNull() & (F.col("error") != ""),
        "full_core": full,
        "has_gaps": gaps,
        "can_quiz": full & (F.col("n_facts") >= 3),
        "can_summarise": done & ((F.col("n_key_points") > 0) | (F.col("n_keywords") > 0)),
        "can_chat": done & ((F.col("n_entities") > 0) | (F.col("n_nodes") > 0)),
        "needs_reprocessing": ~done | (~full & gaps & (F.col("coverage") < VIEW_BANDS[1])),
        "has_reasoning": (F.col("n_nodes") > 0) & (F.col("n_facts") > 0),
    }


def confidence_mode(confidence: Column, bands: tuple[float, float] = RESULT_BANDS) -> Column:
    score = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(score >= bands[0], "SYMBOLIC_ONLY")
        .when(score >= bands[1], "SYMBOLIC_WITH_OPTIONAL_AI_POLISH")
        .otherwise("AI_REQUIRED")
    )


def needs_repair(n_missing: Column, overall: Column, threshold: float = 0.85) -> Column:
    return (n_missing > 0) | (overall < threshold)


def view_status(stage: Column, error: Column) -> Column:
    """Status of a stored result as readers see it; a missing row has no stage."""
    return (
        F.when(stage.isNull(), "not_generated")
        .when(stage == "complete", "ready")
        .when(error.isNotNull() & (error != ""), "failed")
        .otherwise("partial")
    )


def cached_summary_ok(summary: Column) -> Column:
    """A stored summary good enough to serve again."""
    def test(s: Column) -> Column:
        return (
            (F.char_length(s) >= 350)
            & (T.corrupt_ratio(s) <= 0.035)
            & (T.greek_ratio(s) <= 0.12)
            & ~s.rlike(f"(?i)Case Study Series{T.WS}+Case Study Series")
            & ~s.rlike(f"(?im)^#?{T.WS}*(?:untitled|case|study){T.WS}*$")
            & s.rlike(f"(?i)##{T.WS}+(?:Overview|Decision Problem|Key Points|Main Concepts)")
        )

    from lectern.functions.arrays import let

    return let(T.strip(summary), test)

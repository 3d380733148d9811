"""JSON drafts: claims, summaries, quizzes and cards supplied as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import text as T
from lectern.functions.arrays import first_where, let
from lectern.schema import CARD_DRAFT, CLAIM_DRAFT, QUIZ_DRAFT, SUMMARY_DRAFT

QUESTION_TYPES = ("multiple_choice", "true_false", "short_answer")


def strip_fences(payload: Column) -> Column:
    """Drop a Markdown code fence around JSON."""
    bare = F.regexp_replace(T.strip(payload), r"(?i)^```(?:json)?\s*", "")
    return T.strip(F.regexp_replace(bare, r"\s*```$", ""))


def parse_claims(payload: Column) -> Column:
    """Claims of a draft; unreadable JSON gives an empty array."""
    parsed = F.from_json(strip_fences(payload), CLAIM_DRAFT)
    return F.coalesce(parsed["claims"], F.from_json(F.lit("[]"), CLAIM_DRAFT[len("struct<claims:"):-1]))


def parse_summary(payload: Column) -> Column:
    """Summary draft with blank list items dropped; null when unreadable."""
    def kept(items: Column) -> Column:
        trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), T.strip)
        return F.filter(trimmed, lambda s: s.isNotNull() & (s != ""))

    def checked(d: Column) -> Column:
        return F.when(
            d["overview"].isNotNull(),
            F.struct(
                T.strip(d["overview"]).alias("overview"),
                kept(d["keyPoints"]).alias("keyPoints"),
                kept(d["importantConcepts"]).alias("importantConcepts"),
                F.filter(
                    F.coalesce(d["keyTerms"], F.from_json(F.lit("[]"), "array<struct<term:string,definition:string>>")),
                    lambda t: t["term"].isNotNull() & t["definition"].isNotNull(),
                ).alias("keyTerms"),
                kept(d["unresolvedAssumptions"]).alias("unresolvedAssumptions"),
            ),
        )

    return let(F.from_json(strip_fences(payload), SUMMARY_DRAFT), checked)


def parse_quiz(payload: Column) -> Column:
    """Questions of a draft; one unusable field rejects the whole payload (null)."""
    questions = F.from_json(strip_fences(payload), QUIZ_DRAFT)["questions"]
    usable = F.forall(
        questions,
        lambda q: q["question"].isNotNull()
        & F.coalesce(q["questionType"].isin(*QUESTION_TYPES), F.lit(False))
        & q["options"].isNotNull()
        & q["answer"].isNotNull(),
    )
    return F.when((F.size(questions) > 0) & usable, questions)


def parse_cards(payload: Column) -> Column:
    """Cards of a draft without blank sides; unknown difficulty reads as medium."""
    cards = F.from_json(strip_fences(payload), CARD_DRAFT)["flashcards"]
    kept = F.filter(
        cards, lambda c: (F.coalesce(T.strip(c["front"]), F.lit("")) != "") & (F.coalesce(T.strip(c["back"]), F.lit("")) != "")
    )
    return F.transform(
        kept,
        lambda c: F.struct(
            T.strip(c["front"]).alias("front"),
            T.strip(c["back"]).alias("back"),
            F.when(c["difficulty"].isin("easy", "medium", "hard"), c["difficulty"]).otherwise("medium").alias("difficulty"),
        ),
    )


def stored_questions(payload: Column) -> Column:
    """Question structs from any stored generation of the record layout."""
    questions = F.from_json(payload, QUIZ_DRAFT)["questions"]

    def fix(q: Column, i: Column) -> Column:
        options = F.filter(F.coalesce(q["options"], F.array().cast("array<string>")), lambda o: o.isNotNull())
        low = F.transform(options, F.lower)
        named = F.coalesce(q["questionType"], q["type"], q["question_type"])
        kind = (
            F.when(named.isin(*QUESTION_TYPES), named)
            .when((F.size(options) == 2) & F.array_contains(low, "true") & F.array_contains(low, "false"), "true_false")
            .when(F.size(options) >= 2, "multiple_choice")
            .otherwise("short_answer")
        )
        answer = F.coalesce(T.strip(q["answer"]), F.lit(""))
        listed = first_where(options, lambda o: F.lower(o) == F.lower(answer))
        text = F.coalesce(T.strip(q["question"]), F.lit(""))
        return F.struct(
            F.when(text != "", text).otherwise(F.concat(F.lit("Question "), (i + 1).cast("string"))).alias("question"),
            kind.alias("questionType"),
            F.when(kind == "true_false", F.array(F.lit("True"), F.lit("False"))).otherwise(options).alias("options"),
            F.when(kind == "true_false", F.when(F.lower(answer) == "false", "False").otherwise("True"))
            .when(kind == "multiple_choice", F.coalesce(listed, F.get(options, F.lit(0)), F.lit("")))
            .otherwise(answer)
            .alias("answer"),
            T.strip(q["explanation"]).alias("explanation"),
        )

    return F.transform(questions, fix)

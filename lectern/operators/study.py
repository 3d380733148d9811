"""Study material from a document's text and facts: quizzes, cards, summaries, answers.

Texts are cleaned texts. Facts arrive as a headline struct (method, dataset,
problem, accuracy, metric, limitations, future_work, contributions, key_points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T
from lectern.functions.arrays import keep_first, let, top_n
from lectern.functions.numbers import plain_number
from lectern.operators import rules
from lectern.operators.concepts import is_valid_concept

# Lengths for callers who want bounded texts; no builder cuts unless it is given one.
LENGTHS = {"answer": 300, "card": 350, "summary": 24_000, "symbolic": 4_800, "opening": 4_000}
# Characters of the source that one request to a text generator carries.
DRAFT_LIMITS = {"claims": 18_000, "quiz": 24_000, "summary": 30_000, "cards": 8_000}


def score_answers(questions: DataFrame, given: DataFrame) -> DataFrame:
    """Hits per quiz: trimmed, lower-cased equality; an unanswered question is a miss."""
    joined = questions.join(given, ["quiz_id", "question_no"], "left")
    hit = F.lower(T.strip(F.col("given"))) == F.lower(T.strip(F.col("answer")))
    return joined.groupBy("quiz_id").agg(
        F.count("*").alias("questions"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits")
    )


def shorten(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or the whole text."""
    return text if chars is None else F.substring(text, 1, chars)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def unique(values: Column, n: int) -> Column:
    """Trimmed values, case-insensitively distinct, first kept, at most n."""
    trimmed = F.filter(F.transform(values, T.strip), lambda v: v.isNotNull() & (v != ""))
    return F.slice(keep_first(trimmed, lambda v: F.lower(v)), 1, n)


def meaningful_sentences(text: Column, n: int | None = 12) -> Column:
    """Sentences of 45 to 360 characters that say something, distinct, in order."""
    bare = F.regexp_replace(text, "(?m)^[ \t]*[0-9]+[ \t]*$", "")
    parts = F.split(bare, r"(?<=[.!?])" + T.WS + r"+|\n{2,}")
    kept = F.filter(
        F.transform(parts, T.squeeze_strip),
        lambda s: F.char_length(s).between(45, 360)
        & ~s.rlike("(?i)^(?:references|bibliography|acknowledg)")
        & ~s.rlike(r"^[0-9 .,;:()\[\]-]+$"),
    )
    distinct = keep_first(kept, lambda s: F.lower(s))
    return F.slice(distinct, 1, n) if n else distinct


def study_headings(text: Column, n: int = 12) -> Column:
    """Numbered or known heading lines without their number."""
    known = (
        "(?i)^(?:abstract|introduction|background|method|methodology|results?|discussion|conclusion|limitations?|future work)$"
    )
    lines = F.transform(F.split(text, "\n"), T.strip)
    kept = F.filter(
        lines,
        lambda l: F.char_length(l).between(3, 90) & (l.rlike(r"^[0-9]+(?:\.[0-9]+)* +[A-Z]") | l.rlike(known)),
    )
    bare = F.transform(kept, lambda l: T.strip(F.regexp_replace(l, r"^[0-9]+(?:\.[0-9]+)* +", "")))
    return F.slice(F.array_distinct(bare), 1, n)


DEFINED = r"(?i)^([A-Z][A-Za-z0-9 ()/_-]{2,70}?) +(?:is|are|means|refers to|can be defined as) +(.{20,260})$"


def definitions(text: Column, n: int = 15, pattern: str = DEFINED, sentences: int | None = None) -> Column:
    """First n of array<struct<term, definition>> from the meaningful sentences (all, or the first ``sentences``)."""
    hits = F.filter(meaningful_sentences(text, sentences), lambda s: s.rlike(pattern))
    found = F.transform(
        hits,
        lambda s: F.struct(
            T.strip(F.regexp_extract(s, pattern, 1)).alias("term"),
            T.strip(F.regexp_extract(s, pattern, 2)).alias("definition"),
        ),
    )
    return F.slice(keep_first(found, lambda d: F.lower(d["term"])), 1, n)


# ---- quizzes -------------------------------------------------------------------------------------


def question(text: Column, kind: str, options: Column, answer: Column, why: str | Column) -> Column:
    return F.struct(
        text.alias("question"), F.lit(kind).alias("questionType"), options.cast("array<string>").alias("options"),
        answer.alias("answer"), (why if isinstance(why, Column) else F.lit(why)).alias("explanation"),
    )


def _maybe(test: Column, item: Column) -> Column:
    return F.filter(F.array(item), lambda _: F.coalesce(test, F.lit(False)))


def distractors(pool: Column, correct: Column, n: int = 3) -> Column:
    """First pool values that differ from the answer, whatever the letter case."""
    return F.slice(F.filter(pool, lambda v: F.lower(v) != F.lower(correct)), 1, n)


def questions_from_facts(h: Column, pool: Column, n: int, types=rules.QUESTION_TYPES, chars: int | None = None) -> Column:
    """Template questions from headline facts."""
    none = no_strings()
    both = F.array(F.lit("True"), F.lit("False"))
    wrong = distractors(pool, h["method"])
    parts = []
    if "multiple_choice" in types:
        parts.append(
            _maybe(
                h["method"].isNotNull() & (F.size(wrong) > 0),
                question(
                    F.lit("Which method does this document propose or evaluate?"), "multiple_choice",
                    F.concat(F.array(h["method"]), wrong), h["method"],
                    F.concat(F.lit("The extracted method is "), h["method"], F.lit(".")),
                ),
            )
        )
    if "true_false" in types:
        parts.append(
            _maybe(
                h["dataset"].isNotNull(),
                question(
                    F.concat(F.lit("True or false: the document uses the "), h["dataset"], F.lit(" dataset.")),
                    "true_false", both, F.lit("True"),
                    F.concat(F.lit("The extracted dataset is "), h["dataset"], F.lit(".")),
                ),
            )
        )
    if "short_answer" in types:
        parts += [
            _maybe(
                h["problem"].isNotNull(),
                question(
                    F.lit("What main problem does this document address?"), "short_answer", none,
                    shorten(h["problem"], chars), "The answer comes from the extracted problem statement.",
                ),
            ),
            _maybe(
                h["accuracy"].isNotNull(),
                question(
                    F.lit("What performance result is reported?"), "short_answer", none,
                    F.concat(plain_number(h["accuracy"]), F.lit("%")), "The value comes from the extracted result.",
                ),
            ),
            F.transform(
                h["key_points"],
                lambda p: question(
                    F.concat(F.lit('What is stated about "'), p["label"], F.lit('"?')), "short_answer", none,
                    shorten(p["value"], chars), "This key point was extracted from the document.",
                ),
            ),
            F.transform(
                h["contributions"],
                lambda c: question(
                    F.lit("Name one contribution of this work."), "short_answer", none,
                    shorten(c, chars), "This is one of the extracted contributions.",
                ),
            ),
        ]
    return F.slice(F.concat(*parts), 1, n)


def questions_from_text(text: Column, n: int, types=rules.QUESTION_TYPES, pattern: str = DEFINED, chars: int | None = None) -> Column:
    """Definition questions, then heading questions, then true/false statements."""
    none = no_strings()

    def build(x: Column) -> Column:
        parts = []
        if "short_answer" in types:
            parts.append(
                F.transform(
                    x["defs"],
                    lambda d: question(
                        F.concat(F.lit("What is "), d["term"], F.lit("?")), "short_answer", none,
                        shorten(d["definition"], chars), "This definition was extracted from the uploaded document.",
                    ),
                )
            )
            paired = F.slice(x["heads"], 1, F.size(x["sents"]))
            parts.append(
                F.transform(
                    paired,
                    lambda hd, i: question(
                        F.concat(F.lit('What is an important point from the section "'), hd, F.lit('"?')), "short_answer", none,
                        shorten(F.get(x["sents"], i), chars),
                        "The answer is based on text extracted from that document section.",
                    ),
                )
            )
        if "true_false" in types:
            parts.append(
                F.transform(
                    x["sents"],
                    lambda s: question(
                        F.concat(F.lit("True or false: "), s), "true_false", F.array(F.lit("True"), F.lit("False")),
                        F.lit("True"), "The statement appears in the uploaded document.",
                    ),
                )
            )
        return F.slice(F.concat(*parts), 1, n)

    return let(
        F.struct(
            definitions(text, n, pattern).alias("defs"), meaningful_sentences(text, None).alias("sents"),
            study_headings(text, n).alias("heads"),
        ),
        build,
    )


def generation_confidence(made: Column, requested: int, document: Column) -> Column:
    return F.least(F.lit(1.0), 0.35 + 0.45 * made / requested + 0.2 * document)


def is_ready(made: Column, requested: int, least: int = 3) -> Column:
    return made >= max(least, -(-requested * 7 // 10))


def build_quiz(facts: Column, text: Column, drafts: Column, n: int, document: Column) -> Column:
    """Quiz struct: facts, text, then drafts; distinct, capped, checked and labelled."""
    symbolic = F.concat(facts, text)

    def assemble(x: Column) -> Column:
        def key(q):
            return T.squeeze_strip(F.lower(q["question"]))

        own = F.slice(F.filter(keep_first(x["own"], key), lambda q: key(q) != ""), 1, n)
        every = F.filter(keep_first(F.concat(x["own"], x["drafts"]), key), lambda q: key(q) != "")
        merged = F.slice(F.filter(every, lambda q: rules.question_error(q).isNull()), 1, n)
        return let(
            merged,
            lambda qs: F.struct(
                qs.alias("questions"),
                F.when(F.size(own) >= F.size(qs), "symbolic").when(F.size(own) > 0, "hybrid").otherwise("ai_fallback").alias("source"),
                generation_confidence(F.size(qs), n, document).alias("confidence"),
                F.when(is_ready(F.size(qs), n), "ready").when(F.size(qs) > 0, "partial").otherwise("failed").alias("status"),
            ),
        )

    return let(F.struct(symbolic.alias("own"), drafts.alias("drafts")), assemble)


# ---- cards ---------------------------------------------------------------------------------------


def card(front: Column, back: Column, difficulty: str, chars: int | None = None) -> Column:
    return F.struct(front.alias("front"), shorten(back, chars).alias("back"), F.lit(difficulty).alias("difficulty"))


def cards_from_facts(h: Column, n: int, chars: int | None = None) -> Column:
    def fixed(field: Column, front: str, difficulty: str, back: Column | None = None) -> Column:
        return _maybe(field.isNotNull(), card(F.lit(front), back if back is not None else field, difficulty, chars))

    return F.slice(
        F.concat(
            fixed(h["method"], "What is the main method proposed or evaluated?", "medium"),
            fixed(h["dataset"], "Which dataset is used?", "easy"),
            fixed(h["metric"], "Which evaluation metric is used?", "easy"),
            fixed(h["accuracy"], "What performance result is reported?", "medium", F.concat(plain_number(h["accuracy"]), F.lit("%"))),
            fixed(h["problem"], "What problem does the document address?", "hard"),
            F.transform(h["contributions"], lambda c: card(F.lit("What is one contribution of this work?"), c, "hard", chars)),
            F.transform(
                h["key_points"],
                lambda p: card(F.concat(F.lit('What is important about "'), p["label"], F.lit('"?')), p["value"], "medium", chars),
            ),
        ),
        1,
        n,
    )


def cards_from_text(text: Column, n: int, pattern: str = DEFINED, chars: int | None = None) -> Column:
    def build(x: Column) -> Column:
        paired = F.slice(x["heads"], 1, F.size(x["sents"]))
        return F.slice(
            F.concat(
                F.transform(x["defs"], lambda d: card(F.concat(F.lit("What is "), d["term"], F.lit("?")), d["definition"], "easy", chars)),
                F.transform(
                    paired,
                    lambda hd, i: card(F.concat(F.lit('What is a key point from "'), hd, F.lit('"?')), F.get(x["sents"], i), "medium", chars),
                ),
                F.transform(x["sents"], lambda s: card(F.lit("What important fact is explained in this document?"), s, "medium", chars)),
            ),
            1,
            n,
        )

    return let(
        F.struct(
            definitions(text, n, pattern).alias("defs"), meaningful_sentences(text, None).alias("sents"),
            study_headings(text, n).alias("heads"),
        ),
        build,
    )


def build_deck(facts: Column, text: Column, drafts: Column, n: int, document: Column) -> Column:
    """Deck struct: facts, text, then drafts; distinct by front, capped and labelled."""

    def assemble(cs: Column) -> Column:
        kept = F.filter(
            keep_first(cs, lambda c: T.squeeze_strip(F.lower(c["front"]))), lambda c: (T.strip(c["front"]) != "") & (T.strip(c["back"]) != "")
        )
        return let(
            F.slice(kept, 1, n),
            lambda k: F.struct(
                k.alias("cards"), generation_confidence(F.size(k), n, document).alias("confidence"),
                F.when(is_ready(F.size(k), n, 4), "ready").when(F.size(k) > 0, "partial").otherwise("failed").alias("status"),
            ),
        )

    return let(F.concat(facts, text, drafts), assemble)


# ---- summaries -----------------------------------------------------------------------------------


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")


def blocks(*parts: Column, cap: int | None = None) -> Column:
    """Non-empty parts with an empty line between them, cut at the cap if there is one."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return T.strip(shorten(F.array_join(kept, "\n\n"), cap))


def _titled(heading: str, body: Column) -> tuple[Column, Column]:
    return F.when(body.isNotNull() & (body != ""), F.lit(heading)), body


def detail_lines(h: Column, metric: str) -> Column:
    return F.concat(
        _maybe(h["method"].isNotNull(), F.concat(F.lit("- **Method:** "), h["method"])),
        _maybe(h["dataset"].isNotNull(), F.concat(F.lit("- **Dataset:** "), h["dataset"])),
        _maybe(h["accuracy"].isNotNull(), F.concat(F.lit("- **Reported result:** "), plain_number(h["accuracy"]), F.lit("%"))),
        _maybe(h["metric"].isNotNull(), F.concat(F.lit(f"- **{metric}:** "), h["metric"])),
    )


def fact_points(h: Column) -> Column:
    return F.concat(
        F.transform(h["key_points"], lambda p: F.concat(p["label"], F.lit(": "), p["value"])), h["contributions"]
    )


def general_summary(h: Column, text: Column, title: Column, concepts: Column, terms: Column, quality: Column, cap: int | None = None) -> Column:
    """Markdown summary struct; concepts are terms, terms are struct<term, definition>, quality may be null."""
    parts = F.split(text, r"(?<=[.!?])" + T.WS + r"+|\n{2,}")
    sentences = F.filter(F.transform(parts, T.squeeze_strip), lambda s: F.char_length(s).between(45, 420))

    def build(ss: Column) -> Column:
        overview = F.coalesce(h["problem"], F.get(ss, F.lit(0)), F.concat(F.lit("This document discusses "), title, F.lit(".")))
        lists = F.struct(
            unique(F.concat(fact_points(h), F.slice(ss, 2, 7)), 10).alias("points"),
            unique(F.filter(concepts, is_valid_concept), 16).alias("concepts"),
        )

        def render(x: Column) -> Column:
            text_out = blocks(
                F.concat(F.lit("# "), title), F.lit("## Overview"), overview,
                *_titled("## Method and Evidence", F.array_join(detail_lines(h, "Metric"), "\n")),
                *_titled("## Key Points", bullets(x["points"])),
                *_titled("## Main Concepts", bullets(x["concepts"])),
                *_titled(
                    "## Key Terms",
                    F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- **"), t["term"], F.lit(":** "), t["definition"])), "\n"),
                ),
                *_titled("## Limitations", h["limitations"]), *_titled("## Future Work", h["future_work"]),
                F.lit("## Key Takeaways"), bullets(F.slice(ss, 1, 5)), cap=cap,
            )
            score = F.coalesce(
                quality, F.least(F.lit(0.72), 0.35 + F.size(x["points"]) * 0.045 + F.size(x["concepts"]) * 0.02)
            )
            return F.struct(
                text_out.alias("summary"), x["points"].alias("key_points"), x["concepts"].alias("concepts"),
                score.alias("confidence"),
                F.when((score >= 0.85) & (F.size(x["points"]) >= 3), "ready").otherwise("partial").alias("status"),
            )

        return let(lists, render)

    return let(sentences, build)


def symbolic_summary(h: Column, text: Column, title: Column, entities: Column, keywords: Column, pattern: str = DEFINED, cap: int | None = None) -> Column:
    """The shorter summary: overview, points, concepts, terms and takeaways."""
    parts = F.struct(
        meaningful_sentences(text, 8).alias("s"), definitions(text, 6, pattern).alias("d"), study_headings(text, 8).alias("h"),
    )

    def build(x: Column) -> Column:
        overview = F.coalesce(F.nullif(T.strip(h["problem"]), F.lit("")), F.get(x["s"], F.lit(0)), F.concat(F.lit("This document discusses "), title, F.lit(".")))
        points = F.slice(
            F.array_distinct(F.filter(F.transform(F.concat(fact_points(h), F.slice(x["s"], 2, 4)), T.strip), lambda p: p != "")), 1, 8
        )
        concepts = unique(F.concat(entities, F.transform(x["d"], lambda d: d["term"]), x["h"], keywords), 12)

        def render(y: Column) -> Column:
            listed = F.transform(x["d"], lambda d: F.concat(F.lit("- **"), d["term"], F.lit(":** "), d["definition"]))

            def section(heading: str, items: Column) -> Column:
                return F.when(F.size(items) > 0, F.concat(F.lit(heading + "\n"), F.array_join(items, "\n")))

            summary = blocks(
                F.concat(F.lit("# "), title), F.lit("## Overview"), overview,
                section("## Important Details", detail_lines(h, "Evaluation metric")),
                section("## Key Points", F.transform(y["p"], lambda p: F.concat(F.lit("- "), p))),
                section("## Main Concepts", F.transform(y["c"], lambda p: F.concat(F.lit("- "), p))),
                section("## Key Terms", listed),
                section("## Key Takeaways", F.transform(F.slice(x["s"], 1, 5), lambda p: F.concat(F.lit("- "), p))),
                cap=cap,
            )
            evidence = (
                sum(F.when(h[f].isNotNull() & (h[f] != ""), 1).otherwise(0) for f in ("problem", "method", "dataset"))
                + F.least(F.lit(4), F.size(y["p"])) + F.least(F.lit(3), F.size(x["d"])) + F.least(F.lit(2), F.size(x["h"]))
            )
            score = F.least(F.lit(1.0), 0.25 + evidence * 0.055 + F.least(F.char_length(text) / 20_000, F.lit(0.2)))
            return F.struct(
                summary.alias("summary"), y["p"].alias("key_points"), y["c"].alias("concepts"), score.alias("confidence"),
                F.when((F.char_length(summary) >= 350) & (F.size(y["p"]) >= 3), "ready").otherwise("partial").alias("status"),
            )

        return let(F.struct(points.alias("p"), concepts.alias("c")), render)

    return let(parts, build)


def parse_stored_summary(text: Column) -> Column:
    """struct<prose, key_points, concepts> of a flattened summary."""
    points_mark, concepts_mark = "\n\n**Key Points:**\n", "\n\n**Important Concepts:** "
    p, c = F.instr(text, points_mark), F.instr(text, concepts_mark)
    end = F.when(p > 0, p - 1).when(c > 0, c - 1).otherwise(F.char_length(text))
    body = F.when(
        p > 0,
        text.substr(p + len(points_mark), F.when(c > 0, F.greatest(c - p - len(points_mark), F.lit(0))).otherwise(F.char_length(text))),
    )
    points = F.filter(F.transform(F.split(body, "\n"), lambda l: T.strip(F.regexp_replace(l, "^-" + T.WS + "*", ""))), lambda l: l != "")
    tail = F.when(c > 0, text.substr(c + len(concepts_mark), F.char_length(text)))
    concepts = F.filter(F.transform(F.split(tail, ","), T.strip), lambda l: l != "")
    return F.struct(
        T.strip(text.substr(F.lit(1), end)).alias("prose"), F.coalesce(points, no_strings()).alias("key_points"),
        F.coalesce(concepts, no_strings()).alias("concepts"),
    )


# ---- answers -------------------------------------------------------------------------------------


def query_terms(asked: Column) -> Column:
    words = F.regexp_extract_all(F.lower(asked), F.lit("[a-z][a-z-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(T.STUDY_STOP_WORDS)))


def excerpts(sentences: Column, asked: Column, n: int = 3) -> Column:
    """Sentences with the most question terms, ties in document order: array<struct<i, text, score>>."""

    def rank(terms: Column) -> Column:
        scored = F.transform(
            sentences,
            lambda s, i: let(
                F.lower(s),
                lambda low: F.struct(
                    i.alias("i"), s.alias("text"), F.size(F.filter(terms, lambda t: F.contains(low, t))).alias("score")
                ),
            ),
        )
        return top_n(
            F.filter(scored, lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("a"), s["i"].alias("b")), n
        )

    return let(query_terms(asked), rank)


# Question wording that a headline fact answers, in order.
DIRECT_ROUTES = [
    ("method|approach|technique", "method"), ("dataset|data set|corpus", "dataset"),
    ("accuracy|performance|result", "accuracy"), ("problem|goal|aim", "problem"),
]


def answer(h: Column, sentences: Column, asked: Column) -> Column:
    """struct<text, confidence, route>: direct fact, contributions, excerpts or nothing."""
    low = F.lower(asked)
    direct = F.lit(None).cast("string")
    for pattern, field in reversed(DIRECT_ROUTES):
        value = F.concat(plain_number(h["accuracy"]), F.lit("%")) if field == "accuracy" else h[field]
        direct = F.when(low.rlike(pattern) & value.isNotNull() & (value != ""), value).otherwise(direct)
    contributions = F.when(low.rlike("contribut") & (F.size(h["contributions"]) > 0), bullets(F.slice(h["contributions"], 1, 3)))
    found = excerpts(sentences, asked)

    def choose(x: Column) -> Column:
        n = F.size(x["found"])
        quoted = F.concat(F.lit("Based on the uploaded document:\n"), bullets(F.transform(x["found"], lambda e: e["text"])))
        fallback = F.lit("I could not find enough document evidence to answer that confidently.")
        return F.struct(
            F.coalesce(x["direct"], x["contrib"], F.when(n > 0, quoted), fallback).alias("text"),
            F.when(x["direct"].isNotNull(), 0.92).when(x["contrib"].isNotNull(), 0.88).when(n >= 2, 0.72).when(n == 1, 0.58).otherwise(0.2).alias("confidence"),
            F.when(x["direct"].isNotNull(), "fact").when(x["contrib"].isNotNull(), "contribution").when(n > 0, "excerpt").otherwise("none").alias("route"),
        )

    return let(F.struct(direct.alias("direct"), contributions.alias("contrib"), found.alias("found")), choose)


def chat_context(facts: Column, evidence: Column, text: Column, history: Column, asked: Column, opening: int | None = None) -> Column:
    """Prompt text: facts, evidence or else the text (or its opening), the last six turns, the question."""
    turns = F.array_join(
        F.transform(F.slice(history, F.greatest(F.size(history) - 5, F.lit(1)), 6), lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), t["answer"])), "\n"
    )
    source = F.when(F.size(evidence) > 0, bullets(evidence)).otherwise(shorten(text, opening))
    return blocks(
        F.concat(F.lit("FACTS\n"), F.array_join(facts, "\n")), F.concat(F.lit("EVIDENCE\n"), source),
        F.when(turns != "", F.concat(F.lit("HISTORY\n"), turns)), F.concat(F.lit("QUESTION\n"), asked),
    )


def chat_readiness(confidence: Column, text: Column, has_core: Column) -> Column:
    """struct<confidence, status> of a document as a chat source."""
    long = F.char_length(text) >= 500
    return F.struct(
        F.coalesce(confidence, F.when(long, 0.45).otherwise(0.2)).alias("confidence"),
        F.when(has_core | long, "ready").otherwise("partial").alias("status"),
    )


def draft_requests(docs: DataFrame, kind: str, head: Column, text: str = "text") -> DataFrame:
    """Request rows for an outside text generator: one per stretch of the kind's limit, so that nothing is left out."""
    limit = DRAFT_LIMITS[kind]
    source = F.coalesce(F.col(text), F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(F.char_length(source) / limit)).cast("int")
    rows = docs.select("doc_id", source.alias("_source"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.select(
        "doc_id", F.lit(kind).alias("kind"), "part", "parts",
        F.concat(head, F.lit("\nDOCUMENT:\n"), F.col("_source").substr(F.col("part") * limit + 1, F.lit(limit))).alias("request"),
    )


def explain_facts(facts: DataFrame) -> DataFrame:
    """Numbered sentences per document from facts(doc_id, functor, a, b), direct before ontology before derived."""
    # Sentence per functor and evidence tier.
    templates = {
        "method": ("uses the method", 0), "dataset": ("uses the dataset", 0), "accuracy": ("reports accuracy", 0),
        "tool": ("uses the tool", 0), "mentions": ("mentions", 0), "is_a": ("is a kind of", 1), "part_of": ("is part of", 1),
        "related_to": ("is related to", 1),
    }
    words = F.create_map(*[F.lit(x) for k, (t, _) in templates.items() for x in (k, t)])
    tiers = F.create_map(*[F.lit(x) for k, (_, n) in templates.items() for x in (k, n)])
    rows = facts.select(
        "doc_id", F.coalesce(F.try_element_at(tiers, F.col("functor")), F.lit(2)).alias("tier"),
        F.concat(F.col("a"), F.lit(" "), F.coalesce(F.try_element_at(words, F.col("functor")), F.replace("functor", F.lit("_"), F.lit(" "))), F.lit(" "), F.col("b"), F.lit(".")).alias("sentence"),
    ).distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("tier", "sentence")
    return rows.select("doc_id", F.row_number().over(w).alias("no"), "tier", "sentence")

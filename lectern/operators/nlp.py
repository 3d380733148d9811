"""Sentence analysis: entities, key words, key phrases, sentence scores, concepts.

The unit is a document row holding ``sentences`` (array<struct<no, text, ...>>).
Everything that looks at one document stays inside its row, so the corpus needs
no exchange; rows leave by ``explode`` only for output or corpus-wide joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions import text as T
from lectern.functions.arrays import grouped, keep_first, let, run_counts, top_n
from lectern.operators import terms as terms_of

def plain_sentences(text: Column) -> Column:
    """Sentence structs of a text without sections."""
    return F.transform(
        T.sentences(text),
        lambda s, i: F.struct(
            i.alias("no"), s.alias("text"), F.lit("Document").alias("section"), F.lit("other").alias("role"),
            F.lit(1).alias("page"),
        ),
    )


def annotate(docs: DataFrame, terms: dict[str, list[str]] | None = None, scores: bool = False, phrases: str | None = None, words: str | None = None) -> DataFrame:
    """Add tagged tokens and entities to each sentence struct of ``sentences``.

    In the same pass over the texts, where asked: the scores of ``with_scores``, and as the columns named
    the phrases of ``with_key_phrases`` and the words of ``keywords``.
    """
    named = {part: name for part, name in (("phrases", phrases), ("keywords", words)) if name}
    parts = ["tokens", "entities", *(["scores"] if scores else []), *named]
    found = docs.withColumn("_read", terms_of.read(sentence_texts(), parts, terms))

    def sentence(s: Column, i: Column) -> Column:
        own = lambda part: F.get(F.col("_read")[part], i)
        return F.struct(
            s["no"].alias("no"), s["text"].alias("text"), s["section"].alias("section"), s["role"].alias("role"),
            s["page"].alias("page"), own("tokens").alias("tokens"), own("entities").alias("entities"),
            *([own("scores").alias("score")] if scores else []),
        )

    found = found.withColumn("sentences", F.transform("sentences", sentence))
    return found.withColumns({name: F.col("_read")[part] for part, name in named.items()}).drop("_read")


def lexicon_match(sentences: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """Whole-term matches of any-size lexicon(type, term) in sentences.

    A lexicon of a checked size goes to every worker as one automaton. Of a larger one, candidates come from an equi-join on the term's first alphanumeric run, so
    work grows with the matches and not with terms x sentences. That lexicon
    carries no broadcast hint: its size decides at run time.
    """
    if (rows := terms_of.bounded(lexicon)) is not None:
        return terms_of.match_rows(sentences, rows, lexicon.schema["type"].dataType, keys, text).distinct()
    return join_lexicon(sentences, lexicon, keys, text)


def join_lexicon(sentences: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """``lexicon_match`` by an equi-join on first runs, for a lexicon of any size."""
    first_run = F.regexp_extract(F.lower("term"), "[a-z0-9]+", 0)
    terms = lexicon.select("type", "term", F.lower("term").alias("_low"), first_run.alias("_run")).filter(
        F.col("_run") != ""
    )
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    pieces = sentences.select(*keys, F.lower(text).alias("_text"), F.explode(runs).alias("_run"))
    # Boundaries: the term between non-alphanumeric marks, in a text where every such character is one mark.
    padded = F.concat(F.lit(" "), F.col("_text"), F.lit(" "))
    escaped = F.regexp_replace("_low", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    whole = F.contains("_text", F.col("_low")) & F.expr(
        "regexp_like(_padded, concat('[^a-z0-9]', _escaped, '[^a-z0-9]'))"
    )
    return (
        pieces.withColumn("_padded", padded)
        .join(terms.withColumn("_escaped", escaped), "_run")
        .filter(whole)
        .select(*keys, "type", "term")
        .distinct()
    )


def keywords(sentences: Column, n: int = 12) -> Column:
    """Most frequent content words: array<struct<value, n, first>>, ties by first use."""
    words = F.flatten(F.transform(sentences, lambda s: F.transform(T.content_tokens(s["tokens"]), lambda t: t["lower"])))
    return top_n(run_counts(words), lambda r: F.struct((-r["n"]).alias("a"), r["first"].alias("b")), n)


def text_keywords(sentences: Column, n: int = 12) -> Column:
    """The same key words straight from the sentence texts, without tagging any token."""

    def content(s: Column) -> Column:
        # Tokens start with a letter or a digit, and ":" follows "9": numbers sort below it.
        low = F.transform(F.filter(T.tokens(s["text"]), lambda w: w >= F.lit(":")), F.lower)
        return F.filter(low, lambda w: (F.char_length(w) >= 3) & ~T.is_stop_word(w))

    words = F.flatten(F.transform(sentences, content))
    return top_n(run_counts(words), lambda r: F.struct((-r["n"]).alias("a"), r["first"].alias("b")), n)


def study_keywords(text: Column, n: int = 12) -> Column:
    """Words of four letters and more used at least twice, by count then alphabet."""
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z-]{3,}"), F.lit(0)),
        lambda w: ~w.isin(T.STUDY_STOP_WORDS),
    )
    counted = F.filter(run_counts(words), lambda r: r["n"] >= 2)
    return top_n(counted, lambda r: F.struct((-r["n"]).alias("a"), r["value"].alias("b")), n)


def sentence_ngrams(tokens: Column, sizes=(2, 3, 4)) -> Column:
    """Runs of consecutive content tokens without verb forms or adverbs."""

    def runs_of(c: Column, k: int) -> Column:
        def phrase(_: Column, i: Column) -> Column:
            part = F.slice(c, i + 1, k)
            verbal = F.exists(part, lambda x: x["pos"].isin("VB", "VBG", "VBN", "RB"))
            joined = F.array_join(F.transform(part, lambda x: x["lower"]), " ")
            return F.when((i + k <= F.size(c)) & ~verbal, joined)

        return F.array_compact(F.transform(c, phrase))

    def grams(c: Column) -> Column:
        return F.concat(*[runs_of(c, k) for k in sizes])

    return let(T.content_tokens(tokens), grams)


def sentence_texts() -> Column:
    return F.transform("sentences", lambda s: s["text"])


def with_key_phrases(docs: DataFrame, terms: dict[str, list[str]] | None = None, n: int = 30, name: str = "phrases") -> DataFrame:
    """Add the weighted phrases (array<struct<value, n>>) of each document: n-grams count one, entities four; two or more needed."""
    return docs.withColumn(name, terms_of.key_phrases(sentence_texts(), terms, n))


def combined_keywords(phrases: Column, words: Column) -> Column:
    """Twelve phrases then twelve words, twenty in all."""
    both = F.concat(
        F.transform(F.slice(phrases, 1, 12), lambda p: p["value"]), F.transform(words, lambda w: w["value"])
    )
    return F.slice(both, 1, 20)


@pandas_udf(ArrayType(DoubleType()))
def overlap_scores(word_sets: pd.Series) -> pd.Series:
    """Mean Jaccard overlap of each sentence with the others, relative to the document's best.

    One document at a time, in blocks of rows, as incidence-matrix products:
    pairs are summed where they arise and never become rows.
    """

    def score(sets) -> list[float] | None:
        if sets is None:
            return None
        codes: dict[str, int] = {}
        words = np.array([codes.setdefault(w, len(codes)) for s in sets for w in s], dtype=np.int64)
        return list(terms_of.overlap(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), words, len(sets)))

    return word_sets.map(score)


def max_normalise(scores: DataFrame, unit: str, value: str, floor: float = 0.0001) -> DataFrame:
    """Scores relative to the best of their unit (at least ``floor``).

    The maximum comes from an aggregation joined back, so a unit with very many rows is combined
    before the exchange and its join can be split, which a window over it could not.
    """
    top = scores.groupBy(unit).agg(F.max(value).alias("_top"))
    return scores.join(top, unit).withColumn(value, F.col(value) / F.greatest("_top", F.lit(floor))).drop("_top")


def with_scores(docs: DataFrame) -> DataFrame:
    """Add ``score`` to each sentence struct."""
    scored = docs.withColumn("_scores", terms_of.read(sentence_texts(), ["scores"])["scores"])
    return scored.withColumn(
        "sentences", F.transform("sentences", lambda s, i: s.withField("score", F.get(F.col("_scores"), i)))
    ).drop("_scores")


def top_sentences(sentences: Column, n: int = 8) -> Column:
    """Best sentences by score, back in document order."""
    best = top_n(sentences, lambda s: F.struct((-s["score"]).alias("a"), s["no"].alias("b")), n)
    return F.sort_array(F.transform(best, lambda s: F.struct(s["no"].alias("no"), s["text"].alias("text"))))


def document_entities(sentences: Column) -> Column:
    every = F.flatten(F.transform(sentences, lambda s: s["entities"]))
    return keep_first(every, lambda e: F.struct(e["type"], F.lower(e["text"])))


def nlp_result(docs: DataFrame, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Sentences with tokens, entities and score; key phrases, key words, entities, best sentences."""
    full = annotate(docs, terms, scores=True, phrases="phrases", words="words")
    return (
        full.withColumn("key_phrases", F.transform("phrases", lambda p: p["value"]))
        .withColumn("keywords", combined_keywords(F.col("phrases"), F.col("words")))
        .withColumn("entities", document_entities(F.col("sentences")))
        .withColumn("top_sentences", top_sentences(F.col("sentences")))
        .drop("phrases", "words")
    )


# ---- concepts ------------------------------------------------------------------------------------


def invalid_reason(term: Column) -> Column:
    value = T.strip(term)
    return (
        F.when(F.char_length(value) < 3, "too short")
        .when(T.is_number(value), "number")
        .when(value.rlike(r"^\[?[0-9]+(?: *[,–-] *[0-9]+)*\]?$"), "citation")
        .when(value.rlike(r"(?i)^(?:section|figure|page) +[0-9]+"), "label")
        .when(F.lower(value) == "map", "ambiguous")
    )


def normalise_term(term: Column) -> Column:
    """Lower-case term of plain characters, null when it cannot be a concept."""
    value = T.squeeze_strip(F.regexp_replace(F.lower(term), r"[^a-z0-9-]", " "))
    return let(value, lambda v: F.when(invalid_reason(v).isNull(), v))


def concept_candidates(sentences: Column, phrases: Column, n: int = 40) -> Column:
    """Concepts with weight, evidence, sections, score and validity, best first."""

    def mentions(s: Column, phrases: Column) -> Column:
        def mention(term: Column, weight: int) -> Column:
            return F.struct(
                normalise_term(term).alias("norm"), term.alias("term"), F.lit(weight).alias("weight"),
                s["no"].alias("no"), s["text"].alias("text"), s["section"].alias("section"),
            )

        named = F.filter(s["entities"], lambda e: e["type"].isin("METHOD", "ALGORITHM", "TOOL", "CONCEPT"))
        held = let(F.lower(s["text"]), lambda low: F.filter(phrases, lambda p: F.contains(low, p)))
        return F.concat(
            F.transform(named, lambda e: mention(e["text"], 3)), F.transform(held, lambda p: mention(p, 1))
        )

    found = let(phrases, lambda ps: F.flatten(F.transform(sentences, lambda s: mentions(s, ps))))
    every = F.filter(found, lambda m: m["norm"].isNotNull())

    def concept(g: Column) -> Column:
        items = g["items"]
        occurrences = F.aggregate(items, F.lit(0), lambda acc, m: acc + m["weight"])
        longest = F.aggregate(
            items,
            F.lit(""),
            lambda acc, m: F.when(F.char_length(m["term"]) > F.char_length(acc), m["term"]).otherwise(acc),
        )
        evidence = keep_first(
            F.transform(
                items, lambda m: F.struct(m["no"].alias("no"), m["text"].alias("text"), m["section"].alias("section"))
            ),
            lambda e: e["text"],
        )
        return F.struct(
            g["first"].alias("first"), g["key"].alias("norm"), longest.alias("term"),
            occurrences.alias("occurrences"), evidence.alias("evidence"),
        )

    def score(c: Column) -> Column:
        value = F.least(
            F.lit(1.0), 0.35 + c["occurrences"] * 0.08 + F.least(F.lit(0.25), F.size(c["evidence"]) * 0.05)
        )
        reason = invalid_reason(c["term"])
        return F.struct(
            c["norm"].alias("norm"), T.capitalise_words(c["term"]).alias("term"), c["occurrences"].alias("occurrences"),
            F.slice(c["evidence"], 1, 4).alias("evidence"),
            F.array_distinct(F.transform(c["evidence"], lambda e: e["section"])).alias("sections"),
            F.size(c["evidence"]).alias("n_evidence"), value.alias("score"), reason.isNull().alias("valid"),
            reason.alias("reason"), c["first"].alias("first"),
        )

    concepts = F.transform(F.transform(grouped(every, lambda m: m["norm"]), concept), score)
    return top_n(
        concepts,
        lambda c: F.struct(
            (~c["valid"]).alias("a"), (-c["score"]).alias("b"), (-F.char_length(c["term"])).alias("c"), c["first"].alias("d")
        ),
        n,
    )

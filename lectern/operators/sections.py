"""Sections, pages of sections and chunks, inside the document row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lectern.functions import headings as H
from lectern.functions import text as T
from lectern.functions.arrays import let
from lectern.operators.cleaning import strip_citation_noise

# Chunk sizes.
CHUNK_CHARS, CHUNK_OVERLAP = 4600, 2
PARAGRAPH_CHUNK_CHARS, MAX_SAMPLED_CHUNKS = 10_000, 6


def heading_candidates(text: Column) -> Column:
    """Headings of a text with their offsets: array<struct<line, heading, number, level, start, body>>."""

    def find(lines: Column) -> Column:
        shaped = F.transform(lines, lambda l, i: F.struct(i.alias("i"), H.heading_of(l).alias("h")))
        # Number of the last line that is not blank: a heading after it heads nothing.
        trimmed = F.regexp_replace(text, T.WS + "+$", "")
        last = F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit("\n"), F.lit("")))
        hits = F.filter(shaped, lambda s: s["h"].isNotNull())

        def starts_of(hits: Column) -> Column:
            """Where each heading begins: from one heading to the next, so every line is measured once."""

            def step(acc: Column, s: Column) -> Column:
                way = F.aggregate(F.slice(lines, acc["i"] + 1, s["i"] - acc["i"]), F.lit(0), lambda n, l: n + F.char_length(l) + 1)
                return let(acc["at"] + way, lambda at: F.struct(s["i"].alias("i"), at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

            begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(hits, begin, step, lambda acc: acc["out"])

        def place(s: Column, at: Column, last: Column) -> Column:
            return F.struct(
                s["h"]["line"].alias("line"), s["h"]["heading"].alias("heading"), s["h"]["number"].alias("number"),
                s["h"]["level"].alias("level"), at.alias("start"),
                (at + F.char_length(s["h"]["line"]) + 1).alias("body"), (s["i"] < last).alias("followed"),
            )

        def genuine(c: Column) -> Column:
            return (F.size(F.split(c["heading"], T.WS + "+")) <= 12) & (
                c["followed"] | (F.lower(c["heading"]) == "references")
            )

        def placed(x: Column) -> Column:
            found = let(starts_of(x["hits"]), lambda at: F.transform(x["hits"], lambda s, k: place(s, F.get(at, k), x["last"])))
            return F.filter(found, genuine)

        return let(F.struct(hits.alias("hits"), last.alias("last")), placed)

    return let(F.split(text, "\n"), find)


def page_span(pages: Column, length: Column, page_count: Column, start: Column, end: Column) -> Column:
    """struct<first, last, estimate> of the pages holding an offset range."""

    def holding(at: Column) -> Column:
        return F.filter(pages, lambda p: (at >= p["start"]) & (at <= p["end"]))

    def estimated(at: Column) -> Column:
        return F.least(page_count, F.greatest(F.lit(1), F.floor(at / length * page_count).cast("int") + 1))

    first = F.get(holding(start), F.lit(0))["page_no"]
    last = F.try_element_at(holding(end), F.lit(-1))["page_no"]
    single = (page_count <= 1) | (length == 0)
    return F.when(
        F.size(pages) > 1,
        F.struct(first.alias("first"), F.coalesce(last, first).alias("last"), F.lit(False).alias("estimate")),
    ).otherwise(
        F.when(
            single, F.struct(F.lit(1).alias("first"), F.lit(1).alias("last"), (page_count > 1).alias("estimate"))
        ).otherwise(F.struct(estimated(start).alias("first"), estimated(end).alias("last"), F.lit(True).alias("estimate")))
    )


def detect_sections(docs: DataFrame) -> DataFrame:
    """Add ``sections`` to cleaned documents(display_text, analysis_text, source_pages[, page_count])."""
    count = F.col("page_count") if "page_count" in docs.columns else F.size("source_pages")
    text, length = F.col("display_text"), F.char_length("display_text")

    def section(ident, title, role, heading, number, level, body, analysis, start, end) -> Column:
        return F.struct(
            ident.alias("id"), title.alias("title"), role.alias("role"), heading.alias("heading"),
            number.cast("string").alias("number"), level.alias("level"), body.alias("body"),
            analysis.alias("analysis_body"), start.cast("int").alias("start"), end.cast("int").alias("end"),
            page_span(F.col("source_pages"), length, count, start, end).alias("pages"),
        )

    nothing = F.lit(None)
    whole = section(
        F.lit("section-document"), F.lit("other"), F.lit("other"), F.lit("Document"), nothing, F.lit(1),
        text, F.col("analysis_text"), F.lit(0), length,
    )

    def split(found: Column) -> Column:
        lead = T.strip(text.substr(F.lit(1), F.get(found, F.lit(0))["start"]))
        preamble = let(
            lead,
            lambda b: F.when(
                b != "",
                F.array(
                    section(
                        F.lit("section-preamble"), F.lit("other"), F.lit("title"), F.lit("Preamble"), nothing, F.lit(1),
                        b, strip_citation_noise(b), F.lit(0), F.get(found, F.lit(0))["start"],
                    )
                ),
            ),
        )

        def one(c: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["start"], length)
            body = T.strip(text.substr(c["body"] + 1, F.greatest(end - c["body"], F.lit(0))))
            slug = T.slugify(F.concat_ws("-", F.coalesce(c["number"], F.lit("")), c["heading"]))
            return let(
                F.struct(H.map_heading(c["heading"]).alias("m"), body.alias("b"), slug.alias("slug")),
                lambda x: section(
                    F.concat(F.lit("section-"), F.when(x["slug"] != "", x["slug"]).otherwise((i + 1).cast("string"))),
                    x["m"]["title"], x["m"]["role"], T.strip(c["line"]), c["number"], c["level"],
                    x["b"], strip_citation_noise(x["b"]), c["start"], end,
                ),
            )

        rest = F.transform(found, one)
        return F.when(F.size(found) == 0, F.array(whole)).otherwise(
            F.when(preamble.isNotNull(), F.concat(preamble, rest)).otherwise(rest)
        )

    titled = docs.withColumn("sections", let(heading_candidates(text), split))
    titles = F.transform("sections", lambda s: s["title"])
    return titled.withColumn("has_abstract", F.array_contains(titles, "abstract")).withColumn(
        "has_methodology", F.arrays_overlap(titles, F.array(F.lit("methodology"), F.lit("experiments")))
    )


def section_sentences(sections: Column) -> Column:
    """Sentence structs of all sections but the references, numbered through the document."""
    nested = F.transform(
        F.filter(sections, lambda s: s["role"] != "references"),
        lambda s: F.transform(
            T.sentences(s["analysis_body"]),
            lambda t, i: F.struct(
                t.alias("text"), s["heading"].alias("section"), H.section_role(s["heading"]).alias("role"),
                s["pages"]["first"].alias("page"), s["id"].alias("section_id"), (i + 1).alias("in_section"),
            ),
        ),
    )
    return F.transform(
        F.flatten(nested),
        lambda s, i: F.struct(
            i.alias("no"), s["text"].alias("text"), s["section"].alias("section"), s["role"].alias("role"),
            s["page"].alias("page"), s["section_id"].alias("section_id"), s["in_section"].alias("in_section"),
        ),
    )


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def chunk_spans(max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP):
    """UDF from sentence lengths to chunk ranges; only lengths travel, texts stay in the JVM."""

    @pandas_udf(_SPANS)
    def spans(lengths: pd.Series) -> pd.Series:
        def pack(sizes) -> list[dict]:
            out, begin, n = [], 0, 0 if sizes is None else len(sizes)
            while begin < n:
                total, stop = int(sizes[begin]), begin + 1
                while stop < n and total + 1 + int(sizes[stop]) <= max_chars:
                    total += 1 + int(sizes[stop])
                    stop += 1
                out.append({"start": begin, "end": stop})
                if stop == n:
                    break
                begin = max(begin + 1, stop - overlap)
            return out

        return lengths.map(pack)

    return spans


def chunk_sections(sectioned: DataFrame, key: str, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk of documents(key, sections): sentences packed greedily with overlap."""
    rows = sectioned.select(key, F.posexplode("sections").alias("sec_no", "s")).filter(
        (F.col("s.role") != "references") & (T.strip(F.col("s.analysis_body")) != "")
    )
    rows = rows.select(
        key, "sec_no", F.col("s.id").alias("section_id"), F.col("s.heading").alias("section"), F.col("s.role").alias("role"),
        F.col("s.pages.first").alias("page_start"), F.col("s.pages.last").alias("page_end"),
        T.sentences(F.col("s.analysis_body")).alias("_sentences"),
    )
    sized = rows.withColumn(
        "_spans", chunk_spans(max_chars, overlap)(F.transform("_sentences", lambda x: F.char_length(x)))
    )
    parts = sized.select("*", F.posexplode("_spans").alias("part", "_span"))
    text = F.array_join(F.slice("_sentences", F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")), " ")
    return parts.select(
        key, "sec_no", "section_id", "section", "role", "page_start", "page_end", (F.col("part") + 1).alias("part"),
        F.concat_ws("", F.col("section_id"), F.lit("-chunk-"), (F.col("part") + 1).cast("string")).alias("chunk_id"),
        text.alias("text"),
        F.col("_span.start").alias("first_sentence"), F.col("_span.end").alias("after_sentence"),
        F.greatest(
            F.lit(0), F.coalesce(F.get("_spans", F.col("part") - 1)["end"] - F.col("_span.start"), F.lit(0))
        ).alias("overlap"),
    ).withColumn("token_estimate", T.token_estimate(F.col("text")))


_CUTS = ArrayType(
    StructType([StructField(f, IntegerType()) for f in ("first", "last", "offset", "length")])
)


def paragraph_spans(max_chars: int = PARAGRAPH_CHUNK_CHARS):
    """UDF from paragraph lengths to ranges; a paragraph over the limit becomes hard cuts."""

    @pandas_udf(_CUTS)
    def spans(lengths: pd.Series) -> pd.Series:
        def pack(sizes) -> list[dict]:
            out: list[dict] = []
            first, total = -1, 0
            sizes = [] if sizes is None else [int(x) for x in sizes]

            def flush(stop: int) -> None:
                if first >= 0:
                    out.append({"first": first, "last": stop, "offset": -1, "length": 0})

            for i, size in enumerate(sizes):
                if size > max_chars:
                    flush(i - 1)
                    first = -1
                    out.extend(
                        {"first": i, "last": i, "offset": at, "length": max_chars} for at in range(0, size, max_chars)
                    )
                elif first < 0:
                    first, total = i, size
                elif total + 2 + size > max_chars:
                    flush(i - 1)
                    first, total = i, size
                else:
                    total += 2 + size
            flush(len(sizes) - 1)
            return out

        return lengths.map(pack)

    return spans


def split_paragraphs(docs: DataFrame, key: str, text: str, max_chars: int = PARAGRAPH_CHUNK_CHARS) -> DataFrame:
    """One row per paragraph chunk."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), T.strip), lambda p: p != "")
    df = docs.select(key, parts.alias("_paragraphs"))
    df = df.withColumn("_spans", paragraph_spans(max_chars)(F.transform("_paragraphs", lambda p: F.char_length(p))))
    df = df.select(key, "_paragraphs", F.posexplode("_spans").alias("chunk_no", "_s"))
    whole = F.array_join(
        F.slice("_paragraphs", F.col("_s.first") + 1, F.col("_s.last") - F.col("_s.first") + 1), "\n\n"
    )
    cut = T.strip(F.get("_paragraphs", F.col("_s.first")).substr(F.col("_s.offset") + 1, F.col("_s.length")))
    return df.select(key, "chunk_no", F.when(F.col("_s.offset") < 0, whole).otherwise(cut).alias("text"))


def even_sample(items: Column, n: int = MAX_SAMPLED_CHUNKS) -> Column:
    """At most ``n`` elements spread evenly from the first to the last."""
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.size(items) - 1) / (n - 1) + 0.5).cast("int")
    )
    return F.when(F.size(items) <= n, items).otherwise(F.transform(picks, lambda p: F.get(items, p)))


def source_bundle(chunks: Column) -> Column:
    """Chunks as one titled text with page labels."""
    return F.array_join(
        F.transform(
            chunks,
            lambda c: F.concat(
                F.lit("["), c["section"],
                F.when(c["page"].isNotNull(), F.concat(F.lit(", page "), c["page"].cast("string"))).otherwise(""),
                F.lit("]\n"), c["text"],
            ),
        ),
        "\n\n",
    )

"""Cleaning, headers and text quality over the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let
from lectern.operators import cleaning as C
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.text_queries import _BAD, _KEY, _TIDY, _VISIBLE, _ratio_sql, document_lines
from lectern.sources import tables as S

# A one-word line stands in for the references heading, which the corpus lacks.
ONE_WORD = r"^[A-Z][a-z]+\.$"

_KEYS = f"""{Q.LINES}, tidy AS (SELECT l.doc_id, source, line_no, {Q.strip(_TIDY)} AS line FROM lines l JOIN documents d USING (doc_id)),
keys AS (SELECT *, trim({Q.squeeze(_KEY)}, ' ') AS line_key FROM tidy)"""


@query(
    "running_header_detect",
    f"""WITH {_KEYS}, c AS (SELECT source, line_key, count(DISTINCT doc_id) AS pages FROM keys WHERE length(line_key) BETWEEN 4 AND 140 GROUP BY 1, 2),
n AS (SELECT source, count(*) AS total FROM documents GROUP BY 1)
SELECT source, line_key, pages FROM c JOIN n USING (source) WHERE pages >= greatest(2, ceil(total * 0.05))""",
)
def running_header_detect(spark, sf):
    """Documents of one source as its pages; with unrelated texts five per cent is the telling share."""
    docs = S.documents(spark, sf)
    return C.running_headers(docs, "source", "doc_id", "text", share=0.05)


@query(
    "repeated_line_detect",
    f"""WITH {_KEYS} SELECT doc_id, line_key FROM keys WHERE length(line_key) BETWEEN 4 AND 140 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def repeated_line_detect(spark, sf):
    return C.repeated_lines(S.documents(spark, sf), "doc_id", "text")


@query(
    "reference_truncation",
    f"""WITH {_KEYS}, f AS (SELECT *, max(CASE WHEN regexp_matches(line, '{ONE_WORD}') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS reached FROM keys)
SELECT doc_id, line_no, line FROM f WHERE reached = 0 AND line <> '' AND NOT regexp_matches(line, '{T.PAGE_NUMBER}')""",
)
def reference_truncation(spark, sf):
    """Lines before the first one-word line, whatever follows."""
    pages = F.array(F.struct(F.lit(1).alias("page_no"), F.col("text").alias("raw_text")))
    lines = S.documents(spark, sf).select("doc_id", F.explode(C.page_lines(pages, ONE_WORD)).alias("l"))
    return lines.filter((F.col("l.kind") == "analysis") & (F.col("l.text") != "")).select(
        "doc_id", F.col("l.no").alias("line_no"), F.col("l.text").alias("line")
    )


@query(
    "first_header_preserve",
    f"""WITH {_KEYS}, h AS (SELECT source, line_key FROM keys WHERE length(line_key) BETWEEN 4 AND 140 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2),
r AS (SELECT k.*, h.line_key IS NOT NULL AS head, row_number() OVER (PARTITION BY k.source, k.line_key ORDER BY doc_id, line_no) AS rn
  FROM keys k LEFT JOIN h ON h.source = k.source AND h.line_key = k.line_key)
SELECT doc_id, line_no, line_key FROM r WHERE NOT head OR rn = 1""",
)
def first_header_preserve(spark, sf):
    docs = S.documents(spark, sf)
    lines = docs.select(
        "doc_id", "source", F.posexplode(F.split(T.unix_newlines(F.col("text")), "\n")).alias("line_no", "line")
    ).withColumn("line", T.tidy_line(F.col("line"))).withColumn("line_key", C.header_key(F.col("line")))
    headers = C.running_headers(docs, "source", "doc_id", "text", share=0.0)
    # Lines too long or too short for a header meet none: they need no exchange.
    could_be = F.coalesce(F.char_length("line_key").between(C.HEADER_MIN, C.HEADER_MAX), F.lit(False))
    kept = C.first_header_only(lines.filter(could_be).drop("line"), headers, "source", ["doc_id", "line_no"])
    others = lines.filter(~could_be).select("doc_id", "line_no", T.line_key(F.col("line")).alias("line_key"))
    return kept.select("doc_id", "line_no", "line_key").unionByName(others)


@query(
    "page_offsets",
    """SELECT doc_id, source, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents""",
)
def page_offsets(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    return C.running_total(docs, "source", "doc_id", F.col("n") + 2, block=256).select("doc_id", "source", "start")


@query(
    "line_offsets",
    f"""WITH {Q.LINES} SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines""",
)
def line_offsets(spark, sf):
    lines = document_lines(spark, sf).select("doc_id", "line_no", F.char_length("line").alias("n"))
    return C.running_total(lines, "doc_id", "line_no", F.col("n") + 1).select("doc_id", "line_no", "start")


@query(
    "strip_citations",
    "SELECT doc_id, turn, CAST(len(regexp_extract_all(t, '\\[(?:[0-9]+(?:[ ]*[,–-][ ]*[0-9]+)*)\\]')) AS INTEGER) AS found, trim(regexp_replace(t, '\\[(?:[0-9]+(?:[ ]*[,–-][ ]*[0-9]+)*)\\]', '', 'g'), ' ') AS bare FROM (SELECT conv_id AS doc_id, turn, replace(replace(replace(text, chr(10), ' '), '.', ' [' || turn || ', 3].'), ' [' , '[') AS t FROM conversations)",
)
def strip_citations(spark, sf):
    """Conversation turns with a numeric citation before every full stop."""
    mark = F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit(", 3]."))
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    t = F.replace(F.replace(flat, F.lit("."), mark), F.lit(" ["), F.lit("["))
    return S.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", C.count_citations(t).alias("found"),
        F.trim(C.strip_citations(t)).alias("bare"),
    )


@query(
    "strip_citation_noise",
    f"""SELECT conv_id AS doc_id, turn, {Q.strip(f"regexp_replace(regexp_replace(replace(text, '.', ' [' || turn || ', 3] .'), '" + C.NUMERIC_CITATION + f"', '', 'g'), '{Q.WS}+([.,;:!?])', '\\1', 'g')")} AS bare FROM conversations""",
)
def strip_citation_noise(spark, sf):
    mark = F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit(", 3] ."))
    return S.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", C.strip_citation_noise(F.replace(F.col("text"), F.lit("."), mark)).alias("bare")
    )


def _layout_sql(expr):
    t = f"replace({expr}, chr(9), ' ')"
    t = f"regexp_replace({t}, '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g')"
    # RE2 has no look-ahead: mark the joint, then drop the mark.
    t = f"regexp_replace({t}, '([a-z0-9,;:])\\n([a-z(])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '[ ]{{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return Q.strip(f"regexp_replace({t}, '{Q.WS}+([.,;:!?])', '\\1', 'g')")


@query(
    "normalise_layout",
    f"""WITH t AS (SELECT doc_id, replace(replace(text, ', ', ',' || chr(10)), 'en', 'e-' || chr(10) || 'n') AS t FROM documents)
SELECT doc_id, {_layout_sql('t')} AS layout, CAST(len(regexp_extract_all(t, '(\\p{{L}})-\\n(\\p{{Ll}})')) AS INTEGER) AS joins FROM t""",
)
def normalise_layout(spark, sf):
    """Texts broken after every comma and inside every "en"."""
    broken = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(",\n")), F.lit("en"), F.lit("e-\nn"))
    docs = S.documents(spark, sf).select("doc_id", broken.alias("t"))
    return docs.select(
        "doc_id", C.normalise_layout(F.col("t"), True).alias("layout"),
        F.regexp_count("t", F.lit(C.HYPHEN_BREAK)).alias("joins"),
    )


_Q = f"""WITH q AS (SELECT doc_id, length(text) AS n, {_ratio_sql('least(1.0 * length(text), ' + _BAD + ')', 'length(text)')} AS suspicious,
  {_ratio_sql(Q.count_matches('text', chr(92) + 'p{Greek}'), _VISIBLE)} AS greek,
  {_ratio_sql(Q.count_matches('text', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]'), _VISIBLE)} AS readable,
  greatest(1, len(regexp_split_to_array(text, '\\r?\\n'))) AS lines, CAST(doc_id % 3 AS DOUBLE) AS corrupt, CAST(doc_id % 4 AS DOUBLE) AS repeated FROM documents),
s AS (SELECT *, greatest(0.0, least(1.0, 1 - suspicious * 2.5 - greatest(0, greek - 0.08) * 1.2 - greatest(0, 0.62 - readable) * 0.9
  - least(0.32, (corrupt + repeated * 0.35) / lines) - greatest(0, 0.45 - least(1.0, n / greatest(400.0, n * 0.28))) * 0.45)) AS score FROM q)"""


@query(
    "text_quality_score",
    f"""{_Q} SELECT doc_id, round(score, 6) AS score, score >= 0.72 AND n >= 250 AS passed,
  CAST((corrupt > 0)::INT + (repeated > 0)::INT + (suspicious > 0.04)::INT + (readable < 0.6)::INT + (n < 250)::INT AS INTEGER) AS warnings FROM s""",
)
def text_quality_score(spark, sf):
    """Quality of each text taken as its own cleaned form, with stated line counts."""
    corrupt, repeated = F.col("doc_id") % 3, F.col("doc_id") % 4
    docs = S.documents(spark, sf).select("doc_id", C.quality(F.col("text"), F.col("text"), corrupt, repeated).alias("q"))
    return docs.select("doc_id", F.round("q.score", 6).alias("score"), "q.passed", F.size("q.warnings").alias("warnings"))


@query("usable_text_gate", f"{_Q} SELECT doc_id FROM s WHERE score >= 0.72 AND n >= 250")
def usable_text_gate(spark, sf):
    return text_quality_score(spark, sf).filter("passed").select("doc_id")


@query("clean_text_reliably")
def clean_text_reliably(spark, sf):
    docs = C.clean_text_reliably(S.documents(spark, sf))
    return docs.select(
        "doc_id", F.col("clean.text").alias("text"), F.round("clean.quality.score", 6).alias("score"),
        "clean.corrupt_lines", "clean.repeated_lines", "clean.page_numbers",
    )


def cleaned(spark, sf, judged=False):
    """Documents cleaned with every five lines as one page."""
    lines = F.split(T.unix_newlines(F.col("text")), "\n")
    pages = let(
        lines,
        lambda ls: F.transform(
            F.sequence(F.lit(0), F.size(ls) - 1, F.lit(5)),
            lambda at, i: F.struct((i + 1).alias("page_no"), F.array_join(F.slice(ls, at + 1, 5), "\n").alias("raw_text")),
        ),
    )
    return C.clean_documents(S.documents(spark, sf).select("doc_id", "source", F.col("text").alias("raw_text"), pages.alias("pages")), judged=judged)


@query("clean_document")
def clean_document(spark, sf):
    """Both texts of every document, its pages with their place, texts and quality, and what was removed."""
    docs = cleaned(spark, sf, judged=True)
    return docs.select("doc_id", "display_text", "analysis_text", F.size("source_pages").alias("pages"), "source_pages", "stats")


@query("cleaning_stats")
def cleaning_stats(spark, sf):
    return cleaned(spark, sf).select("doc_id", "stats.*")

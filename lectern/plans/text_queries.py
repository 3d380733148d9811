"""Scalar text functions over every line or sentence of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as T
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.sources import tables


def document_lines(spark, sf) -> DataFrame:
    docs = tables.documents(spark, sf).select("doc_id", T.unix_newlines(F.col("text")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def document_sentences(spark, sf) -> DataFrame:
    return tables.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query("normalise_line")
def normalise_line(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", T.normalise_line(F.col("line")).alias("line"))


_KEY = (
    "regexp_replace(regexp_replace(lower(line), '\\bpage" + Q.WS + "+[0-9]+\\b', 'page #', 'g'), '\\b[0-9]+\\b', '#', 'g')"
)


@query(
    "repeated_line_key",
    f"WITH {Q.LINES} SELECT doc_id, line_no, trim({Q.squeeze(_KEY)}, ' ') AS line_key FROM lines",
)
def repeated_line_key(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", T.line_key(F.col("line")).alias("line_key"))


def _ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / CAST({whole} AS DOUBLE) ELSE 0.0 END"


_BAD = (
    Q.count_matches("text", T.SUSPICIOUS) + " + 2 * " + Q.count_matches("text", T.BROKEN)
    + " + 2 * " + Q.count_matches("text", T.CONTROL)
)
_VISIBLE = Q.count_matches("text", T.NON_WS)


@query(
    "corrupt_ratio",
    f"SELECT doc_id, round(least(1.0, {_ratio_sql(_BAD, 'length(text)')}), 6) AS ratio FROM documents",
)
def corrupt_ratio(spark, sf):
    return tables.documents(spark, sf).select("doc_id", F.round(T.corrupt_ratio(F.col("text")), 6).alias("ratio"))


@query(
    "greek_ratio",
    f"SELECT doc_id, round({_ratio_sql(Q.count_matches('text', chr(92) + 'p{Greek}'), _VISIBLE)}, 6) AS ratio FROM documents",
)
def greek_ratio(spark, sf):
    return tables.documents(spark, sf).select("doc_id", F.round(T.greek_ratio(F.col("text")), 6).alias("ratio"))


@query(
    "readable_ratio",
    f"SELECT doc_id, round({_ratio_sql(Q.count_matches('text', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]'), _VISIBLE)}, 6) AS ratio FROM documents",
)
def readable_ratio(spark, sf):
    return tables.documents(spark, sf).select("doc_id", F.round(T.readable_ratio(F.col("text")), 6).alias("ratio"))


def _noise_sql(col: str) -> str:
    bad = "(" + _BAD.replace("text", col) + ")"
    visible = _VISIBLE.replace("text", col)
    latin = Q.count_matches(col, "\\p{Latin}")
    greek = Q.count_matches(col, "\\p{Greek}")
    readable = Q.count_matches(col, "[\\p{L}\\p{N}]")
    english = "|".join(T.CLEARING_WORDS)
    return f"""(length({col}) >= 12 AND ({_ratio_sql(bad, f'length({col})')} > 0.08
      OR {_ratio_sql(readable, visible)} < 0.48
      OR ({_ratio_sql(greek, visible)} > 0.22 AND {latin} / CAST(greatest(1, length({col})) AS DOUBLE) < 0.18
          AND NOT regexp_matches({col}, '(?i)\\b(?:{english})\\b'))))"""


_TIDY = "regexp_replace(regexp_replace(regexp_replace(line, '" + T.BROKEN + "', '', 'g'), '" + T.CONTROL + "', '', 'g'), '[ \\t]+', ' ', 'g')"


@query(
    "encoding_noise",
    f"""WITH {Q.LINES}, tidy AS (SELECT doc_id, line_no, {Q.strip(_TIDY)} AS line FROM lines)
SELECT doc_id, line_no, {_noise_sql('line')} AS noisy FROM tidy""",
)
def encoding_noise(spark, sf):
    tidy = document_lines(spark, sf).withColumn("line", T.tidy_line(F.col("line")))
    return tidy.select("doc_id", "line_no", T.encoding_noise(F.col("line")).alias("noisy"))


@query("collapse_line_phrase")
def collapse_line_phrase(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", T.collapse_line_phrase(F.col("line")).alias("line"))


_WORDS = f"list_filter(regexp_split_to_array(line, '{Q.WS}+'), lambda w: w <> '')"
_LOW_WORDS = f"list_filter(regexp_split_to_array(lower(line), '{Q.WS}+'), lambda w: w <> '')"


@query(
    "repeated_bigram_ratio",
    f"""WITH {Q.LINES}, w AS (SELECT doc_id, line_no, {_LOW_WORDS} AS w FROM lines),
p AS (SELECT doc_id, line_no, len(w) AS n, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS pairs FROM w)
SELECT doc_id, line_no, round(CASE WHEN n >= 4 THEN 1 - len(list_distinct(pairs)) / CAST(len(pairs) AS DOUBLE)
  ELSE 0.0 END, 6) AS ratio FROM p""",
)
def repeated_bigram_ratio(spark, sf):
    return document_lines(spark, sf).select(
        "doc_id", "line_no", F.round(T.repeated_bigram_ratio(F.col("line")), 6).alias("ratio")
    )


@query("split_sentences", f"WITH {Q.sentences()} SELECT doc_id, sent_no, sentence FROM sentences")
def split_sentences(spark, sf):
    return document_sentences(spark, sf)


@query(
    "tokenise",
    f"WITH {Q.sentences()}, {Q.TOKENS} SELECT doc_id, sent_no, CAST(tok_no - 1 AS INTEGER) AS tok_no, word, low, low IN ({Q.STOP}) AS stop FROM tokens",
)
def tokenise(spark, sf):
    tagged = document_sentences(spark, sf).select(
        "doc_id", "sent_no", F.posexplode(T.tokens(F.col("sentence"))).alias("tok_no", "word")
    )
    low = F.lower("word")
    return tagged.select("doc_id", "sent_no", "tok_no", "word", low.alias("low"), T.is_stop_word(low).alias("stop"))


@query(
    "tag_pos",
    f"WITH {Q.sentences()}, {Q.TOKENS}, tagged AS (SELECT doc_id, {Q.POS_TAG} AS pos FROM tokens) SELECT doc_id, pos, count(*) AS n FROM tagged GROUP BY ALL",
)
def tag_pos(spark, sf):
    """Tag counts per document."""
    words = document_sentences(spark, sf).select("doc_id", F.explode(T.tokens(F.col("sentence"))).alias("word"))
    return words.groupBy("doc_id", T.tag_pos(F.col("word")).alias("pos")).agg(F.count("*").alias("n"))


_SLUG = "regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slugify", f"WITH {Q.LINES} SELECT doc_id, line_no, {_SLUG} AS slug FROM lines")
def slugify(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", T.slugify(F.col("line")).alias("slug"))


@query(
    "title_case",
    f"""WITH {Q.LINES}, w AS (SELECT doc_id, line_no, {_WORDS} AS w FROM lines)
SELECT doc_id, line_no, array_to_string(list_transform(w, lambda x: CASE WHEN upper(x) IN ('NPV','IRR','AI','ML','NLP','SQL','API')
  THEN upper(x) ELSE replace(upper(substr(x, 1, 1)), 'ẞ', 'SS') || lower(substr(x, 2)) END), ' ') AS title FROM w""",
)
def title_case(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", T.title_case(F.col("line")).alias("title"))


_COMPARE = "regexp_replace(regexp_replace(lower(text), '[`*_>#\\-]', ' ', 'g'), '[^a-z0-9.%+]', ' ', 'g')"


@query("compare_normalise", f"SELECT doc_id, trim({Q.squeeze(_COMPARE)}, ' ') AS plain FROM documents")
def compare_normalise(spark, sf):
    return tables.documents(spark, sf).select("doc_id", T.compare_form(F.col("text")).alias("plain"))


@query("word_count", f"WITH l AS (SELECT doc_id, text AS line FROM documents) SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS words FROM l")
def word_count(spark, sf):
    return tables.documents(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(
    "token_estimate",
    f"WITH {Q.sentences()} SELECT doc_id, sent_no, CAST(ceil(length(sentence) / 4.0) AS BIGINT) AS tokens FROM sentences",
)
def token_estimate(spark, sf):
    return document_sentences(spark, sf).select("doc_id", "sent_no", T.token_estimate(F.col("sentence")).alias("tokens"))


@query(
    "trim_to_limit",
    f"""WITH t AS (SELECT doc_id, {Q.strip("replace(text, chr(10), chr(10) || chr(10))")} AS t FROM documents),
h AS (SELECT doc_id, t, substr(t, 1, 600) AS head FROM t),
c AS (SELECT doc_id, t, head, CASE WHEN contains(head, chr(10) || chr(10))
        THEN length(head) - instr(reverse(head), chr(10) || chr(10)) - 1 ELSE -1 END AS kept FROM h)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE {Q.strip("CASE WHEN kept >= 450 THEN substr(head, 1, kept) ELSE head END")} END AS cut FROM c""",
)
def trim_to_limit(spark, sf):
    """Lines taken as paragraphs, cut at 600 characters."""
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return tables.documents(spark, sf).select("doc_id", T.trim_to_limit(paragraphs, 600).alias("cut"))


SIGNALS = ["the thing", "that", "under", "pour la"]


@query(
    "contains_signal",
    f"""WITH {Q.sentences()} SELECT doc_id, sent_no, {" OR ".join(f"contains(lower(sentence), '{s}')" for s in SIGNALS)} AS signal FROM sentences""",
)
def contains_signal(spark, sf):
    return document_sentences(spark, sf).select(
        "doc_id", "sent_no", T.contains_signal(F.col("sentence"), SIGNALS).alias("signal")
    )


@query(
    "phrase_frequency",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bof the\\b')) AS INTEGER) AS hits FROM documents""",
)
def phrase_frequency(spark, sf):
    return tables.documents(spark, sf).select("doc_id", T.phrase_frequency(F.col("text"), "of the").alias("hits"))

"""Headings, sections, chunks and classification over the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import headings as H
from lectern.functions import text as T
from lectern.operators import classify as K
from lectern.operators import sections as X
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.text_queries import document_lines
from lectern.sources import tables as S

_TRIMMED = f"{Q.LINES}, t AS (SELECT doc_id, line_no, {Q.strip('line')} AS t, line FROM lines)"
_W = f"regexp_split_to_array(t, '{Q.WS}+')"
_TITLE = f"(len({_W}) <= 10 AND len(list_filter({_W}, lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9&/-]*$'))) / CAST(len({_W}) AS DOUBLE) >= 0.75 AND NOT regexp_matches(t, '[.!?]$'))"
_UPPER = f"(length(t) - length(regexp_replace(t, '[A-Za-z]+', '', 'g')) >= 3 AND t = upper(t) AND len({_W}) <= 12)"


@query(
    "heading_tests",
    f"""WITH {_TRIMMED} SELECT doc_id, line_no, regexp_matches(t, '{H.KNOWN_HEADING}') AS known, {_UPPER} AS upper_case,
  {_TITLE} AS title_case, regexp_matches(t, '{H.NUMBERED}') AS numbered FROM t""",
)
def heading_tests(spark, sf):
    t = T.strip(F.col("line"))
    return document_lines(spark, sf).select(
        "doc_id", "line_no", H.is_known(t).alias("known"), H.is_upper(t).alias("upper_case"),
        H.is_title_case(t).alias("title_case"), t.rlike(H.NUMBERED).alias("numbered"),
    )


_VALUE = f"trim({Q.squeeze('regexp_replace(lower(line), ' + chr(39) + '[^a-z0-9]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ')"
# Vocabulary argument: corpus words stand in for heading words.
CORPUS_RULES = [("thing|that", "abstract", "abstract"), ("tion|ment", "results", "results"), ("^un|^und", "conclusion", "conclusion")]


@query(
    "map_heading",
    f"WITH {Q.LINES}, v AS (SELECT doc_id, line_no, {_VALUE} AS v FROM lines) SELECT doc_id, line_no, CASE "
    + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{t}'" for p, t, _ in H.HEADING_RULES)
    + " ELSE 'other' END AS title, CASE "
    + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{r}'" for p, _, r in H.HEADING_RULES)
    + " ELSE 'other' END AS role FROM v",
)
def map_heading(spark, sf):
    rows = document_lines(spark, sf).select("doc_id", "line_no", H.map_heading(F.col("line")).alias("m"))
    return rows.select("doc_id", "line_no", "m.title", "m.role")


@query(
    "section_role",
    f"WITH {Q.LINES} SELECT doc_id, line_no, CASE "
    + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{r}'" for p, r in H.ROLE_RULES)
    + " ELSE 'background' END AS role FROM lines",
)
def section_role(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", H.section_role(F.col("line")).alias("role"))


# Line-final full stops are dropped so that one-word lines read as title-case headings.
_BARE = "documents2 AS (SELECT doc_id, replace(text, '.' || chr(10), chr(10)) AS text FROM documents)"
_HEADS = f"""{_BARE}, {Q.LINES.replace("FROM documents)", "FROM documents2)")},
pos AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
t AS (SELECT p.*, {Q.strip('line')} AS t, d.text FROM pos p JOIN documents2 d USING (doc_id)),
numbered AS (SELECT *, regexp_extract(t, '{H.NUMBERED}', 1) AS num, regexp_extract(t, '{H.NUMBERED}', 2) AS rest FROM t),
shaped AS (SELECT *, num <> '' AND len(regexp_split_to_array({Q.strip('rest')}, '{Q.WS}+')) <= 14
  AND NOT (regexp_matches(rest, '[.!?]$') AND len(regexp_split_to_array({Q.strip('rest')}, '{Q.WS}+')) > 7) AND regexp_matches(rest, '[A-Za-z]') AS is_num FROM numbered),
cand AS (SELECT doc_id, line_no, text, line, CAST(start AS INTEGER) AS start, CAST(start + length(line) + 1 AS INTEGER) AS body,
   CASE WHEN is_num THEN {Q.strip('rest')} ELSE t END AS heading, CASE WHEN is_num THEN num END AS num FROM shaped
  WHERE t <> '' AND length(t) <= {H.HEADING_MAX} AND (is_num OR regexp_matches(t, '{H.KNOWN_HEADING}') OR {_UPPER} OR {_TITLE})),
heads AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_start FROM cand
  WHERE len(regexp_split_to_array(heading, '{Q.WS}+')) <= 12 AND (length({Q.strip('substr(text, body + 1)')}) > 0 OR lower(heading) = 'references'))"""


def sectioned(spark, sf):
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit("\n"))
    page = F.struct(F.lit(1).alias("page_no"), F.lit(0).alias("start"), F.char_length("display_text").alias("end"))
    docs = S.documents(spark, sf).select("doc_id", text.alias("display_text")).select(
        "doc_id", "display_text", F.col("display_text").alias("analysis_text")
    )
    return X.detect_sections(docs.withColumn("source_pages", F.array(page)).withColumn("page_count", F.lit(4)))


@query(
    "heading_false_positives",
    f"WITH {_HEADS} SELECT doc_id, start, heading, num AS number FROM heads",
)
def heading_false_positives(spark, sf):
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit("\n"))
    docs = S.documents(spark, sf).select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.explode(X.heading_candidates(F.col("t"))).alias("h")).select(
        "doc_id", "h.start", "h.heading", "h.number"
    )


_SECTIONS = f"""{_HEADS}, firsts AS (SELECT doc_id, min(start) AS s FROM heads GROUP BY 1),
sections AS (SELECT doc_id, 'Document' AS heading, text AS body, 0 AS start, CAST(length(text) AS INTEGER) AS stop FROM documents2 WHERE doc_id NOT IN (SELECT doc_id FROM firsts)
 UNION ALL SELECT d.doc_id, 'Preamble', {Q.strip('substr(text, 1, s)')}, 0, s FROM documents2 d JOIN firsts USING (doc_id) WHERE s > 0 AND length({Q.strip('substr(text, 1, s)')}) > 0
 UNION ALL SELECT doc_id, {Q.strip('line')}, {Q.strip('substr(text, body + 1, greatest(0, coalesce(next_start, CAST(length(text) AS INTEGER)) - body))')}, start, coalesce(next_start, CAST(length(text) AS INTEGER)) FROM heads)"""


@query("section_ranges", f"WITH {_SECTIONS} SELECT doc_id, heading, body, start, stop FROM sections")
def section_ranges(spark, sf):
    rows = sectioned(spark, sf).select("doc_id", F.explode("sections").alias("s"))
    return rows.select("doc_id", "s.heading", "s.body", "s.start", F.col("s.end").alias("stop"))


@query(
    "interval_page_lookup",
    f"""WITH {_SECTIONS}, n AS (SELECT doc_id, length(text) AS n FROM documents2)
SELECT doc_id, start, stop, CASE WHEN n = 0 THEN 1 ELSE least(4, greatest(1, CAST(floor(start / CAST(n AS DOUBLE) * 4) AS INTEGER) + 1)) END AS first_page,
  CASE WHEN n = 0 THEN 1 ELSE least(4, greatest(1, CAST(floor(stop / CAST(n AS DOUBLE) * 4) AS INTEGER) + 1)) END AS last_page FROM sections JOIN n USING (doc_id)""",
)
def interval_page_lookup(spark, sf):
    """Pages by proportion: each document claims four pages but keeps one text."""
    rows = sectioned(spark, sf).select("doc_id", F.explode("sections").alias("s"))
    return rows.select(
        "doc_id", "s.start", F.col("s.end").alias("stop"), F.col("s.pages.first").alias("first_page"),
        F.col("s.pages.last").alias("last_page"),
    )


@query(
    "interval_page_join",
    f"""WITH {Q.LINES}, pages AS (SELECT doc_id, line_no AS page_no, coalesce(sum(length(line) + 2) OVER w, 0) AS s, coalesce(sum(length(line) + 2) OVER w, 0) + length(line) AS e
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marks AS (SELECT doc_id, unnest(range(0, length(text), 97)) AS mark FROM documents)
SELECT doc_id, CAST(mark AS INTEGER) AS mark, min(page_no) AS page_no FROM marks JOIN pages USING (doc_id) WHERE mark BETWEEN s AND e GROUP BY 1, 2""",
)
def interval_page_join(spark, sf):
    """Page of every 97th character, lines taken as pages: a range lookup inside the row."""
    lines = F.split(T.unix_newlines(F.col("text")), "\n")
    docs = S.documents(spark, sf).select("doc_id", F.char_length("text").alias("n"), F.posexplode(lines).alias("page_no", "line"))
    from lectern.operators.cleaning import running_total

    placed = running_total(docs, "doc_id", "page_no", F.char_length("line") + 2).withColumn("stop", F.col("start") + F.char_length("line"))
    marks = F.sequence(F.ceil(F.col("start") / 97) * 97, F.col("stop"), F.lit(97).cast("bigint"))
    held = placed.filter((F.ceil(F.col("start") / 97) * 97 <= F.col("stop"))).select("doc_id", "page_no", "n", F.explode(marks).alias("mark"))
    return held.filter(F.col("mark") < F.col("n")).select("doc_id", F.col("mark").cast("int").alias("mark"), "page_no")


@query("detect_sections")
def detect_sections(spark, sf):
    return sectioned(spark, sf).select(
        "doc_id", F.size("sections").alias("sections"), "has_abstract", "has_methodology",
        F.array_join(F.transform("sections", lambda s: s["id"]), "|").alias("ids"),
    )


_SIGNALS = {
    "first": [("text", "(?:the|of)"), ("headings", "^[a-z]+$"), ("abstract", "")],
    "second": [("text", "(?:la|le)"), ("text", "que"), ("headings", "tion")],
    "third": [("text", "(?:die|der)"), ("text", "und")],
}


@query(
    "classify_profile",
    """WITH h AS (SELECT doc_id, lower(text) AS low, list_transform(string_split(text, chr(10)), lambda l: lower(l)) AS heads, n_chars % 2 = 0 AS abs FROM documents),
s AS (SELECT doc_id, regexp_matches(low, '\\b(?:the|of)\\b')::INT + (len(list_filter(heads, lambda x: regexp_matches(x, '^[a-z]+$'))) > 0)::INT + abs::INT AS a,
  regexp_matches(low, '\\b(?:la|le)\\b')::INT + regexp_matches(low, '\\bque\\b')::INT + (len(list_filter(heads, lambda x: regexp_matches(x, 'tion'))) > 0)::INT AS b,
  regexp_matches(low, '\\b(?:die|der)\\b')::INT + regexp_matches(low, '\\bund\\b')::INT AS c FROM h),
r AS (SELECT doc_id, greatest(a, b, c) AS best, CASE WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS kind,
  list_sort([a, b, c], 'DESC')[2] AS runner FROM s)
SELECT doc_id, CASE WHEN best > 0 THEN kind ELSE 'unknown' END AS kind, CAST(round(CASE WHEN best > 0 THEN least(0.98, 0.55 + best * 0.1 + (best - runner) * 0.05) ELSE 0.45 END, 6) AS DOUBLE) AS confidence FROM r""",
)
def classify_profile(spark, sf):
    """Three profiles with corpus signals; every line counts as a heading."""
    docs = S.documents(spark, sf).select(
        "doc_id", K.profile(F.col("text"), F.split("text", "\n"), F.col("n_chars") % 2 == 0, _SIGNALS).alias("p")
    )
    return docs.select("doc_id", "p.kind", F.round("p.confidence", 6).alias("confidence"))


_GROUPS = {"a": ["of the", "that", "ing"], "b": ["que", "la "], "c": ["und", "sch", "die der"]}


@query(
    "classify_kind_domain",
    "WITH l AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, "
    + ", ".join(
        " + ".join(f"least(3, len(regexp_extract_all(t, '{p}'))) * {1.35 if ' ' in p else 1.0}" for p in ps) + f" AS {k}"
        for k, ps in _GROUPS.items()
    )
    + """ FROM l), r AS (SELECT doc_id, greatest(a, b, c) AS best, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS kind, list_sort([a, b, c], 'DESC')[2] AS runner FROM s)
SELECT doc_id, CASE WHEN best > 0 THEN kind ELSE 'unknown' END AS kind, round(CASE WHEN best > 0 THEN greatest(0.45, least(0.98, 0.52 + best * 0.035 + (best - runner) * 0.025)) ELSE 0.25 END + 1e-9, 6) AS confidence FROM r""",
)
def classify_kind_domain(spark, sf):
    docs = S.documents(spark, sf).select("doc_id", K.phrase_votes(F.lower("text"), _GROUPS, "unknown").alias("v"))
    return docs.select("doc_id", F.col("v.name").alias("kind"), F.round(F.col("v.confidence") + 1e-9, 6).alias("confidence"))


@query(
    "best_and_margin",
    """WITH r AS (SELECT o_custkey AS user_id, o_orderpriority AS name, sum(o_totalprice) AS score FROM orders GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, name) AS rn, lead(score, 1, 0) OVER (PARTITION BY user_id ORDER BY score DESC, name) AS nxt FROM r)
SELECT user_id, name, round(score, 2) AS score, round(score - nxt, 2) AS margin FROM k WHERE rn = 1""",
)
def best_and_margin(spark, sf):
    """Leading order class per owner; classes per owner are few, so they fold into one small array."""
    scores = S.owned_items(spark, sf).groupBy("user_id", F.col("title").alias("name")).agg(F.sum("score").alias("score"))
    listed = scores.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("name", "score"))).alias("s"))
    best = listed.select("user_id", K.best_and_margin(F.col("s")).alias("b"))
    return best.select("user_id", "b.name", F.round("b.score", 2).alias("score"), F.round("b.margin", 2).alias("margin"))


@query(
    "expected_fields",
    "WITH k AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'research_paper' WHEN 'fr' THEN 'lecture_notes' WHEN 'de' THEN 'assignment' ELSE 'unknown' END AS kind, source FROM documents), e AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"('{k}', '{f}', {i}, {str(r).lower()}, {str(a).lower()})"
        for k, fields in K.EXPECTED_FIELDS.items()
        for i, (f, r, a) in enumerate(fields)
    )
    + ") v(kind, field, pos, required, applicable)) SELECT source, kind, field, pos, required, applicable FROM k JOIN e USING (kind)",
)
def expected_fields(spark, sf):
    """Expected fields of the profiles met in each source."""
    kind = F.when(F.col("lang") == "en", "research_paper").when(F.col("lang") == "fr", "lecture_notes").when(
        F.col("lang") == "de", "assignment"
    ).otherwise("unknown")
    met = S.table(spark, sf, "documents").select(kind.alias("kind"), "source").distinct()
    return met.join(F.broadcast(K.expected_fields(spark)), "kind").select("source", "kind", "field", "pos", "required", "applicable")


@query("chunk_sections")
def chunk_sections(spark, sf):
    chunks = X.chunk_sections(sectioned(spark, sf), "doc_id", 1200, 2)
    return chunks.select("doc_id", "sec_no", "part", "chunk_id", "text", "overlap", "token_estimate")


@query("split_paragraph_chunks")
def split_paragraph_chunks(spark, sf):
    """Lines taken as paragraphs, packed to 1,500 characters."""
    docs = S.documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return X.split_paragraphs(docs, "doc_id", "text", 1500)


@query(
    "even_sample",
    f"""WITH {Q.LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
p AS (SELECT doc_id, i, CASE WHEN n <= 6 THEN i ELSE CAST(floor(i * (n - 1) / 5.0 + 0.5) AS BIGINT) END AS line_no FROM n, unnest(range(0, 6)) AS r(i) WHERE n > 6 OR i < n)
SELECT p.doc_id, CAST(i AS INTEGER) AS pick, p.line_no FROM p""",
)
def even_sample(spark, sf):
    """Six evenly spread line numbers per document."""
    numbers = F.transform(F.split(T.unix_newlines(F.col("text")), "\n"), lambda l, i: i.cast("bigint"))
    docs = S.documents(spark, sf).select("doc_id", numbers.alias("n"))
    return docs.select("doc_id", F.posexplode(X.even_sample(F.col("n"))).alias("pick", "line_no"))


@query(
    "source_bundle",
    f"""WITH {Q.LINES} SELECT doc_id, string_agg('[Part ' || (line_no + 1) || ', page ' || (line_no + 1) || ']' || chr(10) || line, chr(10) || chr(10) ORDER BY line_no) AS bundle FROM lines GROUP BY 1""",
)
def source_bundle(spark, sf):
    """Lines as titled chunks."""
    chunks = F.transform(
        F.split(T.unix_newlines(F.col("text")), "\n"),
        lambda l, i: F.struct(
            F.concat(F.lit("Part "), (i + 1).cast("string")).alias("section"), (i + 1).alias("page"), l.alias("text")
        ),
    )
    return S.documents(spark, sf).select("doc_id", X.source_bundle(chunks).alias("bundle"))

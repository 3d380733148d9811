"""Scores, gaps, titles, amounts and profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import finance as M
from lectern.operators import scores as P
from lectern.operators import titles as X
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.section_queries import sectioned
from lectern.plans.text_queries import document_lines
from lectern.sources import tables as S

_R6 = lambda c: F.round(c + 1e-9, 6)
_COMP = """c AS (SELECT doc_id, n_chars, lang, source, (n_chars % 100) / 100.0 AS grounding, (n_chars % 90) / 100.0 AS "numeric", (n_chars % 80) / 100.0 AS consistency, (n_chars % 70) / 100.0 AS sections,
 (n_chars % 60) / 100.0 AS concepts, (n_chars % 50) / 100.0 AS ontology, (n_chars % 120) / 100.0 AS graph, (n_chars % 30) / 100.0 AS reasoning FROM documents)"""


def components(spark, sf):
    n = F.col("n_chars")
    mods = {"grounding": 100, "numeric": 90, "consistency": 80, "sections": 70, "concepts": 60, "ontology": 50, "graph": 120, "reasoning": 30}
    return S.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", *[((n % m) / 100).alias(k) for k, m in mods.items()])


_SUM = " + ".join(f'{w} * greatest(0, least(1, "{k}"))' for k, w in P.CONFIDENCE_WEIGHTS.items())


@query("composite_confidence", f"WITH {_COMP} SELECT doc_id, round(CAST({_SUM} AS DOUBLE) + 1e-9, 6) AS overall FROM c")
def composite_confidence(spark, sf):
    return components(spark, sf).select("doc_id", _R6(P.composite_confidence()).alias("overall"))


@query("concept_quality", "SELECT o_custkey AS doc_id, round(CAST(count_if(o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) * 0.65 + least(1.0, count_if(o_orderstatus = 'F' AND o_totalprice > 200000) / 8.0) * 0.35 AS DOUBLE) + 1e-9, 6) AS quality FROM orders GROUP BY 1")
def concept_quality(spark, sf):
    g = S.owned_items(spark, sf).groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("stage") == "F").alias("v"), F.count_if((F.col("stage") == "F") & (F.col("score") > 200000)).alias("s")
    )
    return g.select("doc_id", _R6(P.concept_quality(F.col("n"), F.col("v"), F.col("s"))).alias("quality"))


@query("ontology_score", "SELECT o_custkey AS doc_id, round(CAST(avg(CASE o_orderstatus WHEN 'F' THEN 0.35 WHEN 'P' THEN 0.65 ELSE (o_orderkey % 100) / 100.0 END) AS DOUBLE) + 1e-9, 6) AS ontology FROM orders GROUP BY 1")
def ontology_score(spark, sf):
    kind = F.when(F.col("stage") == "F", "unknown").when(F.col("stage") == "P", "generated").otherwise("exact")
    m = S.owned_items(spark, sf).select(F.col("user_id").alias("doc_id"), kind.alias("match_type"), ((F.col("id") % 100) / 100).alias("confidence"))
    return P.ontology_score(m).withColumn("ontology", _R6(F.col("ontology")))


@query("graph_score", "WITH g AS (SELECT l_orderkey AS doc_id, count(*) AS v, count_if(l_returnflag = 'A') AS c, count_if(l_linestatus = 'O') AS e FROM lineitem GROUP BY 1) SELECT doc_id, round(CAST(least(1.0, c / CAST(v AS DOUBLE)) * 0.65 + least(1.0, e / CAST(v AS DOUBLE)) * 0.35 AS DOUBLE) + 1e-9, 6) AS graph FROM g")
def graph_score(spark, sf):
    g = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.count("*").alias("v"), F.count_if(F.col("l_returnflag") == "A").alias("c"), F.count_if(F.col("l_linestatus") == "O").alias("e")
    )
    return g.select("doc_id", _R6(P.graph_score(F.col("v"), F.col("c"), F.col("e"))).alias("graph"))


@query(
    "gap_coverage",
    """WITH g AS (SELECT doc_id, lang = 'en' AS paper, n_chars % 2 = 0 AS has_abs, n_chars % 3 = 0 AS has_exp, n_chars % 5 = 0 AS has_conc, n_chars % 4 AS missing FROM documents),
m AS (SELECT *, CASE WHEN paper THEN (NOT has_abs)::INT + (NOT has_exp)::INT + (NOT has_conc)::INT + (NOT has_conc)::INT ELSE 0 END AS lost FROM g)
SELECT doc_id, CAST(lost AS INTEGER) AS sections, round(CAST(greatest(0, 1 - (missing + lost) / CAST(greatest(1, 3 + CASE WHEN paper THEN 4 ELSE 0 END) AS DOUBLE)) AS DOUBLE) + 1e-9, 6) AS coverage FROM m""",
)
def gap_coverage(spark, sf):
    n = F.col("n_chars")
    present = F.array_compact(F.array(F.when(n % 2 == 0, F.lit("abstract")), F.when(n % 3 == 0, F.lit("experiments")), F.when(n % 5 == 0, F.lit("conclusion"))))
    kind = F.when(F.col("lang") == "en", "research_paper").otherwise("unknown")
    d = S.table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.size(P.missing_sections(kind, present)).alias("sections"), (n % 4).alias("missing"))
    return d.select("doc_id", "sections", _R6(P.gap_coverage(F.col("kind"), F.lit(3), F.col("missing"), F.col("sections"))).alias("coverage"))


_COV = f"""{_COMP}, k AS (SELECT *, CASE WHEN lang = 'en' THEN 6 ELSE 3 END AS n, CASE WHEN lang = 'en' THEN (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT + (n_chars % 2 = 0)::INT + (n_chars % 3 = 0)::INT + (n_chars % 5 = 0)::INT
  ELSE (doc_id % 2 = 0)::INT + (n_chars % 2 = 0)::INT + (n_chars % 7 = 0)::INT END AS met FROM c),
v AS (SELECT *, CAST(0.18 * grounding + 0.10 * "numeric" + 0.12 * consistency + 0.22 * met / n + 0.13 * sections + 0.10 * concepts + 0.07 * ontology + 0.08 * reasoning AS DOUBLE) AS score FROM k),
s AS (SELECT *, CASE WHEN doc_id % 11 = 0 OR score < 0.55 THEN 'rejected' WHEN score >= 0.85 AND n - met <= 1 THEN 'ready' ELSE 'partial' END AS status FROM v)"""


def _coverage(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    flags = {
        "problem": d % 2 == 0, "method": d % 3 == 0, "evidence": d % 5 == 0, "findings": n % 3 == 0, "limitations": n % 5 == 0,
        "overview": d % 2 == 0, "keyPoints": n % 7 == 0, "concepts": n % 2 == 0,
    }
    parts = dict(zip(("text", "title", "concepts", "grounding", "numeric", "consistency", "sections"), map(F.col, ("grounding", "numeric", "consistency", "sections", "concepts", "ontology", "reasoning"))))
    kind = F.when(F.col("lang") == "en", "research_paper").otherwise("unknown")
    return components(spark, sf).select("*", P.coverage_report(P.checks(kind, flags), parts, d % 11 != 0).alias("r"))


@query("coverage_report", f"WITH {_COV} SELECT doc_id, round(score + 1e-9, 6) AS score, status, CAST(n - met AS INTEGER) AS missing FROM s")
def coverage_report(spark, sf):
    return _coverage(spark, sf).select("doc_id", _R6(F.col("r.score")).alias("score"), "r.status", F.size("r.missing").alias("missing"))


@query("calibrate_confidence", f"WITH {_COV}, b AS (SELECT *, CAST({_SUM} AS DOUBLE) * 0.58 + score * 0.42 AS blend FROM s), x AS (SELECT *, CASE status WHEN 'partial' THEN least(blend, 0.84) WHEN 'rejected' THEN least(blend, 0.59) ELSE blend END AS capped FROM b) SELECT doc_id, round(CASE WHEN doc_id % 11 = 0 THEN least(capped, 0.54) ELSE capped END + 1e-9, 6) AS confidence FROM x")
def calibrate_confidence(spark, sf):
    c = P.calibrated(P.composite_confidence(), F.col("r.score"), F.col("r.status"), F.col("doc_id") % 11 != 0)
    return _coverage(spark, sf).select("doc_id", _R6(c).alias("confidence"))


@query("status_rollup", "SELECT o_custkey AS user_id, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_or(o_orderstatus IN ('F', 'P')) THEN 'partial' ELSE 'failed' END AS stage FROM orders GROUP BY 1")
def status_rollup(spark, sf):
    status = F.when(F.col("stage") == "F", "ready").when(F.col("stage") == "P", "partial").otherwise("failed")
    return P.status_rollup(S.owned_items(spark, sf).select("user_id", status.alias("s")), "user_id", "s")


@query("profile_merge", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE source END AS topic, CASE WHEN l.quality = 1 THEN 'good' ELSE lang END AS method, lang AS problem FROM documents d LEFT JOIN labels l USING (doc_id)")
def profile_merge(spark, sf):
    core = S.table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic"), F.col("lang").alias("method"), F.col("lang").alias("problem"))
    profile = S.table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("topic"), F.when(F.col("quality") == 1, "good").alias("method"), F.lit(None).cast("string").alias("problem"))
    return P.profile_merge(core, profile)


@query("stage_metrics", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def stage_metrics(spark, sf):
    """Sizes per source as a stage would report them; partial sums keep a hot source cheap."""
    docs = S.documents(spark, sf)
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("characters"),
        F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("lines"),
        F.sum(T.token_estimate(F.col("text"))).alias("tokens"),
    )


# ---- titles --------------------------------------------------------------------------------------


@query("collapse_title_phrases")
def collapse_title_phrases(spark, sf):
    """Every line, written twice, as a title."""
    doubled = F.concat_ws(" ", "line", "line")
    return document_lines(spark, sf).select("doc_id", "line_no", F.get(X.collapse_phrases(F.array(doubled)), F.lit(0)).alias("title"))


@query("take_while_texts")
def take_while_texts(spark, sf):
    return sectioned(spark, sf).select("doc_id", F.size(X.take_while_other(F.col("sections"))).alias("opening"))


@query("adjacent_join_texts")
def adjacent_join_texts(spark, sf):
    return sectioned(spark, sf).select("doc_id", F.posexplode(X.joined_candidates(X.fragments(F.col("sections")))).alias("pos", "candidate"))


def line_sections(spark, sf):
    """Every order's lines as sections of two lines each; returned ones have a known title."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("lines"))
    body = lambda x: F.concat(F.lit("Line of supplier "), x["l_suppkey"].cast("string"), F.lit("\nTotal "), x["l_quantity"].cast("int").cast("string"))
    section = lambda x: F.struct(F.when(x["l_returnflag"] == "R", "results").otherwise("other").alias("title"), F.concat(F.lit("Part "), x["l_partkey"].cast("string")).alias("heading"), body(x).alias("body"))
    return lines.select("doc_id", F.transform("lines", section).alias("sections"))


_OPEN = """l AS (SELECT *, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS n FROM lineitem),
w AS (SELECT *, min(CASE WHEN l_returnflag = 'R' AND n <= 8 THEN n END) OVER (PARTITION BY doc_id) AS stop FROM l), op AS (SELECT * FROM w WHERE n <= 8 AND (stop IS NULL OR n < stop))"""


@query("take_while", f"WITH {_OPEN}, k AS (SELECT doc_id, string_agg('Part ' || l_partkey, '|' ORDER BY n) AS opening FROM op GROUP BY 1) SELECT doc_id, coalesce(opening, '') AS opening FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN k USING (doc_id)")
def take_while(spark, sf):
    """Headings of the sections before the first with a known title."""
    return line_sections(spark, sf).select("doc_id", F.array_join(F.transform(X.take_while_other(F.col("sections")), lambda s: s["heading"]), "|").alias("opening"))


@query(
    "adjacent_join",
    f"""WITH {_OPEN}, fr AS (SELECT doc_id, n * 10 AS pos, 'Part ' || l_partkey AS f FROM op UNION ALL SELECT doc_id, n * 10 + 1, 'Line of supplier ' || l_suppkey FROM op UNION ALL SELECT doc_id, n * 10 + 2, 'Total ' || CAST(l_quantity AS INTEGER) FROM op),
fd AS (SELECT doc_id, f, min(pos) AS pos FROM fr GROUP BY 1, 2), fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM fd), fl AS (SELECT doc_id, list(f ORDER BY rn) FILTER (rn <= 6) AS hs FROM fk GROUP BY 1),
c AS (SELECT doc_id, 1 AS g, i, array_to_string(hs[i:i + 2], ' ') AS candidate FROM fl, unnest(range(1, len(hs) - 1)) t(i) UNION ALL SELECT doc_id, 2, i, array_to_string(hs[i:i + 1], ' ') FROM fl, unnest(range(1, len(hs))) t(i)
 UNION ALL SELECT doc_id, 3, rn, f FROM fk WHERE rn <= 10)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, i) - 1 AS INTEGER) AS pos, candidate FROM c WHERE CASE WHEN g = 3 THEN length(candidate) >= 8 ELSE length(candidate) BETWEEN 12 AND 150 END""",
)
def adjacent_join(spark, sf):
    """Title candidates of adjacent headings and lines."""
    return line_sections(spark, sf).select("doc_id", F.posexplode(X.joined_candidates(X.fragments(F.col("sections")))).alias("pos", "candidate"))


@query("resolve_title")
def resolve_title(spark, sf):
    docs = sectioned(spark, sf).withColumn("file_name", F.concat(F.lit("study_of_"), F.col("doc_id").cast("string"), F.lit("_things.pdf")))
    docs = docs.withColumn("metadata_title", F.when(F.col("doc_id") % 7 == 0, F.lit("Given Title Given Title")))
    docs = docs.withColumn("kind", F.lit("research_paper")).withColumn("domain", F.lit("general")).withColumn("class_confidence", F.lit(0.5))
    return X.resolve_titles(docs).select("doc_id", "title.value", "title.source", F.round("title.confidence", 6).alias("confidence"), F.size("title.rejected").alias("rejected"))


# ---- amounts -------------------------------------------------------------------------------------

# Every order is a case study of up to 25 lines; which lines it has, and all amounts, follow from the order.
# (wording, growth, first year): # is the amount.
LINES = [
    ("Brewpub system costs $#", None, None), ("Construction is planned at $#", None, None), ("The initial licence fee is $#", None, None), ("The media company asks $#", None, None),
    ("Net working capital needs $#", None, None), ("Completed market research was $#", None, None), ("The selling price is $# per pint", None, None),
    ("The ingredient cost is $# and will increase by 4%", 4.0, None), ("Rent is $# per month from year 2", None, 2), ("Maintenance is $# a year", None, None), ("The brewery operator gets $#", None, None),
    ("Insurance adds $#", None, None), ("Utilities add $# and rise 3 %", 3.0, None), ("Each licence renewal is $#", None, None), ("Advertising takes $#", None, None), ("The salvage value is $#", None, None),
    ("A renovation in year 5 needs $#", None, 5), ("The tax rate is #%", None, None), ("The cost of capital is #%", None, None), ("An economic life of # years is assumed", None, None), ("It is a #-seat restaurant", None, None),
    ("Best-case sales are # barrels per seat", None, None), ("Worst-case sales are # barrels per seat", None, None), ("One barrel holds # gallons", None, None), ("One gallon holds # pints", None, None),
]
_WHOLE = 17  # lines before have amounts in dollars, written with thousands


def case_texts(spark, sf):
    """(doc_id, text, pages): the lines in turn on two pages."""
    doc = F.col("id")

    def said(k: int, wording: str):
        amount = (doc * (k + 3)) % (90_000 if k < _WHOLE else 40) + 1
        shown = F.format_number(amount, 0) if k < _WHOLE else amount.cast("string")
        before, after = wording.split("#")
        return F.when(doc % (k + 2) != 0, F.concat(F.lit(before), shown, F.lit(after + ".")))

    lines = [said(k, w) for k, (w, _, _) in enumerate(LINES)]
    more = [
        F.when(doc % 4 == 0, F.lit("A quote of $1 per month stands elsewhere.")), F.when(doc % 3 == 0, F.lit("Straight-line depreciation applies.")), F.when(doc % 5 == 0, F.lit("It is a sunk cost.")),
        F.when(doc % 2 == 0, F.lit("A sensitivity analysis is asked for.")), F.when(doc % 7 != 0, F.lit("Operating cash flow and NPV are required.")),
    ]
    first = F.concat(F.lit("Anna Berg and Carl Dorn of Old Mill Restaurant decide whether to invest in project "), doc.cast("string"), F.lit("."))
    page = lambda *parts: F.array_join(F.array_compact(F.array(*parts)), "\n")
    rows = S.spread(S.owned_items(spark, sf)).select(doc.alias("doc_id"), F.array(page(first, *lines[::2]), page(*lines[1::2], *more)).alias("pages"))
    return rows.select("doc_id", F.array_join("pages", "\n").alias("text"), "pages")


_CASES = "o AS (SELECT o_orderkey AS doc_id FROM orders), a AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS k, '{M.PATTERNS[k][0]}' AS label, CAST((doc_id * {k + 3}) % {90_000 if k < _WHOLE else 40} + 1 AS DOUBLE) AS value, '{M.PATTERNS[k][1]}' AS unit, '{M.PATTERNS[k][2]}' AS frequency,
 CAST({g or 'NULL'} AS DOUBLE) AS growth, CAST({y or 'NULL'} AS INTEGER) AS start_year, '{w.split('#')[0]}' || {"format('{:,}', (doc_id * %d) %% 90000 + 1)" % (k + 3) if k < _WHOLE else f"CAST((doc_id * {k + 3}) % 40 + 1 AS VARCHAR)"} || '{w.split('#')[1]}.' AS evidence, {1 + k % 2} AS page FROM o WHERE doc_id % {k + 2} <> 0"""
    for k, (w, g, y) in enumerate(LINES)
) + """), v AS (SELECT doc_id, max(value) FILTER (k = 6) AS price, max(value) FILTER (k = 20) AS seats, max(value) FILTER (k = 21) AS best, max(value) FILTER (k = 22) AS worst, max(value) FILTER (k = 23) * max(value) FILTER (k = 24) AS pints,
 coalesce(bool_or(k = 1), false) AS built, coalesce(bool_or(k = 5), false) AS asked, coalesce(bool_or(k = 8), false) AS rented, coalesce(bool_or(k = 16), false) AS renewed FROM o LEFT JOIN a USING (doc_id) GROUP BY 1)"""


@query("financial_inputs", f"WITH {_CASES} SELECT doc_id, label, value, unit, frequency, growth, start_year, evidence, CAST(page AS INTEGER) AS page FROM a")
def financial_inputs(spark, sf):
    rows = case_texts(spark, sf).select("doc_id", F.explode(M.amounts(F.col("text"), pages=F.col("pages"))).alias("a"))
    return rows.select("doc_id", "a.label", "a.value", "a.unit", "a.frequency", "a.growth", "a.start_year", "a.evidence", "a.page")


@query(
    "derived_calculations",
    f"""WITH {_CASES} SELECT doc_id, 'Pints per barrel' AS label, pints AS value FROM v WHERE pints IS NOT NULL
UNION ALL SELECT doc_id, 'Best-case first-year volume', seats * best * pints FROM v WHERE seats * best * pints IS NOT NULL UNION ALL SELECT doc_id, 'Best-case first-year revenue', seats * best * pints * price FROM v WHERE seats * best * pints * price IS NOT NULL
UNION ALL SELECT doc_id, 'Worst-case first-year volume', seats * worst * pints FROM v WHERE seats * worst * pints IS NOT NULL UNION ALL SELECT doc_id, 'Worst-case first-year revenue', seats * worst * pints * price FROM v WHERE seats * worst * pints * price IS NOT NULL""",
)
def derived_calculations(spark, sf):
    rows = case_texts(spark, sf).select("doc_id", F.explode(M.derived(M.amounts(F.col("text")))).alias("d"))
    return rows.select("doc_id", "d.label", "d.value")


@query("distinct_rent_check", "SELECT o_custkey AS doc_id, CAST(count(DISTINCT floor(o_totalprice / 50000)) AS INTEGER) AS rents, count(DISTINCT floor(o_totalprice / 50000)) > 1 AS open FROM orders GROUP BY 1")
def distinct_rent_check(spark, sf):
    """Rents of an owner's orders, one sentence each, in one text; rounded so that few differ."""
    said = F.concat(F.lit("Rent is $"), F.floor(F.col("score") / 50000).cast("string"), F.lit(" per month."))
    # Distinct sentences first: an owner with very many orders still has few rents.
    texts = S.owned_items(spark, sf).select("user_id", said.alias("s")).distinct().groupBy("user_id").agg(F.array_join(F.collect_list("s"), "\n").alias("text"))
    rents = texts.select(F.col("user_id").alias("doc_id"), F.size(M.distinct_rents(F.col("text"))).alias("rents"))
    return rents.withColumn("open", F.col("rents") > 1)


@query(
    "evidence_page_lookup",
    f"""WITH {Q.LINES}, n AS (SELECT doc_id, count(*) AS n, arg_max(line, line_no) AS last FROM lines GROUP BY 1)
SELECT n.doc_id, CASE WHEN n > 1 THEN CAST(min(line_no) FILTER (contains(lower(line), lower(substr(last, 1, 45)))) + 1 AS INTEGER) END AS page
FROM n JOIN lines USING (doc_id) GROUP BY n.doc_id, n, last""",
)
def evidence_page_lookup(spark, sf):
    """Page (line) of the start of each document's last line."""
    lines = F.split(T.unix_newlines(F.col("text")), "\n")
    docs = S.documents(spark, sf).select("doc_id", lines.alias("p"))
    return docs.select("doc_id", M.evidence_page(F.col("p"), F.element_at("p", -1)).alias("page"))


_TRUE = lambda test, text: f"CASE WHEN {test} THEN '{text}' END"
_PART = "(SELECT evidence FROM a WHERE a.doc_id = v.doc_id AND k = {k})"


@query(
    "case_profile",
    f"""WITH {_CASES} SELECT doc_id, 'Anna Berg and Carl Dorn of Old Mill Restaurant decide whether to invest in project ' || doc_id || '.' AS decision, 'Anna Berg|Carl Dorn|Old Mill Restaurant' AS actors,
 'Capital-budgeting analysis using ' || concat_ws(', ', CASE WHEN doc_id % 7 <> 0 THEN 'operating and incremental cash flows' ELSE 'cash-flow analysis' END, {_TRUE('doc_id % 7 <> 0', 'NPV')}, {_TRUE('best IS NOT NULL OR worst IS NOT NULL', 'scenario analysis')}, {_TRUE('doc_id % 2 = 0', 'sensitivity analysis')}) || '.' AS method,
 concat_ws('|', 'Best-case scenario=' || {_PART.format(k=21)}, 'Worst-case scenario=' || {_PART.format(k=22)}, 'Renovation scenario=' || {_PART.format(k=16)}, {_TRUE('doc_id % 2 = 0', 'Cost-of-capital sensitivity=A sensitivity analysis is asked for.')}) AS scenarios,
 concat_ws('|', {_TRUE('rented AND doc_id % 4 = 0', 'rent')}, {_TRUE('built AND doc_id % 3 = 0', 'depreciation')}, {_TRUE('asked AND doc_id % 5 <> 0', 'sunk')}) AS assumptions FROM v""",
)
def case_profile(spark, sf):
    docs = case_texts(spark, sf).select("doc_id", M.case_profile(F.col("text"), pages=F.col("pages")).alias("c"))
    topic = lambda t: F.when(F.contains(t, F.lit("rent")), "rent").when(F.contains(t, F.lit("depreciation")), "depreciation").otherwise("sunk")
    return docs.select(
        "doc_id", "c.decision", F.array_join("c.actors", "|").alias("actors"), "c.method",
        F.array_join(F.transform("c.scenarios", lambda x: F.concat(x["name"], F.lit("="), x["evidence"])), "|").alias("scenarios"), F.array_join(F.transform("c.assumptions", topic), "|").alias("assumptions"),
    )


@query("case_summaries")
def case_summaries(spark, sf):
    """Amounts, derived figures and required analyses of the cases as counts beside their summaries."""
    docs = case_texts(spark, sf).select("doc_id", M.case_profile(F.col("text"), pages=F.col("pages")).alias("c"))
    return docs.select("doc_id", F.size("c.inputs").alias("inputs"), F.size("c.derived").alias("derived"), F.array_join("c.required", "|").alias("required"), M.case_summary(F.col("c"), F.lit("Case")).alias("summary"))


@query("summary_case")
def summary_case(spark, sf):
    docs = case_texts(spark, sf).select("doc_id", M.case_profile(F.col("text")).alias("c"))
    return docs.select("doc_id", M.case_summary(F.col("c"), F.concat(F.lit("Case "), F.col("doc_id").cast("string"))).alias("summary"))


@query("quality_profile")
def quality_profile(spark, sf):
    """Quality, class and key words of every document joined into one row."""
    from lectern.operators import classify as K
    from lectern.operators import cleaning as C
    from lectern.operators import nlp

    docs = C.clean_text_reliably(S.documents(spark, sf))
    text = F.col("clean.text")
    docs = docs.select("doc_id", F.col("clean.quality").alias("q"), K.kind_and_domain(text).alias("k"), nlp.study_keywords(text).alias("w"))
    return docs.select(
        "doc_id", F.round(F.col("q.score") * 10, 4).alias("out_of_ten"), "q.passed", "k.kind", "k.domain", F.round("k.confidence", 6).alias("confidence"),
        F.array_join(F.transform("w", lambda x: x["value"]), "|").alias("keywords"), F.size("q.warnings").alias("warnings"),
    )

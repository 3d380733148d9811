"""Claims, validation and headline fields over the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import claims as C
from lectern.operators import classify as K
from lectern.operators import nlp
from lectern.plans import sql as Q
from lectern.plans.nlp_queries import _SCORES, LEXICON_SQL, TERMS, annotated, _ORDERED, rounded_scores, sentence_docs
from lectern.plans.registry import query
from lectern.sources import tables as S

# Vocabulary argument with corpus words.
SIGNALS = {
    "problem": ["under", "that the"], "method": ["the thing", "with the"], "contribution": ["of the", "pour la"],
    "limitation": ["was the", "und die"], "future_work": ["this is", "les de"],
}
NOUNS = "the|of|de|la|und"
DEFINITION = f"(?i)^(.{{2,80}}?){T.WS_LIST}+(?:is|est|ist){T.WS_LIST}+(.{{20,260}})$"
VOCABULARY = {
    "signals": SIGNALS, "sample_nouns": NOUNS, "data_wording": "that|pour|und", "result_words": "the|la|die",
    "metric_order": ["from", "with"], "definition": DEFINITION,
}


def with_numbers(spark, sf, **read):
    """Annotated sentences in which each "from" and "avec" brings a number, so numeric claims occur; ``read`` is what else ``nlp.annotate`` adds."""
    text = F.replace(F.replace(F.col("text"), F.lit(" from "), F.lit(" from 37.5% ")), F.lit(" avec "), F.lit(" avec 12 "))
    docs = S.documents(spark, sf).select("doc_id", nlp.plain_sentences(text).alias("sentences"))
    docs = docs.withColumn("sentences", F.transform("sentences", lambda s: s.withField("role", F.lit("background"))))
    return nlp.annotate(docs, TERMS, scores=True, **read)


def _rows(docs, claims):
    rows = docs.select("doc_id", F.explode(claims).alias("c"))
    return rows.select("doc_id", "c.sent_no", "c.object", F.round("c.confidence", 6).alias("confidence"))


def _has(signals, col="lower(sentence)"):
    return "(" + " OR ".join(f"contains({col}, '{s}')" for s in signals) + ")"


_HITS = f"""WITH {Q.sentences()}, {LEXICON_SQL}, hits AS (SELECT s.doc_id, s.sent_no, s.sentence, x.type, x.term FROM sentences s JOIN lexicon x
  ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || x.term || '($|[^a-z0-9])'))"""


@query(
    "claims_method",
    f"""{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY length(term) DESC, term DESC) AS rk FROM hits WHERE type = 'METHOD')
SELECT doc_id, sent_no, term AS object, CASE WHEN {_has(SIGNALS['method'])} THEN CAST(0.93 AS DOUBLE) ELSE 0.72 END AS confidence FROM r WHERE rk <= 2""",
)
def claims_method(spark, sf):
    return _rows(annotated(spark, sf), C.method_claims(F.col("sentences"), SIGNALS["method"]))


@query(
    "longest_entities",
    f"""WITH {Q.sentences()}, {_ORDERED}, r AS (SELECT doc_id, sent_no, term, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY length(term) DESC, place) AS rk FROM sentences JOIN ordered
  ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) SELECT doc_id, sent_no, string_agg(term, '|' ORDER BY rk) AS longest FROM r WHERE rk <= 2 GROUP BY 1, 2""",
)
def longest_entities(spark, sf):
    """The two longest terms of each sentence."""
    rows = annotated(spark, sf).select("doc_id", F.explode("sentences").alias("s"))
    lexical = F.filter("s.entities", lambda e: ~e["type"].isin("NUMBER", "ACRONYM"))
    best = F.transform(C.longest_entities(lexical, 2), lambda e: e["text"])
    return rows.select("doc_id", F.col("s.no").alias("sent_no"), F.array_join(best, "|").alias("longest")).filter("longest <> ''")


@query("claims_tool", f"{_HITS} SELECT doc_id, sent_no, term AS object, CAST(0.88 AS DOUBLE) AS confidence FROM hits WHERE type = 'TOOL'")
def claims_tool(spark, sf):
    return _rows(annotated(spark, sf), C.tool_claims(F.col("sentences")))


@query(
    "claims_data_source",
    f"""{_HITS}, w AS (SELECT *, regexp_matches(lower(sentence), '\\b(?:that|pour|und)\\b') AS worded FROM hits WHERE type = 'DATASET')
SELECT doc_id, sent_no, term AS object, CASE WHEN worded THEN CAST(0.95 AS DOUBLE) ELSE 0.76 END AS confidence FROM w WHERE worded OR length(term) > 4""",
)
def claims_data_source(spark, sf):
    return _rows(annotated(spark, sf), C.data_source_claims(F.col("sentences"), "that|pour|und"))


_NUMBERED = "numbered AS (SELECT doc_id, replace(replace(text, ' from ', ' from 37.5% '), ' avec ', ' avec 12 ') AS text FROM documents)"
_SAMPLE = "(?i)\\b([0-9]{1,6})" + Q.WS + "+((?:[A-Za-z][A-Za-z-]*" + Q.WS + "+){0,4})(the|of|de|la|und)\\b"


@query(
    "claims_sample",
    f"""WITH {_NUMBERED}, {Q.sentences('numbered')} SELECT doc_id, sent_no, regexp_extract(sentence, '{_SAMPLE}', 1) || ' ' ||
  trim({Q.squeeze(f"regexp_extract(sentence, '{_SAMPLE}', 2) || regexp_extract(sentence, '{_SAMPLE}', 3)")}, ' ') AS object, CAST(0.9 AS DOUBLE) AS confidence
FROM sentences WHERE regexp_matches(sentence, '{_SAMPLE}')""",
)
def claims_sample(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit(" from "), F.lit(" from 37.5% ")), F.lit(" avec "), F.lit(" avec 12 "))
    docs = S.documents(spark, sf).select("doc_id", nlp.plain_sentences(text).alias("sentences"))
    return _rows(docs, C.sample_claims(F.col("sentences"), NOUNS))


@query(
    "nearest_number",
    f"""WITH {_NUMBERED}, {Q.sentences('numbered')}, m AS (SELECT doc_id, sent_no, sentence, instr(lower(sentence), 'the') AS at_metric, instr(sentence, '37.5%') AS p1, instr(sentence, '12') AS p2 FROM sentences)
SELECT doc_id, sent_no, CAST(CASE WHEN at_metric > 0 THEN CASE WHEN abs(p1 - at_metric) <= abs(p2 - at_metric) THEN 37.5 ELSE 12 END ELSE 37.5 END AS DOUBLE) AS value FROM m""",
)
def nearest_number(spark, sf):
    """Which of two numbers lies nearer to the first "the" of each sentence."""
    text = F.replace(F.replace(F.col("text"), F.lit(" from "), F.lit(" from 37.5% ")), F.lit(" avec "), F.lit(" avec 12 "))
    rows = S.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(text)).alias("sent_no", "sentence"))
    numbers = F.array(F.lit("37.5%"), F.lit("12"))
    return rows.select("doc_id", "sent_no", C.nearest_number(F.col("sentence"), F.lit("the"), numbers).alias("value"))


@query(
    "claims_result",
    f"""WITH {_NUMBERED}, {Q.sentences('numbered')} SELECT doc_id, sent_no, sentence AS object, CAST(0.93 AS DOUBLE) AS confidence FROM sentences
WHERE regexp_matches(sentence, '(?i)\\b(?:the|la|die)\\b') AND contains(lower(sentence), 'from') AND regexp_matches(sentence, '(^|[^0-9A-Za-z.])37.5%')""",
)
def claims_result(spark, sf):
    claims = F.filter(
        C.result_claims(F.col("sentences"), NOUNS, "the|la|die", ["from"]), lambda c: (c["type"] == "result") & (c["metric"] == "from") & (c["value"] == 37.5)
    )
    return _rows(with_numbers(spark, sf), claims)


@query(
    "claims_signal",
    f"""WITH {Q.sentences()} """ + " UNION ALL ".join(
        f"SELECT doc_id, sent_no, '{k}' AS type, sentence AS evidence FROM sentences WHERE {_has(SIGNALS[k])}"
        for k in ("contribution", "limitation", "future_work")
    ),
)
def claims_signal(spark, sf):
    docs = annotated(spark, sf)
    lists = F.concat(*[C.signal_claims(F.col("sentences"), k, SIGNALS[k]) for k in ("contribution", "limitation", "future_work")])
    rows = docs.select("doc_id", F.explode(lists).alias("c"))
    return rows.select("doc_id", "c.sent_no", "c.type", "c.evidence")


@query(
    "claims_definition",
    f"""{_HITS}, {Q.TOKENS}, named AS (SELECT doc_id, sent_no FROM hits WHERE type IN ('CONCEPT', 'METHOD') UNION SELECT doc_id, sent_no FROM tokens WHERE regexp_matches(word, '{T.ACRONYM}'))
SELECT doc_id, sent_no, {Q.strip(f"regexp_extract(sentence, '{DEFINITION}', 2)")} AS object, CAST(0.74 AS DOUBLE) AS confidence
FROM sentences JOIN named USING (doc_id, sent_no) WHERE length(sentence) <= 360 AND regexp_matches(sentence, '{DEFINITION}')""",
)
def claims_definition(spark, sf):
    return _rows(annotated(spark, sf), C.definition_claims(F.col("sentences"), DEFINITION))


_PICKED = f"""f AS (SELECT s.doc_id, s.sent_no, s.sentence, round(c.score + 1e-12, 9) AS score, {_has(SIGNALS['problem'])} AS sig FROM sentences s JOIN scores c USING (doc_id, sent_no)),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sig DESC, CASE WHEN sig THEN score ELSE 0 END DESC, sent_no) AS rk FROM f)"""


def _problems(spark, sf):
    docs = rounded_scores(nlp.annotate(sentence_docs(spark, sf), TERMS, scores=True))
    docs = docs.withColumn("sentences", F.transform("sentences", lambda s: s.withField("role", F.lit("background"))))
    return docs.select("doc_id", "sentences", F.explode(C.problem_claims(F.col("sentences"), SIGNALS["problem"])).alias("c"))


@query("claims_problem", f"WITH {Q.sentences()}, {Q.TOKENS}, {_SCORES}, {_PICKED} SELECT doc_id, sent_no, sentence AS object, CASE WHEN sig THEN CAST(0.86 AS DOUBLE) ELSE 0.62 END AS confidence FROM m WHERE rk = 1")
def claims_problem(spark, sf):
    """Each document's problem sentence as a claim."""
    return _problems(spark, sf).select("doc_id", "c.sent_no", "c.object", F.round("c.confidence", 6).alias("confidence"))


def extracted(spark, sf, **read):
    docs = with_numbers(spark, sf, **read)
    return docs.withColumn("claims", C.extract_claims(F.col("sentences"), VOCABULARY))


@query("extract_knowledge")
def extract_knowledge(spark, sf):
    """Headline fields, topic, key phrases, concepts and all claims of every document."""
    docs = extracted(spark, sf, phrases="phrases", words="words").withColumn("h", C.headline(C.validate_claims(F.col("claims"))))
    docs = docs.withColumn("phrases", F.transform("phrases", lambda p: p["value"])).withColumn("concepts", nlp.concept_candidates(F.col("sentences"), F.col("phrases")))
    entities = F.transform(F.filter("concepts", lambda c: c["valid"]), lambda c: c["term"])
    topic = F.coalesce(F.get("phrases", F.lit(0)), F.get("words", F.lit(0))["value"])
    return docs.select(
        "doc_id", F.size("claims").alias("claims"), "h.method", "h.dataset", "h.problem", "h.accuracy", "h.metric",
        F.size("h.contributions").alias("contributions"), F.array_join("h.contributions", "|").alias("contributed"), "h.limitations", "h.future_work",
        topic.alias("topic"), F.array_join(F.slice("phrases", 1, 20), "|").alias("keywords"), F.array_join(entities, "|").alias("entities"),
        F.transform("concepts", lambda c: c.dropFields("first")).alias("concepts"), F.col("claims").alias("claim_list"),
    )


@query("claims_union_all")
def claims_union_all(spark, sf):
    rows = extracted(spark, sf).select("doc_id", F.explode("claims").alias("c"))
    return rows.select("doc_id", "c.claim_no", "c.id", "c.type", "c.object", "c.metric", "c.value", "c.unit")


def validated(spark, sf):
    """Claims checked; every third number is falsified first so that rejections occur."""
    docs = extracted(spark, sf)
    falsified = F.transform(
        "claims", lambda c: c.withField("value", F.when(c["claim_no"] % 3 == 0, c["value"] + 1).otherwise(c["value"]))
    )
    return docs.withColumn("claims", C.validate_claims(falsified))


@query("validate_claims_texts")
def validate_claims_texts(spark, sf):
    rows = validated(spark, sf).select("doc_id", F.explode("claims").alias("c"))
    return rows.select("doc_id", "c.id", "c.status", "c.is_duplicate", F.array_join("c.messages", "|").alias("messages"), "c.confidence")


def expected_array(fields):
    return F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(r).alias("required"), F.lit(a).alias("applicable")) for f, r, a in fields]
    )


def with_states(spark, sf):
    docs = validated(spark, sf).withColumn("valid", F.filter("claims", C.is_valid))
    return docs.withColumn("states", C.field_states(expected_array(K.EXPECTED_FIELDS["research_paper"]), F.col("valid")))


@query("field_states_texts")
def field_states_texts(spark, sf):
    return with_states(spark, sf).select("doc_id", F.inline("states"))


@query("validation_report_texts")
def validation_report_texts(spark, sf):
    docs = with_states(spark, sf)
    return docs.select("doc_id", C.validation_report(F.col("claims"), F.col("states"), F.lit(0)).alias("r")).select("doc_id", "r.*")


@query("headline_pivot_texts")
def headline_pivot_texts(spark, sf):
    docs = with_states(spark, sf).withColumn("h", C.headline(F.col("valid")))
    return docs.select("doc_id", "h.method", "h.dataset", "h.problem", "h.limitations", "h.future_work", F.array_join("h.contributions", "|").alias("contributions"))


@query("key_points_texts")
def key_points_texts(spark, sf):
    docs = with_states(spark, sf)
    return docs.select("doc_id", F.posexplode(C.key_points(F.col("valid"))).alias("pos", "k")).select("doc_id", "pos", "k.label", "k.value")


# ---- the same checks on claims made of line items ------------------------------------------------

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")


def line_claims(spark, sf):
    """Every order's lines as claims: some without evidence, with another number or another metric than it, or repeated."""
    lines = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("lines"))

    def one(x, i):
        result = x["l_returnflag"] == "N"
        kind = F.when(x["l_returnflag"] == "A", "method").when(result, "result").when(x["l_suppkey"] % 2 == 0, "contribution").otherwise("limitation")
        shown = (x["l_quantity"] + F.when(x["l_partkey"] % 3 == 0, 1).otherwise(0)).cast("int").cast("string")
        evidence = F.when(x["l_suppkey"] % 5 == 0, "").when(result, F.concat(F.lit("An accuracy of "), shown, F.lit("% was measured"))).otherwise("Said in words")
        sentence = F.struct(i.alias("no"), evidence.alias("text"), F.lit("Results").alias("section"), F.lit(1).alias("page"))
        metric = F.when(result, F.when(x["l_partkey"] % 2 == 0, "accuracy").otherwise("recall"))
        made = C.claim(sentence, kind, "Document", "states", F.concat(F.lit("Part "), (x["l_partkey"] % 20).cast("string")), 0.8, metric, F.when(result, x["l_quantity"]))
        return made.withField("claim_no", i + 1).withField("id", F.concat(F.lit("claim-"), kind, F.lit("-"), (i + 1).cast("string")))

    docs = lines.select("doc_id", C.validate_claims(F.transform("lines", one)).alias("claims")).withColumn("valid", F.filter("claims", C.is_valid))
    return docs.withColumn("states", C.field_states(expected_array(K.EXPECTED_FIELDS["research_paper"]), F.col("valid")))


_LINES = f"""l AS (SELECT *, l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS claim_no FROM lineitem),
c AS (SELECT doc_id, claim_no, CASE WHEN l_returnflag = 'A' THEN 'method' WHEN l_returnflag = 'N' THEN 'result' WHEN l_suppkey % 2 = 0 THEN 'contribution' ELSE 'limitation' END AS type, 'Part ' || l_partkey % 20 AS object,
 CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_partkey % 2 = 0 THEN 'accuracy' ELSE 'recall' END END AS metric, CASE WHEN l_returnflag = 'N' THEN l_quantity END AS value, l_suppkey % 5 = 0 AS bare, l_partkey % 3 = 0 AS other FROM l),
e AS (SELECT *, value IS NOT NULL AND (bare OR other) AS wrong_number, metric IS NOT NULL AND (bare OR metric = 'recall') AS wrong_metric, row_number() OVER (PARTITION BY doc_id, type, object ORDER BY claim_no) > 1 AS dup FROM c),
j AS (SELECT *, bare OR wrong_number OR wrong_metric AS bad, bare::INT + wrong_number::INT + wrong_metric::INT AS errors FROM e),
va AS (SELECT * FROM j WHERE NOT bad AND NOT dup),
ef AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', {str(r).lower()})" for i, (f, r, _) in enumerate(K.EXPECTED_FIELDS['research_paper']))}) v(place, field, required)),
st AS (SELECT d.doc_id, field, required, CASE WHEN EXISTS (SELECT 1 FROM va WHERE va.doc_id = d.doc_id AND va.type = ef.field) THEN 'present' ELSE 'missing' END AS state FROM (SELECT DISTINCT doc_id FROM c) d, ef)"""


@query("validate_claims", f"WITH {_LINES} SELECT doc_id, 'claim-' || type || '-' || claim_no AS id, CASE WHEN bad THEN 'rejected' ELSE 'valid' END AS status, dup AS is_duplicate, concat_ws('|', CASE WHEN bare THEN 'missing_evidence' END, CASE WHEN wrong_number THEN 'unsupported_number' END, CASE WHEN wrong_metric THEN 'metric_mismatch' END) AS messages, CASE WHEN bad THEN 0.35 ELSE 0.8 END::DOUBLE AS confidence FROM j")
def validate_claims(spark, sf):
    rows = line_claims(spark, sf).select("doc_id", F.explode("claims").alias("c"))
    return rows.select("doc_id", "c.id", "c.status", "c.is_duplicate", F.array_join("c.messages", "|").alias("messages"), "c.confidence")


@query("field_states", f"WITH {_LINES} SELECT doc_id, field, required, state FROM st")
def field_states(spark, sf):
    return line_claims(spark, sf).select("doc_id", F.inline("states"))


@query(
    "validation_report",
    f"""WITH {_LINES}, v AS (SELECT doc_id, count(*) AS valid, CASE WHEN count(DISTINCT value) FILTER (type = 'result' AND metric = 'accuracy') > 1 THEN 1 ELSE 0 END AS clash FROM va GROUP BY 1),
m AS (SELECT doc_id, count(*) AS missing FROM st WHERE required AND state = 'missing' GROUP BY 1), a AS (SELECT doc_id, count(*) AS n, sum(errors) AS errors FROM j GROUP BY 1),
r AS (SELECT doc_id, coalesce(valid, 0) AS valid, n, errors, coalesce(missing, 0) AS missing, coalesce(clash, 0) AS clash FROM a LEFT JOIN v USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(valid AS INTEGER) AS valid, CAST(n - valid AS INTEGER) AS rejected, valid / CAST(n AS DOUBLE) AS grounded_ratio, CAST(1 AS DOUBLE) AS numeric_ratio, 1 - clash / CAST(greatest(1, valid) AS DOUBLE) AS consistency,
 CAST(errors AS INTEGER) AS claim_errors, CAST(missing AS INTEGER) AS missing_required, clash AS contradictions, 0 AS invalid_concepts, valid > 0 AND errors + missing = 0 AS passed FROM r""",
)
def validation_report(spark, sf):
    docs = line_claims(spark, sf)
    return docs.select("doc_id", C.validation_report(F.col("claims"), F.col("states"), F.lit(0)).alias("r")).select("doc_id", "r.*")


@query(
    "headline_pivot",
    f"""WITH {_LINES} SELECT d.doc_id, arg_min(object, claim_no) FILTER (type = 'method') AS method, arg_min(object, claim_no) FILTER (type = 'limitation') AS limitations, arg_min(value, claim_no) FILTER (type = 'result' AND metric = 'accuracy') AS accuracy,
 arg_min(metric, claim_no) FILTER (type = 'result') AS metric, coalesce(string_agg(object, '|' ORDER BY claim_no) FILTER (type = 'contribution'), '') AS contributions FROM (SELECT DISTINCT doc_id FROM c) d LEFT JOIN va USING (doc_id) GROUP BY 1""",
)
def headline_pivot(spark, sf):
    docs = line_claims(spark, sf).withColumn("h", C.headline(F.col("valid")))
    return docs.select("doc_id", "h.method", "h.limitations", "h.accuracy", "h.metric", F.array_join("h.contributions", "|").alias("contributions"))


@query(
    "key_points",
    f"""WITH {_LINES}, q AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{lab}', {n})" for i, (k, lab, n) in enumerate(C.KEY_POINTS))}) v(place, type, label, quota)),
r AS (SELECT doc_id, place, label, object AS value, claim_no, row_number() OVER (PARTITION BY doc_id, type ORDER BY claim_no) AS k, quota FROM va JOIN q USING (type))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, claim_no) - 1 AS INTEGER) AS pos, label, value FROM r WHERE k <= quota""",
)
def key_points(spark, sf):
    docs = line_claims(spark, sf)
    return docs.select("doc_id", F.posexplode(C.key_points(F.col("valid"))).alias("pos", "k")).select("doc_id", "pos", "k.label", "k.value")


@query(
    "metric_contradiction",
    """SELECT l_orderkey AS doc_id, count(DISTINCT l_quantity) AS "values", CAST((count(DISTINCT l_quantity) > 1)::INT AS INTEGER) AS contradiction
FROM lineitem GROUP BY 1""",
)
def metric_contradiction(spark, sf):
    """Line items as accuracy results: orders whose values differ."""
    from lectern.operators.validation import metric_values

    claims = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit("accuracy").alias("metric"), F.col("l_quantity").alias("value")
    )
    return metric_values(claims).select("doc_id", "values", "contradiction")


@query(
    "contains_number",
    f"""WITH {_NUMBERED}, {Q.sentences('numbered')} SELECT doc_id, sent_no, regexp_matches(sentence, '(^|[^0-9])37\\.5(%|\\b)') AS a, regexp_matches(sentence, '(^|[^0-9])12(%|\\b)') AS b FROM sentences""",
)
def contains_number(spark, sf):
    text = F.replace(F.replace(F.col("text"), F.lit(" from "), F.lit(" from 37.5% ")), F.lit(" avec "), F.lit(" avec 12 "))
    rows = S.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(text)).alias("sent_no", "sentence"))
    return rows.select(
        "doc_id", "sent_no", C.contains_number(F.col("sentence"), F.lit(37.5)).alias("a"),
        C.contains_number(F.col("sentence"), F.lit(12.0)).alias("b"),
    )


@query(
    "metric_supported",
    f"""WITH {Q.sentences()} SELECT doc_id, sent_no, contains(lower(sentence), 'accuracy') OR contains(lower(sentence), 'accurate') AS a,
  contains(lower(sentence), 'the') AS b FROM sentences""",
)
def metric_supported(spark, sf):
    rows = S.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return rows.select(
        "doc_id", "sent_no", C.metric_supported(F.lit("Accuracy"), F.col("sentence")).alias("a"),
        C.metric_supported(F.lit("The"), F.col("sentence")).alias("b"),
    )


@query(
    "choose_metric",
    f"""WITH {Q.sentences()} SELECT doc_id, sent_no, CASE WHEN contains(lower(sentence), 'from') THEN 'from' WHEN contains(lower(sentence), 'with') THEN 'with' ELSE 'none' END AS metric FROM sentences""",
)
def choose_metric(spark, sf):
    rows = S.documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))
    detected = F.array(F.struct(F.lit("NONE").alias("text"), F.lit("METRIC").alias("type")))
    return rows.select("doc_id", "sent_no", C.choose_metric(F.col("sentence"), detected, ["from", "with"]).alias("metric"))


@query(
    "structural_number",
    f"""WITH l AS (SELECT doc_id, lower(replace(text, ' the ', ' figure 3 ')) AS low FROM documents) SELECT doc_id, regexp_matches(low, '\\b(section|figure|table|equation|reference){Q.WS}+3\\b') AS labelled FROM l""",
)
def structural_number(spark, sf):
    low = F.lower(F.replace(F.col("text"), F.lit(" the "), F.lit(" figure 3 ")))
    return S.documents(spark, sf).select("doc_id", C.structural_number(F.lit("3%"), low).alias("labelled"))


@query(
    "best_problem_sentence",
    f"""WITH {Q.sentences()}, {Q.TOKENS}, {_SCORES}, {_PICKED}, n AS (SELECT doc_id, count(*) AS scoped, count_if(sig) AS flagged FROM f GROUP BY 1)
SELECT doc_id, scoped, flagged, sentence, CASE WHEN sig THEN round(score, 6) END AS score FROM m JOIN n USING (doc_id) WHERE rk = 1""",
)
def best_problem_sentence(spark, sf):
    """The chosen sentence with its score, and how many were in scope and flagged."""
    rows = _problems(spark, sf)
    flagged = F.filter("sentences", lambda s: T.contains_signal(s["text"], SIGNALS["problem"]))
    score = F.round(F.get("sentences", F.col("c.sent_no"))["score"], 6)
    return rows.select("doc_id", F.size("sentences").cast("bigint").alias("scoped"), F.size(flagged).cast("bigint").alias("flagged"), F.col("c.object").alias("sentence"), F.when(F.col("c.confidence") > 0.8, score).alias("score"))

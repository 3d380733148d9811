"""Sentence analysis over the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.lexicon import term_rows
from lectern.functions.arrays import let
from lectern.operators import nlp
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.text_queries import document_sentences
from lectern.sources import tables as S

# Vocabulary argument for the given corpus, whose prose has none of the default terms.
TERMS = {
    "METHOD": ["of the", "to the and", "the thing", "les de la"],
    "DATASET": ["this", "that is", "pour la", "und der"],
    "METRIC": ["from", "with the"],
    "TOOL": ["for", "en un", "ing"],
    "CONCEPT": ["in the", "that the", "la de", "is the"],
}


def lexicon_frame(spark):
    return spark.createDataFrame([(k, t) for k, ts in TERMS.items() for t in ts], "type string, term string")


LEXICON_SQL = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{t}')" for k, ts in TERMS.items() for t in ts
) + ") v(type, term))"


def sentence_docs(spark, sf):
    return S.documents(spark, sf).select("doc_id", nlp.plain_sentences(F.col("text")).alias("sentences"))


def annotated(spark, sf):
    return nlp.annotate(sentence_docs(spark, sf), TERMS)


def _tagged_only(spark, sf):
    return sentence_docs(spark, sf).withColumn(
        "sentences",
        F.transform("sentences", lambda s: s.withField("tokens", T.tagged_tokens(s["text"])).withField(
            "entities", F.array().cast("array<struct<text:string,type:string>>"))),
    )


_BASE = f"WITH {Q.sentences()}, {Q.TOKENS}, {Q.CONTENT_TOKENS}"


@query(
    "keyword_counts",
    f"""{_BASE}, c AS (SELECT doc_id, low AS word, count(*) AS n, min((sent_no, tok_no)) AS f FROM content GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rk FROM c)
SELECT doc_id, CAST(rk AS INTEGER) AS rank, word, CAST(n AS INTEGER) AS n FROM r WHERE rk <= 12""".replace("min((sent_no, tok_no))", "min(row(sent_no, tok_no))"),
)
def keyword_counts(spark, sf):
    docs = sentence_docs(spark, sf)
    top = docs.select("doc_id", F.posexplode(nlp.text_keywords(F.col("sentences"))).alias("i", "k"))
    return top.select("doc_id", (F.col("i") + 1).alias("rank"), F.col("k.value").alias("word"), "k.n")


@query(
    "keyword_counts_simple",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]{{3,}}')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({Q.STUDY_STOP}) GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rk FROM c)
SELECT doc_id, CAST(rk AS INTEGER) AS rank, word, CAST(n AS INTEGER) AS n FROM r WHERE rk <= 12""",
)
def keyword_counts_simple(spark, sf):
    docs = S.documents(spark, sf).select("doc_id", F.posexplode(nlp.study_keywords(F.col("text"))).alias("i", "k"))
    return docs.select("doc_id", (F.col("i") + 1).alias("rank"), F.col("k.value").alias("word"), "k.n")


_GRAMS = "grams AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, sent_no, {k} AS size, c_no, {" || ' ' || ".join(["low"] + [f"lead(low, {i}) OVER w" for i in range(1, k)])} AS phrase,
  {" OR ".join([f"coalesce(lead(pos, {i}, 'NN') OVER w IN ('VB','VBG','VBN','RB'), false)" for i in range(0, k)])} AS verbal
 FROM content WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY c_no)"""
    for k in (2, 3, 4)
) + "), kept AS (SELECT doc_id, sent_no, size, c_no, phrase FROM grams WHERE phrase IS NOT NULL AND NOT verbal)"


@query("ngram_frames", f"{_BASE}, {_GRAMS} SELECT doc_id, sent_no, phrase, count(*) AS n FROM kept GROUP BY ALL")
def ngram_frames(spark, sf):
    docs = _tagged_only(spark, sf).select("doc_id", F.explode("sentences").alias("s"))
    grams = docs.select("doc_id", F.col("s.no").alias("sent_no"), F.explode(nlp.sentence_ngrams(F.col("s.tokens"))).alias("phrase"))
    return grams.groupBy("doc_id", "sent_no", "phrase").agg(F.count("*").alias("n"))


_BAD_PHRASE = f"(length(phrase) < 4 OR regexp_matches(phrase, '{T.NUMBER}') OR regexp_matches(phrase, '^section +[0-9]+') OR len(list_filter(string_split(phrase, ' '), lambda w: w NOT IN ({Q.STOP}))) = 0)"
_RANK_PHRASES = """pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, f) AS rk FROM pc)"""


_ORDERED = "ordered AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(term_rows(TERMS))) + ") v(place, type, term))"


@query(
    "phrase_counts",
    f"""{_BASE}, {_GRAMS}, {_ORDERED}, ent AS (
  SELECT s.doc_id, s.sent_no, -1 AS size, x.term AS phrase, x.place FROM sentences s JOIN ordered x
    ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || x.term || '($|[^a-z0-9])') WHERE x.type <> 'METRIC'),
shaped AS (SELECT doc_id, sent_no, low AS phrase, min(tok_no) AS place FROM tokens WHERE regexp_matches(word, '{T.ACRONYM}') GROUP BY ALL),
w AS (SELECT doc_id, sent_no, size, c_no, phrase, 1 AS weight FROM kept
  UNION ALL SELECT doc_id, sent_no, size, place, phrase, 4 FROM ent
  UNION ALL SELECT doc_id, sent_no, 0, place, phrase, 4 FROM shaped),
pc AS (SELECT doc_id, phrase, sum(weight) AS n, min(row(sent_no, size, c_no)) AS f FROM w WHERE NOT {_BAD_PHRASE} GROUP BY 1, 2 HAVING sum(weight) >= 2),
{_RANK_PHRASES} SELECT doc_id, CAST(rk AS INTEGER) AS rank, phrase, CAST(n AS INTEGER) AS n FROM pr WHERE rk <= 30""",
)
def phrase_counts(spark, sf):
    """The thirty key phrases of each document with their weights."""
    docs = nlp.with_key_phrases(sentence_docs(spark, sf), TERMS).select("doc_id", F.posexplode("phrases").alias("i", "p"))
    return docs.select("doc_id", (F.col("i") + 1).alias("rank"), F.col("p.value").alias("phrase"), "p.n")


@query(
    "lexicon_match",
    f"""WITH {Q.sentences()}, {LEXICON_SQL} SELECT s.doc_id, s.sent_no, x.type, x.term FROM sentences s JOIN lexicon x
  ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || x.term || '($|[^a-z0-9])')""",
)
def lexicon_match(spark, sf):
    return nlp.lexicon_match(document_sentences(spark, sf), lexicon_frame(spark), ["doc_id", "sent_no"])


@query(
    "extract_entities",
    f"""WITH {Q.sentences()}, {Q.TOKENS}, {LEXICON_SQL}, e AS (SELECT s.doc_id, s.sent_no, x.type, x.term AS text FROM sentences s JOIN lexicon x
  ON regexp_matches(lower(sentence), '(^|[^a-z0-9])' || x.term || '($|[^a-z0-9])')
UNION ALL SELECT doc_id, sent_no, 'NUMBER', word FROM tokens WHERE regexp_matches(word, '{T.NUMBER}')
UNION ALL SELECT doc_id, sent_no, 'ACRONYM', word FROM tokens WHERE regexp_matches(word, '{T.ACRONYM}'))
SELECT DISTINCT doc_id, sent_no, type, text FROM e""",
)
def extract_entities(spark, sf):
    docs = annotated(spark, sf).select("doc_id", F.explode("sentences").alias("s"))
    return docs.select("doc_id", F.col("s.no").alias("sent_no"), F.inline("s.entities")).select("doc_id", "sent_no", "type", "text")


_SCORES = f"""sets AS (SELECT DISTINCT doc_id, sent_no, low FROM tokens WHERE low NOT IN ({Q.STOP}) AND length(low) > 2),
sizes AS (SELECT s.doc_id, s.sent_no, count(x.low) AS n FROM sentences s LEFT JOIN sets x USING (doc_id, sent_no) GROUP BY 1, 2),
shared AS (SELECT a.doc_id, a.sent_no AS i, b.sent_no AS j, count(*) AS k FROM sets a JOIN sets b USING (doc_id, low) WHERE a.sent_no <> b.sent_no GROUP BY 1, 2, 3),
sums AS (SELECT h.doc_id, h.i AS sent_no, sum(h.k / CAST(x.n + y.n - h.k AS DOUBLE)) AS t FROM shared h
  JOIN sizes x ON x.doc_id = h.doc_id AND x.sent_no = h.i JOIN sizes y ON y.doc_id = h.doc_id AND y.sent_no = h.j GROUP BY 1, 2),
per AS (SELECT s.doc_id, s.sent_no, count(*) OVER (PARTITION BY s.doc_id) AS m, coalesce(t, 0) AS t FROM sentences s LEFT JOIN sums USING (doc_id, sent_no)),
mean AS (SELECT doc_id, sent_no, m, CASE WHEN m = 1 THEN 1.0 ELSE t / greatest(1, m - 1) END AS v FROM per),
scores AS (SELECT doc_id, sent_no, v AS mean, CASE WHEN m = 1 THEN 1.0 ELSE v / greatest(max(v) OVER (PARTITION BY doc_id), 0.0001) END AS score FROM mean)"""


@query(
    "sentence_similarity_join",
    f"WITH {Q.sentences()}, {Q.TOKENS}, {_SCORES} SELECT doc_id, sent_no, round(score + 1e-9, 6) AS score FROM scores",
)
def sentence_similarity_join(spark, sf):
    docs = nlp.with_scores(sentence_docs(spark, sf)).select("doc_id", F.explode("sentences").alias("s"))
    return docs.select("doc_id", F.col("s.no").alias("sent_no"), F.round(F.col("s.score") + 1e-9, 6).alias("score"))


def rounded_scores(docs):
    """Scores to nine places, so that sums in another order rank alike."""
    return docs.withColumn("sentences", F.transform("sentences", lambda s: s.withField("score", F.round(s["score"] + 1e-12, 9))))


@query(
    "top_sentences",
    f"""WITH {Q.sentences()}, {Q.TOKENS}, {_SCORES}, r AS (SELECT doc_id, sent_no, row_number() OVER (PARTITION BY doc_id ORDER BY round(score + 1e-12, 9) DESC, sent_no) AS rk FROM scores)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS INTEGER) AS place, sent_no, sentence FROM r JOIN sentences USING (doc_id, sent_no) WHERE rk <= 8""",
)
def top_sentences(spark, sf):
    """The eight best sentences in the order of the document."""
    docs = rounded_scores(nlp.with_scores(sentence_docs(spark, sf))).select("doc_id", F.posexplode(nlp.top_sentences(F.col("sentences"))).alias("i", "s"))
    return docs.select("doc_id", (F.col("i") + 1).alias("place"), F.col("s.no").alias("sent_no"), F.col("s.text").alias("sentence"))


@query(
    "set_overlap",
    f"""WITH {Q.sentences()}, {Q.TOKENS}, sets AS (SELECT DISTINCT doc_id, sent_no, low FROM tokens WHERE low NOT IN ({Q.STOP}) AND length(low) > 2),
n AS (SELECT doc_id, sent_no, count(*) AS n FROM sets GROUP BY 1, 2),
k AS (SELECT a.doc_id, a.sent_no, count(*) AS k FROM sets a JOIN sets b ON b.doc_id = a.doc_id AND b.low = a.low AND b.sent_no = a.sent_no + 1 GROUP BY 1, 2)
SELECT s.doc_id, s.sent_no, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0.0 ELSE coalesce(k.k, 0) / CAST(coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(k.k, 0) AS DOUBLE) END, 6) AS jaccard
FROM sentences s JOIN sentences t ON t.doc_id = s.doc_id AND t.sent_no = s.sent_no + 1
 LEFT JOIN n x ON x.doc_id = s.doc_id AND x.sent_no = s.sent_no LEFT JOIN n y ON y.doc_id = s.doc_id AND y.sent_no = s.sent_no + 1
 LEFT JOIN k ON k.doc_id = s.doc_id AND k.sent_no = s.sent_no""",
)
def set_overlap(spark, sf):
    """Word-set overlap of each sentence with the next one."""
    sets = sentence_docs(spark, sf).select("doc_id", F.transform("sentences", lambda s: T.word_set(s["text"])).alias("sets"))
    pairs = sets.select("doc_id", "sets", F.posexplode("sets").alias("sent_no", "a")).withColumn(
        "b", F.get("sets", F.col("sent_no") + 1)
    ).filter(F.col("b").isNotNull())
    union = F.size(F.array_union("a", "b"))
    return pairs.select(
        "doc_id", "sent_no",
        F.round(F.when(union > 0, F.size(F.array_intersect("a", "b")) / union).otherwise(0.0), 6).alias("jaccard"),
    )


@query(
    "phrase_sentence_join",
    f"""{_BASE}, c AS (SELECT doc_id, low AS phrase, count(*) AS n, min(row(sent_no, tok_no)) AS f FROM content GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rk FROM c)
SELECT s.doc_id, s.sent_no, phrase FROM sentences s JOIN r ON r.doc_id = s.doc_id AND r.rk <= 12 AND contains(lower(s.sentence), r.phrase)""",
)
def phrase_sentence_join(spark, sf):
    """Which of the document's twelve top terms each sentence holds."""
    docs = sentence_docs(spark, sf).withColumn(
        "top", F.transform(nlp.text_keywords(F.col("sentences")), lambda k: k["value"])
    )
    rows = docs.select("doc_id", "top", F.explode("sentences").alias("s"))
    held = let(F.lower("s.text"), lambda low: F.filter("top", lambda p: F.contains(low, p)))
    return rows.select("doc_id", F.col("s.no").alias("sent_no"), F.explode(held).alias("phrase"))


@query(
    "ordinal_ids",
    f"WITH {Q.sentences()} SELECT doc_id, 'section-document-sentence-' || (sent_no + 1) AS id, length(sentence) AS size FROM sentences",
)
def ordinal_ids(spark, sf):
    return document_sentences(spark, sf).select(
        "doc_id", F.concat(F.lit("section-document-sentence-"), F.col("sent_no") + 1).alias("id"),
        F.char_length("sentence").cast("bigint").alias("size"),
    )


@query(
    "normalise_term",
    f"""WITH {Q.LINES}, n AS (SELECT doc_id, line_no, trim({Q.squeeze("regexp_replace(lower(line), '[^a-z0-9-]', ' ', 'g')")}, ' ') AS v FROM lines)
SELECT doc_id, line_no, CASE WHEN length(v) < 3 OR regexp_matches(v, '{T.NUMBER}') OR v = 'map' OR regexp_matches(v, '^(section|figure|page) +[0-9]+')
  OR regexp_matches(v, '^[0-9]+( *- *[0-9]+)*$') THEN NULL ELSE v END AS term FROM n""",
)
def normalise_term(spark, sf):
    from lectern.plans.text_queries import document_lines

    return document_lines(spark, sf).select("doc_id", "line_no", nlp.normalise_term(F.col("line")).alias("term"))


@query("nlp_result")
def nlp_result(spark, sf):
    result = nlp.nlp_result(sentence_docs(spark, sf), TERMS)
    return result.select(
        "doc_id", F.size("sentences").alias("sentences"), F.size("entities").alias("entities"),
        F.array_join("key_phrases", "|").alias("key_phrases"), F.array_join("keywords", "|").alias("keywords"),
        F.array_join(F.transform("top_sentences", lambda s: s["no"].cast("string")), ",").alias("top_sentences"),
    )


@query("concept_candidates")
def concept_candidates(spark, sf):
    docs = nlp.annotate(sentence_docs(spark, sf), TERMS, phrases="phrases").withColumn("phrases", F.transform("phrases", lambda p: p["value"]))
    rows = docs.select("doc_id", F.posexplode(nlp.concept_candidates(F.col("sentences"), F.col("phrases"))).alias("rank", "c"))
    return rows.select(
        "doc_id", "rank", "c.norm", "c.term", "c.occurrences", "c.n_evidence", F.round("c.score", 6).alias("score"), "c.valid"
    )

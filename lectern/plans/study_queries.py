"""Study material, concepts and grounding over the whole documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.functions import drafts as D
from lectern.functions import text as T
from lectern.operators import concepts as K
from lectern.operators import grounding as G
from lectern.operators import study as U
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.text_queries import document_lines
from lectern.sources import tables as S

# Vocabulary argument: definitions by corpus verbs.
DEFINED = r"(?i)^([A-Z][A-Za-z0-9 ()/_-]{2,70}?) +(?:is|that|est|ist) +(.{20,260})$"


def _pieces(text="text"):
    marked = f"regexp_replace(regexp_replace({text}, '(?m)^[ \\t]*[0-9]+[ \\t]*$', '', 'g'), '([.!?]){Q.WS}+|\\n{{2,}}', '\\1' || chr(1), 'g')"
    return f"""pieces AS (SELECT doc_id, i AS piece, trim({Q.squeeze('p[i]')}, ' ') AS s FROM (SELECT doc_id, string_split({marked}, chr(1)) AS p FROM documents) d, unnest(range(1, len(p) + 1)) AS r(i)),
kept AS (SELECT * FROM pieces WHERE length(s) BETWEEN 45 AND 360 AND NOT regexp_matches(s, '(?i)^(?:references|bibliography|acknowledg)') AND NOT regexp_matches(s, '^[0-9 .,;:()\\[\\]-]+$')),
uniq AS (SELECT doc_id, arg_min(s, piece) AS s, min(piece) AS piece FROM kept GROUP BY doc_id, lower(s)),
ms AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS n FROM uniq)"""


@query("meaningful_sentence_filter", f"WITH {_pieces()} SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, s AS sentence FROM ms WHERE n <= 12")
def meaningful_sentence_filter(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.posexplode(U.meaningful_sentences(F.col("text"))).alias("pos", "sentence"))


_HEADS = f"""{Q.LINES}, hl AS (SELECT doc_id, line_no, {Q.strip('line')} AS l FROM (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN (line_no + 1) || '.2 ' || line ELSE line END AS line FROM lines)),
hk AS (SELECT doc_id, line_no, {Q.strip("regexp_replace(l, '^[0-9]+(?:\\.[0-9]+)* +', '')")} AS h FROM hl WHERE length(l) BETWEEN 3 AND 90 AND regexp_matches(l, '^[0-9]+(?:\\.[0-9]+)* +[A-Z]'))"""


@query("extract_headings", f"WITH {_HEADS}, u AS (SELECT doc_id, h, min(line_no) AS f FROM hk GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS n FROM u) SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, h AS heading FROM r WHERE n <= 12")
def extract_headings(spark, sf):
    """Every fourth line is numbered so that headings occur."""
    numbered = F.array_join(
        F.transform(F.split(T.unix_newlines(F.col("text")), "\n"), lambda l, i: F.when(i % 4 == 1, F.concat((i + 1).cast("string"), F.lit(".2 "), l)).otherwise(l)), "\n"
    )
    return S.documents(spark, sf).select("doc_id", F.posexplode(U.study_headings(numbered)).alias("pos", "heading"))


_DEFS = f"""{_pieces()}, df AS (SELECT doc_id, n, trim(regexp_extract(s, '{DEFINED}', 1), ' ') AS term, trim(regexp_extract(s, '{DEFINED}', 2), ' ') AS definition FROM ms WHERE regexp_matches(s, '{DEFINED}')),
dk AS (SELECT doc_id, arg_min(term, n) AS term, arg_min(definition, n) AS definition, min(n) AS n FROM df GROUP BY doc_id, lower(term)),
dd AS (SELECT doc_id, term, definition, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM dk)"""


@query("extract_definitions", f"WITH {_DEFS} SELECT doc_id, term, definition FROM dd WHERE pos <= 15")
def extract_definitions(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.inline(U.definitions(F.col("text"), 15, DEFINED)))


@query(
    "questions_from_text",
    f"""WITH {_DEFS}, q AS (SELECT doc_id, 1 AS g, pos AS o, 'What is ' || term || '?' AS question, 'short_answer' AS kind, definition AS answer FROM dd WHERE pos <= 10
 UNION ALL SELECT doc_id, 2, n, 'True or false: ' || s, 'true_false', 'True' FROM ms), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) AS n FROM q)
SELECT doc_id, question, kind, answer FROM r WHERE n <= 10""",
)
def questions_from_text(spark, sf):
    docs = S.documents(spark, sf).select("doc_id", F.explode(U.questions_from_text(F.col("text"), 10, pattern=DEFINED)).alias("q"))
    return docs.select("doc_id", "q.question", F.col("q.questionType").alias("kind"), "q.answer")


@query(
    "cards_from_text",
    f"""WITH {_DEFS}, q AS (SELECT doc_id, 1 AS g, pos AS o, 'What is ' || term || '?' AS front, definition AS back, 'easy' AS difficulty FROM dd WHERE pos <= 8
 UNION ALL SELECT doc_id, 2, n, 'What important fact is explained in this document?', s, 'medium' FROM ms), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) AS n FROM q)
SELECT doc_id, front, back, difficulty FROM r WHERE n <= 8""",
)
def cards_from_text(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.inline(U.cards_from_text(F.col("text"), 8, DEFINED)))


def headline(method="source", dataset="lang"):
    """Facts struct from document columns: the source as method, the language as data set."""
    return F.struct(
        F.when(F.col("doc_id") % 2 == 0, F.col(method)).alias("method"), F.when(F.col("doc_id") % 3 != 0, F.col(dataset)).alias("dataset"),
        F.when(F.col("doc_id") % 5 == 0, F.col("text")).alias("problem"),
        F.when(F.col("doc_id") % 4 == 0, (F.col("n_chars") % 1000) / 10).alias("accuracy"), F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast("string").alias("limitations"), F.lit(None).cast("string").alias("future_work"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.col("source"), F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("contributions"),
        F.array(F.struct(F.lit("Origin").alias("label"), F.col("source").alias("value"))).alias("key_points"),
    )


_NUM = "regexp_replace(CAST(CAST((n_chars % 1000) / 10.0 AS DOUBLE) AS VARCHAR), '\\.0$', '')"


@query(
    "questions_from_facts",
    f"""WITH q AS (SELECT doc_id, 1 AS o, 'Which method does this document propose or evaluate?' AS question, source AS answer FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'True or false: the document uses the ' || lang || ' dataset.', 'True' FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 3, 'What main problem does this document address?', text FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 4, 'What performance result is reported?', {_NUM} || '%' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 5, 'What is stated about "Origin"?', source FROM documents
UNION ALL SELECT doc_id, 6, 'Name one contribution of this work.', source FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 7, 'Name one contribution of this work.', lang FROM documents WHERE doc_id % 6 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM q) SELECT doc_id, question, answer FROM r WHERE n <= 5""",
)
def questions_from_facts(spark, sf):
    pool = F.array(F.upper("source"), F.lit("other"), F.lit("third"), F.lit("fourth"))
    docs = S.documents(spark, sf).select("doc_id", F.explode(U.questions_from_facts(headline(), pool, 5)).alias("q"))
    return docs.select("doc_id", "q.question", "q.answer")


@query(
    "cards_from_facts",
    f"""WITH q AS (SELECT doc_id, 1 AS o, 'What is the main method proposed or evaluated?' AS front, source AS back, 'medium' AS difficulty FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'Which dataset is used?', lang, 'easy' FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 4, 'What performance result is reported?', {_NUM} || '%', 'medium' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 5, 'What problem does the document address?', text, 'hard' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 6, 'What is one contribution of this work?', source, 'hard' FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 7, 'What is one contribution of this work?', lang, 'hard' FROM documents WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 8, 'What is important about "Origin"?', source, 'medium' FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM q) SELECT doc_id, front, back, difficulty FROM r WHERE n <= 4""",
)
def cards_from_facts(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.inline(U.cards_from_facts(headline(), 4)))


@query("distractor_pick", "SELECT doc_id, array_to_string(list_filter([upper(source), 'other', 'third', 'fourth'], lambda v: lower(v) <> lower(source))[1:3], '|') AS wrong FROM documents")
def distractor_pick(spark, sf):
    pool = F.array(F.upper("source"), F.lit("other"), F.lit("third"), F.lit("fourth"))
    return S.table(spark, sf, "documents").select("doc_id", F.array_join(U.distractors(pool, F.col("source")), "|").alias("wrong"))


_NO_QUESTIONS = "array<struct<question:string,questionType:string,options:array<string>,answer:string,explanation:string>>"
_NO_CARDS = "array<struct<front:string,back:string,difficulty:string>>"


def line_questions(spark, sf):
    """Every order's lines as questions: shipped ones from facts, open ones from the text, returned ones as drafts, some of them without an answer."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("lines"))

    def of(flag):
        asked = lambda x: F.concat(F.lit("Which supplier sent part "), (x["l_partkey"] % 10).cast("string"), F.lit("?"))
        answer = lambda x: F.when((x["l_returnflag"] != "R") | (x["l_suppkey"] % 3 != 0), F.concat(F.lit("supplier "), x["l_suppkey"].cast("string"))).otherwise(" ")
        none = F.array().cast("array<string>")
        return F.transform(F.filter("lines", lambda x: x["l_returnflag"] == flag), lambda x: U.question(asked(x), "short_answer", none, answer(x), "Said in the order."))

    return lines.select("doc_id", of("A").alias("facts"), of("N").alias("texts"), of("R").alias("drafts"))


@query(
    "quiz_build",
    """WITH l AS (SELECT *, l_orderkey AS doc_id, 'Which supplier sent part ' || l_partkey % 10 || '?' AS question, CASE WHEN l_returnflag <> 'R' OR l_suppkey % 3 <> 0 THEN 'supplier ' || l_suppkey ELSE ' ' END AS answer,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY n) AS d FROM l WHERE l_returnflag <> 'R') WHERE d = 1),
own AS (SELECT doc_id, question, answer, n FROM o WHERE k <= 4), ev AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question ORDER BY n) AS d FROM (SELECT * FROM own UNION ALL SELECT doc_id, question, answer, n FROM l WHERE l_returnflag = 'R')),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM ev WHERE d = 1 AND answer <> ' '), m AS (SELECT doc_id, count(*) AS made, string_agg(question || ' ' || answer, '|' ORDER BY k) AS questions FROM q WHERE k <= 4 GROUP BY 1),
s AS (SELECT doc_id, count(*) AS own FROM own GROUP BY 1), r AS (SELECT doc_id, coalesce(made, 0) AS made, coalesce(questions, '') AS questions, coalesce(own, 0) AS own FROM (SELECT DISTINCT doc_id FROM l) LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, questions, CASE WHEN own >= made THEN 'symbolic' WHEN own > 0 THEN 'hybrid' ELSE 'ai_fallback' END AS source, CASE WHEN made >= 3 THEN 'ready' WHEN made > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""",
)
def quiz_build(spark, sf):
    """Four questions an order: facts, then text, then drafts."""
    made = line_questions(spark, sf).select("doc_id", U.build_quiz(F.col("facts"), F.col("texts"), F.col("drafts"), 4, F.lit(0.5)).alias("z"))
    return made.select("doc_id", F.array_join(F.transform("z.questions", lambda q: F.concat_ws(" ", q["question"], q["answer"])), "|").alias("questions"), "z.source", "z.status")


@query("quiz_build_texts")
def quiz_build_texts(spark, sf):
    pool = F.array(F.lit("other"), F.lit("third"))
    facts = U.questions_from_facts(headline(), pool, 12)
    text = U.questions_from_text(F.col("text"), 12, pattern=DEFINED)
    draft = F.from_json(F.lit("[]"), _NO_QUESTIONS)
    docs = S.documents(spark, sf).select("doc_id", U.build_quiz(facts, text, draft, 12, F.lit(0.5)).alias("z"))
    return docs.select("doc_id", F.size("z.questions").alias("questions"), "z.source", F.round("z.confidence", 6).alias("confidence"), "z.status")


@query("deck_build")
def deck_build(spark, sf):
    facts, text = U.cards_from_facts(headline(), 10), U.cards_from_text(F.col("text"), 10, DEFINED)
    deck = U.build_deck(facts, text, F.from_json(F.lit("[]"), _NO_CARDS), 10, F.lit(0.5))
    docs = S.documents(spark, sf).select("doc_id", deck.alias("z"))
    return docs.select("doc_id", F.size("z.cards").alias("cards"), F.round("z.confidence", 6).alias("confidence"), "z.status")


@query(
    "generation_confidence",
    "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, n, round(CAST(least(1.0, 0.35 + 0.45 * n / 10 + 0.2 * 0.5) AS DOUBLE), 6) AS confidence, n >= 7 AS ready FROM c",
)
def generation_confidence(spark, sf):
    counts = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return counts.select("conv_id", "n", F.round(U.generation_confidence(F.col("n"), 10, F.lit(0.5)), 6).alias("confidence"), U.is_ready(F.col("n"), 10).alias("ready"))


@query("summary_general")
def summary_general(spark, sf):
    s = U.general_summary(
        headline(), F.col("text"), F.col("source"), F.array("source", "lang"),
        F.from_json(F.lit("[]"), "array<struct<term:string,definition:string>>"), F.lit(None).cast("double"),
    )
    return S.documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.summary", F.round("s.confidence", 6).alias("confidence"), "s.status")


@query("summary_symbolic")
def summary_symbolic(spark, sf):
    s = U.symbolic_summary(headline(), F.col("text"), F.col("source"), F.array("source"), F.array("lang"), DEFINED)
    return S.documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.summary", F.round("s.confidence", 6).alias("confidence"), "s.status")


@query("summary_sections_parse", "SELECT doc_id, trim(text, ' ') AS prose, source || '|' || lang AS points, lang || '|' || source AS concepts FROM documents".replace("trim(text, ' ')", Q.strip("text")))
def summary_sections_parse(spark, sf):
    flat = F.concat(F.col("text"), F.lit("\n\n**Key Points:**\n- "), "source", F.lit("\n-  "), "lang", F.lit("\n\n**Important Concepts:** "), "lang", F.lit(", "), "source")
    s = U.parse_stored_summary(flat)
    return S.documents(spark, sf).select("doc_id", s.alias("s")).select(
        "doc_id", "s.prose", F.array_join("s.key_points", "|").alias("points"), F.array_join("s.concepts", "|").alias("concepts")
    )


@query("ordered_union_distinct", "SELECT doc_id, CASE WHEN lower(source) = lower(lang) THEN source ELSE source || '|' || lang END AS merged FROM documents")
def ordered_union_distinct(spark, sf):
    values = F.array("source", F.upper("source"), F.lit("  "), F.concat(F.lit(" "), "lang"), F.lower("source"))
    return S.table(spark, sf, "documents").select("doc_id", F.array_join(U.unique(values, 5), "|").alias("merged"))


@query("set_difference", "WITH o AS (SELECT o_custkey AS user_id, list_sort(list_distinct(list(o_orderstatus))) AS present FROM orders GROUP BY 1) SELECT user_id, array_to_string(list_filter(['F', 'O', 'P'], lambda v: NOT list_contains(present, v)), '|') AS missing FROM o")
def set_difference(spark, sf):
    """Required states an owner's records lack."""
    present = S.owned_items(spark, sf).groupBy("user_id").agg(F.collect_set("stage").alias("present"))
    required = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return present.select("user_id", F.array_join(F.array_except(required, "present"), "|").alias("missing"))


_CHAT_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z][a-z-]{{2,}}'), lambda w: w NOT IN ({Q.STUDY_STOP})))"


@query(
    "excerpt_topk",
    f"""WITH {S.CHATS_SQL}, q AS (SELECT note_id, turn, {_CHAT_WORDS} AS terms, answer FROM chats), p AS (SELECT note_id, turn, terms, string_split(regexp_replace(answer, '([.!?]){Q.WS}+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM q),
x AS (SELECT note_id, turn, i, len(list_filter(terms, lambda t: contains(lower(s[i]), t))) AS score FROM p, unnest(range(1, len(s) + 1)) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY note_id, turn ORDER BY score DESC, i) AS n FROM x WHERE score > 0) SELECT note_id, turn, CAST(i - 1 AS INTEGER) AS i, CAST(score AS INTEGER) AS score FROM k WHERE n <= 3""",
)
def excerpt_topk(spark, sf):
    """Best sentences of each answer for its question."""
    sentences = F.split("answer", r"(?<=[.!?])" + T.WS + "+")
    rows = S.chat_turns(spark, sf).select("note_id", "turn", F.explode(U.excerpts(sentences, F.col("question"))).alias("e"))
    return rows.select("note_id", "turn", "e.i", "e.score")


@query("answer_question")
def answer_question(spark, sf):
    """Every user turn asked of the document with the conversation's number."""
    asked = S.chat_turns(spark, sf)
    docs = S.table(spark, sf, "documents").withColumn("note_id", F.col("doc_id"))
    joined = asked.join(docs, "note_id").select(
        "note_id", "turn", U.answer(headline(), U.meaningful_sentences(F.col("text"), None), F.col("question")).alias("a")
    )
    return joined.select("note_id", "turn", "a.text", "a.confidence", "a.route")


@query(
    "chat_context",
    f"""WITH {S.CHATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY turn DESC) AS k FROM chats),
h AS (SELECT note_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) ORDER BY turn) AS turns FROM r WHERE k <= 6 GROUP BY 1),
p AS (SELECT note_id, concat_ws(chr(10) || chr(10), 'FACTS' || chr(10) || 'Method: ' || source, 'EVIDENCE' || chr(10) || text, 'HISTORY' || chr(10) || turns,
 'QUESTION' || chr(10) || 'What is it about?') AS prompt FROM h JOIN documents ON doc_id = note_id)
SELECT note_id, {Q.strip('prompt')} AS prompt FROM p""",
)
def chat_context(spark, sf):
    turns = S.chat_turns(spark, sf)
    # A conversation's turns are bounded by the listing limit of ten.
    from lectern.operators.listings import last_n

    recent = last_n(turns, ["note_id"], [F.col("turn")], 10)
    history = recent.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("turn", "question", "answer"))).alias("history"))
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), "text", "source", "lang")
    j = history.join(docs, "note_id")
    return j.select(
        "note_id",
        U.chat_context(F.array(F.concat(F.lit("Method: "), "source")), U.no_strings(), F.col("text"), F.col("history"), F.lit("What is it about?")).alias("prompt"),
    )


@query("chat_readiness", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS DOUBLE) WHEN length(text) >= 500 THEN 0.45 ELSE 0.2 END AS confidence, CASE WHEN l.doc_id IS NOT NULL OR length(text) >= 500 THEN 'ready' ELSE 'partial' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def chat_readiness(spark, sf):
    labels = S.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("c"))
    j = S.table(spark, sf, "documents").join(labels, "doc_id", "left")
    return j.select("doc_id", U.chat_readiness(F.col("c"), F.col("text"), F.col("c").isNotNull()).alias("r")).select("doc_id", "r.*")


@query("draft_requests", """WITH p AS (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / 8000.0)) AS INTEGER) AS parts FROM documents)
SELECT doc_id, 'cards' AS kind, CAST(part AS INTEGER) AS part, parts, 'Make cards' || chr(10) || 'DOCUMENT:' || chr(10) || substr(text, part * 8000 + 1, 8000) AS request FROM p, unnest(range(0, parts)) AS r(part)""")
def draft_requests(spark, sf):
    return U.draft_requests(S.table(spark, sf, "documents"), "cards", F.lit("Make cards"))


@query("explain_facts", """WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, 0 AS tier, l_orderkey || ' uses the method s' || l_suppkey || '.' AS sentence FROM lineitem
UNION SELECT l_orderkey, 1, l_orderkey || ' is a kind of ' || l_returnflag || '.' FROM lineitem UNION SELECT l_orderkey, 2, l_orderkey || ' key fact ' || l_linestatus || '.' FROM lineitem)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier, sentence) AS INTEGER) AS no, tier, sentence FROM f""")
def explain_facts(spark, sf):
    li = S.table(spark, sf, "lineitem")
    doc = F.col("l_orderkey")

    def rows(name, value):
        return li.select(doc.alias("doc_id"), F.lit(name).alias("functor"), doc.cast("string").alias("a"), value.alias("b"))

    facts = rows("method", F.concat(F.lit("s"), "l_suppkey")).unionByName(rows("is_a", F.col("l_returnflag"))).unionByName(rows("key_fact", F.col("l_linestatus")))
    return U.explain_facts(facts)


# ---- concepts ------------------------------------------------------------------------------------

_BARE = f"""{Q.LINES}, b0 AS (SELECT doc_id, line_no, {Q.strip("regexp_replace(regexp_replace(regexp_replace(line, '[\\x{FFFD}\\x{0}]', '', 'g'), '[\\x{1}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}]', '', 'g'), '[ \\t]+', ' ', 'g')")} AS t FROM lines),
b AS (SELECT doc_id, line_no, trim({Q.squeeze("regexp_replace(regexp_replace(t, '^[-–—•*0-9.) ]+', ''), '[.:;,]+$', '')")}, ' ') AS v FROM b0)"""


@query(
    "valid_concept",
    f"""WITH {_BARE} SELECT doc_id, line_no, length(v) BETWEEN 4 AND 85 AND len(list_filter(regexp_split_to_array(lower(v), '{Q.WS}+'), lambda w: w <> '')) <= 7
  AND lower(v) NOT IN ({", ".join(f"'{w}'" for w in K.BLOCKED)}) AND NOT regexp_matches(lower(v), '(?i)^(?:she|he|they|this|that|these|those|it|such|suppose)\\b') AND NOT regexp_matches(lower(v), '{T.NUMBER}')
  AND NOT regexp_matches(v, '[.!?]') AND NOT regexp_matches(lower(v), '^(?:year|page|table|figure) +[0-9]+$') AND regexp_matches(lower(v), '[a-z]') AS valid FROM b""",
)
def valid_concept(spark, sf):
    """Each line as a term."""
    return document_lines(spark, sf).select("doc_id", "line_no", K.is_valid_concept(F.col("line")).alias("valid"))


@query(
    "canonical_concept",
    f"""WITH {_BARE} SELECT doc_id, line_no, array_to_string(list_transform(regexp_split_to_array(v, '{Q.WS}+'), lambda w: CASE WHEN lower(w) IN ({", ".join(f"'{w}'" for w in K.UPPER_WORDS)}) THEN upper(w)
  WHEN lower(w) IN ({", ".join(f"'{w}'" for w in K.LOWER_WORDS)}) THEN lower(w) ELSE replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || lower(substr(w, 2)) END), ' ') AS name FROM b""",
)
def canonical_concept(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", K.canonical_concept(F.col("line")).alias("name"))


@query(
    "concept_category",
    f"""WITH {Q.LINES} SELECT doc_id, line_no, CASE WHEN regexp_matches(lower(line), 'npv|irr|cash flow|capital|working capital|salvage|discount|tax|depreciation') THEN 'finance'
  WHEN regexp_matches(lower(line), 'scenario|sensitivity') THEN 'analysis' WHEN regexp_matches(lower(line), 'dataset|model|algorithm|prediction|classification|roc|rate') THEN 'general' ELSE 'concept' END AS category FROM lines""",
)
def concept_category(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", K.concept_category(F.col("line"), F.lit("general")).alias("category"))


@query(
    "first_evidence_sentence",
    f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){Q.WS}+|\\n+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
x AS (SELECT doc_id, i, length({Q.strip("regexp_replace(regexp_replace(regexp_replace(s[i], '[\\x{FFFD}\\x{0}]', '', 'g'), '[\\x{1}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}]', '', 'g'), '[ \\t]+', ' ', 'g')")}) AS n FROM p, unnest(range(1, len(s) + 1)) AS r(i) WHERE contains(lower(s[i]), 'the th'))
SELECT doc_id, arg_min(n, i) AS size FROM x GROUP BY 1""",
)
def first_evidence_sentence(spark, sf):
    docs = S.documents(spark, sf).select("doc_id", K.first_evidence(K.evidence_sentences(F.col("text")), F.lit("The TH")).alias("e"))
    return docs.filter(F.col("e").isNotNull()).select("doc_id", F.char_length("e").cast("bigint").alias("size"))


_VOCAB = {"en": ["of the", "and the", "thing"], "fr": ["de la", "les"]}


@query("validated_concepts")
def validated_concepts(spark, sf):
    entities = F.array(F.struct(F.col("source").alias("text"), F.lit("CONCEPT").alias("type")), F.struct(F.lit("12").alias("text"), F.lit("NUMBER").alias("type")))
    c = K.validated_concepts(F.col("text"), entities, F.array(F.lit("of the"), F.lit("single")), F.col("lang"), vocabulary=_VOCAB)
    return S.documents(spark, sf).select("doc_id", F.posexplode(c).alias("pos", "c")).select("doc_id", "pos", "c.term", "c.category", F.round("c.confidence", 6).alias("confidence"), "c.source")


@query("validated_key_terms")
def validated_key_terms(spark, sf):
    return S.documents(spark, sf).select("doc_id", F.inline(K.key_terms(F.col("text"), F.array(F.lit("the")))))


# ---- grounding -----------------------------------------------------------------------------------


_WORDED, _COUNTED = "[A-Za-z][A-Za-z ]{20,60}[A-Za-z]", "[A-Za-z]{3,} [0-9]{1,4}"


def drafts_per_document(spark, sf):
    """Four draft claims a document: a benchmark passage, and words of its own text without a number, without a metric, and with their number.

    Passages are numbered by rank and dealt round, so every document has one; planted passages are found, the others rejected.
    """
    bench = S.table(spark, sf, "benchmark")
    clean = F.regexp_replace(F.regexp_replace("text", r'["\\]', ""), T.WS + "+", " ")
    ranked = bench.select("item_id", clean.alias("passage")).withColumn("place", F.row_number().over(Window.orderBy("item_id")) - 1)
    total = F.broadcast(bench.agg(F.count("*").alias("n")))
    docs = S.table(spark, sf, "documents").select("doc_id", "text").crossJoin(total).withColumn("place", F.col("doc_id") % F.col("n")).join(ranked, "place")
    worded, counted = (F.regexp_extract("text", p, 0) for p in (_WORDED, _COUNTED))

    def draft(kind, obj, evidence, number=None, metric=None):
        return F.struct(
            F.lit(kind).alias("type"), obj.alias("object"), evidence.alias("evidenceText"), F.lit(0.95).alias("confidence"),
            (F.lit(None).cast("string") if number is None else number.cast("string")).try_cast("double").alias("numericValue"), F.lit(metric).cast("string").alias("metric"),
        )

    claims = F.array(
        draft("method", F.concat(F.lit("passage "), F.col("item_id").cast("string")), F.col("passage")), draft("result", F.lit("number"), worded, F.col("doc_id") % 7),
        draft("result", F.lit("metric"), worded, metric="accuracy"), draft("result", F.lit("counted"), counted, F.regexp_extract(counted, "[0-9]+$", 0)),
    )
    return docs.select("doc_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(claims.alias("claims"))), F.lit("\n```")).alias("payload"))


@query(
    "claim_grounding_join",
    f"""WITH i AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark),
w AS (SELECT doc_id, text, trim({Q.squeeze('lower(text)')}, ' ') AS src, regexp_extract(text, '{_WORDED}') AS worded, regexp_extract(text, '{_COUNTED}') AS counted FROM documents),
d AS (SELECT doc_id, src, 'passage ' || item_id AS object, {Q.squeeze("regexp_replace(i.text, '[\"\\\\]', '', 'g')")} AS ev, NULL AS late FROM w JOIN i ON place = doc_id % n
 UNION ALL SELECT doc_id, src, 'number', worded, 'number' FROM w UNION ALL SELECT doc_id, src, 'metric', worded, CASE WHEN regexp_matches(lower(worded), 'accura(te|cy)') THEN NULL ELSE 'metric' END FROM w UNION ALL SELECT doc_id, src, 'counted', counted, NULL FROM w),
s AS (SELECT *, instr(src, trim({Q.squeeze('lower(ev)')}, ' ')) AS pos FROM d)
SELECT doc_id, object, CASE WHEN pos > 0 THEN CAST(pos - 1 AS INTEGER) END AS start, CAST(0.9 AS DOUBLE) AS confidence, CASE WHEN ev = '' THEN 'incomplete' WHEN pos = 0 THEN 'not_in_source' ELSE late END AS rejected FROM s""",
)
def claim_grounding_join(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    return G.ground_claims(drafts_per_document(spark, sf), docs).select("doc_id", "object", "start", "confidence", "rejected")


@query(
    "grounding_pairs",
    f"""WITH n AS (SELECT doc_id, trim({Q.squeeze('lower(text)')}, ' ') AS src FROM documents), b AS (SELECT item_id, trim({Q.squeeze('lower(text)')}, ' ') AS ev FROM benchmark)
SELECT item_id, doc_id, CAST(instr(src, ev) - 1 AS INTEGER) AS start FROM b JOIN n ON contains(src, ev)""",
)
def grounding_pairs(spark, sf):
    """Where each passage stands in the corpus: candidates by a shared sentence, then the exact test."""
    from lectern.operators.passages import find_passages

    return find_passages(S.table(spark, sf, "benchmark"), S.documents(spark, sf)).select("item_id", "doc_id", "start")


@query("repair_merge", "SELECT o_orderkey AS doc_id, o_orderstatus AS type, o_orderpriority AS object, 'symbolic' AS source FROM orders UNION ALL SELECT o_orderkey, 'P', 'draft', 'ai' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' AND o_orderkey % 7 <> 3")
def repair_merge(spark, sf):
    items = S.owned_items(spark, sf)
    claims = items.select(F.col("id").alias("doc_id"), F.col("stage").alias("type"), F.col("title").alias("object"))
    grounded = items.select(F.col("id").alias("doc_id"), F.lit("P").alias("type"), F.lit("draft").alias("object"), F.when(F.col("id") % 7 == 3, "not_in_source").alias("rejected"))
    missing = items.filter(F.col("id") % 2 == 0).select(F.col("id").alias("doc_id"), F.lit("P").alias("type"))
    return G.repair_merge(claims, grounded, missing)


@query(
    "grounding_ratio",
    f"""WITH {S.CHATS_SQL}, t AS (SELECT note_id, turn, list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-z][a-z0-9-]{{3,}}'), lambda w: w NOT IN ('this','that','these','those','with','from','have','will'))) AS a,
 regexp_extract_all(lower(question), '[a-z][a-z0-9-]{{3,}}') AS q FROM chats) SELECT note_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda w: list_contains(q, w))) / CAST(len(a) AS DOUBLE) ELSE 0.0 END, 6) AS ratio FROM t""",
)
def grounding_ratio(spark, sf):
    return S.chat_turns(spark, sf).select(
        "note_id", "turn", F.round(G.grounding_ratio(F.col("answer"), G.meaningful_tokens(F.col("question"))), 6).alias("ratio")
    )


_FOREIGN = "A sentence long enough to count among the tested ones which however cannot be found in any of the given documents at all."


def _compare_form(expr):
    bare = f"regexp_replace(lower({expr}), '[`*_>#\\-]', ' ', 'g')"
    return f"trim({Q.squeeze(f"regexp_replace({bare}, '[^a-z0-9.%+]', ' ', 'g')")}, ' ')"


@query(
    "copy_ratio",
    f"""WITH o AS (SELECT doc_id, {_compare_form('text')} AS src, string_split(regexp_replace('{_FOREIGN}' || chr(10) || text, '([.!?]){Q.WS}+|\\n+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, src, {_compare_form('part')} AS s FROM (SELECT doc_id, src, unnest(parts) AS part FROM o))
SELECT doc_id, round(count(*) FILTER (contains(src, s)) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM s WHERE length(s) >= 100 GROUP BY 1""",
)
def copy_ratio(spark, sf):
    """Each text against itself with a foreign sentence added."""
    out = F.concat(F.lit(_FOREIGN + "\n"), F.col("text"))
    return S.documents(spark, sf).select("doc_id", F.round(G.copy_ratio(out, F.col("text")), 6).alias("ratio"))


@query("draft_validate")
def draft_validate(spark, sf):
    """Drafts made of the document's own sentences; every third is foreign."""
    return _drafted(spark, sf).select("doc_id", F.col("v").isNotNull().alias("accepted"), F.size("v.key_points").alias("points"))


def _drafted(spark, sf):
    # Overview: the first, middle and last sentence; key points: all sentences.
    n = F.size("own")
    picks = F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))
    spread = F.array_join(F.transform(F.filter(picks, lambda k: k >= 0), lambda k: F.get("own", k)), " ")
    overview = F.when(F.col("doc_id") % 3 == 0, F.lit("Completely foreign wording " * 6)).otherwise(spread)
    payload = F.to_json(
        F.struct(
            overview.alias("overview"), F.col("own").alias("keyPoints"), F.array(F.lit("first idea"), F.lit("second idea")).alias("importantConcepts"),
            F.array().cast("array<struct<term:string,definition:string>>").alias("keyTerms"), F.array().cast("array<string>").alias("unresolvedAssumptions"),
        )
    )
    docs = S.documents(spark, sf).withColumn("own", U.meaningful_sentences(F.col("text"), None))
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars", D.parse_summary(payload).alias("d"))
    return docs.withColumn("v", G.validate_draft(F.col("d"), F.col("text")))


@query("draft_merge")
def draft_merge(spark, sf):
    s = U.general_summary(headline(), F.col("text"), F.col("source"), F.array("source"), F.from_json(F.lit("[]"), "array<struct<term:string,definition:string>>"), F.lit(None).cast("double"))
    docs = _drafted(spark, sf).withColumn("s", s)
    merged = docs.select("doc_id", G.merge_draft(F.col("s"), F.col("v"), F.lit("partial")).alias("m"))
    return merged.select("doc_id", "m.summary", F.round("m.confidence", 6).alias("confidence"), "m.status")


@query("draft_provider")
def draft_provider(spark, sf):
    """Drafts arrive as a table and pass the validators before use."""
    # Exploded, not filtered: a filter moves below the projection and validates every draft a second time.
    return _drafted(spark, sf).select("doc_id", F.explode(F.array_compact(F.array("v"))).alias("v")).select("doc_id", F.size("v.concepts").alias("concepts"))


@query("claims_json", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS INTEGER) AS claims, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS object FROM orders")
def claims_json(spark, sf):
    ok = F.concat(F.lit('```json\n{"claims":[{"type":"method","object":"'), F.col("title"), F.lit('"}]}\n```'))
    docs = S.owned_items(spark, sf).select("id", D.parse_claims(F.when(F.col("id") % 4 == 0, F.lit("no json")).otherwise(ok)).alias("c"))
    return docs.select("id", F.size("c").alias("claims"), F.get("c", F.lit(0))["object"].alias("object"))


@query("draft_json", "SELECT o_orderkey AS id, o_orderpriority AS overview, 1 AS points FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0")
def draft_json(spark, sf):
    ok = F.concat(F.lit('{"overview":" '), F.col("title"), F.lit('","keyPoints":["a"," "],"importantConcepts":["x"],"keyTerms":[{"term":"t"}]}'))
    docs = S.owned_items(spark, sf).select("id", D.parse_summary(F.when(F.col("id") % 4 == 0, F.lit("{oops")).otherwise(ok)).alias("d"))
    return docs.select("id", "d.overview", F.when(F.col("d").isNotNull(), F.size("d.keyPoints")).alias("points"))


@query("quiz_json", "SELECT o_orderkey AS id, o_orderstatus <> 'P' AS accepted FROM orders")
def quiz_json(spark, sf):
    kind = F.when(F.col("stage") == "P", "essay").otherwise("short_answer")
    payload = F.concat(F.lit('{"questions":[{"question":"q","questionType":"'), kind, F.lit('","options":[],"answer":"a"}]}'))
    return S.owned_items(spark, sf).select("id", D.parse_quiz(payload).isNotNull().alias("accepted"))


@query("cards_json", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INTEGER) AS cards, CASE WHEN o_orderstatus = 'O' THEN 'hard' ELSE 'medium' END AS difficulty FROM orders")
def cards_json(spark, sf):
    front = F.when(F.col("stage") == "F", " ").otherwise("second")
    level = F.when(F.col("stage") == "O", "hard").otherwise("unknown")
    payload = F.concat(F.lit('{"flashcards":[{"front":"f","back":"b","difficulty":"'), level, F.lit('"},{"front":"'), front, F.lit('","back":"b"}]}'))
    docs = S.owned_items(spark, sf).select("id", D.parse_cards(payload).alias("c"))
    return docs.select("id", F.size("c").alias("cards"), F.get("c", F.lit(0))["difficulty"].alias("difficulty"))


@query("valid_context")
def valid_context(spark, sf):
    from lectern.operators import claims as C
    from lectern.plans.claim_queries import validated

    docs = validated(spark, sf)
    return docs.select(
        "doc_id", F.size(F.filter("claims", C.is_valid)).alias("claims"),
        F.size(F.filter("claims", lambda c: c["is_duplicate"])).alias("warnings"),
    )

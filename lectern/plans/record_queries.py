"""Sources, sinks, record rules and listings bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import listings, rules
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.text_queries import _BAD, _VISIBLE, _ratio_sql
from lectern.sources import collections as C, ingest, tables as S
from lectern.sources.guarded import Guard, guarded
from lectern.streaming.flow import work_path


def joined(column):
    """Arrays leave as text so both engines print them alike."""
    return F.array_join(column, "|")


# ---- scans and ingest ----------------------------------------------------------------------------


@query("collection_scan", "SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_custkey = 42")
def collection_scan(spark, sf):
    """Point read on an owner: the filter reaches the parquet scan."""
    return C.point_lookup(S.owned_items(spark, sf), "user_id", 42).select("id", "score")


def _collections(spark, sf):
    """The given tables as the stored collections."""
    docs, labels = S.table(spark, sf, "documents"), S.table(spark, sf, "labels")
    return {
        "users": S.users(spark, sf), "notes": S.notes(spark, sf), "quizzes": S.owned_items(spark, sf),
        "flashcards": S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("front"), F.col("p_type").alias("back"), F.col("p_size").alias("review_count")),
        "chats": S.chat_turns(spark, sf).select(F.concat_ws("-", "note_id", "turn").alias("id"), "note_id", "question", "answer"),
        "audit": S.audit_log(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")),
        "generation_state": docs.select(F.col("doc_id").alias("note_id"), F.col("source").alias("user_id"), F.lit("pending").alias("stage")),
        "results": labels.select(F.col("doc_id").alias("note_id"), F.lit("complete").alias("stage"), F.col("quality").alias("confidence")),
    }


@query(
    "collection_scan_typed",
    f"""WITH {S.CHATS_SQL} SELECT 'users' AS collection, count(*) AS rows, min(CAST(c_custkey AS VARCHAR)) AS first FROM customer UNION ALL SELECT 'notes', count(*), min(CAST(doc_id AS VARCHAR)) FROM documents
UNION ALL SELECT 'quizzes', count(*), min(CAST(o_orderkey AS VARCHAR)) FROM orders UNION ALL SELECT 'flashcards', count(*), min(CAST(p_partkey AS VARCHAR)) FROM part UNION ALL SELECT 'chats', count(*), min(note_id || '-' || turn) FROM chats
UNION ALL SELECT 'audit', count(*), min(CAST(event_id AS VARCHAR)) FROM events UNION ALL SELECT 'generation_state', count(*), min(CAST(doc_id AS VARCHAR)) FROM documents UNION ALL SELECT 'results', count(*), min(CAST(doc_id AS VARCHAR)) FROM labels""",
)
def collection_scan_typed(spark, sf):
    """Every collection written in its fixed schema and scanned with it: row count and first key."""
    found = None
    for name, df in _collections(spark, sf).items():
        path = work_path(spark, name)
        C.append(C.conform(df, name), path)
        rows = C.scan(spark, path, name)
        one = rows.agg(F.count("*").alias("rows"), F.min(rows.columns[0]).alias("first")).select(F.lit(name).alias("collection"), "rows", "first")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "ingest_validate",
    f"""WITH {S.NOTES_SQL} SELECT id,
  CASE WHEN file_size > 10485760 THEN 'too_large'
       WHEN file_type NOT IN ('pdf', 'docx') AND id % 3 = 0 THEN 'mime_type'
       WHEN file_type NOT IN ('pdf', 'docx') THEN 'extension' END AS reject_reason FROM notes""",
)
def ingest_validate(spark, sf):
    """Foreign types declare their own MIME on every third row and pretend to be PDF elsewhere."""
    mime = F.when(F.col("file_type").isin("pdf", "docx"), ingest.mime_type(F.col("file_type"))).when(
        F.col("id") % 3 == 0, F.concat(F.lit("text/"), F.col("file_type"))
    ).otherwise("application/pdf")
    files = S.notes(spark, sf).withColumn("mime_type", mime)
    good, bad = ingest.split_uploads(files.select("id", "file_name", "mime_type", "file_size"))
    return good.select("id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("id", "reject_reason")
    )


@query(
    "sanitize_file_name",
    """SELECT doc_id, substr(regexp_replace(regexp_replace(text || '.pdf', '[^a-zA-Z0-9._-]', '_', 'g'),
  '_+', '_', 'g'), 1, 255) AS file_name FROM documents""",
)
def sanitize_file_name(spark, sf):
    """Each document's whole text as a wild file name."""
    name = F.concat("text", F.lit(".pdf"))
    return S.documents(spark, sf).select("doc_id", ingest.sanitize_file_name(name).alias("file_name"))


@query(
    "title_from_file_name",
    f"""WITH {S.NOTES_SQL} SELECT id,
  {Q.strip("replace(regexp_replace(file_name, '(?i)\\.(?:pdf|docx)$', ''), '_', ' ')")} AS title FROM notes""",
)
def title_from_file_name(spark, sf):
    return S.notes(spark, sf).select("id", ingest.title_from_file_name(F.col("file_name")).alias("title"))


_EXTRACTED = "replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(9), ' ')"
_EXTRACTED = f"regexp_replace(regexp_replace({_EXTRACTED}, '[ ]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(
    "extracted_text_normalize",
    f"WITH t AS (SELECT doc_id, {Q.strip(_EXTRACTED)} AS content FROM documents) SELECT * FROM t WHERE length(content) > 0",
)
def extracted_text_normalize(spark, sf):
    clean = S.documents(spark, sf).select("doc_id", ingest.normalise_extracted(F.col("text")).alias("content"))
    return clean.filter(F.char_length("content") > 0)


@query(
    "to_raw_document",
    f"""WITH {S.NOTES_SQL} SELECT id AS doc_id, content AS raw_text, file_name,
  CASE file_type WHEN 'pdf' THEN 'application/pdf'
    ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS mime_type, file_size FROM notes""",
)
def to_raw_document(spark, sf):
    return ingest.raw_documents(S.notes(spark, sf))


PAGE_BREAK = r"\.\n"


@query(
    "page_split",
    """SELECT doc_id, CAST(i AS INTEGER) AS page_no, parts[i] AS raw_text
FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(12)), chr(12)) AS parts FROM documents) d,
  unnest(range(1, len(parts) + 1)) AS r(i)""",
)
def page_split(spark, sf):
    """Sentence-final line ends become form feeds, so documents have several pages."""
    fed = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\f"))
    return S.documents(spark, sf).select("doc_id", F.inline(ingest.page_texts(fed)))


# ---- sinks ---------------------------------------------------------------------------------------


@query(
    "append_sink",
    "SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS score, o_orderstatus AS stage FROM orders",
)
def append_sink(spark, sf):
    """Rows read back after two appends, partitioned by stage."""
    from lectern.streaming.flow import work_path

    path = work_path(spark, "appended")
    items = S.owned_items(spark, sf).select("id", "user_id", "score", "stage")
    C.append(items.filter(F.col("id") % 2 == 0), path, ["stage"])
    C.append(items.filter(F.col("id") % 2 == 1), path, ["stage"])
    return spark.read.schema("id bigint, user_id bigint, score double, stage string").parquet(path)


@query(
    "keyed_upsert",
    """WITH base AS (SELECT c_custkey AS note_id, 'base' AS stage, c_acctbal AS score, CAST(0 AS BIGINT) AS version FROM customer),
upd AS (SELECT o_custkey AS note_id, o_orderstatus AS stage, o_totalprice AS score, CAST(epoch(o_orderdate) AS BIGINT) * 100000000 + o_orderkey AS version FROM orders),
u AS (SELECT *, 0 AS rk FROM base UNION ALL SELECT *, 1 AS rk FROM upd)
SELECT note_id, stage, score, version FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY version DESC, rk DESC) AS rn FROM u) WHERE rn = 1""",
)
def keyed_upsert(spark, sf):
    base = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("note_id"), F.lit("base").alias("stage"), F.col("c_acctbal").alias("score"),
        F.lit(0).cast("bigint").alias("version"),
    )
    updates = S.owned_items(spark, sf).select(
        F.col("user_id").alias("note_id"), "stage", "score",
        (F.unix_seconds(F.col("created_at").cast("timestamp")) * 100000000 + F.col("id")).alias("version"),
    )
    return C.keyed_upsert(base, updates, "note_id", "version")


@query(
    "failed_upsert",
    """WITH g AS (SELECT doc_id, nullif(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'), '') AS body, regexp_extract(text, '[0-9]+') AS digits, text FROM documents),
n AS (SELECT *, TRY_CAST(digits AS INTEGER) AS number, regexp_matches(text, '[\x01-\x08\x0E-\x1F]') AS dirty FROM g),
s AS (SELECT doc_id, CASE WHEN body IS NULL THEN 'text' WHEN dirty THEN 'decoding' WHEN number IS NULL THEN 'number' WHEN number > 100000 THEN 'range' END AS stage, digits, number FROM n)
SELECT doc_id AS note_id, coalesce(stage, 'complete') AS stage, stage AS failed_stage, CASE stage WHEN 'text' THEN 'no readable text' WHEN 'decoding' THEN 'control characters' WHEN 'number' THEN CASE WHEN digits = '' THEN 'no number' ELSE 'number too long: ' || digits END
 WHEN 'range' THEN 'out of range: ' || number END AS failed_reason, CASE WHEN stage IS NULL THEN number / 100000.0 END::DOUBLE AS confidence FROM s""",
)
def failed_upsert(spark, sf):
    """Documents by what their own text lets a stage do: readable, clean, with a number that fits and is in range."""
    digits = F.regexp_extract("text", "[0-9]+", 0)
    guards = [
        Guard("text_", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")), "no readable text"),
        Guard("decoding", F.when(~F.col("text_").rlike(r"[\x01-\x08\x0E-\x1F]"), F.col("text_")), "control characters"),
        Guard("number", digits.try_cast("int"), F.when(digits == "", "no number").otherwise(F.concat(F.lit("number too long: "), digits))),
        Guard("range", F.when(F.col("number") <= 100000, F.col("number") / 100000), lambda: F.concat(F.lit("out of range: "), F.col("number").cast("string"))),
    ]
    seen = guarded(S.documents(spark, sf).select("doc_id", "text"), guards).withColumn("failed_stage", F.when(F.col("failed_stage") == "text_", "text").otherwise(F.col("failed_stage")))
    good = seen.filter(F.col("failed_stage").isNull()).select(F.col("doc_id").alias("note_id"), F.lit("complete").alias("stage"), "failed_stage", "failed_reason", F.col("range").alias("confidence"))
    failures = seen.filter(F.col("failed_stage").isNotNull()).select(F.col("doc_id").alias("note_id"), F.col("failed_stage").alias("at"), F.col("failed_reason").alias("why"))
    return good.unionByName(C.failed_rows(failures, good, "note_id", "at", "why"))


@query(
    "init_if_absent",
    """SELECT o_orderkey AS note_id, o_orderstatus AS stage FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT l_orderkey, 'pending' FROM (SELECT DISTINCT l_orderkey FROM lineitem) k
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def init_if_absent(spark, sf):
    existing = S.owned_items(spark, sf).filter(F.col("stage") == "F").select(F.col("id").alias("note_id"), "stage")
    wanted = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id")).distinct()
    return C.init_if_absent(existing, wanted.withColumn("stage", F.lit("pending")), "note_id")


@query(
    "nested_patch",
    """SELECT d.doc_id AS note_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'ready' END
    ELSE 'pending' END AS quiz_status, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS DOUBLE) ELSE 0.0 END AS quiz_confidence,
  'pending' AS summary_status FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def nested_patch(spark, sf):
    """Labelled documents patch their quiz state; the other features stay."""
    fresh = F.struct(
        F.lit("pending").alias("status"), F.lit(0.0).alias("confidence"), F.lit(None).cast("timestamp").alias("updatedAt")
    )
    state = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"), F.struct(fresh.alias("summary"), fresh.alias("quiz")).alias("features")
    )
    patches = S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("note_id"),
        F.when(F.col("toxic") == 1, "failed").otherwise("ready").alias("status"),
        F.col("quality").cast("double").alias("confidence"),
        F.lit("2024-02-01").cast("timestamp").alias("updatedAt"),
    )
    patched = C.patch_nested(state, patches, "note_id", "quiz", ["status", "confidence"])
    return patched.select(
        "note_id",
        F.col("features.quiz.status").alias("quiz_status"),
        F.col("features.quiz.confidence").alias("quiz_confidence"),
        F.col("features.summary.status").alias("summary_status"),
    )


_STAGE = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'running' END"


@query(
    "stage_patch",
    f"""SELECT o_orderkey AS id, {_STAGE} AS stage, CASE WHEN {_STAGE} IN ('complete', 'partial', 'failed')
  THEN strftime(o_orderdate, '%Y-%m-%d') END AS completed_at FROM orders""",
)
def stage_patch(spark, sf):
    stage = F.when(F.col("stage") == "F", "complete").when(F.col("stage") == "P", "partial").otherwise("running")
    patched = C.patch_stage(S.owned_items(spark, sf), stage, F.col("created_at"))
    return patched.select("id", "stage", F.date_format("completed_at", "yyyy-MM-dd").alias("completed_at"))


@query(
    "increment_patch",
    """WITH r AS (SELECT l_partkey AS card_id, count(*) AS n, arg_max(l_returnflag, row(l_shipdate, l_orderkey * 10 + l_linenumber, l_returnflag)) AS difficulty,
  max(l_shipdate) AS reviewed FROM lineitem GROUP BY 1)
SELECT p_partkey AS id, coalesce(r.difficulty, p_type) AS difficulty, CAST(p_size + coalesce(n, 0) AS BIGINT) AS review_count,
  strftime(reviewed, '%Y-%m-%d') AS last_reviewed_at FROM part LEFT JOIN r ON r.card_id = p_partkey""",
)
def increment_patch(spark, sf):
    """Parts as cards, line items as their reviews."""
    cards = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("difficulty"),
        F.col("p_size").cast("bigint").alias("review_count"),
        F.lit(None).cast("timestamp").alias("last_reviewed_at"),
    )
    reviews = S.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("card_id"),
        F.col("l_returnflag").alias("difficulty"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return C.apply_reviews(cards, reviews).withColumn(
        "last_reviewed_at", F.date_format("last_reviewed_at", "yyyy-MM-dd")
    )


@query(
    "summary_patch",
    "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE d.source END AS summary FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def summary_patch(spark, sf):
    notes = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("summary"))
    patches = S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality")).alias("summary")
    )
    return C.patch_column(notes, patches, "id", "summary")


@query(
    "cascade_delete",
    "SELECT l_orderkey AS note_id, l_linenumber AS line, l_quantity AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def cascade_delete(spark, sf):
    deleted = S.owned_items(spark, sf).filter(F.col("stage") == "F")
    child = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty")
    )
    return C.cascade_delete(child, deleted, "note_id")


@query(
    "quiz_schema_on_read",
    """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 5 AS k FROM orders)
SELECT id, CASE WHEN k = 0 THEN 'Question 1' ELSE p END AS question,
  CASE WHEN s = 'F' THEN 'multiple_choice' WHEN s = 'O' THEN 'true_false' ELSE 'short_answer' END AS kind,
  CASE WHEN s = 'F' THEN '1-URGENT|3-MEDIUM|5-LOW' WHEN s = 'O' THEN 'True|False' ELSE '' END AS options,
  CASE WHEN s = 'F' THEN CASE WHEN p IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN p ELSE '1-URGENT' END
       WHEN s = 'O' THEN CASE WHEN k = 1 THEN 'False' ELSE 'True' END ELSE p END AS answer FROM r""",
)
def quiz_schema_on_read(spark, sf):
    """Legacy question JSON: alias keys for the type, odd letter case, missing text."""
    from lectern.functions import drafts

    items = S.owned_items(spark, sf)
    payload = (
        F.when(
            F.col("stage") == "F",
            F.concat(
                F.lit('{"questionType":"multiple_choice","options":["1-URGENT","3-MEDIUM","5-LOW"],"answer":"'),
                F.lower("title"), F.lit('","question":"'),
            ),
        )
        .when(
            F.col("stage") == "O",
            F.concat(
                F.lit('{"options":["true","FALSE"],"answer":"'),
                F.when(F.col("id") % 5 == 1, "fAlse").otherwise("yes"), F.lit('","question":"'),
            ),
        )
        .otherwise(F.concat(F.lit('{"question_type":"short_answer","answer":" '), F.col("title"), F.lit(' ","question":"')))
    )
    payload = F.concat(payload, F.when(F.col("id") % 5 == 0, "  ").otherwise(F.col("title")), F.lit('"}'))
    raw = items.select("id", F.concat(F.lit('{"questions":['), payload, F.lit("]}")).alias("payload"))
    q = raw.select("id", F.explode(drafts.stored_questions(F.col("payload"))).alias("q"))
    return q.select(
        "id", "q.question", F.col("q.questionType").alias("kind"), joined("q.options").alias("options"), "q.answer"
    )


# ---- projections, filters, rules -----------------------------------------------------------------


@query("public_projection", f"WITH {S.USERS_SQL} SELECT id, name, email, role, is_active FROM users")
def public_projection(spark, sf):
    return S.users(spark, sf).drop("password_hash", "nation_id")


@query("equality_lookup", f"WITH {S.USERS_SQL} SELECT id, email FROM users WHERE email = 'customer#000000007@example.org'")
def equality_lookup(spark, sf):
    return listings.lookup(S.users(spark, sf), email="  CUSTOMER#000000007@example.org ").select("id", "email")


@query("optional_filters", f"WITH {S.USERS_SQL} SELECT id, name FROM users WHERE role = 'MACHINERY' AND is_active")
def optional_filters(spark, sf):
    return listings.optional_filters(S.users(spark, sf), role="MACHINERY", is_active=True, nation_id=None).select("id", "name")


@query(
    "regex_search_or",
    f"WITH {S.NOTES_SQL} SELECT id, file_name FROM notes WHERE regexp_matches(title, '(?i)NOTE 1[0-9]$') OR regexp_matches(file_name, '(?i)NOTE 1[0-9]$|SRC7_')",
)
def regex_search_or(spark, sf):
    return listings.search(S.notes(spark, sf), ["title", "file_name"], "NOTE 1[0-9]$|SRC7_", regex=True).select("id", "file_name")


@query(
    "exists_check",
    f"WITH {S.USERS_SQL} SELECT id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = users.id) AS present FROM users",
)
def exists_check(spark, sf):
    return listings.exists_flags(S.users(spark, sf), S.owned_items(spark, sf), "id", "user_id")


@query(
    "in_list_filter",
    f"WITH {S.USERS_SQL} SELECT id, email FROM users WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def in_list_filter(spark, sf):
    ids = S.owned_items(spark, sf).filter(F.col("score") > 400000).select(F.col("user_id").alias("id"))
    return listings.in_list(S.users(spark, sf), "id", ids).select("id", "email")


@query("ownership_filter", f"WITH {S.NOTES_SQL} SELECT id, title FROM notes WHERE user_id = 'src3'")
def ownership_filter(spark, sf):
    return S.notes(spark, sf).filter(F.col("user_id") == "src3").select("id", "title")


def _blank(expr):
    return f"length({Q.strip(expr)}) = 0"



@query(
    "note_rules",
    f"""WITH {S.NOTES_SQL} SELECT id, concat_ws('|',
  CASE WHEN {_blank("content")} OR length({Q.strip("content")}) > 200 THEN 'title' END,
  CASE WHEN {_blank("content")} OR length(content) > 500000 THEN 'content' END,
  CASE WHEN {_blank("content")} OR length(content) > 30000 THEN 'summary' END) AS errors FROM notes""",
)
def note_rules(spark, sf):
    """The text itself doubles as title and summary, so limits are hit."""
    notes = S.notes(spark, sf).withColumn("title", F.col("content")).withColumn("summary", F.col("content"))
    return notes.select("id", joined(rules.note_errors()).alias("errors"))


@query(
    "flashcard_rules",
    """SELECT conv_id, turn, concat_ws('|', CASE WHEN length(trim(text)) = 0 OR length(text) > 500 THEN 'front' END,
  CASE WHEN length(text) > 1000 THEN 'back' END) AS errors, turn > 0 AS reviewed FROM conversations""",
)
def flashcard_rules(spark, sf):
    cards = S.table(spark, sf, "conversations").withColumn("front", F.col("text")).withColumn("back", F.col("text"))
    return cards.select("conv_id", "turn", joined(rules.card_errors()).alias("errors"), (F.col("turn") > 0).alias("reviewed"))


@query(
    "chat_rules",
    f"""WITH {S.CHATS_SQL} SELECT note_id, turn, concat_ws('|', CASE WHEN length(trim(question)) = 0 OR length(question) > 2000 THEN 'question' END,
  CASE WHEN length(answer) > 10000 THEN 'answer' END) AS errors FROM chats""",
)
def chat_rules(spark, sf):
    return S.chat_turns(spark, sf).select("note_id", "turn", joined(rules.chat_errors()).alias("errors"))


def _orders_as_questions(spark, sf):
    kind = F.when(F.col("stage") == "F", "multiple_choice").when(F.col("stage") == "O", "true_false").otherwise("essay")
    return S.owned_items(spark, sf).select(
        "id", "user_id",
        F.struct(
            F.col("title").alias("question"),
            kind.alias("questionType"),
            F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("options"),
            F.when(F.col("stage") == "O", F.when(F.col("id") % 2 == 0, "True").otherwise("true"))
            .otherwise(F.col("title")).alias("answer"),
        ).alias("q"),
    )


@query(
    "quiz_question_rules",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'questionType'
  WHEN o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'answer'
  WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN 'answer' END AS error FROM orders""",
)
def quiz_question_rules(spark, sf):
    return _orders_as_questions(spark, sf).select("id", rules.question_error(F.col("q")).alias("error"))


@query(
    "quiz_count_gate",
    """SELECT o_custkey AS user_id, count(*) AS questions, count(*) BETWEEN 1 AND 20 AS within
FROM orders GROUP BY 1""",
)
def quiz_count_gate(spark, sf):
    """Question count per owner against the 20-question limit."""
    counts = _orders_as_questions(spark, sf).groupBy("user_id").agg(F.count("*").alias("questions"))
    return counts.withColumn("within", F.col("questions").between(1, rules.MAX_QUESTIONS))


_RESULTS = """results AS (SELECT d.doc_id AS note_id, CASE WHEN l.doc_id IS NULL THEN 'nlp' ELSE 'complete' END AS stage,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(d.n_chars % 130 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN l.toxic = 1 OR (l.doc_id IS NULL AND d.doc_id % 5 = 0) THEN 'failed: ' || d.source END AS error,
  d.lang <> 'de' AS has_core, d.lang <> 'fr' AS has_facts, d.doc_id % 6 <> 0 AS has_graph, d.doc_id % 9 <> 0 AS has_gaps,
  CASE WHEN d.lang = 'en' THEN 'm' END AS method, CASE WHEN d.doc_id % 2 = 0 THEN 'd' END AS dataset,
  d.n_chars % 5 AS n_entities, d.n_chars % 3 AS n_nodes, d.n_chars % 7 AS n_facts, d.n_chars % 2 AS n_missing_fields,
  0 AS n_missing_sections, d.n_chars % 4 AS n_unresolved, d.n_chars % 6 AS n_key_points, 0 AS n_keywords,
  CAST(d.n_chars % 100 AS DOUBLE) / 100 AS coverage
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


# Results exist for labelled documents only; the others have none.
_LABELLED = """labelled AS (SELECT l.doc_id AS note_id, CASE WHEN l.quality = 1 THEN 'complete' ELSE 'nlp' END AS stage,
  CASE WHEN l.toxic = 1 THEN 'failed' END AS error, CASE WHEN l.quality = 1 THEN CAST(0.9 AS DOUBLE) END AS confidence FROM labels l)"""


def labelled_results(spark, sf):
    """Labels as stored results: good ones are complete, toxic ones failed."""
    return S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("note_id"), F.when(F.col("quality") == 1, "complete").otherwise("nlp").alias("stage"),
        F.when(F.col("toxic") == 1, "failed").alias("error"), F.when(F.col("quality") == 1, F.lit(0.9)).alias("confidence"),
    )


def stored_results(spark, sf):
    """Document and label columns as stored analysis results with varied states."""
    d = S.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = S.table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    j = d.join(labels, "doc_id", "left")
    has = F.col("labelled").isNotNull()
    n, i = F.col("n_chars"), F.col("doc_id")
    return j.select(
        i.alias("note_id"),
        F.when(has, "complete").otherwise("nlp").alias("stage"),
        F.when(i % 4 != 0, (n % 130) / 100).alias("confidence"),
        F.when((F.col("toxic") == 1) | (~has & (i % 5 == 0)), F.concat(F.lit("failed: "), F.col("source"))).alias("error"),
        (F.col("lang") != "de").alias("has_core"),
        (F.col("lang") != "fr").alias("has_facts"),
        (i % 6 != 0).alias("has_graph"),
        (i % 9 != 0).alias("has_gaps"),
        F.when(F.col("lang") == "en", "m").alias("method"),
        F.when(i % 2 == 0, "d").alias("dataset"),
        (n % 5).alias("n_entities"), (n % 3).alias("n_nodes"), (n % 7).alias("n_facts"),
        (n % 2).alias("n_missing_fields"), F.lit(0).alias("n_missing_sections"), (n % 4).alias("n_unresolved"),
        (n % 6).alias("n_key_points"), F.lit(0).alias("n_keywords"), ((n % 100) / 100).alias("coverage"),
    )


@query(
    "knowledge_rules",
    f"""WITH {_RESULTS} SELECT note_id, concat_ws('|',
  CASE WHEN stage <> 'complete' AND confidence IS NOT NULL THEN 'early_confidence' END,
  CASE WHEN stage = 'complete' AND (confidence IS NULL OR confidence > 1 OR confidence < 0) THEN 'confidence' END,
  CASE WHEN stage = 'complete' AND NOT has_core THEN 'core' END, CASE WHEN stage = 'complete' AND NOT has_facts THEN 'facts' END,
  CASE WHEN stage = 'complete' AND NOT has_graph THEN 'graph' END, CASE WHEN stage = 'complete' AND NOT has_gaps THEN 'gaps' END) AS errors FROM results""",
)
def knowledge_rules(spark, sf):
    return stored_results(spark, sf).select("note_id", joined(rules.knowledge_errors()).alias("errors"))


@query(
    "readiness_flags",
    f"""WITH {_RESULTS}, f AS (SELECT *, stage = 'complete' AS done,
  stage = 'complete' AND method IS NOT NULL AND dataset IS NOT NULL AND n_entities > 0 AND n_nodes > 0 AND n_facts > 0 AS full_core,
  n_missing_fields + n_missing_sections + n_unresolved > 0 AS has_gaps2 FROM results)
SELECT note_id, done AS is_complete, NOT done AND error IS NOT NULL AS has_failed, full_core, has_gaps2 AS has_gaps,
  full_core AND n_facts >= 3 AS can_quiz, done AND (n_key_points > 0 OR n_keywords > 0) AS can_summarise,
  done AND (n_entities > 0 OR n_nodes > 0) AS can_chat, NOT done OR (NOT full_core AND has_gaps2 AND coverage < 0.61) AS needs_reprocessing,
  n_nodes > 0 AND n_facts > 0 AS has_reasoning FROM f""",
)
def readiness_flags(spark, sf):
    return stored_results(spark, sf).select("note_id", *[c.alias(n) for n, c in rules.readiness().items()])


def _mode(hi, lo):
    return f"CASE WHEN coalesce(confidence, 0) >= {hi} THEN 'SYMBOLIC_ONLY' WHEN coalesce(confidence, 0) >= {lo} THEN 'SYMBOLIC_WITH_OPTIONAL_AI_POLISH' ELSE 'AI_REQUIRED' END"


@query(
    "confidence_mode",
    f"WITH {_RESULTS} SELECT note_id, {_mode(0.85, 0.7)} AS result_mode, {_mode(0.81, 0.61)} AS view_mode FROM results",
)
def confidence_mode(spark, sf):
    return stored_results(spark, sf).select(
        "note_id",
        rules.confidence_mode(F.col("confidence")).alias("result_mode"),
        rules.confidence_mode(F.col("confidence"), rules.VIEW_BANDS).alias("view_mode"),
    )


@query(
    "repair_gate",
    f"WITH {_RESULTS} SELECT note_id, n_missing_fields AS missing, coverage FROM results WHERE n_missing_fields > 0 OR coverage < 0.85",
)
def repair_gate(spark, sf):
    return stored_results(spark, sf).filter(rules.needs_repair(F.col("n_missing_fields"), F.col("coverage"))).select(
        "note_id", F.col("n_missing_fields").alias("missing"), "coverage"
    )


@query(
    "view_status",
    f"""WITH {_LABELLED} SELECT d.doc_id AS note_id, CASE WHEN r.stage IS NULL THEN 'not_generated' WHEN r.stage = 'complete' THEN 'ready'
  WHEN r.error IS NOT NULL THEN 'failed' ELSE 'partial' END AS status
FROM documents d LEFT JOIN labelled r ON r.note_id = d.doc_id""",
)
def view_status(spark, sf):
    """Documents without a label have no result and read as not generated."""
    known = labelled_results(spark, sf)
    ids = S.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"))
    return ids.join(known, "note_id", "left").select(
        "note_id", rules.view_status(F.col("stage"), F.col("error")).alias("status")
    )


@query(
    "cached_summary_gate",
    f"""WITH t AS (SELECT doc_id, {Q.strip("CASE WHEN doc_id % 2 = 0 THEN '## Overview' ELSE '## Notes' END || chr(10) || text")} AS text FROM documents)
SELECT doc_id, length(text) >= 350 AND least(1.0, {_ratio_sql(_BAD, 'length(text)')}) <= 0.035
  AND {_ratio_sql(Q.count_matches('text', chr(92) + 'p{Greek}'), _VISIBLE)} <= 0.12 AND NOT regexp_matches(text, '(?i)Case Study Series{Q.WS}+Case Study Series')
  AND NOT regexp_matches(text, '(?im)^#?{Q.WS}*(?:untitled|case|study){Q.WS}*$')
  AND regexp_matches(text, '(?i)##{Q.WS}+(?:Overview|Decision Problem|Key Points|Main Concepts)') AS reliable FROM t""",
)
def cached_summary_gate(spark, sf):
    """Each text served as a stored summary, half of them under a known heading."""
    summary = F.concat(F.when(F.col("doc_id") % 2 == 0, "## Overview\n").otherwise("## Notes\n"), F.col("text"))
    return S.documents(spark, sf).select("doc_id", rules.cached_summary_ok(summary).alias("reliable"))


# ---- listings ------------------------------------------------------------------------------------


@query(
    "content_listing",
    f"""WITH {S.NOTES_SQL}, {S.USERS_SQL} SELECT n.id, n.title, n.file_name, n.file_size, coalesce(u.email, 'Unknown') AS owner_email,
  CASE WHEN l.quality = 1 THEN 'Indexed' WHEN l.doc_id IS NOT NULL THEN 'Processing' ELSE 'Unknown' END AS status
FROM notes n LEFT JOIN users u ON u.id = n.id * 3 LEFT JOIN labels l ON l.doc_id = n.id""",
)
def content_listing(spark, sf):
    """Owners are every third account, so some notes have none; labels give the stage."""
    notes = S.notes(spark, sf).drop("content").withColumn("user_id", F.col("id") * 3)
    stages = S.table(spark, sf, "labels").select(
        F.col("doc_id").alias("note_id"), F.when(F.col("quality") == 1, "complete").otherwise("nlp").alias("stage")
    )
    return listings.content_listing(notes, S.users(spark, sf), stages).select(
        "id", "title", "file_name", "file_size", "owner_email", "status"
    )


@query(
    "paginate",
    f"WITH {S.ITEMS_SQL} SELECT id, user_id, score FROM items ORDER BY score DESC, id LIMIT 50 OFFSET 100",
)
def paginate(spark, sf):
    """Third page of a listing; the asked-for limit of 80 is clamped to 50."""
    return listings.paginate(S.owned_items(spark, sf), [F.desc("score"), F.col("id")], 3, 80).select("id", "user_id", "score")


@query(
    "paginate_seek",
    f"WITH {S.ITEMS_SQL} SELECT id, user_id, score FROM items ORDER BY score DESC, id LIMIT 50 OFFSET 150",
)
def paginate_seek(spark, sf):
    """The fourth page by the keys of the third page's last row."""
    order, items = [("score", True), ("id", False)], S.owned_items(spark, sf)
    third = listings.paginate(items, [F.desc("score"), F.col("id")], 3, 50)
    return listings.seek(items, order, listings.page_token(third, order, 50), 50).select("id", "user_id", "score")


@query(
    "page_meta",
    f"WITH {S.ITEMS_SQL}, t AS (SELECT count(*) AS total FROM items) SELECT total, 3 AS page, 50 AS \"limit\", CAST(ceil(total / 50.0) AS BIGINT) AS total_pages, 3 < ceil(total / 50.0) AS has_next, true AS has_prev FROM t",
)
def page_meta(spark, sf):
    return listings.page_meta(S.owned_items(spark, sf), 3, 80)


@query(
    "latest_per_key",
    f"""WITH {S.ITEMS_SQL} SELECT user_id, id, score, stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY created_at DESC, id DESC) AS rn FROM items) WHERE rn = 1""",
)
def latest_per_key(spark, sf):
    items = S.owned_items(spark, sf).select("user_id", "id", "score", "stage", "created_at")
    return C.latest_per_key(items, ["user_id"], [F.col("created_at"), F.col("id")]).select("user_id", "id", "score", "stage")


@query(
    "last_n_ascending",
    """SELECT conv_id AS note_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations) WHERE rn <= 3""",
)
def last_n_ascending(spark, sf):
    turns = S.table(spark, sf, "conversations")
    return listings.last_n(turns, ["conv_id"], [F.col("turn")], 3).orderBy("conv_id", "turn").select(
        F.col("conv_id").alias("note_id"), "turn", "role"
    )


@query(
    "recent_feed",
    f"WITH {S.AUDIT_SQL} SELECT id, actor_id, action FROM audit ORDER BY created_at DESC, id DESC LIMIT 50",
)
def recent_feed(spark, sf):
    audit = S.audit_log(spark, sf)
    return listings.paginate(audit, [F.desc("created_at"), F.desc("id")], 1, 50, listings.MAX_AUDIT_LIMIT).select("id", "actor_id", "action")


@query(
    "recent_by_actor",
    f"WITH {S.AUDIT_SQL} SELECT id, actor_id, action FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, id DESC) AS rn FROM audit) WHERE rn <= 5",
)
def recent_by_actor(spark, sf):
    return listings.last_n(S.audit_log(spark, sf), ["actor_id"], [F.col("created_at"), F.col("id")], 5).select("id", "actor_id", "action")


@query("ordered_child_list", f"WITH {S.ITEMS_SQL} SELECT id, score FROM items WHERE user_id = 12 ORDER BY created_at DESC, id")
def ordered_child_list(spark, sf):
    return S.owned_items(spark, sf).filter(F.col("user_id") == 12).orderBy(F.desc("created_at"), "id").select("id", "score")


@query(
    "keep_first_dedupe",
    """SELECT lower(c_mktsegment) AS k, c_nationkey AS n, min(c_custkey) AS id FROM customer GROUP BY 1, 2""",
)
def keep_first_dedupe(spark, sf):
    """First account per (segment, nation) in key order."""
    from lectern.operators.dedupe import keep_first

    users = S.users(spark, sf).select(F.lower("role").alias("k"), F.col("nation_id").alias("n"), "id", "name")
    return keep_first(users, ["k", "n"], [F.col("id")]).select("k", "n", "id")


@query(
    "audit_text",
    f"""WITH {S.AUDIT_SQL} SELECT id, CASE action WHEN 'auth.register' THEN coalesce(actor_email, 'System') || ' registered an account'
  WHEN 'auth.login' THEN coalesce(actor_email, 'System') || ' logged in'
  WHEN 'flashcards.generated' THEN coalesce(actor_email, 'System') || ' generated a flashcard deck' || CASE WHEN card_count <> '0' THEN ' (' || card_count || ' cards)' ELSE '' END
  WHEN 'rate_limit.hit' THEN 'Rate limit hit on ' || route || ' from IP unknown IP'
  ELSE coalesce(actor_email, 'System') || ' changed ' || target_id || ' to another role' END AS line FROM audit""",
)
def audit_text(spark, sf):
    from lectern.operators.usage import audit_text as describe

    return S.audit_log(spark, sf).select(
        "id", describe(F.col("actor_email"), F.col("action"), F.col("metadata"), F.col("target_id")).alias("line")
    )


@query(
    "answer_scoring",
    """SELECT l_orderkey AS quiz_id, count(*) AS questions,
  count_if(lower(trim(l_linestatus)) = lower(trim(coalesce(o_orderstatus, '')))) AS hits
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def answer_scoring(spark, sf):
    """Line items as questions, the order status as the given answer."""
    from lectern.operators.study import score_answers

    questions = S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("quiz_id"), F.col("l_linenumber").alias("question_no"), F.col("l_linestatus").alias("answer")
    )
    given = questions.select("quiz_id", "question_no").distinct().join(
        S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.col("o_orderstatus").alias("given")), "quiz_id"
    )
    return score_answers(questions, given)


@query(
    "status_join",
    f"""WITH {_LABELLED}, {S.NOTES_SQL}, p AS (SELECT conv_id, count(*) % 3 AS k FROM conversations GROUP BY 1)
SELECT n.id AS note_id, r.note_id IS NOT NULL AS exists_result, r.stage,
  CASE WHEN r.note_id IS NULL THEN coalesce(p.k = 0, false) ELSE r.stage = 'complete' AND r.error IS NULL END AS is_complete,
  CASE WHEN r.note_id IS NULL THEN coalesce(p.k = 1, false) ELSE r.error IS NOT NULL END AS has_failed, r.confidence
FROM notes n LEFT JOIN labelled r ON r.note_id = n.id LEFT JOIN p ON p.conv_id = n.id""",
)
def status_join(spark, sf):
    """Stored result with live progress; progress alone where no result exists."""
    from lectern.operators.progress import status_join as combine

    notes = S.notes(spark, sf).select("id")
    results = labelled_results(spark, sf)
    turns = S.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("note_id")).agg((F.count("*") % 3).alias("k"))
    progress = turns.select("note_id", F.when(F.col("k") == 0, "complete").when(F.col("k") == 1, "failed").otherwise("running").alias("state"))
    return combine(notes, results, progress).select(
        "note_id", "exists_result", "stage", "is_complete", "has_failed", "confidence"
    )


@query(
    "reanalysis_cache",
    f"WITH {_RESULTS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT note_id FROM results WHERE stage = 'complete')",
)
def reanalysis_cache(spark, sf):
    """Documents still to analyse: those without a complete stored result."""
    done = stored_results(spark, sf).filter(F.col("stage") == "complete").select(F.col("note_id").alias("doc_id"))
    return S.table(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query(
    "deleted_during_run",
    f"WITH {_RESULTS} SELECT note_id, stage FROM results WHERE note_id IN (SELECT doc_id FROM labels)",
)
def deleted_during_run(spark, sf):
    """Results kept only for notes that still exist (the labelled ones)."""
    alive = S.table(spark, sf, "labels").select(F.col("doc_id").alias("note_id"))
    return stored_results(spark, sf).join(alive, "note_id", "left_semi").select("note_id", "stage")

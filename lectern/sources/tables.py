"""Bindings from the given parquet tables to the engine's logical tables.

Scans are lazy and unprojected here; Catalyst prunes columns and pushes filters
into parquet from whatever the query goes on to use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXTENSIONS = {"en": "pdf", "fr": "docx", "de": "txt", "es": "md"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan that has fewer splits than the cluster has cores.

    Text work is CPU-bound, so one small file must not mean one task. A large
    table has splits enough and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded notes: source is the owner, language picks the file type."""
    ext = F.col("lang")
    for lang, name in EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, F.lit(name)).otherwise(ext)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("user_id"),
        F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"),
        F.concat_ws("", F.col("source"), F.lit("__"), F.col("doc_id").cast("string"), F.lit("."), ext).alias(
            "file_name"
        ),
        ext.alias("file_type"),
        F.col("n_chars").alias("file_size"),
        F.col("text").alias("content"),
    )


# The same binding for the SQL statements.
NOTES_SQL = """notes AS (
  SELECT doc_id AS id, source AS user_id, 'note ' || doc_id AS title,
         source || '__' || doc_id || '.' || CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx'
           WHEN 'de' THEN 'txt' WHEN 'es' THEN 'md' ELSE lang END AS file_name,
         CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' WHEN 'de' THEN 'txt'
           WHEN 'es' THEN 'md' ELSE lang END AS file_type,
         n_chars AS file_size, text AS content
  FROM documents)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts: segment is the role, a positive balance is active."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.sha2(F.col("c_name"), 256).alias("password_hash"),
        F.col("c_nationkey").alias("nation_id"),
    )


USERS_SQL = """users AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.org' AS email,
         c_mktsegment AS role, c_acctbal > 0 AS is_active, c_nationkey AS nation_id FROM customer)"""


def owned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as owned records (quizzes): owner, status and creation time."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("stage"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("title"),
    )


ITEMS_SQL = """items AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS stage, o_totalprice AS score,
         o_orderdate AS created_at, o_orderpriority AS title FROM orders)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage telemetry: type is the label, `value` latency, `props.k` tokens."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 3 == 0, "provider_a").otherwise("provider_b").alias("provider"),
        F.col("event_type").alias("usage_label"),
        (F.col("event_type") != "error").alias("success"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
    )


USAGE_SQL = """usage AS (
  SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'provider_a' ELSE 'provider_b' END AS provider,
         event_type AS usage_label, event_type <> 'error' AS success,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_used, value AS latency_ms,
         ts AS created_at, user_id FROM events)"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the audit trail: the actor is the user, the properties are the metadata."""
    action = (
        F.when(F.col("event_type") == "signup", "auth.register")
        .when(F.col("event_type") == "view", "auth.login")
        .when(F.col("event_type") == "click", "flashcards.generated")
        .when(F.col("event_type") == "error", "rate_limit.hit")
        .otherwise(F.lit("admin.role_changed"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("actor_id"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org"))).alias(
            "actor_email"
        ),
        action.alias("action"),
        F.col("event_id").cast("string").alias("target_id"),
        F.concat(
            F.lit('{"cardCount":'), F.get_json_object("props", "$.k"), F.lit(',"route":"/r'),
            F.col("user_id"), F.lit('"}'),
        ).alias("metadata"),
        F.col("ts").alias("created_at"),
    )


AUDIT_SQL = """audit AS (
  SELECT event_id AS id, user_id AS actor_id,
         CASE WHEN user_id % 7 <> 0 THEN 'user' || user_id || '@example.org' END AS actor_email,
         CASE event_type WHEN 'signup' THEN 'auth.register' WHEN 'view' THEN 'auth.login'
           WHEN 'click' THEN 'flashcards.generated' WHEN 'error' THEN 'rate_limit.hit'
           ELSE 'admin.role_changed' END AS action,
         CAST(event_id AS VARCHAR) AS target_id,
         CAST(json_extract_string(props, '$.k') AS VARCHAR) AS card_count, '/r' || user_id AS route,
         ts AS created_at FROM events)"""


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the next assistant turn of the same conversation as the answer.

    A turn pairs with its successor by key equality, so no window gathers a
    whole conversation in one task.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user")
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answers, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("note_id"),
        F.col("turn"),
        F.col("text").alias("question"),
        "answer",
    )


CHATS_SQL = """chats AS (
  SELECT u.conv_id AS note_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

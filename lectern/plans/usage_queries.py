"""Usage, audit and overview reports bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators import usage
from lectern.plans.registry import query
from lectern.sources import tables as S


@query(
    "count_all",
    """SELECT 'users' AS name, count(*) AS n FROM customer UNION ALL SELECT 'notes', count(*) FROM documents
UNION ALL SELECT 'quizzes', count(*) FROM orders UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'""",
)
def count_all(spark, sf):
    items = S.owned_items(spark, sf)
    return usage.count_rows(
        users=S.users(spark, sf), notes=S.table(spark, sf, "documents"), quizzes=items,
        finished=items.filter(F.col("stage") == "F"),
    )


@query(
    "user_stats",
    f"""WITH {S.USERS_SQL} SELECT count(*) AS total, count_if(is_active) AS active, count(*) - count_if(is_active) AS inactive,
  count_if(role = 'MACHINERY') AS admins FROM users""",
)
def user_stats(spark, sf):
    return usage.user_stats(S.users(spark, sf), "MACHINERY")


@query(
    "overview_stats",
    "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM documents) AS notes, (SELECT count(*) FROM orders) AS quizzes, (SELECT count(*) FROM lineitem) AS flashcards",
)
def overview_stats(spark, sf):
    return usage.overview(
        users=S.users(spark, sf), notes=S.table(spark, sf, "documents"),
        quizzes=S.owned_items(spark, sf), flashcards=S.table(spark, sf, "lineitem"),
    )


@query(
    "ratios",
    """WITH t AS (SELECT (SELECT count(*) FROM orders) AS q, (SELECT count(*) FROM documents) AS n,
  (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS a)
SELECT round(CASE WHEN n > 0 THEN q / CAST(n AS DOUBLE) * 100 ELSE 0 END, 6) AS note_conversion,
  round(CASE WHEN a > 0 THEN n / CAST(a AS DOUBLE) ELSE 0 END, 6) AS notes_per_user FROM t""",
)
def ratios(spark, sf):
    counts = usage.overview(
        quizzes=S.owned_items(spark, sf), notes=S.table(spark, sf, "documents"),
        active=S.users(spark, sf).filter("is_active"),
    )
    return counts.select(
        F.round(usage.ratio(F.col("quizzes"), F.col("notes"), 100.0), 6).alias("note_conversion"),
        F.round(usage.ratio(F.col("notes"), F.col("active")), 6).alias("notes_per_user"),
    )


SINCE = "2024-01-15"
_PROVIDERS = "(SELECT unnest(['provider_a', 'provider_b', 'provider_c']) AS provider)"


def _providers(spark):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, [*usage.PROVIDERS, "provider_c"]))).alias("provider"))


def _provider_usage(spark, sf):
    return usage.provider_usage(S.usage_events(spark, sf), F.lit(SINCE).cast("timestamp"), _providers(spark))


_DAILY_USAGE = f"""pu AS (SELECT p.provider, count(u.id) AS requests, CAST(coalesce(sum(u.tokens_used), 0) AS BIGINT) AS tokens,
  CAST(coalesce(floor(avg(u.latency_ms) + 0.5), 0) AS BIGINT) AS average_latency, coalesce(count_if(NOT u.success), 0) AS failures
 FROM {_PROVIDERS} p LEFT JOIN usage u ON u.provider = p.provider AND u.created_at >= TIMESTAMP '{SINCE}' GROUP BY 1)"""


@query("provider_daily_usage", f"WITH {S.USAGE_SQL}, {_DAILY_USAGE} SELECT * FROM pu")
def provider_daily_usage(spark, sf):
    return _provider_usage(spark, sf)


_SERIES = """series AS (SELECT d.day, strftime(d.day, '%a') AS label, count(u.id) AS requests
 FROM (SELECT CAST(unnest(generate_series(CAST((SELECT max(created_at) FROM usage) AS DATE) - 6, CAST((SELECT max(created_at) FROM usage) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day) d
 LEFT JOIN usage u ON CAST(u.created_at AS DATE) = d.day GROUP BY 1, 2)"""


def _daily(spark, sf):
    events = S.usage_events(spark, sf)
    return usage.daily_series(events, events.agg(F.to_date(F.max("created_at")).alias("day")))


@query("daily_request_series", f"WITH {S.USAGE_SQL}, {_SERIES} SELECT CAST(day AS VARCHAR) AS day, label, requests FROM series")
def daily_request_series(spark, sf):
    return _daily(spark, sf).withColumn("day", F.col("day").cast("string"))


@query("label_counts", f"WITH {S.USAGE_SQL} SELECT usage_label, count(*) AS n FROM usage GROUP BY 1")
def label_counts(spark, sf):
    return usage.label_counts(S.usage_events(spark, sf))


@query("top_routes", f"WITH {S.AUDIT_SQL} SELECT route, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, route LIMIT 5")
def top_routes(spark, sf):
    events = S.audit_log(spark, sf).select(F.get_json_object("metadata", "$.route").alias("route"))
    return usage.label_counts(events, "route").limit(5)


@query(
    "usage_rollup",
    f"""WITH {S.USAGE_SQL}, {_DAILY_USAGE}, {_SERIES}
SELECT (SELECT CAST(sum(requests) AS BIGINT) FROM pu) AS requests, (SELECT CAST(sum(failures) AS BIGINT) FROM pu) AS failures,
  (SELECT CAST(sum(requests) AS BIGINT) FROM series) AS week_total, (SELECT greatest(1, max(requests)) FROM series) AS week_max""",
)
def usage_rollup(spark, sf):
    totals = _provider_usage(spark, sf).agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))
    week = _daily(spark, sf).agg(
        F.sum("requests").alias("week_total"), F.greatest(F.lit(1), F.max("requests")).alias("week_max")
    )
    return totals.withColumn("k", F.lit(1)).join(week.withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "attention_items",
    f"""WITH {S.USAGE_SQL}, {_DAILY_USAGE}, s AS (SELECT count_if(NOT (c_acctbal > 0)) AS inactive FROM customer), f AS (SELECT sum(failures) AS n FROM pu)
SELECT 'inactive-users' AS id, 'warning' AS tone, inactive || ' inactive account' || CASE WHEN inactive = 1 THEN '' ELSE 's' END AS title FROM s WHERE inactive > 0
UNION ALL SELECT 'ai-failures', 'danger', n || ' AI failure' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' today' FROM f WHERE n > 0""",
)
def attention_items(spark, sf):
    return usage.attention_items(usage.user_stats(S.users(spark, sf)), _provider_usage(spark, sf))


@query(
    "calendar_helpers",
    """SELECT o_orderkey AS id, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS midnight, strftime(o_orderdate, '%a') AS weekday,
  strftime(o_orderdate, '%b %-d, %Y') AS medium FROM orders""",
)
def calendar_helpers(spark, sf):
    at = F.col("created_at")
    return S.owned_items(spark, sf).select(
        "id",
        F.date_format(F.date_trunc("day", at), "yyyy-MM-dd").alias("midnight"),
        F.date_format(at, "E").alias("weekday"),
        F.date_format(at, "MMM d, yyyy").alias("medium"),
    )


@query(
    "clamp_unit",
    "SELECT o_orderkey AS id, round(greatest(0.0, least(1.0, (o_totalprice - 100000) / 250000)), 6) AS score FROM orders",
)
def clamp_unit(spark, sf):
    return S.owned_items(spark, sf).select("id", F.round(N.clamp_unit((F.col("score") - 100000) / 250000), 6).alias("score"))


@query(
    "rounded_mean",
    "SELECT o_custkey AS user_id, CAST(coalesce(floor(avg(o_totalprice) + 0.5), 0) AS BIGINT) AS mean FROM orders GROUP BY 1",
)
def rounded_mean(spark, sf):
    return S.owned_items(spark, sf).groupBy("user_id").agg(F.coalesce(usage.half_up(F.avg("score")), F.lit(0)).alias("mean"))


@query(
    "money_format",
    """SELECT o_orderkey AS id, '$' || regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS amount FROM orders""",
)
def money_format(spark, sf):
    return S.owned_items(spark, sf).select("id", N.amount_text(F.col("score"), F.lit("USD")).alias("amount"))


@query(
    "parse_number",
    "SELECT o_orderkey AS id, CAST(round(o_totalprice, 2) AS DOUBLE) AS value FROM orders",
)
def parse_number(spark, sf):
    """Formatted amounts read back."""
    text = F.format_number("score", 2)
    return S.owned_items(spark, sf).select("id", N.parse_number(text).alias("value"))


@query(
    "usage_ring",
    f"WITH {S.USAGE_SQL} SELECT id, provider, usage_label FROM usage ORDER BY created_at DESC, id DESC LIMIT 5000",
)
def usage_ring(spark, sf):
    """Newest 5,000 usage events."""
    return usage.newest(S.usage_events(spark, sf), 5000).select("id", "provider", "usage_label")

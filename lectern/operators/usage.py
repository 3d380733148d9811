"""Usage and audit reports: counts, ratios, series and attention rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PROVIDERS = ("provider_a", "provider_b")


def newest(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events: a top-n, merged from per-task heaps."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def user_stats(users: DataFrame, admin_role: str = "admin") -> DataFrame:
    return users.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_active")).alias("active"),
        F.count_if(F.col("role") == admin_role).alias("admins"),
    ).select("total", "active", (F.col("total") - F.col("active")).alias("inactive"), "admins")


def count_rows(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables as (name, n)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def overview(**tables: DataFrame) -> DataFrame:
    """The same counts as one row, one column per table."""
    counts = count_rows(**tables)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def ratio(top: Column, bottom: Column, factor: float = 1.0) -> Column:
    return F.when(bottom > 0, top / bottom * factor).otherwise(F.lit(0.0))


def provider_usage(events: DataFrame, since: Column, providers: DataFrame) -> DataFrame:
    """Per provider since midnight; providers without rows appear with zeros."""
    today = events.filter(F.col("created_at") >= since).groupBy("provider").agg(
        F.count("*").alias("requests"),
        F.sum("tokens_used").alias("tokens"),
        F.avg("latency_ms").alias("latency"),
        F.count_if(~F.col("success")).alias("failures"),
    )
    return providers.join(today, "provider", "left").select(
        "provider",
        F.coalesce("requests", F.lit(0)).alias("requests"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(half_up(F.col("latency")), F.lit(0)).alias("average_latency"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
    )


def daily_series(events: DataFrame, last_day: DataFrame, days: int = 7) -> DataFrame:
    """Requests per calendar day up to ``last_day.day`` (one row), empty days as zero."""
    calendar = last_day.select(F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))).alias("day"))
    counted = events.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("_n"))
    return calendar.join(counted, "day", "left").select(
        "day", F.date_format("day", "E").alias("label"), F.coalesce("_n", F.lit(0)).alias("requests")
    )


def label_counts(events: DataFrame, label: str = "usage_label") -> DataFrame:
    return events.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def attention_items(stats: DataFrame, usage: DataFrame) -> DataFrame:
    """Rows that need a look: inactive accounts and failures today."""
    accounts = stats.filter(F.col("inactive") > 0).select(
        F.lit("inactive-users").alias("id"),
        F.lit("warning").alias("tone"),
        F.concat(F.col("inactive"), F.lit(" inactive account"), F.when(F.col("inactive") == 1, "").otherwise("s")).alias(
            "title"
        ),
    )
    failures = usage.agg(F.sum("failures").alias("n")).filter(F.col("n") > 0).select(
        F.lit("ai-failures").alias("id"),
        F.lit("danger").alias("tone"),
        F.concat(F.col("n"), F.lit(" AI failure"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" today")).alias(
            "title"
        ),
    )
    return accounts.unionByName(failures)


def audit_text(who: Column, action: Column, metadata: Column, target_id: Column) -> Column:
    """One readable sentence per audit row."""
    name = F.coalesce(who, F.lit("System"))

    def field(key: str) -> Column:
        return F.get_json_object(metadata, f"$.{key}")

    # Sentence per action.
    plain = {
        "auth.login": "logged in",
        "auth.logout": "logged out",
        "auth.register": "registered an account",
        "note.uploaded": "uploaded a new note",
        "note.deleted": "deleted a note",
        "quiz.generated": "generated a quiz",
        "summary.generated": "generated a summary",
        "user.profile_updated": "updated their profile",
        "user.account_deleted": "deleted their account",
    }
    target = F.coalesce(field("targetEmail"), target_id, F.lit("a user"))
    cards = field("cardCount")
    sentence = F.concat(name, F.lit(" performed "), action)
    for key, words in plain.items():
        sentence = F.when(action == key, F.concat(name, F.lit(f" {words}"))).otherwise(sentence)
    return (
        F.when(
            action == "flashcards.generated",
            F.concat(
                name,
                F.lit(" generated a flashcard deck"),
                F.when(cards.isNotNull() & ~cards.isin("0", "", "false"), F.concat(F.lit(" ("), cards, F.lit(" cards)"))).otherwise(""),
            ),
        )
        .when(
            action == "rate_limit.hit",
            F.concat(
                F.lit("Rate limit hit on "), F.coalesce(field("route"), F.lit("an endpoint")),
                F.lit(" from IP "), F.coalesce(field("ip"), F.lit("unknown IP")),
            ),
        )
        .when(
            action == "admin.role_changed",
            F.concat(name, F.lit(" changed "), target, F.lit(" to "), F.coalesce(field("newRole"), F.lit("another role"))),
        )
        .when(action == "admin.user_banned", F.concat(name, F.lit(" banned "), target))
        .when(action == "admin.user_unbanned", F.concat(name, F.lit(" restored "), target))
        .when(action == "admin.user_deleted", F.concat(name, F.lit(" deleted "), target))
        .otherwise(sentence)
    )

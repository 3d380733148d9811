"""Streams over the given events and documents, run to their current end, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import nlp, study
from lectern.plans.registry import query
from lectern.sources import tables as S
from lectern.streaming import flow, progress as P, rate_limit as R

LIMIT, SECONDS = 2, 86_400


def requests(df):
    return df.select(F.col("user_id").alias("key"), F.col("ts"), F.col("event_id").alias("id"))


# The statement walks each key's requests in order with the log as a list.
_WALK = f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT key, id, us, n, [us] AS log, true AS allowed, CAST(0 AS BIGINT) AS retry_us FROM r WHERE n = 1
 UNION ALL SELECT x.key, x.id, x.us, x.n, CASE WHEN len(x.kept) < {LIMIT} THEN list_append(x.kept, x.us) ELSE x.kept END, len(x.kept) < {LIMIT},
   CASE WHEN len(x.kept) < {LIMIT} THEN 0 ELSE greatest(1, x.kept[1] + {SECONDS * 1000000} - x.us) END
 FROM (SELECT r.*, list_filter(w.log, lambda t: t > r.us - {SECONDS * 1000000}) AS kept FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1) x)"""


@query("sliding_rate_limit", f"{_WALK} SELECT key, id, us, allowed, retry_us FROM w")
def sliding_rate_limit(spark, sf):
    """Two requests a day per user."""
    return R.batch_limits(requests(S.table(spark, sf, "events")), LIMIT, SECONDS)


@query("sliding_rate_limit_stream", f"{_WALK} SELECT key, id, us, allowed, retry_us FROM w")
def sliding_rate_limit_stream(spark, sf):
    return R.drain_limits(requests(flow.file_stream(spark, sf, "events")), LIMIT, SECONDS)[0]


@query("rate_limit_events", f"{_WALK} SELECT id AS event_id, 'rate_limit.hit' AS action, key AS actor_id, retry_us FROM w WHERE NOT allowed")
def rate_limit_events(spark, sf):
    return R.limit_events(sliding_rate_limit(spark, sf))


@query("window_state_cleanup", f"{_WALK}, l AS (SELECT key, max(us) AS now FROM w GROUP BY 1) SELECT key, us FROM w JOIN l USING (key) WHERE allowed AND us > now - {SECONDS * 1000000}")
def window_state_cleanup(spark, sf):
    return R.log_cleanup(sliding_rate_limit(spark, sf), seconds=SECONDS)


def stage_events(df):
    """Events as stage events of the user's document."""
    stage = F.element_at(F.array(*map(F.lit, P.STAGES)), (F.col("event_id") % len(P.STAGES) + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("complete")
    return df.select(
        F.col("user_id").alias("note_id"), F.col("event_id").alias("seq"), stage.alias("stage"), status.alias("status"),
        (F.col("event_id") % len(P.STAGES) * 7).alias("progress"), F.col("event_type").alias("message"), F.col("ts").cast("timestamp").alias("ts"),
    )


_STAGE = "list_extract([" + ", ".join(f"'{s}'" for s in P.STAGES) + f"], CAST(event_id % {len(P.STAGES)} + 1 AS BIGINT))"
_EV = f"""ev AS (SELECT user_id AS note_id, event_id AS seq, {_STAGE} AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'complete' END AS status,
 event_id % {len(P.STAGES)} * 7 AS progress, event_type AS message, ts FROM events)"""
_SNAP = f"""{_EV}, l AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY ts DESC, seq DESC) AS rn FROM ev),
snap AS (SELECT note_id, CASE WHEN status = 'failed' THEN 'failed' WHEN stage = 'complete' AND status = 'complete' THEN 'complete' ELSE 'running' END AS state, stage AS current_stage,
 CASE WHEN status = 'running' THEN greatest(0, progress - 3) ELSE progress END AS progress, CASE WHEN status = 'failed' THEN message END AS error, ts FROM l WHERE rn = 1)"""


@query("progress_fold", f"WITH {_SNAP} SELECT note_id, state, current_stage, progress, error FROM snap")
def progress_fold(spark, sf):
    return P.snapshots(stage_events(S.table(spark, sf, "events"))).select("note_id", "state", "current_stage", "progress", "error")


@query("progress_fold_stream", f"WITH {_SNAP} SELECT note_id, state, current_stage, progress, error FROM snap")
def progress_fold_stream(spark, sf):
    out, mark = flow.work_path(spark, "progress"), flow.work_path(spark, "progress-mark")
    P.fold_stream(stage_events(flow.file_stream(spark, sf, "events")), out, mark).start().awaitTermination()
    return P.snapshots(P.folded(spark, out)).select("note_id", "state", "current_stage", "progress", "error")


@query("progress_ttl", f"WITH {_SNAP} SELECT note_id, state FROM snap WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def progress_ttl(spark, sf):
    """Snapshots alive at the last event's time."""
    events = stage_events(S.table(spark, sf, "events"))
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    return P.live(P.snapshots(events), F.lit(now)).select("note_id", "state")


@query("stage_events", f"WITH {_EV}, k AS (SELECT note_id, stage, arg_max(status, row(ts, seq)) AS status FROM ev GROUP BY 1, 2) SELECT stage, status, count(*) AS documents FROM k GROUP BY 1, 2")
def stage_events_query(spark, sf):
    return P.stage_funnel(stage_events(S.table(spark, sf, "events"))).select("stage", "status", "documents")


@query("usage_stream_agg", f"WITH {S.USAGE_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, provider, count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, count_if(NOT success) AS failures FROM usage GROUP BY 1, 2")
def usage_stream_agg(spark, sf):
    stream = flow.file_stream(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 == 0, "provider_a").otherwise("provider_b").alias("provider"), (F.col("event_type") != "error").alias("success"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"), F.col("ts").alias("created_at"),
    )
    return flow.current_windows(stream).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "provider", "requests", "tokens", "failures")


@query("idempotent_upload_flow")
def idempotent_upload_flow(spark, sf):
    """Sentences, key words, cards and the first number of every streamed document; texts without a number fail that feature alone."""
    features = {
        "sentences": lambda b: b.select("doc_id", F.size(T.sentences(F.col("text"))).alias("items")),
        "keywords": lambda b: b.select("doc_id", F.size(nlp.study_keywords(F.col("text"))).alias("items")),
        "cards": lambda b: b.select("doc_id", F.size(study.cards_from_text(F.col("text"), 8)).alias("items")),
        "number": lambda b: b.select("doc_id", F.regexp_substr("text", F.lit("[0-9]{1,9}")).try_cast("int").alias("items")),
    }
    return flow.upload_flow(flow.file_stream(spark, sf, "documents"), features)

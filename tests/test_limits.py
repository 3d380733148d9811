"""Sliding limits: pieces of timelines, and streams in any order, against the rule in plain Python."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import rate_limit as R


def stated(rows, limit, seconds):
    logs, out = {}, []
    for k, i, s in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        kept = [t for t in logs.get(k, []) if t > s - seconds]
        ok = len(kept) < limit
        out.append((k, i, ok, 0 if ok else max(1, (kept[0] + seconds - s) * 1_000_000)))
        logs[k] = kept + [s] if ok else kept
    return sorted(out)


def requests(spark, rows):
    return spark.createDataFrame(rows, "key bigint, id bigint, sec bigint").select("key", "id", F.timestamp_seconds("sec").alias("ts"))


def answers(df):
    return sorted((r["key"], r["id"], r["allowed"], r["retry_us"]) for r in df.collect())


def timeline(kind, n=400):
    rng, now, out = random.Random(kind), 0, []
    for i in range(n):
        key = rng.choice([1, 1, 1, 2, 3])
        now += {"busy": rng.randint(0, 9), "gaps": rng.choice([0, 1, 5, 300]), "calm": rng.randint(30, 120), "mixed": rng.choice([0, 0, 2, 40, 90]), "ties": rng.choice([0, 0, 0, 50])}[kind]
        out.append((key, i, now))
    rng.shuffle(out)
    return [*out, (None, 900, 5), (4, 901, None), (5, 902, 7)]


@pytest.mark.parametrize("kind", ["busy", "gaps", "calm", "mixed", "ties"])
@pytest.mark.parametrize("segment_rows", [3, 20, 10**6])
def test_pieces_give_the_whole(spark, kind, segment_rows):
    rows = timeline(kind)
    got = answers(R.batch_limits(requests(spark, rows), 3, 100, segment_rows))
    assert got == stated(rows, 3, 100)


def test_timelines_are_cut_where_the_log_is_known(spark):
    rows = timeline("mixed")
    slots = requests(spark, rows).filter("key is not null and ts is not null").select("key", F.floor(F.unix_micros("ts") / 100_000_000).alias("slot"))
    found = R.segments(slots, 3, 10)
    assert found.select("key", "run", "seg").distinct().count() > found.select("key", "run").distinct().count() > 3
    assert R.batch_limits(requests(spark, rows[:0]), 3, 100).count() == 0


def write_files(spark, files, folder):
    """One file per list of rows, each older than the next."""
    for k, part in enumerate(files):
        requests(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if f.stat().st_mtime > 10**9 + 1000:
                os.utime(f, (10**9 + k, 10**9 + k))
    return spark.readStream.schema("key bigint, id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_stream_of_shuffled_files(spark, tmp_path):
    rows = [r for r in timeline("mixed", 120) if r[0] is not None and r[2] is not None]
    files = [rows[k::5] for k in range(5)]
    stream = write_files(spark, files, tmp_path / "in")
    got, late = R.drain_limits(stream, 3, 100, "30 days")
    assert late == 0 and answers(got) == stated(rows, 3, 100) == answers(R.batch_limits(requests(spark, rows), 3, 100))


def test_late_requests_are_counted_and_listed(spark, tmp_path):
    early = [(1, 0, 1000), (1, 1, 1010), (2, 2, 1020)]
    later = [(1, 3, 90_000), (1, 4, 90_001)]
    behind = [(1, 5, 1015), (2, 6, 89_999)]
    stream = write_files(spark, [early, later, behind], tmp_path / "in")
    got, late = R.drain_limits(stream, 2, 100, "60 seconds")
    assert late == 1 and answers(got) == stated([*early, *later, behind[1]], 2, 100)
    table = requests(spark, [*early, *later, *behind])
    assert [r["id"] for r in R.late_requests(table, got).collect()] == [5]
    assert isinstance(table.first()["ts"], datetime.datetime)

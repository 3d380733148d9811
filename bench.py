"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from lectern.plans import catalog
from lectern.session import local_session

HEADLINE = [
    "keyword_counts", "split_sentences", "phrase_counts", "sentence_similarity_join", "running_header_detect",
    "clean_text_reliably", "section_ranges", "latest_per_key", "paginate", "daily_request_series", "provider_daily_usage",
    "key_facts", "outperforms", "connected_components", "questions_from_text", "sliding_rate_limit_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries, times, cold = catalog.queries(), {}, {}
    spark.range(10**6).selectExpr("sum(id)").collect()
    for name in names:
        spent = []
        for _ in range(runs):
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - begin)
        cold[name] = round(spent[0], 3)
        times[name] = round(min(spent) if runs < 3 else statistics.median(spent), 3)
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()

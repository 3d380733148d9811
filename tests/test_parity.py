"""Registered queries against their SQL statements on the smallest tables."""

import duckdb
import pytest

from lectern.plans import catalog
from tools.check_oracle import TABLES, normal

SF = "/root/testdata/sf0.001"
# One query per family keeps the suite short; tools/check_oracle.py runs them all.
NAMES = [
    "collection_scan", "ingest_validate", "keyed_upsert", "cascade_delete", "quiz_schema_on_read", "content_listing",
    "paginate", "latest_per_key", "daily_request_series", "audit_text", "split_sentences", "keyword_counts",
    "phrase_counts", "lexicon_match", "sentence_similarity_join", "running_header_detect", "first_header_preserve",
    "text_quality_score", "section_ranges", "classify_profile", "claims_method", "claims_problem", "fuzzy_join",
    "bfs", "connected_components", "belongs_to", "outperforms", "coverage_report", "questions_from_text",
    "grounding_pairs", "derived_calculations", "sliding_rate_limit", "sliding_rate_limit_stream", "progress_fold_stream",
]


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    base.sql("SET TimeZone='UTC'")
    for table in TABLES:
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return base


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(catalog.oracles()[name])
    heads = list(result.columns)
    assert columns == sorted(heads)
    order = [heads.index(c) for c in columns]
    assert mine == sorted(tuple(normal(r[i]) for i in order) for r in result.fetchall())


def test_every_statement_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partition_count_does_not_matter(spark, partitions):
    def rows(name):
        return sorted(map(str, catalog.queries()[name](spark, SF).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["first_header_preserve", "page_offsets", "connected_components", "outperforms"]
    expected = {n: rows(n) for n in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert {n: rows(n) for n in names} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

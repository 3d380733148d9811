"""Decontamination, secrets, pseudonyms, fingerprints and quality."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination, fingerprints, pseudonyms, quality, secrets
from lectern.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
KEY = b"test key"


@pytest.mark.parametrize("window,block", [(3, 20), (10, 10**6)])
def test_contamination(spark, table, chunk_bytes, window, block):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randrange(0, 14))) for i in range(12)] + [(50, None)]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(50)] + [(98, None), (99, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(table(rows), bench, window, block_words=block).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found)
    assert got == sorted(brute.contamination(rows, items, window))
    assert all(r["items_sha256"] == hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest() for r in found)


def test_cleaning_removes_passages_and_keeps_the_rest(spark, table):
    passage = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, f"{'before ' * 20}{passage} after"), (2, passage), (3, "clean é"), (4, None)]
    left = {r["doc_id"]: r["text"] for r in decontamination.clean(table(rows), bench).collect()}
    assert left == {1: f"{'before ' * 20} after", 3: "clean é", 4: None}
    assert decontamination.clean(table(rows), bench.limit(0)).count() == 4


def test_secrets(spark, table):
    hexes, long = "0123456789abcdef" * 2, "Qz9/" * 11
    rows = [
        (1, f"é Password: 'longenough' x token=short AKIA{'A' * 12} {hexes}"), (2, None), (3, "token=token=12345678"),
        (4, f"opaque {long} alone"), (5, f"client_id = abcd1234 and {long}"), (6, f"AKIA{'B' * 12}{' x' * 200}{long}"),
        (7, f"secret: abcdefgh1 see https://host.example/path"), (8, "see https://host.example/path"), (8, ""),
    ]
    got = sorted((r["doc_id"], r["spans"], r["base_sha256"]) for r in secrets.digest(secrets.find_secrets(table(rows))).collect())
    strong = {(i, hashlib.sha256(",".join(brute.spans(t)).encode()).hexdigest()) for i, t in rows}
    assert {(i, d) for i, _, d in got} == strong and len(got) == len(rows)
    found = {i: s for i, s, _ in got if s}
    assert 4 not in found and 8 not in found and "opaque" not in found[6]
    assert "name:0:20" in found[5] and "opaque" in found[5] and "endpoint" in found[7]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    other = base.sql(ORACLES[name])
    order = [list(other.columns).index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in other.fetchall()), key=repr)


def test_pseudonyms_keep_formats_links_and_invert(table):
    rows = [
        (1, "card 4111 1111 1111 1111, again 4111-1111-1111-1111; bad 4111 1111 1111 1112"), (2, "on 2024-02-29 and 29.02.2024, not 2023-02-29"),
        (3, "ip 10.200.3.44 tel +1 (415) 555-2671 ssn 123-45-6789 mail Jo.Doe7@mail.example.com DE89 3704 0044 0532 0130 00"), (4, None), (5, ""),
    ]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise_documents(table(rows), KEY).collect()}
    for i, text in rows:
        new = out[i]["text"]
        if text:
            assert len(new) == len(text) and new != text and pseudonyms.pseudonymise(new, KEY, inverse=True)[0] == text
    assert out[4]["text"] is None and out[5]["text"] == ""
    a, b = (t.replace(" ", "").replace("-", "") for t in (out[1]["text"][5:24], out[1]["text"][32:51]))
    assert a == b and pseudonyms.luhn_digit([int(c) for c in a[:-1]]) == int(a[-1]) and "bad 4111 1111 1111 1112" in out[1]["text"]
    assert out[3]["n_found"] == 5 and "not 2023-02-29" in out[2]["text"]


@pytest.mark.parametrize("n", [2, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    net = pseudonyms.Feistel(KEY, "t", n)
    moved = [net.apply(v) for v in range(n)]
    assert sorted(moved) == list(range(n)) and [net.apply(v, inverse=True) for v in moved] == list(range(n))


def test_fingerprints(table):
    rng = random.Random(3)
    words = [f"term{k}" for k in range(5000)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(120))) for i in range(40)] + [(500, None), (501, ""), (502, "x"), (503, "x"), (503, "x")]
    out = fingerprints.match_documents(table(rows)).collect()
    assert len(out) == len(rows)
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    wanted = sorted((i, hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for (i, _), t, n in zip(rows, texts, after, strict=True))
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in out) == wanted
    long = [r for r in out if r["doc_id"] < 117]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.25 > 10 * sum(r["near_next"] for r in long) / len(long)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (502, 503)}) == 1


def test_quality(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op6_rule_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    right = rows.where(F.col("predicted") == F.col("quality")).count()
    assert right >= 0.95 * rows.count()
    model = quality.learn(odd, labels.limit(0))
    scored = quality.score_documents(odd, model)
    assert scored.count() == odd.count() and scored.where("score between 0 and 1").count() == odd.count()
    assert quality.score_documents(odd.limit(0), model).count() == 0

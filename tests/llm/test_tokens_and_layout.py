"""Token shards, packing and sharding: exact round trips and laws."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import packing, repair, sharding, tokens, words
from lectern.llm.queries import tokenizer_path

TEXTS = ["", " ", "a  b", "a \n b", "é ñ don't 's", "a  b", "<|endoftext|> x", "x  \n\n  y ", "日本 語 text", "　 a", "a\x85 b", "́ z", "a\x1c b\x01 c", "İ X 12  3", "word " * 500]
FILES = [("byte_bpe_50k.json", "blanks"), ("word_bpe_49k.json", "spaces")]


def plain(name, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,rule", FILES)
def test_encoder(name, rule, monkeypatch):
    encoder = tokens.Encoder(tokenizer_path(name), rule)
    monkeypatch.setattr(tokens, "POOL_PIECES", 5)
    for size in (10, 10**6):
        for first, n, data, offsets in words.chunks(pa.array(TEXTS), size):
            ids, before = encoder.encode(data, offsets)
            for k in range(n):
                assert ids[before[k] : before[k + 1]].tolist() == plain(name, TEXTS[first + k])


def test_shards(table, odd):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(7, None)]
    shards = repair.write_shards(table(rows), tokenizer_path("word_bpe_49k.json"), shard_tokens=300)
    out = sorted(repair.with_starts(repair.read_documents(shards, with_ids=True), shards).collect(), key=lambda r: r["doc_id"])
    start = 0
    for (i, text), row in zip(sorted(rows), out, strict=True):
        ids = [*plain("word_bpe_49k.json", text), 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (i, start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    for shard in shards.collect():
        for k in range(len(shard["doc_ids"])):
            whole = repair.read_range(shard.asDict(), k, 0, 10**9)
            assert repair.read_range(shard.asDict(), k, 3, 11).tolist() == whole[3:11].tolist()
    empty = repair.write_shards(odd.limit(0), tokenizer_path("word_bpe_49k.json"))
    assert repair.with_starts(repair.read_documents(empty), empty).count() == 0


def test_packing(table, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t * (1 + i % 4)) for i, t in enumerate(TEXTS * 3)] + [(900, None)]
    out = packing.pack_documents(table(rows), path, size=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in rows:
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for p in pieces for x in p["ids"]] == [*plain("byte_bpe_50k.json", text), 2]
        assert all(p["length"] == 64 for p in pieces[1:])
    for pieces in by_sequence.values():
        ends = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == ends
            ends += p["length"]
        assert ends <= 64
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= 1.05 * -(-total // 64) + 1
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert bins.put(8) == (2, 0) and bins.put(9) == (3, 0)  # bin 3 has 1 left and closes
    assert bins.put(1) == (2, 8) and bins.put(4) == (0, 6)


def test_sharding(odd):
    rows = odd.withColumnRenamed("lang", "shard")
    out = sharding.write_shards(rows, shards=4, bucket_bytes=200)
    places = {}
    for r in out.collect():
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1
    key = lambda r: str((r["doc_id"], r["text"]))
    assert sorted(map(key, out.collect())) == sorted(map(key, rows.collect()))
    assert sharding.write_shards(rows.limit(0)).count() == 0


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "benchmark_decontamination", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}

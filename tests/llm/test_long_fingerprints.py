"""Fingerprints of texts with very many terms, and of texts without any term of the lexicon."""

import random

from lectern.llm import fingerprints


def test_long_texts_differ(table):
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(20_000))) for i in range(2)] + [(9 + i, f"short {i}") for i in range(8)]
    out = {r["doc_id"]: r for r in fingerprints.match_documents(table(rows)).collect()}
    assert all(out[i]["fingerprint"].strip("-.") for i in (0, 1))
    assert out[0]["near_next"] == 0 and 0.3 < out[0]["near_edited"] < 1 and out[0]["fingerprint"] != out[1]["fingerprint"]


def test_texts_outside_the_lexicon(table):
    rng = random.Random(1)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(rng.sample(common, 50))) for i in range(10)] + [(20, " "), (21, None), (22, "\n")]
    out = {r["doc_id"]: r for r in fingerprints.match_documents(table(rows)).collect()}
    assert all(out[i]["fingerprint"].strip("-.") and out[i]["near_next"] == 0 for i in range(10))
    assert all(not out[i]["fingerprint"].strip("-.") for i in (20, 21, 22)) and out[20]["near_next"] == out[21]["near_next"] == 1

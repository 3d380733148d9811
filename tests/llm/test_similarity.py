"""Line dedup and the trie join against all pairs."""

import random

import numpy as np
import pytest

from lectern.llm import linededup, ngramjoin, setjoin
from tests.llm import brute


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["É", "ñu"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 40, 90]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_components(table, chunk_bytes, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, ngramjoin.near_duplicates(table(rows)).collect())) == brute.components(rows)


def test_components_with_split_runs_and_chunks(table, monkeypatch):
    rows = corpus(5, 80)
    monkeypatch.setattr(setjoin, "RUN_ROWS", 1)
    monkeypatch.setattr(setjoin, "CHUNK_UNITS", 3)
    assert sorted(map(tuple, ngramjoin.near_duplicates(table(rows)).collect())) == brute.components(rows)


@pytest.mark.parametrize("seed", range(2))
def test_lines(table, chunk_bytes, seed):
    rng = random.Random(seed)
    lines = [t for _, t in corpus(seed + 10)] + ["", "  ", "the end"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(30)]
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(rows)).collect()} == brute.without_lines(rows)


def test_large_groups_of_lines_and_bitmaps():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = sorted({tuple(np.sort(np.concatenate([rng.choice(base, rng.integers(80, 119), replace=False), rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]))) for _ in range(70)})
    sets = [np.array(s, np.uint64) for s in sets]
    rank = rng.permutation(len(sets))
    pairs = [(x, y) for x in range(len(sets)) for y in range(len(sets)) if x != y and brute.similar(set(sets[x].tolist()), set(sets[y].tolist()))]
    wanted = sorted({x for x, y in pairs if rank[y] < rank[x]})
    assert linededup.matched_lines(sets, rank).tolist() == wanted == linededup._any_earlier(sets, rank, 80)
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    ordered = setjoin.Ordered(np.concatenate(sets), firsts, np.zeros(len(sets), np.uint64))
    bits = setjoin.unpack(setjoin.pack_bitmaps(ordered, np.ones(len(sets), bool)))
    good = setjoin.may_be_similar(np.diff(firsts), bits)
    assert {x for x, _ in pairs} <= set(np.flatnonzero(good).tolist())


def test_odd_rows(odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(odd).collect()}
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (5, 1, 4) in got and (8, 2, 8) in got and (None, 2, 8) in got
    cleaned = linededup.dedup_lines(odd)
    assert cleaned.count() == odd.count() and cleaned.where("doc_id = 8").first()["text"] == ""
    assert ngramjoin.near_duplicates(odd.limit(0)).count() == 0 and linededup.dedup_lines(odd.limit(0)).count() == 0

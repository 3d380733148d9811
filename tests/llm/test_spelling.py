"""Spelling variants against a plain statement."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import spelling, words
from tests.llm.brute import low
from tests.llm.conftest import ODD


def counted(rows, min_length=5, min_count=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += len(word) >= min_length
    return {w: n for w, n in count.items() if n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        if vs and count[best := min(vs, key=lambda v: (-count[v], v))] >= 2 * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_rows(seed, n=60, letters="abÀÿ", size=(4, 7)):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(120)]
    return [(k, rng.choice([" ", "-", " ", "1", "\U0001f600", "¿"]).join(rng.choices(pool, weights=range(1, 121), k=80))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_statement(table, seed):
    rows = random_rows(seed)
    got = found(spelling.spelling_variants(table(rows)))
    assert got == variants(counted(rows)) and any(r[1] for r in got)


def test_words_are_counted_whole(table, chunk_bytes, monkeypatch):
    monkeypatch.setattr(spelling, "COUNT_BYTES", 64)
    rows = [*ODD, (None, None), *random_rows(3, 40, "aBéÖz"), *((k, "Straße×÷ÞÐ ÀÁÂÃÄÅ" * 3) for k in range(5)), (8, f"{'long' * 500} " * 4), (9, "touching"), (9, "touching"), (9, "touching")]
    want = counted(rows)
    assert dict(tuple(r) for r in spelling.count_words(table(rows)).collect()) == want and "long" * 500 in want


def test_chains_ties_and_long_words(spark):
    count = {"aaaaa": 1000, "aaaab": 400, "aaabb": 100, "aabbb": 30, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6, "solitary": 5, "x" * 3000: 9, "x" * 2999: 3}
    got = found(spelling.group_variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == variants(count)
    by_word = {r[0]: r for r in got}
    assert by_word["aabbb"][2] == "aaaaa" and by_word["zzzzz"][1] == "zzzzx" and by_word["solitary"][1:5] == (None, "solitary", 5, 0)


def test_empty(table, spark):
    assert spelling.spelling_variants(table(ODD).limit(0)).count() == 0
    assert spelling.spelling_variants(table([(1, None), (2, ""), (3, "12 34")])).count() == 0


@pytest.mark.parametrize("symbols", [2, 8])
def test_neighbourhoods_are_complete_and_without_repeats(symbols):
    alphabet, rng = spelling.Alphabet(symbols), random.Random(symbols)
    for _ in range(30):
        word = [rng.randrange(symbols) for _ in range(rng.randrange(0, 7))]
        edits = {tuple(word)} | {(*word[:k], *word[k + 1 :]) for k in range(len(word))}
        edits |= {(*word[:k], s, *word[k + 1 :]) for k in range(len(word)) for s in range(symbols)}
        edits |= {(*word[:k], s, *word[k:]) for k in range(len(word) + 1) for s in range(symbols)}
        made = [c for _, codes in alphabet.neighbours(np.array(word, np.int64), np.array([0, len(word)])) for c in codes.tolist()]
        flat = np.array([s for e in edits for s in e], np.int64)
        codes = alphabet.codes(flat, np.cumsum([0, *map(len, edits)]))
        assert len(made) == len(set(made)) and set(made) == set(codes.tolist())


def test_checksums_continue():
    texts = ["a", "", "abc", "é" * 40, "x" * 64, "y" * 63, "z" * 500]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    state = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(texts))], np.uint32)
    got = spelling.checksums(data, np.concatenate(([0], ends[:-1])), ends, state)
    assert got.tolist() == [zlib.crc32(f"{k}:{t}".encode()) for k, t in enumerate(texts)]


def test_runs_end_with_their_text():
    texts = ["ab", "cd é", "Éf", "", "1", "g"]
    for first, n, data, offsets in words.chunks(pa.array(texts)):
        starts, ends, owner = spelling.find_runs(data, offsets)
        assert [(bytes(data[a:b]).decode(), o) for a, b, o in zip(starts, ends, owner, strict=True)] == [("ab", 0), ("cd", 1), ("é", 1), ("Éf", 2), ("g", 5)]


def test_neighbours_are_merged_not_sent_to_the_driver(spark):
    words_of = spark.createDataFrame([("house", 9), ("hause", 3), ("houses", 4)], "word string, n long")
    plan = spelling.near_words(words_of)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, spelling.near_words(words_of).collect())) == [("hause", "house", 9), ("house", "hause", 3), ("house", "houses", 4), ("houses", "house", 9)]

"""Places and likeness of fingerprints from plain sets of terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints as P


def words_of(text):
    return set(filter(None, re.split(r"[\x20\x09-\x0D]+", text.lower())))


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 25)])
def test_places_by_plain_sets(spark, table, seed, n):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 40, 120, 300])))) for k in range(n)] + [(n, None), (n + 1, " \t")]
    least, most = 0.05, 0.5
    docs = table(rows)
    found = {r["doc_id"]: r for r in P.match_documents(docs, least, most).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    edited = {}
    for k, i in enumerate(ids):
        text, quarter = texts[i], len(texts[i]) // 4
        edited[i] = text[: len(text) - quarter] + texts[ids[(k + 1) % len(ids)]][:quarter]
    every = sorted(set().union(*(words_of(t) for t in [*texts.values(), *edited.values()])))
    share = {w: sum(w in words_of(t) for t in texts.values()) / len(texts) for w in every}
    lexicon = {w for w in every if least <= share[w] <= most}
    levels = P.subsets(len(lexicon))
    # Which part of each level a term belongs to is the only thing asked of Spark.
    term = F.hash(F.xxhash64("w"))
    parts = {r["w"]: r for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", *[P._part(p, term).alias(f"p{p}") for p, _ in levels]).collect()}

    def places(text):
        own = words_of(text)
        kept = own if len(own) <= P.SHORT_TERMS else own & lexicon
        out = []
        for p, used in levels:
            for part in range(used):
                inside = frozenset(w for w in kept if p == 1 or parts[w][f"p{p}"] == part)
                out.append(inside if 1 <= len(inside) <= P.PLACE_TERMS else None)
        if not any(out):
            out[0] = ("lexicon", frozenset(kept)) if kept else ("all", frozenset(own)) if own else None
        return kept, out

    def alike(a, b):
        filled = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
        return 1.0 if not filled else sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / filled

    hashes = {}
    for k, i in enumerate(ids):
        row, (kept, own), (other_kept, other), (_, after) = found[i], places(texts[i]), places(edited[i]), places(texts[ids[(k + 1) % len(ids)]])
        assert [p == "-" for p in row["fingerprint"].split(".")] == [x is None for x in own]
        assert [p == "-" for p in row["edited_fingerprint"].split(".")] == [x is None for x in other]
        assert row["near_edited"] == pytest.approx(alike(own, other)) and row["near_next"] == pytest.approx(alike(own, after))
        for shown, sets in ((row["fingerprint"], own), (row["edited_fingerprint"], other)):
            for place, (text, inside) in enumerate(zip(shown.split("."), sets, strict=True)):
                if inside is not None:  # one hash for each set at a place, whichever text has it
                    assert hashes.setdefault((place, inside), text) == text
        for shown, terms in ((row["lexicon_hash"], kept), (row["edited_lexicon_hash"], other_kept)):
            assert (shown is None) == (not terms) and (not terms or hashes.setdefault(("lexicon", frozenset(terms)), shown) == shown)


def test_one_lexicon_serves_other_tables(spark, table):
    rows = [(k, " ".join(f"t{(k * j) % 90}" for j in range(1, 60))) for k in range(1, 50)]
    known = P.lexicon(table(rows).select("doc_id", "text"), 0.02, 0.9)
    both = [{r["doc_id"]: r["places"] for r in P.fingerprints(table(some), known=known).collect()} for some in (rows, rows[::2])]
    assert all(both[1][i] == both[0][i] for i in both[1]) and len(both[1]) == 25

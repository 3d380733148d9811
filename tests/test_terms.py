"""Terms by one automaton against one pattern per term, key phrases against a plain count."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import nlp, terms

TERMS = ["a", "ab", "a b", "b-c", "c.", "(d)", "é", "Ab C", "1", "b1", "a b", "", "ß x", "İ"]


def by_pattern(text):
    low = text.lower()
    return [k for k, t in enumerate(TERMS) if t and re.search(f"(?:^|[^a-z0-9]){re.escape(t.lower())}(?:$|[^a-z0-9])", low)]


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["", "A", *("".join(rng.choice(["a", "b", "c", "B", "1", "é", " ", " ", "-", ".", "(d)", "ß", "x", "İ", "d"]) for _ in range(rng.randint(1, 25))) for _ in range(n))]


@pytest.mark.parametrize("seed", [1, 2])
def test_matcher(seed):
    own = terms.Matcher(tuple(TERMS))
    for text in texts(seed):
        assert own.find(text.lower()) == by_pattern(text), text
    assert terms.Matcher(()).find("anything") == []


def test_both_ways_of_matching_a_lexicon(spark):
    rows = [(k, t) for k, t in enumerate(texts(3, 80))] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, sentence string")
    words = ["alpha", "a b", "b", "ab", "b-c", "x1", "a"]
    lexicon = spark.createDataFrame([(n % 2, w) for n, w in enumerate(words)] + [(1, "b"), (1, None)], "type int, term string")
    one = nlp.lexicon_match(df, lexicon, ["doc_id"])
    other = nlp.join_lexicon(df, lexicon, ["doc_id"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.schema["type"].dataType == other.schema["type"].dataType
    assert terms.bounded(lexicon.limit(0)) == []


def test_a_large_lexicon_is_joined(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_TERMS", 2)
    lexicon = spark.createDataFrame([("k", w) for w in ("one", "two", "three")], "type string, term string")
    assert terms.bounded(lexicon) is None
    found = nlp.lexicon_match(spark.createDataFrame([(1, "two and three")], "doc_id long, sentence string"), lexicon, ["doc_id"])
    assert {r["term"] for r in found.collect()} == {"two", "three"} and "MapInArrow" not in found._jdf.queryExecution().toString()


def test_entities_and_phrases(spark):
    sents = ["We train a Neural Network on MNIST and neural network layers.", "A Deep Belief Net (DBN) is used in 95.5% of cases.", "Neural network layers help; ABC helps, abc too.", ""]
    df = spark.createDataFrame([(1, sents), (2, []), (3, None)], "doc_id long, s array<string>")
    vocabulary = {"METHOD": ["neural network"], "DATASET": ["mnist"], "METRIC": ["cases"]}
    found = {r["doc_id"]: r["e"] for r in df.select("doc_id", terms.entities(F.col("s"), vocabulary).alias("e")).collect()}
    assert [[(e["text"], e["type"]) for e in own] for own in found[1]] == [
        [("neural network", "METHOD"), ("mnist", "DATASET"), ("MNIST", "ACRONYM")],
        [("cases", "METRIC"), ("Deep Belief Net", "CONCEPT"), ("DBN", "ACRONYM"), ("95.5%", "NUMBER")],
        [("neural network", "METHOD"), ("ABC", "ACRONYM")], [],
    ]
    assert found[2] == [] and found[3] is None
    phrases = {r["doc_id"]: r["p"] for r in df.select("doc_id", terms.key_phrases(F.col("s"), vocabulary, 5).alias("p")).collect()}
    weight = Counter({(p["value"]): p["n"] for p in phrases[1]})
    assert weight["neural network"] == 4 + 4 + 3 and weight["neural network layers"] == 2 and weight["deep belief net"] == 5
    assert [p["n"] for p in phrases[1]] == sorted(weight.values(), reverse=True) and phrases[2] == [] and phrases[3] is None

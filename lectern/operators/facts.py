"""Rules over facts(doc_id, functor, a, b) restated as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.prefix import running_sum
from lectern.session import cut_lineage

#: Ranges of values that asked documents are met in.
RANGES = 512

# Accuracy bands; functors that are facts rather than rules.
HIGH_ACCURACY, LOW_ACCURACY = 95, 80
GROUND_FUNCTORS = (
    "paper", "method", "dataset", "accuracy", "solves", "mentions", "is_a", "part_of", "uses", "related_to",
    "trained_on", "concept_solves",
)


def belongs_to(relations: DataFrame) -> DataFrame:
    """Transitive closure (concept, domain) over is_a and part_of; cycles end because pairs are distinct.

    Every round joins the paths found last with all paths so far, on either side, so lengths double and the number of
    rounds is the logarithm of the longest chain. A round is written once; none is written again.
    """
    pairs = ["concept", "domain"]
    step = relations.filter(F.col("type").isin("is_a", "part_of")).select(F.col("src").alias("concept"), F.col("dst").alias("domain"))
    rounds = [cut_lineage(step.distinct())]
    closed = rounds[0]
    while not rounds[-1].isEmpty():
        closed = rounds[0]
        for part in rounds[1:]:
            closed = closed.unionByName(part)
        ahead, behind = closed.withColumnRenamed("concept", "_mid"), closed.withColumnRenamed("domain", "_mid")
        fresh = rounds[-1]
        longer = fresh.withColumnRenamed("domain", "_mid").join(ahead, "_mid").select(*pairs)
        longer = longer.unionByName(behind.join(fresh.withColumnRenamed("concept", "_mid"), "_mid").select(*pairs))
        rounds.append(cut_lineage(longer.distinct().join(closed, pairs, "left_anti")))
    return closed


def accuracy_band(value: Column) -> Column:
    return F.when(value > HIGH_ACCURACY, "high").when(value > LOW_ACCURACY, "moderate").otherwise("low")


def outperformed(accuracy: DataFrame) -> DataFrame:
    """Per (doc_id, value): how many (doc, value) rows have a lower value.

    The pairs themselves grow with the square of the corpus. Equal values are counted first, and the counts of lower
    values are a running sum over ranges of values that Spark takes from the data.
    """
    counts = accuracy.groupBy("value").agg(F.count("*").alias("_n"))
    ranks = running_sum(counts, ["value"], "_n", "outperforms")
    return accuracy.join(ranks.select("value", "outperforms"), "value").select("doc_id", "value", "outperforms")


def outperforms(accuracy: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, other) for the asked documents: every other document that has a value below one of theirs.

    Only a document's best value can decide for it, and only its worst against it. Values are cut into even ranges
    between the extremes; an asked document meets the ranges up to its own by equality.
    """
    best = accuracy.join(asked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("value").alias("best"))
    worst = accuracy.groupBy(F.col("doc_id").alias("other")).agg(F.min("value").alias("worst"))
    ends = accuracy.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.least(F.lit(RANGES - 1), F.floor((F.col("worst") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * RANGES)).cast("int")
    dealt = worst.crossJoin(F.broadcast(ends)).select("other", "worst", place.alias("range"))
    own = F.least(F.lit(RANGES - 1), F.floor((F.col("best") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * RANGES)).cast("int")
    wide = best.crossJoin(F.broadcast(ends)).select("doc_id", "best", F.explode(F.sequence(F.lit(0), own)).alias("range"))
    return wide.join(dealt, "range").filter((F.col("worst") < F.col("best")) & (F.col("doc_id") != F.col("other"))).select("doc_id", "other")


def peers(facts: DataFrame, key: str = "b") -> DataFrame:
    """Per (document, shared value): how many other documents share it (a group, not its pairs)."""
    pairs = facts.select("doc_id", F.col(key).alias("shared")).distinct()
    sizes = pairs.groupBy("shared").agg((F.count("*") - 1).alias("peers"))
    return pairs.join(sizes, "shared").filter(F.col("peers") > 0).select("doc_id", "shared", "peers")


def sharing_with(facts: DataFrame, asked: DataFrame, key: str = "b") -> DataFrame:
    """Pairs (doc_id, other, shared) for the asked documents only: a goal with its first argument bound."""
    pairs = facts.select("doc_id", F.col(key).alias("shared")).distinct()
    mine = pairs.join(asked.select("doc_id"), "doc_id", "left_semi")
    others = pairs.withColumnRenamed("doc_id", "other")
    return mine.join(others, "shared").filter(F.col("doc_id") != F.col("other")).select("doc_id", "other", "shared").distinct()


def key_facts(facts: DataFrame, closure: DataFrame) -> DataFrame:
    """(doc_id, type, value): nine kinds of fact worth asking about, from one scan of the facts.

    A method's domains are looked up once per method, so the closure meets distinct names and not rows.
    """
    # Functor of each direct kind.
    kinds = {"method": "method", "dataset": "dataset", "accuracy": "accuracy", "solves": "task", "tool": "tool", "sample": "sample", "result": "result", "problem": "problem"}
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    domains = closure.groupBy(F.col("concept").alias("b")).agg(F.collect_set("domain").alias("_domains"))
    direct = facts.filter(F.col("functor").isin(*kinds)).select("doc_id", "functor", "b").distinct().join(domains, "b", "left")
    own = F.array(F.struct(F.element_at(named, F.col("functor")).alias("type"), F.col("b").alias("value")))
    other = F.transform("_domains", lambda d: F.struct(F.lit("domain").alias("type"), d.alias("value")))
    every = F.when((F.col("functor") == "method") & F.col("_domains").isNotNull(), F.concat(own, other)).otherwise(own)
    return direct.select("doc_id", F.explode(every).alias("k")).select("doc_id", "k.type", "k.value").distinct()


def in_domain(facts: DataFrame, closure: DataFrame, domains: DataFrame) -> DataFrame:
    """(doc_id, domain) where the document's method belongs to one of the asked domains."""
    wanted = closure.join(domains.select("domain"), "domain", "left_semi")
    methods = facts.filter(F.col("functor") == "method")
    return methods.join(wanted, F.col("b") == F.col("concept")).select("doc_id", "domain").distinct()


def explains_domain(facts: DataFrame, relations: DataFrame) -> DataFrame:
    direct = relations.filter(F.col("type") == "is_a").select(F.col("src").alias("b"), F.col("dst").alias("domain"))
    return facts.filter(F.col("functor") == "method").join(direct, "b").select("doc_id", F.col("b").alias("method"), "domain").distinct()


def recommended_baseline(facts: DataFrame, relations: DataFrame) -> DataFrame:
    near = relations.filter(F.col("type") == "related_to").select(F.col("src").alias("b"), F.col("dst").alias("baseline"))
    return facts.filter(F.col("functor") == "method").join(near, "b").select("doc_id", "baseline").distinct()


def goal(facts: DataFrame, functor: str, **bound) -> DataFrame:
    """Solutions of one functor with some arguments bound: a filter, variables stay as columns."""
    hits = facts.filter(F.col("functor") == functor)
    for name, value in bound.items():
        hits = hits.filter(F.col(name) == F.lit(value))
    return hits


def answer_confidence(functor: Column, answers: Column, bound: Column) -> Column:
    """0 without answers, 1 for a fact, 0.7 for a rule, 0.4 when a variable stayed open."""
    return (
        F.when(answers == 0, 0.0).when(~bound, 0.4).when(functor.isin(*GROUND_FUNCTORS), 1.0).otherwise(0.7)
    )


def fact_evidence(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the same document that mention a bound value: (doc_id, value, functor, a, b)."""
    mentions = facts.select("doc_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("value"), "functor", "a", "b")
    return answers.select("doc_id", "value").distinct().join(mentions, ["doc_id", "value"])

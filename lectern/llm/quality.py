"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow random-forest trees are grown on labelled rows; every path from a root is a rule, a
conjunction of thresholds on statistics. A lasso logistic regression weighs the rules; those
with a weight are compiled into one Spark column expression that scores any table.

Labels come from at most ``SAMPLE_ROWS`` labelled rows, those of the smallest id hashes.
Defined results: a null or empty text has all statistics 0 and a score like any text; a null id
counts as not held out; repeated rows score alike; an empty table gives no rows; without labels
of both classes every score is the share of label 1 (0.5 without labels); columns of the table
never enter a score, except the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm import words
from lectern.llm.shared import staged

#: Documented bound of the labelled sample.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 7

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "mean_word", "mean_line", "upper_share", "digit_share", "symbol_share", "exclaim_share", "bar_share",
    "stop_share", "blank_share", "distinct_words", "distinct_lines", "longest_line",
)


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_CLASSES = {
    "upper_share": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit_share": _bytes("0123456789"), "symbol_share": _bytes("#$%&*+<=>@\\^_`{}~"),
    "exclaim_share": _bytes("!?"), "bar_share": _bytes("|/[]()"), "stop_share": _bytes(".,;:"), "blank_share": _bytes(" \t\r\n"),
}
_LINES = words.separators((0x0A, 0x0A), (0x0D, 0x0D))


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Distinct values per run: sort by (run, value) at once, count the changes."""
    owner = np.repeat(np.arange(len(firsts) - 1, dtype=np.uint64), np.diff(firsts))
    keys = np.sort((owner << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(firsts) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of a chunk of texts, one value per text."""
    size = np.diff(offsets).astype(float)
    per_byte = np.maximum(size, 1)
    starts, ends, firsts = words.find_words(data, offsets, words.SPACED)
    line_starts, line_ends, line_firsts = words.find_words(data, offsets, _LINES)
    n_words, n_lines = np.diff(firsts), np.diff(line_firsts)
    lengths = np.concatenate(([0], np.cumsum(ends - starts)))[firsts]
    line_sizes = line_ends - line_starts
    longest = np.zeros(len(size))
    if len(line_sizes):
        filled = n_lines > 0
        longest[filled] = np.maximum.reduceat(line_sizes, line_firsts[:-1][filled])
    out = {"n_bytes": size, "n_words": n_words, "n_lines": n_lines, "longest_line": longest}
    out["mean_word"] = np.diff(lengths) / np.maximum(n_words, 1)
    out["mean_line"] = size / np.maximum(n_lines, 1)
    for name, table in _CLASSES.items():
        out[name] = np.diff(np.concatenate(([0], np.cumsum(table[data])))[offsets]) / per_byte
    out["distinct_words"] = _distinct(words.hash_spans(data, starts, ends), firsts) / np.maximum(n_words, 1)
    out["distinct_lines"] = _distinct(words.hash_spans(data, line_starts, line_ends), line_firsts) / np.maximum(n_lines, 1)
    return {name: out[name].astype(float) for name in STATISTICS}


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Rows with one double column ``stat_<name>`` per statistic (replacing columns of that name)."""
    stats = [f"stat_{s}" for s in STATISTICS]
    docs = docs.drop(*stats)
    names = docs.columns
    place = names.index(text_col)
    kept = [c for c in names if keep_text or c != text_col]
    at = [names.index(c) for c in kept]

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in words.chunks(batch.column(place)):
                rows = batch.slice(first, n)
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in at), *(pa.array(found[s]) for s in STATISTICS)], names=[*kept, *stats])

    fields = [f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(measured, ", ".join([*fields, *(f"{s} double" for s in stats)]))


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; a rule is a tuple of (statistic, is at most, threshold)."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(_condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _condition(rule) -> Column:
    held = F.lit(True)
    for name, below, threshold in rule:
        column = F.col(f"stat_{name}")
        held = held & ((column <= threshold) if below else (column > threshold))
    return held


def tree_rules(root) -> list[tuple]:
    """All paths of a fitted tree, from below the root down to its leaves."""
    found, open_nodes = [], [(root, ())]
    while open_nodes:
        node, path = open_nodes.pop()
        if path:
            found.append(path)
        if node.subtreeDepth():
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], split.threshold()
            open_nodes += [(node.rightChild(), (*path, (name, False, threshold))), (node.leftChild(), (*path, (name, True, threshold)))]
    return found


def simplify(path: tuple) -> tuple:
    """The same conjunction with one threshold per statistic and side, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, below, threshold in path:
        old = tight.get((name, below))
        tight[name, below] = threshold if old is None else min(old, threshold) if below else max(old, threshold)
    return tuple((name, below, tight[name, below]) for name, below in sorted(tight))


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fit on rows with statistics and an integer ``label``; the sample is bounded by the caller."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = float(next(iter(counts), 0.5))
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return RuleModel((), (), logit)
    features = VectorAssembler(inputCols=[f"stat_{s}" for s in STATISTICS], outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="0.5", maxBins=64).fit(features.transform(sample).select("features", "label"))
    rules = sorted({simplify(p) for tree in forest.trees for p in tree_rules(tree._call_java("rootNode"))})
    held = sample.select("label", *[_condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(held)
    lines = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(held.select("features", "label"))
    kept = [(r, float(w)) for r, w in zip(rules, lines.coefficients.toArray(), strict=True) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lines.intercept))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on the labelled rows with the smallest id hashes, at most ``sample_rows`` of them."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{text_col}`").alias("text"))
    # The sample's ids are bounded, so the texts stay where they are.
    sample = with_statistics(texts.join(F.broadcast(chosen), "label_id"), keep_text=False)
    sample = sample.orderBy(F.xxhash64("label_id"), "label_id", *[f"stat_{s}" for s in STATISTICS]).limit(sample_rows)
    return fit(staged(sample.coalesce(1), "quality-sample"))


def score_documents(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Rows with ``score`` and ``predicted`` (replacing columns of that name)."""
    stats = [f"stat_{s}" for s in STATISTICS]
    scored = with_statistics(docs.drop("score", "predicted"), text_col, keep_text).withColumn("score", model.score()).drop(*stats)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    names = docs.columns
    kept = score_documents(docs, learn(docs, labels), threshold=threshold, keep_text=True).where(F.col("predicted") == 1)
    return kept.select(*[F.col(f"`{c}`") for c in names])

"""Exact occurrences of passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as T


def find_passages(passages: DataFrame, documents: DataFrame, words: int = 5) -> DataFrame:
    """(item_id, doc_id, start): passages(item_id, text) that stand in documents(doc_id, text).

    The passage's first words meet the documents' word runs by equi-join, so
    only real candidates are compared; the comparison itself is exact. Passages
    shorter than that many words use as many as they have.
    """
    norm = T.squeeze_strip(F.lower(F.col("text")))
    p = passages.select("item_id", norm.alias("_passage"))
    # Inner words only: the first and last may continue beyond the passage's edge in the document.
    tokens = F.split("_passage", " ")
    inner = F.slice(tokens, 2, F.least(F.lit(words), F.greatest(F.size(tokens) - 2, F.lit(0))))
    p = p.withColumn("_size", F.size(inner)).withColumn("_key", F.array_join(inner, " "))
    d = documents.select("doc_id", norm.alias("_source"))
    sizes = [r["_size"] for r in p.select("_size").distinct().collect()]  # at most words + 1 values
    hits = None
    for size in sizes:
        mine = p.filter(F.col("_size") == size)
        if size == 0:
            # One or two words: no inner word to join on, so each word of the corpus is a candidate.
            part = mine.join(d, F.contains("_source", F.col("_passage")))
        else:
            w = F.split("_source", " ")
            runs = F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0))),
                    lambda i: F.array_join(F.slice("_w", i + 1, size), " "),
                )
            )
            pieces = d.withColumn("_w", w).select("doc_id", F.explode(runs).alias("_key"))
            near = mine.join(pieces, "_key").select("item_id", "_passage", "doc_id").distinct()
            part = near.join(d, "doc_id").filter(F.contains("_source", F.col("_passage")))
        part = part.select("item_id", "doc_id", (F.instr("_source", F.col("_passage")) - 1).alias("start"))
        hits = part if hits is None else hits.unionByName(part)
    return hits

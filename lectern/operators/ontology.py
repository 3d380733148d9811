"""Resolve terms against a user-supplied ontology of any size.

Tables: concepts(id, label, domain), aliases(alias, concept_id, ord),
relations(src, type, dst), ancestors(concept_id, pos, ancestor_id; root first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T
from lectern.operators.dedupe import keep_first
from lectern.session import cut_lineage

# Confidence by kind of match, relation names kept for document facts.
EXACT, ALIAS, FUZZY, TEXT_ID, TEXT_ALIAS = 1.0, 0.85, 0.6, 0.8, 0.75
RELATION_WEIGHT, ANCESTOR_WEIGHT = 0.7, 0.85
RESERVED_RELATIONS = ("paper", "method", "dataset", "accuracy", "solves", "mentions")


def lookup_table(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, concept_id, is_id): an id always wins over an alias, the first alias over later ones."""
    ids = concepts.select(F.lower("id").alias("key"), F.col("id").alias("concept_id"), F.lit(-1).alias("ord"))
    rest = aliases.select(F.lower("alias").alias("key"), "concept_id", F.col("ord").cast("int"))
    first = keep_first(ids.unionByName(rest), ["key"], [F.col("ord"), F.col("concept_id")])
    return first.select("key", "concept_id", (F.col("ord") < 0).alias("is_id"))


def alias_join(terms: DataFrame, lookup: DataFrame) -> DataFrame:
    """Terms(term) with concept and match type where an id or alias equals the term."""
    keyed = terms.withColumn("_key", T.strip(F.lower("term")))
    hit = lookup.withColumnRenamed("key", "_key")
    return keyed.join(hit, "_key", "left").select(
        *terms.columns,
        "concept_id",
        F.when(F.col("is_id"), "exact").when(F.col("concept_id").isNotNull(), "alias").alias("match_type"),
        F.when(F.col("is_id"), EXACT).when(F.col("concept_id").isNotNull(), ALIAS).alias("confidence"),
    )


def _segments(value: Column, length: Column, parts: int) -> Column:
    """Even cut of a string into ``parts`` pieces: array<struct<no, at, piece>> (1-based positions)."""
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")

    def one(k: Column) -> Column:
        wide = F.greatest(F.lit(0), k - (F.lit(parts) - extra))
        at = k * base + wide + 1
        size = base + F.when(k >= F.lit(parts) - extra, 1).otherwise(0)
        return F.struct(k.alias("no"), at.alias("at"), value.substr(at, size).alias("piece"), size.alias("size"))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), one)


def edit_distance_join(terms: DataFrame, ids: DataFrame, limit: int = 2) -> DataFrame:
    """All (term, id, distance) with Levenshtein distance <= limit, without comparing every pair.

    An id cut into limit + 1 pieces keeps at least one piece whole, shifted by at
    most ``limit``, in any term that close. Pieces meet by equi-join on (length,
    number, text); the native distance then decides. Exact, and no cross join.
    """
    parts = limit + 1
    left = ids.select(F.col("id"), F.char_length("id").alias("_n"))
    left = left.select("id", "_n", F.inline(_segments(F.col("id"), F.col("_n"), parts))).select(
        "id", F.col("_n").alias("n"), F.col("no").alias("k"), "piece"
    )
    probe = terms.select("term", F.char_length("term").alias("_m"))
    probe = probe.select(
        "term", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_m") - limit), F.col("_m") + limit)).alias("n")
    )
    # Piece positions depend only on the id's length, so they are known for each length probed.
    shape = _segments(F.lit(""), F.col("n"), parts)
    probe = probe.select("term", "n", F.inline(shape)).select("term", "n", F.col("no").alias("k"), "at", "size")
    probe = probe.select(
        "term", "n", "k", "size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - limit), F.col("at") + limit)).alias("from")
    )
    probe = probe.select("term", "n", "k", F.col("term").substr(F.col("from"), F.col("size")).alias("piece"), "size").filter(
        F.char_length("piece") == F.col("size")
    ).select("term", "n", "k", "piece").distinct()
    near = probe.join(left, ["n", "k", "piece"]).select("term", "id").distinct()
    distance = F.levenshtein("term", "id", limit)
    return near.withColumn("distance", distance).filter(F.col("distance") >= 0)


def fuzzy_join(terms: DataFrame, concepts: DataFrame, limit: int = 2) -> DataFrame:
    """Closest concept id per distinct unmatched term: least distance, then smallest id."""
    distinct = terms.select(T.strip(F.lower("term")).alias("term")).distinct()
    near = edit_distance_join(distinct, concepts.select("id"), limit)
    best = near.groupBy("term").agg(F.min(F.struct("distance", "id")).alias("b"))
    return best.select("term", F.col("b.id").alias("concept_id"), F.col("b.distance").alias("distance"))


def resolve_terms(terms: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Terms with concept, match type and confidence: id, alias, close id, else unknown."""
    direct = alias_join(terms, lookup_table(concepts, aliases))
    open_terms = direct.filter(F.col("concept_id").isNull()).select("term")
    fuzzy = fuzzy_join(open_terms, concepts).select(
        F.col("term").alias("_t"), F.col("concept_id").alias("_fuzzy")
    )
    joined = direct.withColumn("_t", T.strip(F.lower("term"))).join(fuzzy, "_t", "left")
    return joined.select(
        *terms.columns,
        F.coalesce("concept_id", "_fuzzy").alias("concept_id"),
        F.coalesce("match_type", F.when(F.col("_fuzzy").isNotNull(), "fuzzy"), F.lit("unknown")).alias("match_type"),
        F.coalesce("confidence", F.when(F.col("_fuzzy").isNotNull(), FUZZY), F.lit(0.0)).alias("confidence"),
    )


def longest_alias_in_text(texts: DataFrame, lookup: DataFrame, key: str, text: str) -> DataFrame:
    """Longest id or alias of three characters or more standing as a whole term in each text."""
    from lectern.operators.nlp import lexicon_match

    lexicon = lookup.filter(F.char_length("key") >= 3).select(F.col("concept_id").alias("type"), F.col("key").alias("term"))
    hits = lexicon_match(texts, lexicon, [key], text)
    flags = lookup.select(F.col("key").alias("term"), "is_id")
    best = hits.join(flags, "term").groupBy(key).agg(
        F.min(F.struct((-F.char_length("term")).alias("n"), F.col("term").alias("term"), F.col("type").alias("id"), "is_id")).alias("b")
    )
    return best.select(
        key, F.col("b.id").alias("concept_id"), F.col("b.term").alias("alias"),
        F.when(F.col("b.is_id"), TEXT_ID).otherwise(TEXT_ALIAS).alias("confidence"),
    )


def ontology_context(resolved: DataFrame, concepts: DataFrame, relations: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Edges(doc_id, src, type, dst, weight) that resolved concepts bring in."""
    known = concepts.select(F.col("id").alias("dst"))
    seen = resolved.select("doc_id", F.col("concept_id").alias("src")).distinct()
    related = (
        seen.join(relations, "src").join(known, "dst", "left_semi")
        .select("doc_id", "src", "type", "dst", F.lit(RELATION_WEIGHT).alias("weight"))
    )
    pairs = key_pairs(ancestors).join(known, F.col("parent") == F.col("dst"), "left_semi")
    chain = (
        seen.join(pairs, seen["src"] == pairs["concept_id"])
        .filter(F.col("child") != F.col("parent"))
        .select(
            "doc_id", F.col("child").alias("src"), F.lit("is_a").alias("type"), F.col("parent").alias("dst"),
            F.lit(ANCESTOR_WEIGHT).alias("weight"),
        )
    )
    return related.unionByName(chain).distinct()


def ancestor_chains(relations: DataFrame) -> DataFrame:
    """ancestors(concept_id, pos, ancestor_id) of every concept with an is_a parent: root first, the concept itself last.

    A concept's parent is the smallest of its is_a targets. Pointers are doubled: a round joins every concept's chain so
    far with the chain of its last ancestor, so the rounds are the logarithm of the longest chain. Where parents
    form a circle, each ancestor counts once, at its first distance.
    """
    pair = ["concept_id", "ancestor_id"]
    parents = relations.filter((F.col("type") == "is_a") & (F.col("src") != F.col("dst"))).groupBy(F.col("src").alias("concept_id")).agg(F.min("dst").alias("ancestor_id"))
    jump = cut_lineage(parents)
    rounds, reach = [jump.withColumn("distance", F.lit(1))], 1
    while True:
        known = rounds[0]
        for part in rounds[1:]:
            known = known.unionByName(part)
        after = known.select(F.col("concept_id").alias("mid"), F.col("ancestor_id").alias("far"), "distance")
        ahead = jump.withColumnRenamed("ancestor_id", "mid").join(after, "mid").filter(F.col("far") != F.col("concept_id"))
        fresh = ahead.groupBy("concept_id", F.col("far").alias("ancestor_id")).agg((F.min("distance") + reach).alias("distance"))
        fresh = cut_lineage(fresh.join(known.select(*pair), pair, "left_anti"))
        if fresh.isEmpty():
            break
        hop = jump.select(F.col("concept_id").alias("mid"), F.col("ancestor_id").alias("far"))
        jump = cut_lineage(jump.withColumnRenamed("ancestor_id", "mid").join(hop, "mid").select("concept_id", F.col("far").alias("ancestor_id")))
        rounds.append(fresh)
        reach *= 2
    height = known.groupBy("concept_id").agg(F.max("distance").alias("height"))
    own = height.select("concept_id", F.col("height").alias("pos"), F.col("concept_id").alias("ancestor_id"))
    return known.join(height, "concept_id").select("concept_id", (F.col("height") - F.col("distance")).alias("pos"), "ancestor_id").unionByName(own)


def key_pairs(ancestors: DataFrame) -> DataFrame:
    """Consecutive ancestors (parent at i, child at i + 1) by equi-join on position."""
    upper = ancestors.select("concept_id", (F.col("pos") + 1).alias("pos"), F.col("ancestor_id").alias("parent"))
    return upper.join(ancestors, ["concept_id", "pos"]).select("concept_id", "pos", "parent", F.col("ancestor_id").alias("child"))


def unobserved_related(resolved: DataFrame, relations: DataFrame, n: int = 12) -> DataFrame:
    """Related concepts a document does not mention, first ``n`` by first relation."""
    seen = resolved.select("doc_id", F.col("concept_id").alias("src"), "pos").filter(F.col("src").isNotNull())
    targets = seen.join(relations, "src").select(
        "doc_id", F.col("dst").alias("concept_id"), F.struct("pos", "type", "dst").alias("_p")
    )
    fresh = targets.join(resolved.select("doc_id", "concept_id"), ["doc_id", "concept_id"], "left_anti")
    first = fresh.groupBy("doc_id", "concept_id").agg(F.min("_p").alias("_p"))
    from pyspark.sql import Window

    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_p")))
    return ranked.filter(F.col("rank") <= n).select("doc_id", "rank", "concept_id")


def integrity(concepts: DataFrame, relations: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Dangling relation targets, dangling ancestors and reserved relation names."""
    ids = concepts.select(F.col("id").alias("_id"))
    dangling = relations.join(ids, F.col("dst") == F.col("_id"), "left_anti").select(
        F.lit("dangling_relation").alias("problem"), "src", "type", "dst"
    )
    lost = ancestors.filter(F.col("ancestor_id") != F.col("concept_id")).join(
        ids, F.col("ancestor_id") == F.col("_id"), "left_anti"
    ).select(F.lit("dangling_ancestor").alias("problem"), F.col("concept_id").alias("src"), F.lit("ancestor").alias("type"), F.col("ancestor_id").alias("dst"))
    reserved = relations.filter(F.col("type").isin(*RESERVED_RELATIONS)).select(
        F.lit("reserved_relation").alias("problem"), "src", "type", "dst"
    )
    return dangling.unionByName(lost).unionByName(reserved)

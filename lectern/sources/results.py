"""Analysis results as stored: one VARIANT column per document, written flattened and read tolerantly.

Older rows keep graph nodes as a map or an object and ontology matches with a nested concept, so readers look at the
shape each row has. All of it is column expressions on the variant; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds of ontology match; others read as the last one.
MATCH_TYPES = ("exact", "alias", "fuzzy", "generated", "unknown")

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def result_serialize(results: DataFrame) -> DataFrame:
    """doc_id and the storable ``result`` of every analysed document.

    results(doc_id, ontology array<struct<concept struct<id, label>, confidence, match_type, raw_input>>,
    graph struct<nodes map<string, ...>, edges array<...>>, facts, confidence, processed_at); matches keep the id of
    their concept, nodes become a list, further columns are stored under their own names. Null parts stay out.
    """
    own = ("doc_id", "ontology", "graph", "facts", "confidence", "processed_at")
    matches = F.transform(
        "ontology",
        lambda m: F.struct(
            m["concept"]["id"].alias("conceptId"), m["confidence"].alias("confidence"), m["match_type"].alias("matchType"), m["raw_input"].alias("rawInput")
        ),
    )
    graph = F.struct(F.map_values("graph.nodes").alias("nodes"), F.col("graph.edges").alias("edges"))
    fields = [
        F.col("doc_id").cast("string").alias("noteId"), F.lit("complete").alias("stage"), matches.alias("ontologyMatches"), graph.alias("graph"),
        F.col("facts").alias("prologFacts"), F.col("confidence"), F.col("processed_at").alias("processedAt"),
    ]
    return results.select("doc_id", F.to_variant_object(F.struct(*fields, *[c for c in results.columns if c not in own])).alias("result"))


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def items(value: Column, path: str = "$") -> Column:
    """The elements of a variant array; null for any other shape."""
    return F.try_variant_get(value, path, "array<variant>")


def text_member(value: Column, path: str) -> Column:
    """A member that is a string; numbers and objects are not read as text."""
    return F.when(F.schema_of_variant(member(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def number_member(value: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(member(value, path)).rlike(_NUMBER), F.try_variant_get(value, path, "double"))


def normalize_graph(value: Column) -> Column:
    """struct<nodes, edges>: nodes of a list as they are, of a map or object its values by key; edges only of a list."""
    none = F.array().cast("array<variant>")
    by_key = F.map_values(F.try_variant_get(value, "$.nodes", "map<string,variant>"))
    return F.struct(F.coalesce(items(value, "$.nodes"), by_key, none).alias("nodes"), F.coalesce(items(value, "$.edges"), none).alias("edges"))


def normalize_ontology(value: Column) -> Column:
    """array<struct<concept_id, confidence, match_type, raw_input>> of a list of matches; anything else has none.

    The id is the match's own or its concept's, if a string; matches without one are left out. Unknown kinds
    read as ``unknown``, a confidence that is no number as 0, missing input as the concept's label.
    """

    def match(m: Column) -> Column:
        kind = text_member(m, "$.matchType")
        return F.struct(
            F.coalesce(text_member(m, "$.conceptId"), text_member(m, "$.concept.id"), F.lit("")).alias("concept_id"),
            F.coalesce(number_member(m, "$.confidence"), F.lit(0.0)).alias("confidence"),
            F.when(kind.isin(*MATCH_TYPES), kind).otherwise("unknown").alias("match_type"),
            F.coalesce(text_member(m, "$.rawInput"), text_member(m, "$.concept.label"), F.lit("")).alias("raw_input"),
        )

    found = F.filter(F.transform(items(value), match), lambda m: m["concept_id"] != "")
    return F.coalesce(found, F.array().cast("array<struct<concept_id:string,confidence:double,match_type:string,raw_input:string>>"))


def graph_rows(results: DataFrame, graph: str = "$.graph") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of stored results(doc_id, result) as rows for the graph operators, in stored order."""
    read = results.select("doc_id", normalize_graph(member(F.col("result"), graph)).alias("g"))
    node = read.select("doc_id", F.posexplode("g.nodes").alias("pos", "v"))
    nodes = node.select("doc_id", "pos", *[text_member(F.col("v"), f"$.{k}").alias(k) for k in ("id", "type", "label")])
    edge = read.select("doc_id", F.posexplode("g.edges").alias("pos", "v"))
    ends = {"src": "from", "dst": "to", "type": "type"}
    edges = edge.select("doc_id", "pos", *[text_member(F.col("v"), f"$.{k}").alias(c) for c, k in ends.items()], number_member(F.col("v"), "$.weight").alias("weight"))
    return nodes.filter(F.col("id").isNotNull()), edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())

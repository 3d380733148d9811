"""Ontology, graph and rules bound to suppliers, nations, regions and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import derivations as V
from lectern.operators import facts as R
from lectern.operators import graph as G
from lectern.operators import ontology as O
from lectern.plans.registry import query
from lectern.session import stored
from lectern.sources import tables as S


def edges(spark, sf):
    """supplier is_a nation, customer mentions nation, nation part_of region."""
    n = S.table(spark, sf, "nation").select(
        F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.lit("part_of").alias("type"), F.concat(F.lit("region:"), "n_regionkey").alias("dst")
    )
    s = S.table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.lit("is_a").alias("type"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst")
    )
    c = S.table(spark, sf, "customer").select(
        F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.lit("mentions").alias("type"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst")
    )
    return s.unionByName(c).unionByName(n)


def nodes(spark, sf):
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")]
    out = None
    for table, key, label in parts:
        df = S.table(spark, sf, table).select(
            F.concat(F.lit(f"{table}:"), key).alias("id"), F.lit(table).alias("type"), F.col(label).alias("label"),
            ((F.col(key) % 10) / 10).alias("confidence"), F.col(key).cast("bigint").alias("pos"),
        )
        out = df if out is None else out.unionByName(df)
    return out


_E = """e AS (SELECT 'supplier:' || s_suppkey AS src, 'is_a' AS type, 'nation:' || s_nationkey AS dst FROM supplier
 UNION ALL SELECT 'customer:' || c_custkey, 'mentions', 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey FROM nation),
n AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label, (r_regionkey % 10) / 10.0 AS confidence FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, (n_nationkey % 10) / 10.0 FROM nation
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, (s_suppkey % 10) / 10.0 FROM supplier
 UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, (c_custkey % 10) / 10.0 FROM customer),
b AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e)"""


@query("edge_dedupe", f"WITH {_E}, l AS (SELECT l_suppkey AS src, l_returnflag AS type, l_partkey AS dst, min(row(l_orderkey, l_linenumber)) AS f FROM lineitem GROUP BY 1, 2, 3) SELECT src, type, dst, struct_extract(f, 1) AS order_id FROM l")
def edge_dedupe(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")
    )
    return G.edge_dedupe(rows, ["order_id", "line"]).select("src", "type", "dst", "order_id")


@query("incident_edges", f"WITH {_E} SELECT src, type, dst FROM e WHERE (src = 'nation:3' OR dst = 'nation:3') AND type = 'is_a'")
def incident_edges(spark, sf):
    return G.incident_edges(edges(spark, sf), "nation:3", "is_a")


@query("neighbors", f"WITH {_E} SELECT DISTINCT node, other FROM b WHERE node LIKE 'nation:%' AND node <> other")
def neighbors(spark, sf):
    return G.neighbors(edges(spark, sf), nodes(spark, sf).filter(F.col("type") == "nation"))


@query("node_connections", f"WITH {_E} SELECT src AS node, 'out' AS direction, e.type, dst AS other, label AS other_label FROM e JOIN n ON n.id = dst UNION ALL SELECT dst, 'in', e.type, src, label FROM e JOIN n ON n.id = src")
def node_connections(spark, sf):
    return G.node_connections(edges(spark, sf), nodes(spark, sf))


@query("degree_count", f"WITH {_E} SELECT node, count(*) AS degree FROM b GROUP BY 1")
def degree_count(spark, sf):
    return G.degree_count(edges(spark, sf))


@query(
    "degree_centrality",
    """WITH e AS (SELECT l_orderkey AS doc_id, 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
b AS (SELECT doc_id, src AS node FROM e UNION ALL SELECT doc_id, dst FROM e), d AS (SELECT doc_id, node, count(*) AS d FROM b GROUP BY 1, 2),
t AS (SELECT doc_id, max(d) AS top FROM d GROUP BY 1), n AS (SELECT DISTINCT doc_id, node FROM b UNION ALL SELECT o_orderkey, 'order' FROM orders)
SELECT doc_id, node, round(coalesce(d, 0) / CAST(coalesce(top, 1) AS DOUBLE), 6) AS centrality FROM n LEFT JOIN d USING (doc_id, node) LEFT JOIN t USING (doc_id)""",
)
def degree_centrality(spark, sf):
    """Every order's graph of suppliers and parts, with the order itself as a node without edges."""
    li = S.table(spark, sf, "lineitem")
    links = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"))
    ends = links.select("doc_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("order").alias("id"))
    return G.degree_centrality(links, ends.unionByName(alone)).withColumn("centrality", F.round("centrality", 6))


_BFS = """WITH RECURSIVE {e}, w AS (SELECT 'region:1' AS node, 0 AS distance UNION ALL SELECT DISTINCT b.other, w.distance + 1 FROM w JOIN b ON b.node = w.node WHERE w.distance < {d})
SELECT node, min(distance) AS distance FROM w GROUP BY 1"""


@query("bfs", _BFS.format(e=_E, d=2))
def bfs(spark, sf):
    return G.bfs(edges(spark, sf), nodes(spark, sf), "region:1", 2)


@query(
    "shortest_path",
    f"""WITH {_E} SELECT min('customer:0>' || p.other || '>' || q.other || '>' || r.other || '>' || t.other) AS path, 4 AS length
FROM b p JOIN b q ON q.node = p.other JOIN b r ON r.node = q.other JOIN b t ON t.node = r.other
WHERE p.node = 'customer:0' AND q.other LIKE 'region:%' AND r.other LIKE 'nation:%' AND r.other <> p.other
  AND t.other = (SELECT min(src) FROM e WHERE src LIKE 'supplier:%' AND dst LIKE 'nation:%7')
HAVING count(*) > 0""",
)
def shortest_path(spark, sf):
    suppliers = edges(spark, sf).filter(F.col("src").startswith("supplier:") & F.col("dst").rlike("^nation:.*7$"))
    goal = suppliers.agg(F.min("src").alias("id")).first()["id"]
    found = G.shortest_path(edges(spark, sf), "customer:0", goal)
    return found.select(F.array_join("path", ">").alias("path"), "length")


@query("connected_components", f"""WITH {_E}, top AS (SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS root FROM nation),
m AS (SELECT node, root FROM top UNION SELECT root, root FROM top UNION SELECT e.src, t.root FROM e JOIN top t ON t.node = e.dst),
r AS (SELECT root, min(node) AS component FROM m GROUP BY 1) SELECT n.id AS node, coalesce(r.component, n.id) AS component FROM n LEFT JOIN m ON m.node = n.id LEFT JOIN r ON r.root = m.root""")
def connected_components(spark, sf):
    return G.connected_components(edges(spark, sf), nodes(spark, sf))


@query("layer_levels")
def layer_levels(spark, sf):
    back = edges(spark, sf).select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))
    return G.layer_levels(back, nodes(spark, sf), "region")


@query("subgraph_filter", f"""WITH {_E}, p AS (SELECT * FROM n WHERE confidence >= 0.2), h AS (SELECT id FROM p WHERE contains(lower(label), 'nation_1')),
k AS (SELECT id FROM h UNION SELECT other FROM b WHERE node IN (SELECT id FROM h)), v AS (SELECT id FROM p WHERE id IN (SELECT id FROM k))
SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""")
def subgraph_filter(spark, sf):
    _, inside = G.subgraph_filter(nodes(spark, sf), edges(spark, sf), 0.2, needle="Nation_1")
    return inside.select("src", "type", "dst")


@query("distinct_types", f"WITH {_E} SELECT DISTINCT type FROM e ORDER BY 1")
def distinct_types(spark, sf):
    return edges(spark, sf).select("type").distinct().orderBy("type")


@query("collect_evidence", "SELECT o_custkey AS doc_id, o_orderstatus AS evidence_id, arg_min(o_orderpriority, o_orderkey) AS text FROM orders GROUP BY 1, 2")
def collect_evidence(spark, sf):
    rows = S.owned_items(spark, sf).select(
        F.col("user_id").alias("doc_id"), F.col("id").alias("pos"),
        F.array(F.struct(F.col("stage").alias("id"), F.col("title").alias("text")), F.struct(F.lit("blank").alias("id"), F.lit("  ").alias("text"))).alias("evidence"),
    )
    return G.collect_evidence(rows)


@query(
    "node_property_merge",
    """WITH m AS (SELECT o_custkey AS id, o_orderstatus AS k, max(o_orderkey) AS v FROM orders GROUP BY 1, 2),
l AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1)
SELECT id, any_value(label) AS label, string_agg(k || '=' || v, ',' ORDER BY k) AS props FROM m JOIN l USING (id) GROUP BY 1""",
)
def node_property_merge(spark, sf):
    rows = S.owned_items(spark, sf).select(
        F.col("user_id").alias("id"), F.col("id").alias("pos"), F.col("title").alias("label"), F.create_map("stage", F.col("id").cast("string")).alias("props")
    )
    merged = G.merge_properties(rows)
    return merged.select("id", "label", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("props"))


@query("graph_mean_confidence", f"WITH {_E} SELECT type, round(CAST(avg(confidence) AS DOUBLE), 6) AS mean FROM n GROUP BY 1")
def graph_mean_confidence(spark, sf):
    return nodes(spark, sf).groupBy("type").agg(F.round(F.avg("confidence"), 6).alias("mean"))


# ---- ontology ------------------------------------------------------------------------------------


def concepts(spark, sf):
    return S.table(spark, sf, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"), F.col("p_name").alias("label")
    ).distinct().withColumn("domain", F.lit("parts"))


def aliases(spark, sf):
    p = S.table(spark, sf, "part")
    return p.select(F.col("p_name").alias("alias"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("concept_id"), F.lit(0).alias("ord")).distinct()


def terms(spark, sf):
    """Part names: as written, as ids, with one letter lost, or with two letters swapped for others."""
    k, name = F.col("p_partkey"), F.col("p_name")
    at = (k % F.char_length(name)).cast("int")
    lost = F.concat(F.replace(name, F.lit(" "), F.lit("_")).substr(F.lit(1), at), F.replace(name, F.lit(" "), F.lit("_")).substr(at + 2, F.char_length(name)))
    term = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 4 == 2, lost).otherwise(F.concat(lost, F.lit("zq")))
    return S.table(spark, sf, "part").select(k.alias("doc_id"), term.alias("term"))


_LOST = "substr(replace(p_name, ' ', '_'), 1, CAST(p_partkey % length(p_name) AS INTEGER)) || substr(replace(p_name, ' ', '_'), CAST(p_partkey % length(p_name) AS INTEGER) + 2)"
_O = f"""c AS (SELECT DISTINCT replace(p_name, ' ', '_') AS id, p_name AS label FROM part),
t AS (SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN {_LOST} ELSE {_LOST} || 'zq' END AS term FROM part),
lk AS (SELECT id AS key, id, true AS is_id FROM c UNION ALL SELECT label, id, false FROM c WHERE label NOT IN (SELECT id FROM c)),
a AS (SELECT t.*, lk.id AS concept_id, CASE WHEN is_id THEN 'exact' WHEN lk.id IS NOT NULL THEN 'alias' END AS match_type FROM t LEFT JOIN lk ON lk.key = lower(term)),
u AS (SELECT DISTINCT lower(term) AS term FROM a WHERE concept_id IS NULL),
f AS (SELECT term, arg_min(id, row(d, id)) AS concept_id, min(d) AS distance FROM (SELECT u.term, c.id, levenshtein(u.term, c.id) AS d FROM u, c) WHERE d <= 2 GROUP BY 1)"""


@query("alias_equi_join", f"WITH {_O} SELECT doc_id, term, concept_id, match_type FROM a")
def alias_equi_join(spark, sf):
    return O.alias_join(terms(spark, sf), O.lookup_table(concepts(spark, sf), aliases(spark, sf))).select("doc_id", "term", "concept_id", "match_type")


@query("fuzzy_join", f"WITH {_O} SELECT term, concept_id, CAST(distance AS INTEGER) AS distance FROM f")
def fuzzy_join(spark, sf):
    direct = O.alias_join(terms(spark, sf), O.lookup_table(concepts(spark, sf), aliases(spark, sf)))
    return O.fuzzy_join(direct.filter(F.col("concept_id").isNull()), concepts(spark, sf))


def resolved(spark, sf):
    return O.resolve_terms(terms(spark, sf), concepts(spark, sf), aliases(spark, sf))


_RESOLVED = f"{_O}, rs AS (SELECT doc_id, a.term, coalesce(a.concept_id, f.concept_id) AS concept_id, coalesce(match_type, CASE WHEN f.term IS NOT NULL THEN 'fuzzy' END, 'unknown') AS match_type FROM a LEFT JOIN f ON f.term = lower(a.term) AND a.concept_id IS NULL)"


@query("resolve_core_terms", f"WITH {_RESOLVED} SELECT doc_id, term, concept_id, match_type, CASE match_type WHEN 'exact' THEN 1.0 WHEN 'alias' THEN 0.85 WHEN 'fuzzy' THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM rs")
def resolve_core_terms(spark, sf):
    return resolved(spark, sf)


@query("ontology_provider", f"WITH {_RESOLVED} SELECT match_type, count(*) AS n FROM rs GROUP BY 1")
def ontology_provider(spark, sf):
    """Any table can be the ontology: match kinds of the part vocabulary."""
    return resolved(spark, sf).groupBy("match_type").agg(F.count("*").alias("n"))


@query("longest_alias_in_text", f"""WITH {_O}, x AS (SELECT p_partkey AS doc_id, 'about ' || p_name || ' and ' || replace(lower(p_type), ' ', '_') || ' things' AS s FROM part),
h AS (SELECT doc_id, key, id, is_id FROM x JOIN lk ON length(key) >= 3 AND regexp_matches(s, '(^|[^a-z0-9])' || key || '($|[^a-z0-9])')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, key) AS rn FROM h) SELECT doc_id, id AS concept_id, key AS alias, CASE WHEN is_id THEN 0.8 ELSE 0.75 END::DOUBLE AS confidence FROM r WHERE rn = 1""")
def longest_alias_in_text(spark, sf):
    texts = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("about "), "p_name", F.lit(" and "), F.lower("p_type"), F.lit(" things")).alias("s")
    )
    return O.longest_alias_in_text(texts, O.lookup_table(concepts(spark, sf), aliases(spark, sf)), "doc_id", "s")


def relations(spark, sf):
    """Concept ids joined by the part keys that follow each other."""
    p = S.table(spark, sf, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("id").alias("dst"), F.col("p_size").alias("_s"))
    kind = F.when(F.col("p_size") % 3 == 0, "is_a").when(F.col("p_size") % 3 == 1, "method").otherwise("related_to")
    dst = F.when(F.col("p_partkey") % 50 == 0, F.concat("dst", F.lit("_gone"))).otherwise(F.col("dst"))
    return p.join(nxt, "p_partkey").filter(F.col("id") != F.col("dst")).select(F.col("id").alias("src"), kind.alias("type"), dst.alias("dst")).distinct()


_REL = """rel AS (SELECT DISTINCT replace(p.p_name, ' ', '_') AS src, CASE p.p_size % 3 WHEN 0 THEN 'is_a' WHEN 1 THEN 'method' ELSE 'related_to' END AS type,
 replace(q.p_name, ' ', '_') || CASE WHEN p.p_partkey % 50 = 0 THEN '_gone' ELSE '' END AS dst FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 WHERE p.p_name <> q.p_name)"""


def ancestors(spark, sf):
    return relations(spark, sf).filter(F.col("type") == "is_a").select(
        F.col("src").alias("concept_id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("dst").alias("ancestor_id")), F.struct(F.lit(1).alias("pos"), F.col("src").alias("ancestor_id")))).alias("x")
    ).groupBy("concept_id", "x.pos").agg(F.min("x.ancestor_id").alias("ancestor_id"))


_ANC = "anc AS (SELECT src AS concept_id, 0 AS pos, min(dst) AS ancestor_id FROM rel WHERE type = 'is_a' GROUP BY 1 UNION ALL SELECT DISTINCT src, 1, src FROM rel WHERE type = 'is_a')"


@query("ontology_context_join", f"""WITH {_RESOLVED}, {_REL}, {_ANC}, seen AS (SELECT DISTINCT doc_id, concept_id AS src FROM rs WHERE concept_id IS NOT NULL)
SELECT DISTINCT doc_id, seen.src, type, dst, CAST(0.7 AS DOUBLE) AS weight FROM seen JOIN rel USING (src) WHERE dst IN (SELECT id FROM c)
UNION SELECT doc_id, src, 'is_a', ancestor_id, CAST(0.85 AS DOUBLE) FROM seen JOIN anc ON anc.concept_id = src AND pos = 0 WHERE ancestor_id <> src AND ancestor_id IN (SELECT id FROM c)""")
def ontology_context_join(spark, sf):
    r = resolved(spark, sf).filter(F.col("concept_id").isNotNull())
    return O.ontology_context(r, concepts(spark, sf), relations(spark, sf), ancestors(spark, sf))


@query("key_consecutive_pairs", f"WITH {_REL}, {_ANC} SELECT a.concept_id, 1 AS pos, a.ancestor_id AS parent, b.ancestor_id AS child FROM anc a JOIN anc b ON b.concept_id = a.concept_id AND b.pos = a.pos + 1")
def key_consecutive_pairs(spark, sf):
    return O.key_pairs(ancestors(spark, sf))


@query("unobserved_related", f"""WITH {_RESOLVED}, {_REL}, s AS (SELECT doc_id % 97 AS doc_id, concept_id, min(doc_id) AS pos FROM rs WHERE concept_id IS NOT NULL GROUP BY 1, 2),
x AS (SELECT s.doc_id, dst AS concept_id, min(row(pos, type, dst)) AS p FROM s JOIN rel ON rel.src = s.concept_id GROUP BY 1, 2),
y AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = x.doc_id AND s.concept_id = x.concept_id)),
r AS (SELECT doc_id, concept_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank FROM y) SELECT doc_id, CAST(rank AS INTEGER) AS rank, concept_id FROM r WHERE rank <= 12""")
def unobserved_related(spark, sf):
    """Parts fall into 97 documents."""
    r = resolved(spark, sf).filter(F.col("concept_id").isNotNull()).groupBy((F.col("doc_id") % 97).alias("doc_id"), "concept_id").agg(F.min("doc_id").alias("pos"))
    return O.unobserved_related(r, relations(spark, sf))


@query("ontology_integrity", f"""WITH {_O}, {_REL}, {_ANC} SELECT 'dangling_relation' AS problem, src, type, dst FROM rel WHERE dst NOT IN (SELECT id FROM c)
UNION ALL SELECT 'dangling_ancestor', concept_id, 'ancestor', ancestor_id FROM anc WHERE ancestor_id <> concept_id AND ancestor_id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'reserved_relation', src, type, dst FROM rel WHERE type = 'method'""")
def ontology_integrity(spark, sf):
    return O.integrity(concepts(spark, sf), relations(spark, sf), ancestors(spark, sf))


# ---- rules ---------------------------------------------------------------------------------------


def facts(spark, sf):
    """Orders as documents: suppliers are methods, parts data sets, twice the quantity an accuracy."""
    li = S.table(spark, sf, "lineitem")
    doc = F.col("l_orderkey").cast("string")

    def rows(name, value):
        return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(name).alias("functor"), doc.alias("a"), value.cast("string").alias("b"))

    return rows("method", F.concat(F.lit("supplier:"), "l_suppkey")).unionByName(
        rows("dataset", F.concat(F.lit("part:"), "l_partkey"))
    ).unionByName(rows("accuracy", (F.col("l_quantity") * 2).cast("int"))).distinct()


_F = """fa AS (SELECT DISTINCT l_orderkey AS doc_id, 'method' AS functor, CAST(l_orderkey AS VARCHAR) AS a, 'supplier:' || l_suppkey AS b FROM lineitem
 UNION SELECT l_orderkey, 'dataset', CAST(l_orderkey AS VARCHAR), 'part:' || l_partkey FROM lineitem
 UNION SELECT l_orderkey, 'accuracy', CAST(l_orderkey AS VARCHAR), CAST(CAST(l_quantity * 2 AS INTEGER) AS VARCHAR) FROM lineitem),
cl AS (SELECT 'supplier:' || s_suppkey AS concept, 'nation:' || s_nationkey AS domain FROM supplier UNION SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


@query("belongs_to", f"WITH {_F} SELECT concept, domain FROM cl")
def belongs_to(spark, sf):
    return R.belongs_to(edges(spark, sf))


@query("accuracy_bands", f"WITH {_F} SELECT doc_id, b AS value, CASE WHEN CAST(b AS INT) > 95 THEN 'high' WHEN CAST(b AS INT) > 80 THEN 'moderate' ELSE 'low' END AS band FROM fa WHERE functor = 'accuracy'")
def accuracy_bands(spark, sf):
    return R.goal(facts(spark, sf), "accuracy").select("doc_id", F.col("b").alias("value"), R.accuracy_band(F.col("b").cast("double")).alias("band"))


@query("key_facts", f"WITH {_F} SELECT doc_id, functor AS type, b AS value FROM fa UNION SELECT doc_id, 'domain', domain FROM fa JOIN cl ON concept = b WHERE functor = 'method'")
def key_facts(spark, sf):
    return R.key_facts(facts(spark, sf), R.belongs_to(edges(spark, sf)))


@query("distinct_fact_types", f"WITH {_F}, k AS (SELECT doc_id, functor AS type FROM fa UNION SELECT doc_id, 'domain' FROM fa JOIN cl ON concept = b WHERE functor = 'method') SELECT doc_id, count(DISTINCT type) AS types, round(least(1.0, count(DISTINCT type) / 8.0), 6)::DOUBLE AS score FROM k GROUP BY 1")
def distinct_fact_types(spark, sf):
    k = R.key_facts(facts(spark, sf), R.belongs_to(edges(spark, sf))).select("doc_id", "type").distinct()
    n = k.groupBy("doc_id").agg(F.count("*").alias("types"))
    return n.withColumn("score", F.round(F.least(F.lit(1.0), F.col("types") / 8), 6))


@query("direct_evidence", f"WITH {_F} SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey IN (SELECT doc_id FROM fa WHERE functor = 'dataset')")
def direct_evidence(spark, sf):
    has = R.goal(facts(spark, sf), "dataset").select("doc_id")
    return S.owned_items(spark, sf).select(F.col("id").alias("doc_id")).join(has, "doc_id", "left_semi")


@query("same_dataset", f"WITH {_F}, s AS (SELECT b, count(*) - 1 AS peers FROM fa WHERE functor = 'dataset' GROUP BY 1) SELECT doc_id, fa.b AS shared, peers FROM fa JOIN s ON s.b = fa.b WHERE functor = 'dataset' AND peers > 0")
def same_dataset(spark, sf):
    """Documents per shared data set as group sizes; pairs exist for asked documents (next query)."""
    return R.peers(R.goal(facts(spark, sf), "dataset"))


@query("same_dataset_of", f"WITH {_F}, d AS (SELECT doc_id, b FROM fa WHERE functor = 'dataset') SELECT DISTINCT x.doc_id, y.doc_id AS other, x.b AS shared FROM d x JOIN d y ON y.b = x.b AND y.doc_id <> x.doc_id WHERE x.doc_id IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def same_dataset_of(spark, sf):
    asked = S.owned_items(spark, sf).filter(F.col("user_id") == 7).select(F.col("id").alias("doc_id"))
    return R.sharing_with(R.goal(facts(spark, sf), "dataset"), asked)


@query("same_domain", f"WITH {_F}, d AS (SELECT DISTINCT doc_id, domain FROM fa JOIN cl ON concept = b WHERE functor = 'method'), s AS (SELECT domain, count(*) - 1 AS peers FROM d GROUP BY 1) SELECT doc_id, domain AS shared, peers FROM d JOIN s USING (domain) WHERE peers > 0")
def same_domain(spark, sf):
    methods = R.goal(facts(spark, sf), "method").join(R.belongs_to(edges(spark, sf)), F.col("b") == F.col("concept"))
    return R.peers(methods.select("doc_id", "domain"), "domain")


@query("outperforms", f"WITH {_F}, v AS (SELECT doc_id, CAST(b AS DOUBLE) AS value FROM fa WHERE functor = 'accuracy') SELECT doc_id, value, CAST(rank() OVER (ORDER BY value) - 1 AS BIGINT) AS outperforms FROM v")
def outperforms(spark, sf):
    v = R.goal(facts(spark, sf), "accuracy").select("doc_id", F.col("b").cast("double").alias("value"))
    return R.outperformed(v)


@query("outperforms_of", f"""WITH {_F}, v AS (SELECT doc_id, CAST(b AS DOUBLE) AS value FROM fa WHERE functor = 'accuracy')
SELECT DISTINCT x.doc_id, y.doc_id AS other FROM v x JOIN v y ON y.value < x.value AND y.doc_id <> x.doc_id WHERE x.doc_id IN (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)""")
def outperforms_of(spark, sf):
    """Pairs for one asked document: the first order of customer 7."""
    v = R.goal(facts(spark, sf), "accuracy").select("doc_id", F.col("b").cast("double").alias("value"))
    asked = S.owned_items(spark, sf).filter(F.col("user_id") == 7).agg(F.min("id").alias("doc_id"))
    return R.outperforms(v, asked)


@query("recommended_baseline", f"WITH {_F}, r AS (SELECT 'supplier:' || s_suppkey AS b, 'supplier:' || ((s_suppkey + 1) % 10) AS baseline FROM supplier) SELECT DISTINCT doc_id, baseline FROM fa JOIN r USING (b) WHERE functor = 'method'")
def recommended_baseline(spark, sf):
    near = S.table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.lit("related_to").alias("type"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 1) % 10).alias("dst")
    )
    return R.recommended_baseline(facts(spark, sf), near)


@query("domain_membership", f"WITH {_F} SELECT DISTINCT doc_id, domain FROM fa JOIN cl ON concept = b WHERE functor = 'method' AND domain LIKE 'region:%'")
def domain_membership(spark, sf):
    wanted = nodes(spark, sf).filter(F.col("type") == "region").select(F.col("id").alias("domain"))
    return R.in_domain(facts(spark, sf), R.belongs_to(edges(spark, sf)), wanted)


@query("explains_domain", f"WITH {_F} SELECT DISTINCT doc_id, b AS method, 'nation:' || s_nationkey AS domain FROM fa JOIN supplier ON b = 'supplier:' || s_suppkey WHERE functor = 'method'")
def explains_domain(spark, sf):
    return R.explains_domain(facts(spark, sf), edges(spark, sf))


@query("goal_query", f"WITH {_F} SELECT doc_id, b FROM fa WHERE functor = 'method' AND b = 'supplier:3'")
def goal_query(spark, sf):
    return R.goal(facts(spark, sf), "method", b="supplier:3").select("doc_id", "b")


def proof_base(spark, sf):
    """Order facts and the relations between suppliers, nations and regions, as (functor, args); some accuracies are not known."""
    own = facts(spark, sf).select("functor", F.array("a", F.when((F.col("functor") != "accuracy") | (F.col("doc_id") % 5 != 0), F.col("b"))).alias("args")).distinct()
    rel = edges(spark, sf).filter(F.col("type").isin("is_a", "part_of")).select(F.col("type").alias("functor"), F.array("src", "dst").alias("args"))
    return V.Base(own.unionByName(rel))


_P = f"""{_F}, st AS (SELECT DISTINCT functor, a, CASE WHEN functor <> 'accuracy' OR doc_id % 5 <> 0 THEN b END AS b FROM fa),
cp AS (SELECT 'supplier:' || s_suppkey AS concept, 'nation:' || s_nationkey AS domain, ['is_a(supplier:' || s_suppkey || ', nation:' || s_nationkey || ')'] AS proof FROM supplier
 UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, ['is_a(supplier:' || s_suppkey || ', nation:' || s_nationkey || ')', 'part_of(nation:' || n_nationkey || ', region:' || n_regionkey || ')'] FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, ['part_of(nation:' || n_nationkey || ', region:' || n_regionkey || ')'] FROM nation)"""


@query(
    "goal_proofs",
    f"""WITH {_P}, j AS (SELECT a AS paper, domain, list_sort(list_concat(['method(' || a || ', ' || b || ')'], proof)) AS proof FROM st JOIN cp ON concept = b WHERE functor = 'method'),
m AS (SELECT paper, domain, min(row(len(proof), proof)) AS p FROM j GROUP BY 1, 2)
SELECT paper, domain, array_to_string(struct_extract(p, 2), '; ') AS evidence, 'Paper = ' || paper || ', Domain = ' || domain || ' — derived from: ' || array_to_string(struct_extract(p, 2), ', ') AS explanation FROM m""",
)
def goal_proofs(spark, sf):
    """Which domain every order's methods belong to, with the facts that show it."""
    found = proof_base(spark, sf).solve(V.atom("key_fact", V.Var("Paper"), "domain", V.Var("Domain")))
    return found.select(F.col("bindings")["Paper"].alias("paper"), F.col("bindings")["Domain"].alias("domain"), F.array_join("evidence", "; ").alias("evidence"), "explanation")


@query(
    "goal_confidence",
    f"""WITH {_P} SELECT 'belongs_to(Concept, region:1)' AS goal, count(*) AS answers, CAST(0.7 AS DOUBLE) AS confidence FROM cp WHERE domain = 'region:1'
 UNION ALL SELECT 'method(Paper, supplier:3)', count(*), 1.0 FROM st WHERE functor = 'method' AND b = 'supplier:3'
 UNION ALL SELECT 'accuracy(Paper, Value)', count(*), 0.4 FROM st WHERE functor = 'accuracy'
 UNION ALL SELECT 'high_accuracy(Paper)', count(DISTINCT a), 0.7 FROM st WHERE functor = 'accuracy' AND CAST(b AS DOUBLE) > 95
 UNION ALL SELECT 'solves(Paper, Value)', 0, 0.0""",
)
def goal_confidence(spark, sf):
    """Bound, open and unanswered goals over facts and rules."""
    base, paper = proof_base(spark, sf), V.Var("Paper")
    goals = [V.atom("belongs_to", V.Var("Concept"), "region:1"), V.atom("method", paper, "supplier:3"), V.atom("accuracy", paper, V.Var("Value")), V.atom("high_accuracy", paper), V.atom("solves", paper, V.Var("Value"))]
    found = None
    for goal in goals:
        row = V.goal_confidence(base.solve(goal), goal)
        found = row if found is None else found.unionByName(row)
    return found


@query("answer_confidence", f"WITH {_F}, c AS (SELECT functor, count(*) AS answers FROM fa GROUP BY 1 UNION ALL SELECT 'belongs_to', count(*) FROM cl UNION ALL SELECT 'solves', 0) SELECT functor, answers, CAST(CASE WHEN answers = 0 THEN 0 WHEN functor = 'belongs_to' THEN 0.7 ELSE 1 END AS DOUBLE) AS confidence FROM c")
def answer_confidence(spark, sf):
    f = facts(spark, sf).groupBy("functor").agg(F.count("*").alias("answers"))
    rules = R.belongs_to(edges(spark, sf)).agg(F.count("*").alias("answers")).select(F.lit("belongs_to").alias("functor"), "answers")
    none = R.goal(facts(spark, sf), "solves").agg(F.count("*").alias("answers")).select(F.lit("solves").alias("functor"), "answers")
    return f.unionByName(rules).unionByName(none).withColumn("confidence", R.answer_confidence(F.col("functor"), F.col("answers"), F.lit(True)))


@query("fact_evidence_join", f"WITH {_F} SELECT doc_id, b AS value, functor, a, b FROM fa WHERE functor = 'method'")
def fact_evidence_join(spark, sf):
    answers = R.goal(facts(spark, sf), "method").select("doc_id", F.col("b").alias("value"))
    return R.fact_evidence(answers, facts(spark, sf))


@query("build_graph_texts")
def build_graph_texts(spark, sf):
    """Edges of the claim and concept graph of every document."""
    n, e = _graph(spark, sf)
    return e.select("doc_id", "src", "type", "dst", F.round("weight", 6).alias("weight"))


def _graph(spark, sf):
    from lectern.operators import claims as C
    from lectern.operators import nlp
    from lectern.plans.claim_queries import validated

    docs = nlp.with_key_phrases(validated(spark, sf)).withColumn("phrases", F.transform("phrases", lambda p: p["value"]))
    docs = cut(docs.select("doc_id", F.filter("claims", C.is_valid).alias("claims"), nlp.concept_candidates(F.col("sentences"), F.col("phrases"), 30).alias("concepts")))
    claims = docs.select("doc_id", F.inline("claims")).withColumn("evidence_id", F.concat(F.lit("evidence-"), F.col("sent_no").cast("string")))
    found = docs.select("doc_id", F.posexplode("concepts").alias("rank", "c")).select("doc_id", "rank", "c.norm", "c.term", "c.score").withColumn("concept_id", F.lit(None).cast("string")).withColumn("label", F.lit(None).cast("string"))
    return G.build_graph(claims, found)


def cut(df):
    from lectern.session import cut_lineage

    return cut_lineage(df)


def ontology_graph(spark, sf):
    """Parts as documents: their shipments are claims about suppliers, their own names the concepts of an ontology."""
    li = S.table(spark, sf, "lineitem")
    claims = li.select(
        F.col("l_partkey").alias("doc_id"), F.concat_ws("-", F.lit("c"), "l_orderkey", "l_linenumber").alias("id"),
        F.when(F.col("l_returnflag") == "A", "method").when(F.col("l_returnflag") == "N", "metric").otherwise("result").alias("type"), F.concat(F.lit("Supplier "), "l_suppkey").alias("object"),
        F.col("l_quantity").alias("value"), F.lit("accuracy").alias("metric"), F.lit(0.5).alias("confidence"), F.lit("e").alias("evidence_id"),
    )
    labels = concepts(spark, sf)
    named = resolved(spark, sf).join(labels.select(F.col("id").alias("concept_id"), "label"), "concept_id", "left")
    named = named.select("doc_id", F.lit(0).alias("rank"), F.lower("term").alias("norm"), "term", F.lit(0.4).alias("score"), "concept_id", "label")
    # Terms are resolved once; papers, nodes, edges and context all read them.
    named = stored(named, "resolved")
    rel = relations(spark, sf)
    return G.build_graph(claims, named, (labels, rel, O.ancestor_chains(rel)))


_CHAIN = """p AS (SELECT src AS c, min(dst) AS a FROM rel WHERE type = 'is_a' GROUP BY 1),
wk AS (SELECT c, a, 1 AS d, [c] AS seen FROM p UNION ALL SELECT wk.c, p.a, d + 1, list_append(seen, wk.a) FROM wk JOIN p ON p.c = wk.a WHERE NOT list_contains(seen, p.a) AND p.a <> wk.a),
ch AS (SELECT c AS concept_id, a AS ancestor_id, max(d) OVER (PARTITION BY c) - d AS pos FROM wk UNION ALL SELECT c, c, max(d) FROM wk GROUP BY 1)"""
_OG = f"""WITH RECURSIVE {_RESOLVED}, {_REL}, {_CHAIN},
cl AS (SELECT DISTINCT l_partkey AS doc_id, 'paper:' || l_partkey AS paper, 'claim:c-' || l_orderkey || '-' || l_linenumber AS claim, CASE l_returnflag WHEN 'A' THEN 'method' WHEN 'N' THEN 'metric' ELSE 'result' END AS kind,
 CASE l_returnflag WHEN 'A' THEN 'uses' ELSE 'reports' END AS edge, 'supplier_' || l_suppkey AS slug FROM lineitem),
sl AS (SELECT doc_id, concept_id, CASE WHEN concept_id IS NULL THEN 'local-' || trim(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), '_') ELSE concept_id END AS name FROM rs),
sn AS (SELECT DISTINCT doc_id, concept_id FROM rs WHERE concept_id IS NOT NULL),
g AS (SELECT doc_id, paper AS src, edge AS type, claim AS dst, CAST(0.5 AS DOUBLE) AS weight FROM cl UNION SELECT doc_id, paper, edge, kind || ':' || slug, 0.5 FROM cl WHERE kind <> 'result'
 UNION SELECT doc_id, claim, 'supports', kind || ':' || slug, 0.5 FROM cl WHERE kind <> 'result' UNION SELECT doc_id, 'paper:' || doc_id, 'mentions', 'concept:' || name, 0.4 FROM sl
 UNION SELECT doc_id, 'concept:' || src, type, 'concept:' || dst, 0.7 FROM sn JOIN rel ON src = concept_id WHERE dst IN (SELECT id FROM c)
 UNION SELECT doc_id, 'concept:' || y.ancestor_id, 'is_a', 'concept:' || x.ancestor_id, 0.85 FROM sn JOIN ch x ON x.concept_id = sn.concept_id JOIN ch y ON y.concept_id = x.concept_id AND y.pos = x.pos + 1 WHERE x.ancestor_id IN (SELECT id FROM c)),
k AS (SELECT doc_id, src, type, dst, CAST(min(weight) AS DOUBLE) AS weight FROM g GROUP BY 1, 2, 3, 4)"""


@query("ancestor_chains", f"WITH RECURSIVE {_REL}, {_CHAIN} SELECT concept_id, CAST(pos AS INTEGER) AS pos, ancestor_id FROM ch")
def ancestor_chains(spark, sf):
    return O.ancestor_chains(relations(spark, sf))


@query("build_graph", f"{_OG} SELECT doc_id, src, type, dst, weight FROM k")
def build_graph(spark, sf):
    """Edges of every part's graph: claims, mentions, and what the ontology adds to a concept it knows."""
    _, e = ontology_graph(spark, sf)
    best = e.groupBy("doc_id", "src", "type", "dst").agg(F.min("weight").alias("weight"))
    return best.select("doc_id", "src", "type", "dst", F.round("weight", 6).alias("weight"))


@query(
    "graph_to_facts",
    f"""{_OG}, ft AS (SELECT DISTINCT doc_id, 'paper' AS functor, CAST(doc_id AS VARCHAR) AS args FROM (SELECT doc_id FROM cl UNION SELECT doc_id FROM rs)
 UNION SELECT doc_id, 'mentions', doc_id || ',' || substr(dst, 9) FROM k WHERE type = 'mentions'
 UNION SELECT doc_id, CASE WHEN type IN ('method', 'claim', 'paper') THEN 'concept_' || type ELSE type END, substr(src, 9) || ',' || substr(dst, 9) FROM k WHERE src LIKE 'concept:%' AND substr(src, 9) <> substr(dst, 9))
SELECT doc_id, functor, args FROM ft""",
)
def graph_to_facts(spark, sf):
    """Papers, mentions and concept relations of these graphs as facts."""
    n, e = ontology_graph(spark, sf)
    kept = e.filter((F.col("type") == "mentions") | F.col("src").startswith("concept:"))
    return G.graph_to_facts(n, kept).select("doc_id", "functor", F.array_join("args", ",").alias("args"))


@query("graph_to_facts_texts")
def graph_to_facts_texts(spark, sf):
    n, e = _graph(spark, sf)
    return G.graph_to_facts(n, e).select("doc_id", "functor", F.array_join("args", ",").alias("args"))

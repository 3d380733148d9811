"""Walks over one graph per customer: orders, their suppliers, and the parts those suppliers ship."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import walks as W
from lectern.plans.registry import query
from lectern.session import stored
from lectern.sources import tables as S


def graphs(spark, sf, every=False):
    """(nodes, edges): order uses supplier, supplier ships part; every customer's first order is its document node.

    Orders later than the first have a node of their own even without lines. Unless ``every`` line is asked for, only a
    customer's third of the suppliers takes part, so some graphs fall apart.
    """
    o = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("key"))
    li = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_suppkey", "l_partkey").join(o, "key")
    order = F.concat(F.lit("order:"), F.lpad(F.col("key").cast("string"), 9, "0"))
    supplier, part = F.concat(F.lit("supplier:"), "l_suppkey"), F.concat(F.lit("part:"), "l_partkey")
    # Nodes, edges and starts all come from this join, and a walk reads each of them more than once: it is written once, as numbers.
    used = stored(li if every else li.filter(F.col("l_suppkey") % 3 == F.col("doc_id") % 3), "used")
    edges = used.select("doc_id", order.alias("src"), supplier.alias("dst")).unionByName(used.select("doc_id", supplier.alias("src"), part.alias("dst")))
    first = o.groupBy("doc_id").agg(F.min("key").alias("first"))
    own = o.join(first, "doc_id").select(
        "doc_id", order.alias("id"), F.when((F.col("key") == F.col("first")) & (F.col("doc_id") % 2 == 0), "paper").otherwise("order").alias("type"), F.col("key").alias("pos"), F.upper(order).alias("label")
    )
    ends = edges.select("doc_id", F.col("dst").alias("id")).distinct()
    other = ends.select("doc_id", "id", F.substring_index("id", ":", 1).alias("type"), (10**9 + F.substring_index("id", ":", -1).cast("long")).alias("pos"), F.upper("id").alias("label"))
    return own.unionByName(other), edges


_G = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS key, 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id FROM orders),
few AS (SELECT doc_id, id, 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS p FROM o JOIN lineitem ON l_orderkey = key WHERE l_suppkey % 3 = doc_id % 3),
e AS (SELECT DISTINCT doc_id, id AS src, s AS dst FROM few UNION SELECT doc_id, s, p FROM few),
b AS (SELECT doc_id, src AS node, dst AS other FROM e UNION SELECT doc_id, dst, src FROM e),
f AS (SELECT doc_id, min(id) AS start FROM o GROUP BY 1),
n AS (SELECT doc_id, id, CASE WHEN id = start AND doc_id % 2 = 0 THEN 'paper' ELSE 'order' END AS type, key AS pos FROM o JOIN f USING (doc_id)
 UNION ALL SELECT DISTINCT doc_id, dst, split_part(dst, ':', 1), 1000000000 + CAST(split_part(dst, ':', 2) AS BIGINT) FROM e)"""
# A line without a supplier has no edge.
_EVERY = _G.replace("WHERE l_suppkey % 3 = doc_id % 3", "WHERE l_suppkey IS NOT NULL")


@query(
    "bfs_documents",
    f"""WITH RECURSIVE {_EVERY}, w AS (SELECT doc_id, start AS node, 0 AS distance FROM f UNION SELECT w.doc_id, b.other, w.distance + 1 FROM w JOIN b ON b.doc_id = w.doc_id AND b.node = w.node WHERE w.distance < 3)
SELECT doc_id, node, min(distance) AS distance FROM w GROUP BY 1, 2""",
)
def bfs_documents(spark, sf):
    """Everything within three steps of each customer's first order, over all their lines."""
    nodes, edges = graphs(spark, sf, every=True)
    starts = nodes.filter(F.col("id").startswith("order:")).groupBy("doc_id").agg(F.min("id").alias("id"))
    return W.bfs(nodes, edges, starts, 3)


@query(
    "shortest_path_documents",
    f"""WITH RECURSIVE {_G}, g AS (SELECT doc_id, max(id) AS goal FROM o GROUP BY 1),
w AS (SELECT doc_id, start AS node, 0 AS length, start AS path FROM f UNION ALL
 SELECT doc_id, other, length + 1, min(path || '>' || other) FROM (SELECT w.doc_id, b.other, w.length, w.path FROM w JOIN b ON b.doc_id = w.doc_id AND b.node = w.node WHERE w.length < 4 AND NOT contains(w.path || '>', b.other || '>')) GROUP BY ALL),
h AS (SELECT w.doc_id, length, path, row_number() OVER (PARTITION BY w.doc_id ORDER BY length, path) AS rn FROM w JOIN g ON g.doc_id = w.doc_id AND goal = node)
SELECT doc_id, path, upper(path) AS labels, length FROM h WHERE rn = 1""",
)
def shortest_path_documents(spark, sf):
    """From each customer's first order to the last, where four steps lead there."""
    nodes, edges = graphs(spark, sf)
    orders = nodes.filter(F.col("id").startswith("order:"))
    asked = orders.groupBy("doc_id").agg(F.min("id").alias("start"), F.max("id").alias("goal"))
    found = W.shortest_path(nodes, edges, asked).filter(F.col("length") <= 4)
    return found.select("doc_id", F.array_join("path", ">").alias("path"), F.array_join("labels", ">").alias("labels"), "length")


@query(
    "connected_components_documents",
    f"""WITH RECURSIVE {_G}, w AS (SELECT doc_id, id AS node, id AS root FROM n UNION SELECT w.doc_id, b.other, w.root FROM w JOIN b ON b.doc_id = w.doc_id AND b.node = w.node WHERE b.other > w.root)
SELECT doc_id, node, min(root) AS component FROM (SELECT * FROM w UNION ALL SELECT DISTINCT w.doc_id, w.node, v.root FROM w JOIN w v ON v.doc_id = w.doc_id AND v.node = w.root) GROUP BY 1, 2""",
)
def connected_components_documents(spark, sf):
    return W.connected_components(*graphs(spark, sf))


@query(
    "layer_levels_documents",
    f"""WITH RECURSIVE {_G}, t AS (SELECT doc_id, bool_or(type = 'paper') AS rooted FROM n GROUP BY 1),
r AS (SELECT doc_id, id FROM n JOIN t USING (doc_id) WHERE CASE WHEN rooted THEN type = 'paper' ELSE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = n.doc_id AND e.dst = n.id) END),
w AS (SELECT doc_id, id AS node, 0 AS level FROM r UNION SELECT w.doc_id, e.dst, w.level + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.src = w.node),
l AS (SELECT doc_id, node, min(level) AS level FROM w GROUP BY 1, 2), d AS (SELECT doc_id, max(level) AS deepest FROM l GROUP BY 1),
x AS (SELECT n.doc_id, n.id, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.pos, n.id) AS place FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = n.doc_id AND l.node = n.id))
SELECT doc_id, node, level FROM l UNION ALL SELECT doc_id, x.id, CAST(deepest + place AS INTEGER) FROM x JOIN d USING (doc_id)""",
)
def layer_levels_documents(spark, sf):
    return W.layer_levels(*graphs(spark, sf))

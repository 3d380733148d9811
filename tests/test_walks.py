"""Per-document graph walks: rows and frontier joins against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lectern.operators import walks

NODES = "doc_id long, id string, type string, pos long, label string"
EDGES = "doc_id long, src string, dst string"


def random_graphs(seed, docs=12):
    rng = random.Random(seed)
    nodes, edges = [], []
    for d in range(docs):
        names = [f"{rng.choice('nmé')}{k}" for k in range(rng.randint(1, 14))]
        nodes += [(d, n, "paper" if d % 3 == 0 and k < 2 else "x", rng.randint(0, 3), None if k % 4 == 0 else n.upper()) for k, n in enumerate(names)]
        edges += [(d, rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 14))]
    edges += [(2, "outside", "n0"), (2, "outside", "beyond"), (50, "a", "b"), (3, None, "n1"), (3, "n1", None)]
    return [*nodes, nodes[0], (60, None, "x", 0, None)], [*edges, *edges[:5]]


class Plain:
    def __init__(self, nodes, edges):
        self.ids, self.near, self.edges = {}, {}, {}
        for d, i, *_ in nodes:
            if i is not None:
                self.ids.setdefault(d, set()).add(i)
        for d, a, b in edges:
            if a is not None and b is not None:
                self.ids.setdefault(d, set()).update((a, b))
                self.near.setdefault((d, a), set()).add(b)
                self.near.setdefault((d, b), set()).add(a)
                self.edges.setdefault(d, []).append((a, b))

    def steps(self, d, start, most=None):
        found = {start: 0} if start in self.ids.get(d, ()) else {}
        queue = deque(found)
        while queue:
            n = queue.popleft()
            for m in self.near.get((d, n), ()) if most is None or found[n] < most else ():
                if m not in found:
                    found[m] = found[n] + 1
                    queue.append(m)
        return found

    def path(self, d, start, goal):
        steps = self.steps(d, goal)
        if start not in steps:
            return None
        way = [start]
        while way[-1] != goal:
            way.append(min(m for m in self.near[d, way[-1]] if steps.get(m) == steps[way[-1]] - 1))
        return way


@pytest.fixture(params=[1, 2])
def graphs(spark, request):
    nodes, edges = random_graphs(request.param)
    return spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(edges, EDGES).repartition(3), Plain(nodes, edges), nodes


@pytest.mark.parametrize("in_row", [0, 9, 10**6])
def test_bfs(spark, graphs, in_row):
    nodes, edges, plain, rows = graphs
    starts = {d: sorted(i)[0] for d, i in plain.ids.items() if d != 5} | {5: "missing"}
    asked = spark.createDataFrame(list(starts.items()), "doc_id long, id string")
    for most in (None, 2):
        got = sorted(tuple(r) for r in walks.bfs(nodes, edges, asked, most, in_row).collect())
        assert got == sorted((d, n, k) for d, s in starts.items() for n, k in plain.steps(d, s, most).items())


@pytest.mark.parametrize("in_row", [0, 9, 10**6])
def test_shortest_path(spark, graphs, in_row):
    nodes, edges, plain, rows = graphs
    pairs = {d: (sorted(i)[0], sorted(i)[-1]) for d, i in plain.ids.items()} | {4: ("missing", "n0"), 6: (None, "n0")}
    asked = spark.createDataFrame([(d, *p) for d, p in pairs.items()], "doc_id long, start string, goal string")
    labels = {(d, i): lab or i for d, i, _, _, lab in rows}
    want = {d: way for d, p in pairs.items() if (way := plain.path(d, *p)) is not None}
    got = walks.shortest_path(nodes, edges, asked, in_row).collect()
    assert {r["doc_id"]: r["path"] for r in got} == want and len(got) == len(want)
    assert all(r["labels"] == [labels.get((r["doc_id"], n), n) for n in r["path"]] and r["length"] == len(r["path"]) - 1 for r in got)


@pytest.mark.parametrize("in_row", [0, 9, 10**6])
def test_connected_components(graphs, in_row):
    nodes, edges, plain, _ = graphs
    got = sorted(tuple(r) for r in walks.connected_components(nodes, edges, in_row).collect())
    assert got == sorted((d, n, min(plain.steps(d, n))) for d, ids in plain.ids.items() for n in ids)


@pytest.mark.parametrize("in_row", [0, 9, 10**6])
def test_layer_levels(graphs, in_row):
    nodes, edges, plain, rows = graphs
    want = []
    for d in {r[0] for r in rows}:
        own = {}
        for _, i, kind, pos, _ in (r for r in rows if r[0] == d and r[1] is not None):
            place, root = own.get(i, ((9, i), False))
            own[i] = min(place, (pos, i)), root or kind == "paper"
        order = sorted(own, key=lambda i: own[i][0])
        links = [(a, b) for a, b in plain.edges.get(d, ()) if a in own and b in own]
        roots = [i for i in own if own[i][1]] or [i for i in own if i not in {b for _, b in links}] or order[:1]
        level = dict.fromkeys(roots, 0)
        queue = deque(roots)
        while queue:
            n = queue.popleft()
            for a, b in links:
                if a == n and b not in level:
                    level[b] = level[n] + 1
                    queue.append(b)
        deepest = max(level.values(), default=0)
        rest = [i for i in order if i not in level]
        want += [(d, n, k) for n, k in (level | {n: deepest + 1 + k for k, n in enumerate(rest)}).items()]
    assert sorted(tuple(r) for r in walks.layer_levels(nodes, edges, "paper", in_row).collect()) == sorted(want)


def test_a_long_chain_and_no_graphs(spark):
    chain = spark.createDataFrame([(1, f"n{k:05}", f"n{k + 1:05}") for k in range(3000)], EDGES)
    nodes = spark.createDataFrame([], NODES)
    asked = spark.createDataFrame([(1, "n00000", "n03000")], "doc_id long, start string, goal string")
    assert walks.shortest_path(nodes, chain, asked).first()["length"] == 3000
    assert walks.connected_components(nodes, chain).select(F.countDistinct("component")).first()[0] == 1
    none = chain.limit(0)
    assert walks.bfs(nodes, none, asked.select("doc_id", F.col("start").alias("id"))).count() == 0
    assert walks.layer_levels(nodes, none).count() == walks.connected_components(nodes, none).count() == 0

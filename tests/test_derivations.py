"""Rules with proofs, running sums, pairs and pages against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import derivations as V
from lectern.operators import facts as R
from lectern.operators import listings, prefix

X, Y, Z = V.Var("X"), V.Var("Y"), V.Var("Z")


def base(spark, rows, rules=V.RULES):
    return V.Base(spark.createDataFrame(rows, "functor string, args array<string>"), rules)


def answers(df):
    return sorted((tuple(sorted(r["bindings"].items(), key=str)), r["evidence"]) for r in df.collect())


def test_recursion_proofs_and_cycles(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)}
    own = base(spark, [("is_a", list(p)) for p in pairs])
    want = {p: [f"is_a({p[0]}, {p[1]})"] for p in pairs}
    while True:
        fresh = {(a, d): 1 for a, b in pairs for c, d in want if b == c and (a, d) not in want}
        if not fresh:
            break
        want |= {p: None for p in fresh}
    got = {(dict(b)["X"], dict(b)["Y"]): e for b, e in answers(own.solve(V.atom("belongs_to", X, Y)))}
    assert set(got) == set(want)
    for (a, b), proof in got.items():  # every proof is a chain from a to b, the first step being the shortest known
        steps = {tuple(f[5:-1].split(", ")) for f in proof}
        assert steps <= pairs and (len(steps) > 1 or steps == {(a, b)})
        reached = {a}
        for _ in steps:
            reached |= {d for c, d in steps if c in reached}
        assert b in reached
    closed = R.belongs_to(spark.createDataFrame([(a, "part_of", b) for a, b in pairs], "src string, type string, dst string"))
    assert {tuple(r) for r in closed.collect()} == set(want)


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(f"n{k}", "is_a", f"n{k + 1}") for k in range(40)], "src string, type string, dst string")
    assert R.belongs_to(chain).count() == 40 * 41 // 2
    assert R.belongs_to(chain.limit(0)).count() == 0


def test_goals(spark):
    rows = [
        ("method", ["p1", "cnn"]), ("method", ["p2", "svm"]), ("method", ["p1", "net"]), ("is_a", ["cnn", "net"]), ("is_a", ["net", "ml"]), ("part_of", ["svm", "ml"]),
        ("dataset", ["p1", "d"]), ("dataset", ["p2", "d"]), ("dataset", ["p3", "e"]), ("accuracy", ["p1", "96"]), ("accuracy", ["p2", None]), ("accuracy", ["p3", "81.5"]), ("pair", ["k", "k"]), ("pair", ["k", "j"]),
        ("paper", ["p1"]), ("short", []),
    ]
    own = base(spark, rows)
    assert answers(own.solve(V.atom("key_fact", V.P, "domain", "ml"))) == [((("Paper", "p1"),), ["is_a(net, ml)", "method(p1, net)"]), ((("Paper", "p2"),), ["method(p2, svm)", "part_of(svm, ml)"])]
    assert answers(own.solve(V.atom("same_dataset", "p1", Y))) == [((("Y", "p2"),), ["dataset(p1, d)", "dataset(p2, d)"])]
    assert [b for b, _ in answers(own.solve(V.atom("pair", X, X)))] == [(("X", "k"),)]
    assert [r["explanation"] for r in own.solve(V.atom("high_accuracy", X)).collect()] == ["X = p1 — derived from: accuracy(p1, 96)"]
    assert [r["explanation"] for r in own.solve(V.atom("paper", "p1")).collect()] == ["goal satisfied — derived from: paper(p1)"]
    assert answers(own.solve(V.atom("moderate_accuracy", X))) == [((("X", "p3"),), ["accuracy(p3, 81.5)"])]
    for goal, n, score in [
        (V.atom("accuracy", X, Y), 3, 0.4), (V.atom("accuracy", X, "96"), 1, 1.0), (V.atom("paper", "p1"), 1, 1.0), (V.atom("belongs_to", X, "ml"), 3, 0.7), (V.atom("solves", X, Y), 0, 0.0), (V.atom("short", X), 0, 0.0),
    ]:
        assert tuple(V.goal_confidence(own.solve(goal), goal).first())[1:] == (n, score), goal


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_sums(spark, partitions):
    rng = random.Random(1)
    rows = sorted({(rng.randrange(500), rng.choice("ab"), rng.randrange(50)) for _ in range(300)}, key=lambda r: r[:2])
    rows = [r for k, r in enumerate(rows) if k == 0 or r[:2] != rows[k - 1][:2]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = prefix.running_sum(spark.createDataFrame(random.sample(rows, len(rows)), "k long, s string, n long"), ["k", "s"], "n")
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(*r, sum(x[2] for x in rows[:k])) for k, r in enumerate(rows)]
    assert prefix.running_sum(df.select("k", "s", "n").limit(0), ["k", "s"], "n").count() == 0


def test_outperforming(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice([0.5, 1.0, 7.25, rng.uniform(0, 99)])) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, value double")
    assert sorted(tuple(r) for r in R.outperformed(df).collect()) == sorted((d, v, sum(w < v for _, w in rows)) for d, v in rows)
    asked = spark.createDataFrame([(1,), (2,), (99,)], "doc_id long")
    want = {(d, e) for d, v in rows for e, w in rows if d in (1, 2) and w < v and d != e}
    found = [tuple(r) for r in R.outperforms(df, asked).collect()]
    assert set(found) == want and len(found) == len(want)
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "doc_id long, value double")
    assert R.outperforms(same, asked).count() == 0


def test_pages_by_seek(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2, 2, 3]), rng.choice([None, "a", "b"])) for k in range(95)]
    df = spark.createDataFrame(rows, "id long, score int, name string").repartition(4)
    for order in ([("score", True), ("id", False)], [("name", False), ("score", True), ("id", True)]):
        want = [tuple(r) for r in df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).collect()]
        got, last, pages = [], None, 0
        while pages == 0 or last is not None:
            page = listings.seek(df, order, last, 20)
            got += [tuple(r) for r in page.collect()]
            last, pages = listings.page_token(page, order, 20), pages + 1
        assert got == want and pages == 5


def test_a_deep_page_is_filtered_at_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS score").write.parquet(str(tmp_path / "t"))
    page = listings.seek(spark.read.parquet(str(tmp_path / "t")), [("score", True), ("id", False)], {"score": 2, "id": 500}, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThanOrEqual(score,2)" in plan.replace(" ", "")

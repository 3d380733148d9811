"""Own small texts with known results."""

import random

import pytest

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import claims as C
from lectern.operators import cleaning, concepts, finance, graph, grounding, nlp, ontology, sections, study, titles
from lectern.streaming import flow, progress, rate_limit

PAPER = """Estimating Residual Defects With Causal Models In Consumer Products

Abstract
Managers lack a reliable way to estimate residual defects and this problem delays releases. We present a Bayesian Network (BN) approach built with AgenaRisk.

1 Introduction
The problem of software defect prediction is hard because data is scarce for most teams. A regression model is a common baseline in many earlier studies.

6.2 Evaluation
We selected 32 software projects and assessed each of them with the trained model. The results confirm a 95% correlation between predicted and actual defects. We found a 10-20% inaccuracy achieved on 75% of projects during the trial.

7 Conclusion
The limitation of this study is that it could not include maintenance data. Future work will extend the causal model to agile teams.

References
[1] Somebody, A paper, 2001.
"""


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def analysed(spark, text):
    from lectern.plans.analysis import analyse

    return analyse(spark.createDataFrame([(1, text)], "doc_id bigint, raw_text string"))


def test_paper(spark):
    row = analysed(spark, PAPER).select("claims", "analysis_text", C.headline(F.filter("claims", C.is_valid)).alias("h")).first()
    by_type = {}
    for c in row["claims"]:
        by_type.setdefault(c["type"], []).append(c)
    assert by_type["sample"][0]["value"] == 32
    assert {c["value"] for c in by_type["result"]} == {95.0, 75.0}
    assert by_type["result"][0]["metric"] == "correlation" or by_type["result"][1]["metric"] == "correlation"
    assert row["h"]["accuracy"] is None and row["h"]["dataset"] is None
    assert "bayesian network" in {c["object"].lower() for c in by_type["method"]}
    assert by_type["tool"][0]["object"] == "AgenaRisk"
    assert "limitation" in by_type and "future_work" in by_type
    assert "Somebody" not in row["analysis_text"]


def test_sections(spark):
    heads = [s["heading"] for s in analysed(spark, PAPER).select("sections").first()["sections"]]
    assert "Abstract" in heads and "6.2 Evaluation" in heads and "7 Conclusion" in heads


def test_running_header_pages(spark):
    pages = ["Case Title Here\nFirst page text goes on.\n1", "Case Title Here\nSecond page text goes on.\n2", "Case Title Here\nThird page ends.\n- 3 -"]
    docs = spark.createDataFrame([(1, "\f".join(pages))], "doc_id bigint, raw_text string")
    row = cleaning.clean_documents(docs).select("display_text", "stats", "source_pages").first()
    assert row["display_text"].count("Case Title Here") == 1
    assert row["stats"]["headers"] == 2 and row["stats"]["page_numbers"] == 3
    assert [p["page_no"] for p in row["source_pages"]] == [1, 2, 3]
    assert row["source_pages"][1]["start"] == row["source_pages"][0]["end"] + 2


def test_edge_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, "Only one sentence stands in this text."), (3, "1\n2\n3"), (4, "hy-\nphen and space 𝒳 text")], "doc_id bigint, raw_text string")
    rows = {r["doc_id"]: r for r in cleaning.clean_documents(docs).select("doc_id", "display_text").collect()}
    assert rows[1]["display_text"] == "" and rows[3]["display_text"] == ""
    assert rows[4]["display_text"].startswith("hyphen and space X")


def test_collapse_line_phrase(spark):
    assert one(spark, T.collapse_line_phrase(F.lit("case study case study case study of things"))) == "case study of things"
    assert one(spark, T.collapse_line_phrase(F.lit("one two three"))) == "one two three"


def test_collapse_title(spark):
    got = one(spark, titles.collapse_phrases(F.array(F.lit("Case Study Series Case Study Series The Pub Pub Plan"))))
    assert got == ["Case Study Series The Pub Plan"]


def test_encoding_noise(spark):
    assert one(spark, T.encoding_noise(F.lit("ΑΒΓΔ ΕΖΗΘ ΙΚΛΜ ΝΞΟΠ")))
    assert not one(spark, T.encoding_noise(F.lit("A plain English line of text.")))


def test_chunks_cover_sentences(spark):
    text = " ".join(f"Sentence number {i} has some more words in it." for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, raw_text string")
    docs = sections.detect_sections(cleaning.clean_documents(docs))
    rows = sections.chunk_sections(docs, "doc_id", 300, 2).orderBy("part").collect()
    seen = [i for r in rows for i in range(r["first_sentence"], r["after_sentence"])]
    assert set(seen) == set(range(60)) and all(len(r["text"]) <= 300 for r in rows)
    assert all(b["first_sentence"] == max(a["first_sentence"] + 1, a["after_sentence"] - 2) for a, b in zip(rows, rows[1:]))


def test_similarity_by_brute_force(spark):
    rng = random.Random(7)
    sents = [" ".join(rng.sample("alpha beta gamma delta kappa sigma omega theta".split(), 4)) for _ in range(9)]
    df = spark.createDataFrame([(sents,)], "s array<string>")
    got = df.select(nlp.overlap_scores(F.transform("s", T.word_set))).first()[0]
    sets = [set(s.split()) for s in sents]
    raw = [sum(len(a & b) / len(a | b) for j, b in enumerate(sets) if j != i) / 8 for i, a in enumerate(sets)]
    assert all(abs(g - r / max(raw)) < 1e-9 for g, r in zip(got, raw))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_edit_distance_join_by_brute_force(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    terms = spark.createDataFrame([(w,) for w in words[:30]], "term string")
    ids = spark.createDataFrame([(w,) for w in words[30:]], "id string")
    got = {(r["term"], r["id"], r["distance"]) for r in ontology.edit_distance_join(terms, ids).collect()}
    want = {(a, b, distance(a, b)) for a in words[:30] for b in words[30:] if distance(a, b) <= 2}
    assert got == want


def test_graph_fixture(spark):
    edges = spark.createDataFrame(
        [("a", "x", "b"), ("b", "x", "c"), ("a", "x", "d"), ("d", "x", "c"), ("c", "y", "c"), ("p", "x", "q"), ("a", "z", "b")],
        "src string, type string, dst string",
    )
    nodes = spark.createDataFrame([(n,) for n in "abcdpqs"], "id string")
    assert {r["node"]: r["distance"] for r in graph.bfs(edges, nodes, "a").collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert graph.bfs(edges, nodes, "missing").count() == 0
    assert graph.shortest_path(edges, "a", "c").first()["path"] == ["a", "b", "c"]
    assert graph.shortest_path(edges, "a", "q").count() == 0
    parts = {r["node"]: r["component"] for r in graph.connected_components(edges, nodes).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "a", "p": "p", "q": "p", "s": "s"}


def test_rate_limit_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randint(0, 4000)) for i, k in enumerate(rng.choices([1, 1, 1, 2, 3], k=300))]
    df = spark.createDataFrame(rows, "key bigint, id bigint, sec bigint").select("key", "id", F.timestamp_seconds("sec").alias("ts"))
    got = {r["id"]: (r["allowed"], r["retry_us"]) for r in rate_limit.batch_limits(df, 3, 200).collect()}
    logs, want = {}, {}
    for k, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        kept = [t for t in logs.get(k, []) if t > s - 200]
        ok = len(kept) < 3
        want[i] = (ok, 0 if ok else max(1, (kept[0] + 200 - s) * 1_000_000))
        logs[k] = kept + [s] if ok else kept
    assert got == want


def test_grounding(spark):
    docs = spark.createDataFrame([(1, PAPER)], "doc_id bigint, text string")
    good = '{"claims":[{"type":"result","object":"fit","evidenceText":"a 95% correlation","numericValue":95,"confidence":0.99}]}'
    bad = '{"claims":[{"type":"result","object":"fit","evidenceText":"a 99% accuracy"}]}'
    drafts = spark.createDataFrame([(1, good), (1, bad), (1, "not json")], "doc_id bigint, payload string")
    rows = grounding.ground_claims(drafts, docs).collect()
    assert sorted((r["rejected"] or "", r["confidence"]) for r in rows) == [("", 0.9), ("not_in_source", 0.7)]


CASE = (
    "Anna Berg and Carl Dorn are considering whether to invest in the project. A 70-seat restaurant is planned. "
    "Best case is 5 barrels per seat. Worst case is 4 barrels per seat. One barrel holds 31 gallons. "
    "One gallon holds 8 pints. The selling price is $8 per pint. Rent is $3,000 per month or rent of $3,500 per month. "
    "The tax rate is 30%. The NPV and the IRR are required."
)


def test_case(spark):
    c = one(spark, finance.case_profile(F.lit(CASE)))
    figures = {d["label"]: d["value"] for d in c["derived"]}
    assert figures["Best-case first-year revenue"] == 694_400 and figures["Pints per barrel"] == 248
    assert {a["label"]: a["value"] for a in c["inputs"]}["Tax rate"] == 30
    assert len(c["assumptions"]) == 1 and "Net Present Value (NPV)" in c["required"]
    assert c["decision"].startswith("Anna Berg")


def test_definitions_and_answers(spark):
    text = "A Semaphore is a counter that guards access to a shared resource in a program. Deadlock means that two tasks wait for each other without any progress at all."
    got = one(spark, study.definitions(F.lit(text)))
    assert [d["term"] for d in got] == ["A Semaphore", "Deadlock"]
    h = F.struct(
        F.lit("BN").alias("method"), *[F.lit(None).cast("string").alias(x) for x in ("dataset", "problem", "metric")],
        F.lit(None).cast("double").alias("accuracy"), F.array().cast("array<string>").alias("contributions"),
    )
    sents = study.meaningful_sentences(F.lit(text))
    assert one(spark, study.answer(h, sents, F.lit("Which method is used?")))["confidence"] == 0.92
    assert one(spark, study.answer(h, sents, F.lit("What is a deadlock of tasks?")))["route"] == "excerpt"
    assert one(spark, study.answer(h, sents, F.lit("Zzz?")))["confidence"] == 0.2


def test_concepts(spark):
    assert one(spark, concepts.canonical_concept(F.lit("- npv."))) == "Net Present Value (NPV)"
    assert one(spark, concepts.is_valid_concept(F.lit("class imbalance")))
    assert not one(spark, concepts.is_valid_concept(F.lit("they grow")))


def test_amounts_reach_over_line_ends(spark):
    from lectern.operators import finance

    text = "The market\nresearch cost was $ 5,000 in all."
    row = spark.createDataFrame([(text,)], "text string").select(finance.amounts(F.col("text")).alias("a")).first()
    assert [(a["label"], a["value"]) for a in row["a"]] == [("Market research cost", 5000.0)]


def test_graph_does_not_depend_on_row_order(spark):
    from lectern.operators import graph

    claims = [(1, f"claim-method-{n}", "method", "gradient trees", float(n), f"m{n % 3}", n / 10, f"evidence-{n}") for n in range(1, 13)]
    ddl = "doc_id long, id string, type string, object string, value double, metric string, confidence double, evidence_id string"
    concepts = spark.createDataFrame([(1, 0, "tree", "tree", 1.0, None, None)], "doc_id long, rank int, norm string, term string, score double, concept_id string, label string")
    seen = set()
    for parts in (1, 17):
        nodes, edges = graph.build_graph(spark.createDataFrame(claims[::-1], ddl).repartition(parts), concepts)
        seen.add((str(sorted(map(str, nodes.collect()))), str(sorted(map(str, edges.collect())))))
    assert len(seen) == 1
    method = nodes.filter("type = 'method'").first()
    assert method["props"] == {"value": "12.0", "metric": "m0"}
    assert edges.filter("dst like 'method:%' and src like 'paper:%'").first()["weight"] == 0.1


def test_long_texts_are_not_cut(spark):
    docs = spark.createDataFrame([(1, "x" * 7999 + "yz" + "w" * 8000), (2, ""), (3, None)], "doc_id long, text string")
    rows = study.draft_requests(docs, "cards", F.lit("H")).orderBy("doc_id", "part").collect()
    bodies = [r["request"].removeprefix("H\nDOCUMENT:\n") for r in rows if r["doc_id"] == 1]
    assert "".join(bodies) == "x" * 7999 + "yz" + "w" * 8000 and [r["parts"] for r in rows] == [3, 3, 3, 1, 1]
    a, b = "word " * 40 + "a", "word " * 40 + "b"
    slugs = [one(spark, T.slugify(F.lit(t), "_", 90)) for t in (a, b)]
    assert slugs[0] != slugs[1] and slugs[0][:90] == slugs[1][:90] and one(spark, T.slugify(F.lit(a), "_")) == "word_" * 40 + "a"


@pytest.mark.parametrize("title,wanted", [("a b a b c", "a b c"), ("x x x", "x"), ("A a b B", "A b"), ("one two one", "one two one"), ("", "")])
def test_collapsed_titles(spark, title, wanted):
    assert one(spark, titles.collapse_phrases(F.array(F.lit(title)))) == [wanted]


def test_pages_with_equal_numbers_keep_their_own_lines(spark):
    page = "struct<page_no:int,raw_text:string>"
    docs = spark.createDataFrame([(1, "", [(2, "first page text"), (None, "second page text")])], f"doc_id int, raw_text string, pages array<{page}>")
    cleaned = cleaning.clean_documents(docs).first()
    assert [(p["page_no"], p["display_text"]) for p in cleaned["source_pages"]] == [(2, "first page text"), (2, "second page text")]


def test_streams_of_many_batches_equal_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(9), k, f"2024-01-{1 + k // 40:02d} 00:{k % 40:02d}:00", rng.choice(["a", "b"]), rng.randrange(9), rng.random() < 0.8) for k in range(200)]
    rng.shuffle(rows)
    names = "note_id long, seq long, ts string, provider string, tokens_used long, success boolean"
    for k in range(5):
        spark.createDataFrame(rows[k::5], names).withColumn("ts", F.to_timestamp("ts")).withColumn("created_at", F.col("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    progress.fold_stream(stream, f"{tmp_path}/out", f"{tmp_path}/mark").start().awaitTermination()
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 5
    latest = {}
    for row in rows:
        latest[row[0]] = max(latest.get(row[0], ("", -1)), (row[2], row[1]))
    assert {r["note_id"]: r["seq"] for r in progress.folded(spark, f"{tmp_path}/out").collect()} == {k: v[1] for k, v in latest.items()}

    late = flow.usage_windows(table, "90 days").collect()
    assert sorted(map(tuple, flow.current_windows(stream, "90 days").collect())) == sorted(map(tuple, late))


def test_a_document_that_fails_a_feature_fails_alone(spark, tmp_path):
    spark.createDataFrame([(1, "7"), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    features = {"number": lambda b: b.select("doc_id", F.col("text").try_cast("int").alias("items")), "size": lambda b: b.select("doc_id", F.length("text").alias("items"))}
    got = sorted(map(tuple, flow.upload_flow(stream, features).collect()))
    assert got == [(1, "number", 7, "ready"), (1, "size", 1, "ready"), (2, "number", 0, "failed"), (2, "size", 1, "ready")]

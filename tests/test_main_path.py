"""The whole analysis on a few documents: stages, their measures, and tables that agree with each other."""

import pytest
from pyspark.sql import functions as F

from lectern.plans import analysis
from lectern.sources.guarded import Guard, guarded

PAPER = """Causal Models for Defect Prediction

Abstract
The problem of defect prediction remains a challenge for software projects. We propose a bayesian network approach.

1. Introduction
We address the problem of residual defects in large software systems. The bayesian network is a causal model that links quality indicators to residual defects.

2. Methodology
We use a dynamic bayesian network implemented in the AgenaRisk toolset. The dynamic bayesian network was trained on data from 31 projects.

3. Results
The model achieved an accuracy of 95% on 31 projects. The linear correlation coefficient was 0.93 for residual defects.

4. Conclusion
A limitation is the restricted data of the study. In future work we plan to test the dynamic bayesian network on more projects.

References
[1] Someone. A paper about defects. 2001."""
OTHER = "Residual defects cost money in every project. The dynamic bayesian network describes residual defects well. A neural network is a decision support system for residual defects."


@pytest.fixture(scope="module")
def run(spark):
    rows = [(1, PAPER), (2, OTHER), (3, ""), (4, "Too short.")]
    return analysis.analyse_corpus(spark.createDataFrame(rows, "doc_id long, raw_text string"))


def per_document(table):
    return {r["doc_id"]: r["n"] for r in table.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


def test_stages_report_what_their_tables_hold(run):
    events = run.stages.table().orderBy("number").collect()
    assert [e["stage"] for e in events] == [
        "document_received", "cleaning", "section_detection", "document_classification", "chunking", "nlp", "claim_extraction", "claim_validation",
        "ontology_resolution", "graph_nodes", "graph_edges", "symbolic_reasoning", "key_facts", "gap_detection", "confidence_scoring",
    ]
    assert all(e["status"] == "complete" and e["duration_ms"] >= 0 and e["started"] > 0 for e in events)
    measures = {e["stage"]: e["measures"] for e in events}
    names = dict(zip(measures, ["received", "clean", "sections", "kinds", "chunks", "nlp", "extracted", "validated", "resolved", "nodes", "edges", "facts", "key_facts", "gaps", "results"], strict=True))
    for stage, table in names.items():
        assert measures[stage]["rows"] == run[table].count()
    assert measures["document_received"]["rawCharacters"] == len(PAPER) + len(OTHER) + len("Too short.")
    assert measures["claim_validation"]["validClaims"] == run["validated"].select(F.sum(F.size("valid"))).first()[0]
    assert measures["graph_edges"]["mentions"] == run["edges"].filter("type = 'mentions'").count()


def test_a_paper_becomes_claims_graph_and_facts(run):
    kinds = {r["doc_id"]: r["kind"] for r in run["kinds"].collect()}
    assert kinds[1] == "research_paper" and kinds[3] == "unknown"
    paper = run["validated"].filter("doc_id = 1").first()
    assert {"method", "sample", "problem"} <= {c["type"] for c in paper["valid"]} and paper["headline"]["method"] is not None
    matches = {r["norm"]: r for r in run["resolved"].filter("doc_id = 1").collect()}
    shared = matches["residual defects"]  # both documents speak of it, so the corpus knows it
    assert shared["concept_id"] == "residual_defects" and shared["match_type"] in ("exact", "alias")
    nodes, edges, facts = per_document(run["nodes"]), per_document(run["edges"]), per_document(run["facts"])
    assert nodes[1] > nodes[2] > 0 and edges[1] > edges[2] and facts[1] > 5
    ids = {(r["doc_id"], r["id"]) for r in run["nodes"].collect()}
    assert all((r["doc_id"], r["src"]) in ids and (r["doc_id"], r["dst"]) in ids for r in run["edges"].collect())
    assert {r["type"] for r in run["key_facts"].filter("doc_id = 1").collect()} >= {"method", "sample"}


def test_results_and_study_material(run):
    results = {r["doc_id"]: r for r in run["results"].collect()}
    assert set(results) == {1, 2, 3, 4} and all(0 <= r["confidence"] <= 1 for r in results.values())
    assert results[1]["overall"] > results[3]["overall"] and results[3]["status"] == "rejected" and results[3]["claims"] == 0
    assert results[1]["missing"] == [] and results[1]["nodes"] == per_document(run["nodes"])[1]
    made = {r["doc_id"]: r for r in analysis.study_material(run).collect()}
    assert len(made[1]["quiz"]) > 2 and len(made[1]["deck"]) > 2 and made[1]["summary"]["summary"].startswith("# Document 1")
    assert made[3]["quiz"] == [] and made[3]["summary"]["summary"] is not None


def test_a_failing_stage_is_an_event(spark):
    stages = analysis.Stages(spark)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        stages.run("division", spark.range(3).select(F.expr("1 / (id - 1)").alias("x")))
    event = stages.table().first()
    assert event["status"] == "failed" and "DIVIDE_BY_ZERO" in event["message"] and event["measures"] == {}


def test_guarded_rows_stop_at_their_first_reason(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x"), (3, None), (4, "99")], "doc_id long, text string")
    guards = [
        Guard("present", F.col("text"), "no text"), Guard("number", F.col("text").try_cast("int"), F.concat(F.lit("not a number: "), "text")),
        Guard("small", F.when(F.col("number") < 50, F.col("number") * 2), lambda: F.concat(F.lit("too large: "), F.col("number").cast("string"))),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in guarded(df, guards).collect()}
    assert got == {1: ("12", 12, 24, None, None), 2: ("x", None, None, "number", "not a number: x"), 3: (None, None, None, "present", "no text"), 4: ("99", 99, None, "small", "too large: 99")}

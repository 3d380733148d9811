"""The whole analysis of raw documents, stage by stage: text, sections, claims, ontology, graph, facts, gaps, confidence.

Each stage is written out before the next reads it: several branches read the stage tables, and one projection holding
every stage would be planned as one enormous expression. What a stage reports is observed while its rows
go to the file, so no measure reads anything again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from lectern.functions import text as T
from lectern.operators import claims as C
from lectern.operators import classify as K
from lectern.operators import cleaning, facts, graph, nlp, ontology as O, scores, sections, study
from lectern.operators.concepts import is_valid_concept
from lectern.session import cut_lineage, stored

#: Concepts of one document that go into its graph.
GRAPH_CONCEPTS = 30
#: Kinds of fact that count as full reasoning.
FACT_KINDS = 8


@dataclass
class Stages:
    """Runs stages in order and keeps an event for each: status, start, duration and measures."""

    spark: SparkSession
    events: list[tuple] = field(default_factory=list)

    def run(self, stage: str, df: DataFrame, **measures: Column) -> DataFrame:
        seen, begin = Observation(f"{stage}-{len(self.events)}"), time.time()
        wanted = {"rows": F.count(F.lit(1)), **measures}
        try:
            out = stored(df.observe(seen, *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(name) for name, m in wanted.items()]), stage)
        except Exception as error:
            self._note(stage, "failed", begin, {}, str(error)[:500])
            raise
        self._note(stage, "complete", begin, seen.get, None)
        return out

    def _note(self, stage: str, status: str, begin: float, measures: dict, message: str | None) -> None:
        # seconds since the epoch and milliseconds
        self.events.append((len(self.events), stage, status, begin, int(1000 * (time.time() - begin)), {k: float(v) for k, v in measures.items()}, message))

    def table(self) -> DataFrame:
        """Ordered events: number, stage, status, started (seconds), duration_ms, measures map, message."""
        return self.spark.createDataFrame(self.events, "number int, stage string, status string, started double, duration_ms long, measures map<string,double>, message string")


@dataclass
class Analysis:
    """The written tables of one run by name, and its events."""

    tables: dict[str, DataFrame]
    stages: Stages

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _kind_fields() -> Column:
    """map<kind, array<struct<field, required, applicable>>>; a constant of the vocabulary."""
    rows = []
    for kind, fields in K.EXPECTED_FIELDS.items():
        entries = [F.struct(F.lit(f).alias("field"), F.lit(r).alias("required"), F.lit(a).alias("applicable")) for f, r, a in fields]
        rows += [F.lit(kind), F.array(*entries)]
    return F.create_map(*rows)


def corpus_ontology(concepts: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, aliases, relations) that a corpus itself suggests: terms of several documents, the longer is_a its last word or pair.

    For corpora without an ontology of their own; any tables of these columns serve as well.
    """
    shared = concepts.groupBy("norm").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") >= least)
    ids = stored(shared.select(F.replace("norm", F.lit(" "), F.lit("_")).alias("id"), F.col("norm").alias("label"), F.lit("corpus").alias("domain")).distinct(), "ontology")
    words = F.split("label", " ")
    tails = ids.select(F.col("id").alias("src"), F.explode(F.array(F.element_at(words, -1), F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " "))).alias("tail"))
    relations = tails.join(ids.select(F.col("label").alias("tail"), F.col("id").alias("dst")), "tail").filter(F.col("src") != F.col("dst"))
    aliases = ids.select(F.col("label").alias("alias"), F.col("id").alias("concept_id"), F.lit(0).alias("ord"))
    return ids, aliases, relations.select("src", F.lit("is_a").alias("type"), "dst").distinct()


def analyse(documents: DataFrame, terms=None, vocabulary=None) -> DataFrame:
    """documents(doc_id, raw_text[, pages]) to text, sections, sentences and validated claims, for who needs no more."""
    clean = cut_lineage(cleaning.clean_documents(documents).select("doc_id", "display_text", "analysis_text", "source_pages", "stats"))
    parts = cut_lineage(sections.detect_sections(clean))
    split = parts.select("doc_id", "analysis_text", "sections", sections.section_sentences(F.col("sections")).alias("sentences"))
    read = cut_lineage(nlp.annotate(split, terms, scores=True))
    found = cut_lineage(read.withColumn("claims", C.extract_claims(F.col("sentences"), vocabulary)))
    return found.withColumn("claims", C.validate_claims(F.col("claims")))


def analyse_corpus(documents: DataFrame, terms=None, vocabulary=None, ontology=None) -> Analysis:
    """documents(doc_id, raw_text[, pages]) to the tables of every stage.

    ``ontology`` is (concepts, aliases, relations); without it the corpus suggests one.
    """
    stages, t = Stages(documents.sparkSession), {}
    size = lambda c: F.sum(F.size(c))
    t["received"] = stages.run("document_received", documents, rawCharacters=F.sum(F.char_length("raw_text")))
    clean = cleaning.clean_documents(t["received"]).select("doc_id", "display_text", "analysis_text", "source_pages", "stats")
    t["clean"] = stages.run("cleaning", clean, cleanCharacters=F.sum("stats.clean_length"), citationsRemoved=F.sum("stats.citations"), referenceLinesRemoved=F.sum("stats.reference_lines"))
    t["sections"] = stages.run("section_detection", sections.detect_sections(t["clean"]), sections=size("sections"), hasAbstract=F.count_if("has_abstract"), hasMethodology=F.count_if("has_methodology"))
    headings = F.transform("sections", lambda s: s["heading"])
    kinds = t["sections"].select("doc_id", K.profile(F.col("analysis_text"), headings, F.col("has_abstract")).alias("p")).select("doc_id", "p.kind", F.col("p.confidence").alias("kind_confidence"))
    t["kinds"] = stages.run("document_classification", kinds, researchPapers=F.count_if(F.col("kind") == "research_paper"), classificationConfidence=F.avg("kind_confidence"))
    chunks = sections.chunk_sections(t["sections"], "doc_id")
    t["chunks"] = stages.run("chunking", chunks, chunks=F.count(F.lit(1)), estimatedTokens=F.sum(T.token_estimate(F.col("text"))))

    split = t["sections"].select("doc_id", "analysis_text", "sections", sections.section_sentences(F.col("sections")).alias("sentences"))
    read = nlp.annotate(split, terms, scores=True, phrases="phrases").withColumn("entities", nlp.document_entities(F.col("sentences")))
    t["nlp"] = stages.run("nlp", read, sentences=size("sentences"), entities=size("entities"), keyPhrases=size("phrases"))
    phrases = F.transform("phrases", lambda p: p["value"])
    found = t["nlp"].withColumn("values", phrases).select("doc_id", C.extract_claims(F.col("sentences"), vocabulary).alias("claims"), nlp.concept_candidates(F.col("sentences"), F.col("values"), GRAPH_CONCEPTS).alias("concepts"))
    t["extracted"] = stages.run("claim_extraction", found, claims=size("claims"), concepts=size("concepts"))

    checked = t["extracted"].join(t["kinds"], "doc_id").withColumn("claims", C.validate_claims(F.col("claims"))).withColumn("valid", F.filter("claims", C.is_valid))
    checked = checked.withColumn("fields", F.coalesce(F.try_element_at(_kind_fields(), F.col("kind")), F.try_element_at(_kind_fields(), F.lit("unknown"))))
    checked = checked.withColumn("states", C.field_states(F.col("fields"), F.col("valid"))).drop("fields")
    bad = F.size(F.filter("concepts", lambda c: ~c["valid"]))
    checked = checked.withColumn("report", C.validation_report(F.col("claims"), F.col("states"), bad)).withColumn("headline", C.headline(F.col("valid")))
    t["validated"] = stages.run("claim_validation", checked, validClaims=size("valid"), rejectedClaims=size("claims") - size("valid"), validConcepts=size("concepts") - F.sum(bad), validationPassed=F.count_if("report.passed"))

    rows = t["validated"].select("doc_id", F.posexplode(F.filter("concepts", lambda c: c["valid"])).alias("rank", "c")).select("doc_id", "rank", "c.norm", "c.term", "c.score")
    known, aliases, relations = ontology or corpus_ontology(rows)
    resolved = O.resolve_terms(rows.withColumn("shown", F.col("term")).withColumn("term", F.col("norm")), known, aliases).join(known.select(F.col("id").alias("concept_id"), "label"), "concept_id", "left")
    resolved = resolved.select("doc_id", "rank", "norm", F.col("shown").alias("term"), "score", "concept_id", "label", "match_type", "confidence")
    matched = F.col("match_type") != "unknown"
    t["resolved"] = stages.run("ontology_resolution", resolved, resolved=F.count_if(matched), documentLocal=F.count_if(~matched))

    claims = t["validated"].select("doc_id", F.inline("valid")).withColumn("evidence_id", F.concat(F.lit("evidence-"), F.col("sent_no").cast("string")))
    nodes, edges = graph.build_graph(claims, t["resolved"], (known, relations, O.ancestor_chains(relations)))
    kind_of = lambda k: F.count_if(F.col("type") == k)
    t["nodes"] = stages.run("graph_nodes", nodes, conceptNodes=kind_of("concept"))
    t["edges"] = stages.run("graph_edges", edges, isA=kind_of("is_a"), mentions=kind_of("mentions"))
    stated = graph.graph_to_facts(t["nodes"], t["edges"]).select("doc_id", "functor", "args", F.get("args", F.lit(0)).alias("a"), F.get("args", F.lit(1)).alias("b"))
    t["facts"] = stages.run("symbolic_reasoning", stated, documentFacts=F.count_if(F.col("functor").isin(*graph.RESERVED)))
    closure = facts.belongs_to(relations)
    t["key_facts"] = stages.run("key_facts", facts.key_facts(t["facts"], closure), domains=F.count_if(F.col("type") == "domain"))

    missing = F.transform(F.filter("states", lambda s: s["required"] & (s["state"] == "missing")), lambda s: s["field"])
    titles = F.transform("sections", lambda s: s["title"])
    gaps = t["validated"].select("doc_id", "kind", missing.alias("missing"), F.size(F.filter("states", lambda s: s["required"])).alias("required"))
    gaps = gaps.join(t["sections"].select("doc_id", titles.alias("titles")), "doc_id").withColumn("sections_missing", scores.missing_sections(F.col("kind"), F.col("titles"))).drop("titles")
    covered = scores.gap_coverage(F.col("kind"), F.col("required"), F.size("missing"), F.size("sections_missing"))
    t["gaps"] = stages.run("gap_detection", gaps.withColumn("coverage", covered), missingFields=size("missing"), missingSections=size("sections_missing"))
    t["results"] = stages.run("confidence_scoring", _confidence(t), ready=F.count_if(F.col("status") == "ready"), rejected=F.count_if(F.col("status") == "rejected"), confidence=F.avg("confidence"))
    return Analysis(t, stages)


def _confidence(t: dict[str, DataFrame]) -> DataFrame:
    """One row per document: counts of all stages, the eight components, coverage status and calibrated confidence."""
    per = lambda name, *measures: t[name].groupBy("doc_id").agg(*measures)
    quality = cleaning.clean_text_reliably(t["received"].select("doc_id", "raw_text"), "raw_text").select("doc_id", F.col("clean.quality.score").alias("text_score"), F.col("clean.quality.passed").alias("text_passed"))
    d = t["validated"].select(
        "doc_id", "kind", "kind_confidence", F.size("claims").alias("claims"), F.size("valid").alias("valid_claims"), "report", "headline",
        F.size("concepts").alias("concepts"), F.size(F.filter("concepts", lambda c: c["valid"])).alias("valid_concepts"),
        F.size(F.filter("concepts", lambda c: c["valid"] & (c["occurrences"] >= 2) & (c["n_evidence"] > 0))).alias("strong_concepts"),
    )
    d = d.join(quality, "doc_id").join(t["gaps"].select("doc_id", "missing", "sections_missing", "coverage"), "doc_id")
    counts = [
        scores.ontology_score(t["resolved"]), per("resolved", F.count_if(F.col("match_type") != "unknown").alias("resolved")),
        per("nodes", F.count("*").alias("nodes"), F.count_if(F.col("type").isin("claim", "result")).alias("claim_nodes")),
        per("edges", F.count("*").alias("edges"), F.countDistinct(F.when(F.col("dst").startswith("claim:"), F.when(F.col("evidence_id").isNotNull(), F.col("dst")))).alias("evidence_edges")),
        per("facts", F.count("*").alias("facts")), per("key_facts", F.countDistinct("type").alias("fact_kinds"), F.count("*").alias("key_facts")),
    ]
    for part in counts:
        d = d.join(part, "doc_id", "left")
    names = ["ontology", "resolved", "nodes", "claim_nodes", "edges", "evidence_edges", "facts", "fact_kinds", "key_facts"]
    d = d.fillna(0, names)
    expected = F.when(F.col("kind") == "research_paper", len(scores.RESEARCH_SECTIONS)).otherwise(0)
    parts = {
        "grounding": F.col("report.grounded_ratio"), "numeric": F.col("report.numeric_ratio"), "consistency": F.col("report.consistency"),
        "sections": F.when(expected == 0, 1.0).otherwise(1 - F.size("sections_missing") / expected),
        "concepts": scores.concept_quality(F.col("concepts"), F.col("valid_concepts"), F.col("strong_concepts")), "ontology": F.col("ontology"),
        "graph": scores.graph_score(F.col("valid_claims"), F.col("claim_nodes"), F.col("evidence_edges")), "reasoning": F.least(F.lit(1.0), F.col("fact_kinds") / FACT_KINDS),
    }
    d = d.select("*", F.struct(*[scores.clamp_unit(v).alias(k) for k, v in parts.items()]).alias("components"))
    part = lambda k: F.col(f"components.{k}")
    h = F.col("headline")
    flags = {
        "problem": h["problem"].isNotNull(), "method": h["method"].isNotNull(), "evidence": h["dataset"].isNotNull() | h["metric"].isNotNull(), "concepts": F.col("valid_concepts") > 0,
        "findings": F.size(h["key_points"]) > 0, "limitations": h["limitations"].isNotNull(), "overview": F.col("valid_claims") > 0, "keyPoints": F.size(h["key_points"]) > 0,
    }
    title = F.when(F.col("kind") == "unknown", 0.45).otherwise(F.col("kind_confidence"))
    coverage = scores.coverage_report(
        scores.checks(F.col("kind"), flags),
        {"text": F.col("text_score"), "title": title, **{k: part(k) for k in ("concepts", "grounding", "numeric", "consistency", "sections")}}, F.col("text_passed"),
    )
    d = d.withColumn("report_of", coverage).withColumn("overall", scores.composite_confidence({k: part(k) for k in scores.CONFIDENCE_WEIGHTS}))
    calibrated = scores.calibrated(F.col("overall"), F.col("report_of.score"), F.col("report_of.status"), F.col("text_passed"))
    return d.select(
        "doc_id", "kind", "claims", "valid_claims", "concepts", "valid_concepts", "resolved", "nodes", "edges", "facts", "key_facts", "missing", "sections_missing", "components", "overall",
        F.col("report_of.score").alias("coverage"), F.col("report_of.status").alias("status"), F.col("report_of.missing").alias("unmet"), calibrated.alias("confidence"), "text_passed",
    )


def study_material(run: Analysis, questions: int = 10, cards: int = 10) -> DataFrame:
    """doc_id, quiz, deck and summary of every document from its own headline facts, concepts and text."""
    term = F.transform(F.filter("concepts", lambda c: c["valid"]), lambda c: c["term"])
    docs = run["validated"].select("doc_id", "headline", term.alias("terms")).join(run["clean"].select("doc_id", "analysis_text"), "doc_id")
    docs = docs.join(run["results"].select("doc_id", "coverage"), "doc_id")
    h, title = F.col("headline"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    none = F.array().cast("array<struct<term:string,definition:string>>")
    defined = study.definitions(F.col("analysis_text"), 12)
    return docs.select(
        "doc_id", study.questions_from_facts(h, F.col("terms"), questions).alias("quiz"), study.cards_from_facts(h, cards).alias("deck"),
        study.general_summary(h, F.col("analysis_text"), title, F.filter("terms", is_valid_concept), F.coalesce(F.transform(defined, lambda d: F.struct(d["term"], d["definition"])), none), F.col("coverage")).alias("summary"),
    )

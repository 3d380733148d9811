"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

from lectern.plans import registry
from lectern.plans import claim_queries, clean_queries, graph_queries, main_queries, nlp_queries, record_queries, result_queries, score_queries, section_queries, stream_queries, study_queries, text_queries, usage_queries, walk_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)

"""All queries of this folder: importing the query modules fills the registry."""

from __future__ import annotations

from tracefold.llm import q_classifier, q_fingerprints, q_licenses, q_mixing, q_packing, q_pii, q_quality, q_runs, q_simhash, q_spelling, q_substrings, q_toxicity, q_warc  # noqa: F401
from tracefold.llm.common import LLM_QUERIES
from tracefold.plans.registry import Query


def llm_queries() -> dict[str, Query]:
    return dict(LLM_QUERIES)

"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from tracefold.plans import q_cells, q_entities, q_misc, q_phases, q_series, q_sources, q_streams  # noqa: F401
from tracefold.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)

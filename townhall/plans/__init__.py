"""Query registry: every operator over the base tables, with its oracle SQL."""

from importlib import import_module

MODULES = ["q_functions", "q_scoring", "q_state", "q_claims", "q_views", "q_sources", "q_evidence", "q_streams", "q_relevance", "q_resolution"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"townhall.plans.{name}")

"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_plans", "turn_plans", "context_plans", "event_plans", "source_plans", "session_plans"]


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for m in MODULES:
        mod = import_module(f"turnloom.plans.{m}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles

"""Queries of this subpackage by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from termwell.plans.registry import Query, Run

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return add

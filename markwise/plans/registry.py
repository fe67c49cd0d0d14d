"""All registered queries."""

from __future__ import annotations

from markwise.plans import authoring, feeds, runs, scoring, shapes, timelines
from markwise.plans.catalog import Query

MODULES = (scoring, timelines, runs, shapes, authoring, feeds)


def all_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}

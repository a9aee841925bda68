"""Queries on the driver tables, by topic; each module has QUERIES and ORACLES."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["metrics", "sequences", "neighbours", "records", "kernels", "rules", "cases", "sources", "components", "beats", "publication", "shapes"]


def catalogue() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for topic in TOPICS:
        module = import_module(f"sparkwright.plans.{topic}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles

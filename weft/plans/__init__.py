"""Query plans: the registry, the registered queries and the command front end."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries and their SQL."""
    from . import graph_queries, json_queries, misc_queries, registry, relational_queries, text_queries, tool_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLE

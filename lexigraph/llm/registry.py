"""The queries of this subpackage and their SQL."""

from lexigraph.llm import clusters, components, copies, entities, frequencies, leaks, mixing, neighbors, repetition, together

MODULES = (clusters, entities, copies, components, frequencies, together, leaks, mixing, repetition, neighbors)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}

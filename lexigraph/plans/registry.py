"""The core queries and their SQL."""

from lexigraph.plans import graphs, partitions, relational, texts

MODULES = [graphs, partitions, relational, texts]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}

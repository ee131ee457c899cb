"""Queries over the given tables, each with the SQL that checks it."""


def load():
    from workload import queries_pages, queries_scores, queries_sites  # noqa: F401
    from workload.registry import ORACLES, QUERIES

    return QUERIES, ORACLES

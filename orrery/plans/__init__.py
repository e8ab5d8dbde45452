"""Queries of the point-cloud engine by name, and their SQL where SQL can say them."""

from orrery.plans import drifts, summaries, vectors


def queries() -> dict:
    return vectors.QUERIES | summaries.QUERIES | drifts.QUERIES


def oracle_sql() -> dict:
    return vectors.SQL | summaries.SQL | drifts.SQL

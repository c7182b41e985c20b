"""Registered queries: importing the modules fills the registry."""

from newsloom.plans import articles, briefing, details, extras, files, intake, matching, reports, runs, streams  # noqa: F401
from newsloom.plans.registry import QUERIES


def queries() -> dict:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}

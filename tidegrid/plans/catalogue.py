"""All queries of the core and their SQL."""

from __future__ import annotations

from . import evaluation, problems, relational, series, streams, studies, topology

PARTS = (relational.cat, series.cat, evaluation.cat, topology.cat, studies.cat, streams.cat)


def queries() -> dict:
    out = dict(problems.QUERIES)
    for part in PARTS:
        out |= part.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(problems.SQL)
    for part in PARTS:
        out |= part.sql
    return out

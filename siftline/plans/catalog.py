"""All queries outside the training-data package, and their SQL."""

from __future__ import annotations

from siftline.plans import evaluation, graph, guards, ingest, retrieval, runs

PLANS = (ingest, retrieval, graph, guards, evaluation, runs)


def queries() -> dict:
    return {k: f for m in PLANS for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in PLANS for k, q in m.ORACLE.items()}

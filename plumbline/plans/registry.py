"""All registered queries of the core and their SQL."""

from __future__ import annotations

from plumbline.plans import calibration, checks, evaluation, retrieval, text_store
from plumbline.plans.base import QUERIES, SQL

__all__ = ["calibration", "checks", "evaluation", "oracle_sql", "queries", "retrieval", "text_store"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

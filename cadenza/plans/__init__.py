"""Registered queries and the SQL that checks them."""

from . import catalog, mixes, series
from .registry import QUERIES, SQL

__all__ = ["catalog", "mixes", "oracle_sql", "queries", "series"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

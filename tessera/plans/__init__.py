"""Registered queries over the driver's tables, each with the SQL that checks it."""

from . import evidence, files, measures, metadata, statistics, texts, workflow
from .registry import QUERIES, SQL

MODULES = (evidence, texts, measures, statistics, files, metadata, workflow)


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)

"""Registered queries over the driver's tables, by area."""

from __future__ import annotations

from . import docs, ledgers, models, stored, tables, texts
from .registry import ORACLES, QUERIES

AREAS = (tables, texts, docs, ledgers, models, stored)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

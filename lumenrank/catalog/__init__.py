"""Registered queries over the test tables, each with the SQL that it is checked against."""

from __future__ import annotations

from . import evaluation, extras, further, mining, planning, retrieval, streams, tensors, texts

_MODULES = (tensors, retrieval, evaluation, texts, mining, planning, extras, further, streams)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

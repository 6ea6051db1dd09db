"""Collects the queries and oracles of every plan module."""

from __future__ import annotations

import importlib

MODULES = ["ingest", "project", "runs", "tracks", "verification", "grids", "swaths", "instruments", "streams"]


def _load():
    return [importlib.import_module(f"galespark.plans.{m}") for m in MODULES]


def queries() -> dict:
    """The caller's session keeps its settings."""
    return {k: v for m in _load() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _load() for k, v in m.ORACLE.items()}

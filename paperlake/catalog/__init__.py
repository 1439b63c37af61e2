"""The registered queries of the reference's operators, each with the DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

import importlib

REGISTRY: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("graph_queries", "question_queries", "vector_queries", "result_queries", "analytics_queries", "ingest_queries", "stream_queries", "access_queries")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")

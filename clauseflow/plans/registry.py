"""Every query of the library by name, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "cross_policy_findings"
MODULES = ["conflicts", "ecosystem", "textual", "web", "crawl", "records", "graphs", "metrics", "evaluation", "pipeline"]


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        out |= import_module(f".{m}", __package__).QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for name, (_, sql) in _all().items() if sql is not None}

"""Every registered query and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def compare(name: str, oracle: str) -> None:
    """SQL for a query that is registered."""
    if name not in _QUERIES or name in _ORACLES:
        raise ValueError(f"{name} isn't registered or has SQL")
    _ORACLES[name] = oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    import importlib

    for module in ("counting", "alignment", "analytics", "formats", "workflows", "files", "recursion", "further"):
        importlib.import_module(f"helixframe.plans.{module}")

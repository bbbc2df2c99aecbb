"""Queries of the game-log part of the library, gathered from the modules of hardwood.plans."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hardwood import plans


def _modules():
    return [importlib.import_module(f"{plans.__name__}.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLE", {}).items()}

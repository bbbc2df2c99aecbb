"""Queries of the corpus operators and of the pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("token_counts", "warc", "near_dups", "toxicity", "url_rules", "lattice", "quality", "pieces", "knn", "mixing", "spelling", "ranked", "fragments")


def _modules():
    return [importlib.import_module(f"hardwood.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for m in _modules() for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

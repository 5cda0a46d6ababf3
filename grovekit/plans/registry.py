"""All queries of the engine and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_corpus, q_eval, q_models, q_retrieval, q_scalars, q_store

_MODULES = (q_scalars, q_store, q_corpus, q_retrieval, q_eval, q_models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_eval.i2_occupancy(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

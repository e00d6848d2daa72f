"""Queries of the core operator for nested records (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shred import list_elements, loop_tables
from ..session import spread
from ..sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_elements(spread(table(spark, sf_dir, "verge_final_pair_level")), "pair_id", "history")


def _loop(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loop_tables(spread(table(spark, sf_dir, "verge_final_pair_level")), "pair_id", "history")[name]

    return query


QUERIES = {"p3_found": p3_found, **{f"p3_{n}": _loop(n) for n in ("steps", "verifications", "candidates", "codes")}}
SQL: dict[str, str] = {}

"""Queries over the shared test tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from navspark.catalogue import evaluation, learning, sentences, tables, tracks

    found: dict[str, Query] = {}
    for module in (sentences, tracks, tables, evaluation, learning):
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = query
    return found


# Microseconds since 1970 of the zone-less column ``ts``, whatever the session time zone.
MICROS = (
    "(unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
    " + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT))"
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Round for comparison across engines, whose trigonometry differs in the last bit."""
    chosen = set(columns)
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if c in chosen else f"`{c}`" for c in df.columns])

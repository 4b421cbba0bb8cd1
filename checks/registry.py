"""Registered queries: the Spark job, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType

from scorecast.functions.columns import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Types and rounding that both engines share; adding 0 turns -0.0 into 0.0."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            column = rounded(column.cast("double"), digits)
        elif isinstance(field.dataType, (IntegralType, BooleanType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def register(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shown(query(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add

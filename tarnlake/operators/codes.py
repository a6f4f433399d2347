"""Codes that were replaced: wanted ones bring their retired ones, rows go under the surviving code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.windows import keep_first


def with_retired(codes: DataFrame, aliases: DataFrame, code: str) -> DataFrame:
    """`codes` and every old code that one of them replaced (aliases: old, new)."""
    old = aliases.join(codes.select(F.col(code).alias("new")), "new", "left_semi").select(F.col("old").alias(code))
    return codes.select(code).unionByName(old).distinct()


def under_surviving(rows: DataFrame, aliases: DataFrame, code: str, key: list[str], ties: list[Column]) -> DataFrame:
    """Rows under their surviving code; where its own row has the same key, that one stays."""
    marked = rows.join(aliases.select(F.col("old").alias("__old"), F.col("new").alias("__new")), F.col(code) == F.col("__old"), "left")
    marked = marked.withColumn("__alias", F.col("__new").isNotNull()).withColumn(code, F.coalesce("__new", code)).drop("__old", "__new")
    return keep_first(marked, key, [F.asc("__alias"), *ties]).drop("__alias")


def read_panel(table: DataFrame, aliases: DataFrame, codes: list, start: str, end: str, code: str, day: str, key: list[str], columns: list[str], ties: list[Column]) -> DataFrame:
    """key and columns of the wanted codes within the dates, in order of the key. Dates and columns reach the file scan."""
    schema = table.select(code).schema
    wanted = table.sparkSession.createDataFrame([(c,) for c in codes], schema)
    every = with_retired(wanted, aliases, code)
    rows = table.where(F.col(day).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).select(*dict.fromkeys([*key, *columns]))
    rows = rows.join(every, code, "left_semi")
    return under_surviving(rows, aliases, code, key, ties).join(wanted, code, "left_semi").select(*dict.fromkeys([*key, *columns])).orderBy(*key)

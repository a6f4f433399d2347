"""Rows by order: latest versions, running states, intervals, dense grids, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in a total order (latest-wins with descending columns)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def running_best(df: DataFrame, by: list[str], time: str, best: list[str], value: str, out: str) -> DataFrame:
    """The value of the row with the greatest `best` among all rows up to each one (a later period displaces an earlier one;
    a restatement of an earlier period does not). Rows are ordered by time, then `best`."""
    window = Window.partitionBy(*by).orderBy(F.asc_nulls_last(time), *[F.asc_nulls_last(c) for c in best]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(F.struct(*best, F.col(value).alias("__v"))).over(window)["__v"])


def validity(df: DataFrame, by: list[str], start: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Half-open intervals [start, next start): the end of the last is NULL."""
    return df.withColumn(valid_from, F.col(start)).withColumn(valid_to, F.lead(start).over(Window.partitionBy(*by).orderBy(start)))


def backfill_gaps(df: DataFrame, key: str, value: str, start: str, end: str, first_day: str) -> DataFrame:
    """Inclusive date intervals plus what lies before the first and between two of them, filled with the next value.

    Columns: key, value, valid_from, valid_to (NULL: open), backfilled.
    """
    order = Window.partitionBy(key).orderBy(start)
    known = df.select(key, value, F.col(start).alias("valid_from"), F.col(end).alias("valid_to"), F.lit(False).alias("backfilled"))
    first = df.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    before = first.where(F.col(start) > F.lit(first_day).cast("date")).select(key, value, F.lit(first_day).cast("date").alias("valid_from"), F.date_sub(start, 1).alias("valid_to"), F.lit(True).alias("backfilled"))
    nxt = df.withColumn("__next", F.lead(start).over(order)).withColumn("__value", F.lead(value).over(order))
    gaps = nxt.where(F.col("__next") > F.date_add(end, 1)).select(key, F.col("__value").alias(value), F.date_add(end, 1).alias("valid_from"), F.date_sub("__next", 1).alias("valid_to"), F.lit(True).alias("backfilled"))
    return known.unionByName(before).unionByName(gaps)


def dense_grid(facts: DataFrame, key: str, day: str, days: DataFrame, values: list[str]) -> DataFrame:
    """Every day of `days` between a key's first and last row; missing values are NULL.

    Each key's row of bounds carries the sessions as one array (a session is a day: some 250 a year, whatever the number of
    keys) and unfolds those between its bounds, so nothing is compared but a key with its own days.
    """
    bounds = facts.groupBy(key).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    sessions = days.select(F.col(day)).distinct().agg(F.sort_array(F.collect_list(day)).alias("__all"))
    inside = F.filter("__all", lambda d: d.between(F.col("__a"), F.col("__b")))
    grid = bounds.join(F.broadcast(sessions), F.lit(True)).select(key, F.explode(inside).alias(day))  # one row
    return grid.join(facts.select(key, day, *values), [key, day], "left")


def fill_forward(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, rows: int, least: int, out: str) -> DataFrame:
    """Mean of the last `rows` rows where at least `least` of them have a value."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(window) >= least, F.avg(value).over(window)))


def fifo_debts(df: DataFrame, by: list[str], order: str, bought: str, repaid: str, out: str) -> DataFrame:
    """What is left of each purchase after first-in-first-out repayments; repayments beyond the debt of the day are lost.

    Closed form: with S the running sum of bought - repaid, the debt is S - min(0, running minimum of S); the part of all
    purchases that is paid off at the end is their sum less the last debt, and it consumes purchases from the first on.
    """
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    df = df.withColumn("__s", F.sum(F.col(bought) - F.col(repaid)).over(up_to)).withColumn("__c", F.sum(bought).over(up_to))
    df = df.withColumn("__low", F.least(F.lit(0.0), F.min("__s").over(up_to)))
    df = df.withColumn("__debt", F.last(F.col("__s") - F.col("__low")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.withColumn("__paid", F.max("__c").over(whole) - F.col("__debt"))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.col(bought), F.col("__c") - F.col("__paid")))).drop("__s", "__c", "__low", "__debt", "__paid")

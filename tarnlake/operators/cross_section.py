"""Cross-sectional operators: ranks, clipping, standardising, neutralising, information coefficients, ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties at their mean; NULL stays NULL."""
    group = [*by, F.col(value).isNull()]
    rank = F.rank().over(Window.partitionBy(*group).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.when(F.col(value).isNotNull(), rank + (ties - 1) / F.lit(2.0))


def percent_rank(value: str, by: list[str]) -> Column:
    return average_rank(value, by) / F.nullif(F.count(value).over(Window.partitionBy(*by)), F.lit(0))


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def winsorise_mad(df: DataFrame, value: str, by: list[str], k: float, out: str) -> DataFrame:
    """Clip to median +- k * 1.4826 * MAD of the group."""
    window = Window.partitionBy(*by)
    df = df.withColumn("__m", F.median(value).over(window)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    df = df.withColumn("__w", F.lit(k * 1.4826) * F.median("__d").over(window))
    return df.withColumn(out, clip(F.col(value), F.col("__m") - F.col("__w"), F.col("__m") + F.col("__w"))).drop("__m", "__d", "__w")


def winsorise_quantile(df: DataFrame, value: str, by: list[str], q: float, out: str) -> DataFrame:
    window = Window.partitionBy(*by)
    return df.withColumn(out, clip(F.col(value), F.percentile(value, F.lit(q)).over(window), F.percentile(value, F.lit(1 - q)).over(window)))


def standardise(df: DataFrame, value: str, by: list[str], out: str, weight: str | None = None) -> DataFrame:
    """(x - mean) / sample sd; the mean weighted if asked for; NULL where the sd is 0 or unknown."""
    window = Window.partitionBy(*by)
    mean = F.avg(value).over(window)
    if weight:
        known = F.when(F.col(value).isNotNull(), F.col(weight))
        mean = F.sum(F.col(value) * F.col(weight)).over(window) / F.nullif(F.sum(known).over(window), F.lit(0.0))
    return df.withColumn(out, (F.col(value) - mean) / F.nullif(F.stddev_samp(value).over(window), F.lit(0.0)))


def neutralise(df: DataFrame, value: str, covariate: str, group: str, by: list[str], out: str, least: int = 10) -> DataFrame:
    """Residual of value on group dummies and one covariate, per `by`: demean both within the groups, then one slope.

    Rows with a NULL input get NULL and take no part; fewer than `least` complete rows of a `by` give NULL.
    """
    whole = F.col(value).isNotNull() & F.col(covariate).isNotNull() & F.col(group).isNotNull()
    cell, date = Window.partitionBy(*by, group), Window.partitionBy(*by)
    df = df.withColumn("__y", F.when(whole, F.col(value))).withColumn("__x", F.when(whole, F.col(covariate)))
    df = df.withColumn("__y", F.col("__y") - F.avg("__y").over(cell)).withColumn("__x", F.col("__x") - F.avg("__x").over(cell))
    slope = F.coalesce(F.try_divide(F.sum(F.col("__x") * F.col("__y")).over(date), F.sum(F.col("__x") * F.col("__x")).over(date)), F.lit(0.0))
    return df.withColumn(out, F.when(F.count("__y").over(date) >= least, F.col("__y") - slope * F.col("__x"))).drop("__x", "__y")


def information_coefficient(df: DataFrame, factor: str, forward: str, by: list[str], least: int = 30) -> DataFrame:
    """by..., ic, rank_ic, n of complete pairs; groups with fewer than `least` pairs or no variance are dropped."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    pairs = pairs.withColumn("__a", average_rank(factor, by)).withColumn("__b", average_rank(forward, by))
    out = pairs.groupBy(*by).agg(F.corr(factor, forward).alias("ic"), F.corr("__a", "__b").alias("rank_ic"), F.count(F.lit(1)).alias("n"), F.var_pop(factor).alias("__va"), F.var_pop(forward).alias("__vb"))
    return out.where((F.col("n") >= least) & (F.col("__va") > 1e-15) & (F.col("__vb") > 1e-15)).drop("__va", "__vb")


def quantile_ladder(df: DataFrame, factor: str, forward: str, by: list[str], n: int) -> DataFrame:
    """by..., quantile, mean_return, count; quantile 0 is top less bottom (NULL if either is missing), its count that of both."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    q = F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(percent_rank(factor, by) * n))).cast("int")
    ladder = pairs.withColumn("quantile", q).groupBy(*by, "quantile").agg(F.avg(forward).alias("mean_return"), F.count(F.lit(1)).alias("count"))
    spread = ladder.groupBy(*by).agg((F.max(F.when(F.col("quantile") == n, F.col("mean_return"))) - F.max(F.when(F.col("quantile") == 1, F.col("mean_return")))).alias("mean_return"), F.sum(F.when(F.col("quantile").isin(1, n), F.col("count"))).alias("count"))
    return ladder.unionByName(spread.withColumn("quantile", F.lit(0)).select(*by, "quantile", "mean_return", "count"))


def step_down(df: DataFrame, p: str, out: str) -> DataFrame:
    """Holm: running maximum of (m - i + 1) p in ascending order, at most 1. The rows are one family of tests."""
    order = Window.orderBy(p)
    df = df.withColumn("__i", F.row_number().over(order)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))
    df = df.withColumn(out, F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))))
    return df.drop("__i", "__m")


def step_up(df: DataFrame, p: str, out: str, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg: running minimum of m p / i from the largest down; dependent: times the harmonic sum (Yekutieli)."""
    df = df.withColumn("__i", F.row_number().over(Window.orderBy(p))).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))
    scale = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda s, k: s + 1 / k.cast("double")) if dependent else F.lit(1.0)
    low = F.min(scale * F.col("__m") * F.col(p) / F.col("__i")).over(Window.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.least(F.lit(1.0), low)).drop("__i", "__m")

"""Factors made of fundamentals, by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _build() -> dict[str, Column]:
    """Each needs columns ttm, before, equity or market_value (in units of ten thousand) of its frame."""
    ttm, before, equity, value = (F.col(c) for c in ("ttm", "before", "equity", "market_value"))
    return {
        "earnings_yield": F.when(value > 0, ttm / (value * 1e4)),
        "roe": F.when(equity > 0, ttm / equity),
        "profit_growth": F.when(before > 0, ttm / before - 1),
    }


def fundamentals(rows: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """keys..., factor, value: the named factors (all of them unless given) in one pass, missing values left out."""
    columns = _build()
    each = F.array(*[F.struct(F.lit(n).alias("factor"), F.round(columns[n], 8).alias("value")) for n in names or columns])
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.factor", "x.value").where("value is not null")

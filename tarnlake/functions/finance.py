"""Closed forms and root searches of derivatives and valuation, as vectorised functions of Spark columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of W. J. Cody's rational approximations of erf and erfc (Math. Comp. 23, 1969).
_NEAR = ([1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
         [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
_MIDDLE = ([2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
            8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
           [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
            3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3])
_FAR = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4],
        [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to about 1e-15, in whole arrays."""
    x = np.asarray(x, float)
    y = np.minimum(np.abs(x), 27.0)
    ratio = lambda c, t: np.polyval(c[0], t) / np.polyval(c[1], t)
    with np.errstate(all="ignore"):
        near = y * ratio(_NEAR, y * y)
        back = 1 / np.maximum(y * y, 1e-300)
        far = (1 / math.sqrt(math.pi) - back * ratio(_FAR, back)) / np.maximum(y, 1e-300)
        rest = np.exp(-y * y) * np.where(y <= 4, ratio(_MIDDLE, y), far)
    return np.copysign(np.where(y <= 0.46875, near, 1 - rest), x)


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def black76(f, k, t, r, sigma, call):
    """Forward option value."""
    d1 = (np.log(f / k) + 0.5 * sigma**2 * t) / (sigma * np.sqrt(t))
    d2 = d1 - sigma * np.sqrt(t)
    sign = np.where(call, 1.0, -1.0)
    return np.exp(-r * t) * sign * (f * _normal(sign * d1) - k * _normal(sign * d2))


@F.pandas_udf(DoubleType())
def black76_price(f: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, sigma: pd.Series, call: pd.Series) -> pd.Series:
    return pd.Series(black76(*(x.to_numpy(float) for x in (f, k, t, r, sigma)), call.to_numpy(bool)))


@F.pandas_udf(DoubleType())
def implied_vol(price: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, call: pd.Series) -> pd.Series:
    """Volatility in [1e-4, 5] by halving; NULL where no volatility gives the price."""
    p, f, k, t, r = (x.to_numpy(float) for x in (price, f, k, t, r))
    call = call.to_numpy(bool)
    low, high = np.full(len(p), 1e-4), np.full(len(p), 5.0)
    with np.errstate(all="ignore"):
        good = (black76(f, k, t, r, low, call) <= p) & (p <= black76(f, k, t, r, high, call))
        for _ in range(100):
            mid = (low + high) / 2
            below = black76(f, k, t, r, mid, call) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
    return pd.Series(np.where(good, (low + high) / 2, np.nan))


def black76_gamma(f: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    d1 = (F.ln(f / k) + 0.5 * sigma * sigma * t) / (sigma * F.sqrt(t))
    return F.exp(-r * t) * F.exp(-d1 * d1 / 2) / F.sqrt(2 * F.pi()) / (f * sigma * F.sqrt(t))


def annuity_years(cap: Column, base: Column, excess: Column, rate: float, most: float) -> Column:
    """Years for which an excess profit must last to justify the price over its base; 0 if it needs none, at most `most`."""
    x = (cap - base) * rate / excess
    years = F.when(x < 1, -F.ln(1 - F.least(x, F.lit(1 - 1e-12))) / math.log1p(rate)).otherwise(F.lit(most))
    return F.when(cap <= base, F.lit(0.0)).when(excess > 0, F.least(years, F.lit(most)))


def implied_growth(cap: Column, profit: Column, rate: float, years: int, steps: int = 80) -> Column:
    """Growth g in [-0.5, 1] at which `years` of growing profits and a flat perpetuity are worth `cap`, by halving."""

    def worth(g: Column) -> Column:
        q = (1 + g) / (1 + rate)
        stream = F.when(F.abs(q - 1) < 1e-12, F.lit(float(years))).otherwise(q * (1 - F.pow(q, F.lit(years))) / (1 - q))
        return profit * (stream + F.pow(q, F.lit(years)) / rate)

    start = F.struct(F.lit(-0.5).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = worth(mid) < cap
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(profit > 0, found)


def interpolated_rate(day: Column, tenors: list[int], rates: list[Column]) -> Column:
    """Linear between tenors, flat beyond them; simple on 360 days to continuous on 365."""
    out = rates[-1]
    for i in range(len(tenors) - 2, -1, -1):
        share = (day - tenors[i]) / F.lit(float(tenors[i + 1] - tenors[i]))
        out = F.when(day <= tenors[i + 1], rates[i] + share * (rates[i + 1] - rates[i])).otherwise(out)
    out = F.when(day <= tenors[0], rates[0]).otherwise(out)
    return F.ln(1 + out * day / 360) * 365 / day


def third_friday(month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(month, "month"), 1), "FR"), 14)


def blended_index(v1: Column, n1: Column, v2: Column, n2: Column, target: float, year: float) -> Column:
    """100 times the root of the variance blended to a constant maturity."""
    t1, t2 = n1 / year, n2 / year
    blend = t1 * v1 * (n2 - target) / (n2 - n1) + t2 * v2 * (target - n1) / (n2 - n1)
    return 100 * F.sqrt(blend * (year / target))


def position_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., long, short and net sums, rounded to cents."""
    long, short = F.sum("long"), F.sum("short")
    return rows.groupBy(*by).agg(F.round(long, 2).alias("long"), F.round(short, 2).alias("short"), F.round(long - short, 2).alias("net"))


def years_paid(cap: Column, base: Column, excess: Column, rate: float, most: float) -> Column:
    """Years of an excess profit that a value pays for over its base, in [0, most]; NULL without a positive excess."""
    x = rate * (cap - base) / excess
    years = F.when(x >= 1, F.lit(most)).otherwise(F.least(-F.ln(1 - F.least(x, F.lit(1 - 1e-15))) / math.log1p(rate), F.lit(most)))
    return F.when(excess > 0, F.when(cap <= base, F.lit(0.0)).otherwise(years))


def implied_price(cap: Column, profit: Column, price: Column, sensitivity: Column, multiple: float) -> Column:
    """The commodity price at which `multiple` times a profit linear in it is worth `cap`; NULL unless profit rises with it."""
    return F.when(sensitivity > 0, price + (cap / multiple - profit) / sensitivity)

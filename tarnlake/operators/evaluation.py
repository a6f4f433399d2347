"""Evaluation of factors over horizons: information coefficients, ladders, tests of their series, adjustment of the family."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.functions import statistics as S
from tarnlake.operators import cross_section as X

#: Dates of a series at least, for its tests, and for a joint resampling.
LEAST_DATES = 20
KEYS = ["trade_date", "factor", "horizon"]


def forward_returns(prices: DataFrame, day: str, code: str, price: str, horizons: list[int]) -> DataFrame:
    """trade_date, code, horizon, fwd: the change of price over each horizon, in rows of one sorted pass; missing ones left out."""
    w = Window.partitionBy(code).orderBy(day)
    wide = prices.select(F.col(day).alias("trade_date"), F.col(code).alias("code"), *[(F.lead(price, h).over(w) / F.col(price) - 1).alias(f"__f{h}") for h in horizons])
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__f{h}").alias("fwd")) for h in horizons])
    return wide.select("trade_date", "code", F.explode(each).alias("x")).select("trade_date", "code", "x.horizon", "x.fwd").where("fwd is not null")


def joined(factors: DataFrame, returns: DataFrame) -> DataFrame:
    """Every factor with every horizon on (trade_date, code); one shuffle serves all of them."""
    return factors.where("value is not null").join(returns, ["trade_date", "code"])


def coefficients(both: DataFrame, least: int = 30) -> DataFrame:
    return X.information_coefficient(both, "value", "fwd", KEYS, least)


def ladders(both: DataFrame, n: int = 5) -> DataFrame:
    return X.quantile_ladder(both, "value", "fwd", KEYS, n)


def thinned(spreads: DataFrame, by: list[str], day: str, horizon: str) -> DataFrame:
    """Every h-th row of each series in order of its dates, from the first on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(day)) - 1
    return spreads.withColumn("__n", n).where(F.col("__n") % F.col(horizon) == 0).drop("__n")


def return_statistics(rows: DataFrame, by: list[str], day: str, value: str, periods: float, horizon: str | None = None) -> DataFrame:
    """n, mean, sd, sharpe_period, ann_return, ann_vol, sharpe, max_drawdown, hit_rate, skew, kurtosis (3 for a normal) of each
    series; a year holds `periods` of them, or periods over the horizon. No spread: skew 0, kurtosis 3, no ratio."""
    scale = F.lit(float(periods)) if horizon is None else F.lit(float(periods)) / F.first(horizon)
    path = Window.partitionBy(*by).orderBy(day)
    x = F.col(value)
    # a loss of everything ends the path; logarithms carry the product otherwise
    r = rows.where(x.isNotNull()).withColumn("__v", F.exp(F.sum(F.ln(F.greatest(1 + x, F.lit(1e-300)))).over(path)))
    r = r.withColumn("__d", F.col("__v") / F.greatest(F.lit(1.0), F.max("__v").over(path)) - 1)
    whole = Window.partitionBy(*by)
    r = r.withColumn("__m", F.avg(x).over(whole))
    dev = x - F.col("__m")
    sd, mean, var = F.stddev_samp(x), F.avg(x), F.avg(dev * dev)
    flat = F.coalesce(sd, F.lit(0.0)) <= 1e-15
    per = F.when(~flat, mean / sd)
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mean.alias("mean"), sd.alias("sd"), per.alias("sharpe_period"), (mean * scale).alias("ann_return"), (sd * F.sqrt(scale)).alias("ann_vol"), (per * F.sqrt(scale)).alias("sharpe"),
        F.least(F.min("__d"), F.lit(0.0)).alias("max_drawdown"), F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.when(flat, 0.0).otherwise(F.avg(dev * dev * dev) / F.pow(var, 1.5)).alias("skew"), F.when(flat, 3.0).otherwise(F.avg(dev * dev * dev * dev) / (var * var)).alias("kurtosis"),
    )


TESTS = "factor string, horizon int, metric string, window string, value double, se double, t double, p double, ci_lo double, ci_hi double"


def series_tests(ic: DataFrame, periods: dict[str, tuple[str, str]] | None = None, draws: int = 999, seed: int = 7) -> DataFrame:
    """TESTS rows of each (factor, horizon) with LEAST_DATES dates or more: ic_mean (HAC t and bootstrap interval), icir
    (bootstrap), fisher_z (Stouffer), break (largest F; t holds the row of the split), ic_mean of each period with three
    dates or more. `ic`: trade_date, factor, horizon, ic, n. A series has a row a date, so each is one small group."""
    periods = periods or {}

    def test(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("trade_date")
        factor, h = f["factor"].iloc[0], int(f["horizon"].iloc[0])
        x, days = f["ic"].to_numpy(float), f["trade_date"].astype(str)
        none, rows = (None,) * 5, []
        if len(x) >= LEAST_DATES:
            block = S.block_length(h)
            mean, se, t, p = S.hac_mean(x, h)
            low, high, _ = S.bootstrap_interval(x, block, draws, seed)
            rows.append((factor, h, "ic_mean", "full", mean, se, t, p, low, high))
            low, high, p = S.bootstrap_interval(x, block, draws, seed, statistic=S.information_ratio)
            rows.append((factor, h, "icir", "full", S.information_ratio(x), None, None, p, low, high))
            z, p = S.stouffer_z(x, f["n"].to_numpy(float))
            rows.append((factor, h, "fisher_z", "full", z, None, z, p, None, None))
            at, stat = S.sup_f_break(x, h)
            rows.append((factor, h, "break", "full", stat, None, float(at), float(stat > S.BREAK_CRITICAL), None, None))
            for name, (first, last) in periods.items():
                part = x[((days >= first) & (days <= last)).to_numpy()]
                if len(part) >= 3:
                    rows.append((factor, h, "ic_mean", name, *S.hac_mean(part, h), *none[:2]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TESTS.split(", ")])

    return ic.select("trade_date", "factor", "horizon", "ic", "n").groupBy("factor", "horizon").applyInPandas(test, TESTS)


ADJUSTED = TESTS + ", p_holm double, p_bh double, p_bhy double, p_romano_wolf double, hurdle double"


def family(tests: DataFrame, ic: DataFrame, draws: int = 999, seed: int = 7, hurdle: float = 3.0) -> DataFrame:
    """The full-window ic_mean rows of a campaign with p values adjusted over all of them, and whether |t| passes the hurdle.

    Romano-Wolf draws resample the dates that all series have, together; it needs two members and LEAST_DATES dates. The
    family is a row a test and the series a row a date, so both are one small group.
    """
    chosen = tests.where("metric = 'ic_mean' and window = 'full'").withColumn("k", F.lit(1))
    series = ic.select(F.lit(1).alias("k"), "trade_date", "factor", "horizon", "ic")

    def adjust(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["factor", "horizon"]).reset_index(drop=True)
        p, m = rows["p"].to_numpy(float), len(rows)
        order = np.argsort(p, kind="stable")
        rank = np.arange(1, m + 1)
        back = np.empty(m, int)
        back[order] = np.arange(m)
        holm = np.maximum.accumulate(np.minimum(1, (m - rank + 1) * p[order]))[back]
        up = lambda c: np.minimum.accumulate(np.minimum(1, c * m * p[order] / rank)[::-1])[::-1][back]
        wide = points.pivot_table(index="trade_date", columns=["factor", "horizon"], values="ic").sort_index()
        matrix = wide[[tuple(x) for x in rows[["factor", "horizon"]].to_numpy()]].dropna().to_numpy() if m else np.zeros((0, 0))
        rw = np.full(m, np.nan)
        if m >= 2 and len(matrix) >= LEAST_DATES:
            at = S.block_indices(len(matrix), S.block_length(int(rows["horizon"].max())), draws, seed)
            boot = np.array([matrix[i].mean(0) for i in at]) - matrix.mean(0)
            rw = S.romano_wolf(rows["t"].to_numpy(float), boot / rows["se"].to_numpy(float))
        out = rows.assign(p_holm=holm, p_bh=up(1.0), p_bhy=up((1 / rank).sum()), p_romano_wolf=rw, hurdle=(rows["t"].abs() >= hurdle).astype(float))
        return out[[c.split()[0] for c in ADJUSTED.split(", ")]]

    return chosen.groupBy("k").cogroup(series.groupBy("k")).applyInPandas(adjust, ADJUSTED)


def profiles(means: DataFrame) -> DataFrame:
    """factor, peak_horizon, half_life, decay_r2, accumulation_ratio of the mean ICs (factor, horizon, ic) of each factor."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        d = S.decay_profile({int(h): float(v) for h, v in zip(f["horizon"], f["ic"], strict=True)})
        return pd.DataFrame({"factor": [f["factor"].iloc[0]], "peak_horizon": [d["peak_horizon"]], "half_life": [d["half_life"]], "decay_r2": [d["r2"]], "accumulation_ratio": [d["accumulation_ratio"]]})

    return means.groupBy("factor").applyInPandas(one, "factor string, peak_horizon double, half_life double, decay_r2 double, accumulation_ratio double")


def canonical_params(params: dict) -> str:
    """Parameters as text, the same whatever the order of their keys."""
    return json.dumps(params, sort_keys=True, default=str)


def add_trials(log: DataFrame, found: DataFrame, campaign: str) -> DataFrame:
    """New rows of a trial log: variants (factor, params, horizon) that it does not hold yet, numbered on from its count.

    `log`: campaign, trial_id, factor, params, horizon, sr, ic_mean; `found` less the first two. A campaign's variants are few.
    """
    known = log.where(F.col("campaign") == campaign)
    fresh = found.dropDuplicates(["factor", "params", "horizon"]).join(known, ["factor", "params", "horizon"], "left_anti")
    n = known.agg(F.count(F.lit(1)).alias("__n"))
    number = F.row_number().over(Window.orderBy("factor", "params", "horizon")) + F.col("__n")
    rows = fresh.join(F.broadcast(n), F.lit(True))
    return rows.select(F.lit(campaign).alias("campaign"), F.format_string(f"{campaign}-%05d", number).alias("trial_id"), "factor", "params", "horizon", "sr", "ic_mean")

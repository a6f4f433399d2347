"""A campaign of factors over horizons, from inputs to adjusted tests and the trial log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.operators import cross_section as X
from tarnlake.operators import evaluation as E
from tarnlake.plans.aggregates import _PANEL, _panel
from tarnlake.plans.joins import read

HORIZONS = [1, 2, 3]
_RANK = "rank() OVER (PARTITION BY d, factor, horizon ORDER BY {0}) + (count(*) OVER (PARTITION BY d, factor, horizon, {0}) - 1) / 2.0"
_BOTH = f"""WITH {_PANEL}, fa AS (SELECT d, code, 'f' AS factor, f AS value FROM p UNION ALL SELECT d, code, 'v', v FROM p),
fw AS ({' UNION ALL '.join(f'SELECT d, code, {h} AS horizon, lead(v, {h}) OVER (PARTITION BY code ORDER BY d) / v - 1 AS fwd FROM p' for h in HORIZONS)}),
b AS (SELECT d, code, factor, horizon, value, fwd FROM fa JOIN fw USING (d, code) WHERE value IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT d, factor, horizon, corr(value, fwd) AS ic, corr(a, b) AS rank_ic, count(*) AS n FROM (SELECT *, {_RANK.format('value')} AS a, {_RANK.format('fwd')} AS b FROM b) GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND var_pop(value) > 1e-15 AND var_pop(fwd) > 1e-15),
ql AS (SELECT d, factor, horizon, greatest(1, least(5, CAST(ceil(({_RANK.format('value')}) / count(*) OVER (PARTITION BY d, factor, horizon) * 5) AS INTEGER))) AS quantile, fwd FROM b),
la AS (SELECT d, factor, horizon, quantile, avg(fwd) AS ret, count(*) AS n FROM ql GROUP BY ALL),
sp AS (SELECT d, factor, horizon, max(ret) FILTER (quantile = 5) - max(ret) FILTER (quantile = 1) AS ret FROM la GROUP BY ALL)"""


def _both(spark, sf_dir):
    p = _panel(spark, sf_dir)
    factors = p.select(F.col("d").alias("trade_date"), "code", F.expr("stack(2, 'f', f, 'v', v) as (factor, value)"))
    return E.joined(factors, E.forward_returns(p, "d", "code", "v", HORIZONS))


@register("campaign_ic", f"{_BOTH} SELECT d AS trade_date, factor, horizon, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, n FROM ic")
def campaign_ic(spark, sf_dir):
    """Coefficients of all factors and horizons in one plan."""
    return E.coefficients(_both(spark, sf_dir)).select("trade_date", "factor", "horizon", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"), "n")


@register("campaign_ladder", f"""
{_BOTH}, m AS (SELECT factor, horizon, quantile, ret FROM la UNION ALL SELECT factor, horizon, 0, ret FROM sp) SELECT factor, horizon, quantile, count(ret) AS days, round(avg(ret), 6) AS mean_return FROM m GROUP BY 1, 2, 3""")  # fmt: skip
def campaign_ladder(spark, sf_dir):
    """Mean return of each quantile over all dates, and of top less bottom."""
    l = E.ladders(_both(spark, sf_dir))  # noqa: E741
    return l.groupBy("factor", "horizon", "quantile").agg(F.count("mean_return").alias("days"), F.round(F.avg("mean_return"), 6).alias("mean_return"))


@register("long_short_statistics", f"""
{_BOTH}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor, horizon ORDER BY d) - 1 AS i FROM sp) WHERE i % horizon = 0 AND ret IS NOT NULL),
c AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-300))) OVER (PARTITION BY factor, horizon ORDER BY d)) AS v, avg(ret) OVER (PARTITION BY factor, horizon) AS m FROM t), e AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY factor, horizon ORDER BY d)) - 1 AS dd FROM c)
SELECT factor, horizon, count(*) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(avg(ret) / stddev_samp(ret) * sqrt(12.0 / horizon), 6) AS sharpe, round(avg(ret) * 12.0 / horizon, 6) AS ann_return, round(least(min(dd), 0), 6) AS max_drawdown, round(avg(CAST(ret > 0 AS DOUBLE)), 6) AS hit_rate,
round(avg((ret - m) ** 3) / var_pop(ret) ** 1.5, 5) AS skew, round(avg((ret - m) ** 4) / var_pop(ret) ** 2, 5) AS kurtosis FROM e GROUP BY 1, 2""")  # fmt: skip
def long_short_statistics(spark, sf_dir):
    """Statistics of top less bottom, every h-th observation, so that overlapping returns do not count twice."""
    spreads = E.ladders(_both(spark, sf_dir)).where("quantile = 0")
    by = ["factor", "horizon"]
    s = E.return_statistics(E.thinned(spreads, by, "trade_date", "horizon"), by, "trade_date", "mean_return", 12.0, "horizon")
    names = ("mean", "sd", "sharpe", "ann_return", "max_drawdown", "hit_rate")
    return s.select(*by, "n", *[F.round(c, 6).alias(c) for c in names], F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"))


@register("horizon_profile", f"""
{_BOTH}, m AS (SELECT factor, horizon, avg(ic) AS ic FROM ic GROUP BY 1, 2) SELECT factor, round(max(ic) FILTER (horizon = 1), 8) AS h1, round(max(ic) FILTER (horizon = 2), 8) AS h2, round(max(ic) FILTER (horizon = 3), 8) AS h3, arg_max(horizon, abs(ic)) AS largest FROM m GROUP BY 1""")  # fmt: skip
def horizon_profile(spark, sf_dir):
    """Mean coefficients by horizon in one row a factor, and the horizon of the largest."""
    m = E.coefficients(_both(spark, sf_dir)).groupBy("factor", "horizon").agg(F.avg("ic").alias("ic"))
    at = lambda h: F.round(F.max(F.when(F.col("horizon") == h, F.col("ic"))), 8).alias(f"h{h}")
    return m.groupBy("factor").agg(*[at(h) for h in HORIZONS], F.max_by("horizon", F.abs("ic")).alias("largest"))


@register("stouffer", f"{_BOTH} SELECT factor, horizon, round(sum(atanh(greatest(least(ic, 0.999999), -0.999999)) * sqrt(greatest(n - 3, 0))) / sqrt(count(*)), 6) AS z FROM ic GROUP BY 1, 2")
def stouffer(spark, sf_dir):
    """Fisher z of each date's coefficient, scaled by its names, combined over dates."""
    z = F.atanh(F.greatest(F.least("ic", F.lit(0.999999)), F.lit(-0.999999))) * F.sqrt(F.greatest(F.col("n") - 3, F.lit(0)))
    return E.coefficients(_both(spark, sf_dir)).groupBy("factor", "horizon").agg(F.round(F.sum(z) / F.sqrt(F.count("*")), 6).alias("z"))


@register("significance")
def significance(spark, sf_dir):
    """Tests of every factor's and horizon's series of coefficients, over all dates and two periods."""
    return E.series_tests(E.coefficients(_both(spark, sf_dir)), {"early": ("1900-01-01", "1998-06-30"), "late": ("1998-07-01", "9999-12-31")})


@register("campaign_family")
def campaign_family(spark, sf_dir):
    """The campaign's mean coefficients with p values adjusted over all factors and horizons."""
    ic = E.coefficients(_both(spark, sf_dir))
    return E.family(E.series_tests(ic), ic)


@register("campaign_profiles")
def campaign_profiles(spark, sf_dir):
    """Peak, decay and accumulation of each factor over its horizons."""
    means = E.coefficients(_both(spark, sf_dir)).groupBy("factor", "horizon").agg(F.avg("ic").alias("ic"))
    return E.profiles(means)


@register("trial_log", f"""
{_BOTH}, m AS (SELECT factor, horizon, round(avg(ic), 8) AS ic_mean FROM ic GROUP BY 1, 2), k AS (SELECT * FROM m WHERE NOT (factor = 'f' AND horizon = 2))
SELECT 'monthly' AS campaign, 'monthly-' || lpad(CAST(row_number() OVER (ORDER BY factor, horizon) + 1 AS VARCHAR), 5, '0') AS trial_id, factor, '{{"lag": 1, "n": 5}}' AS params, horizon, CAST(NULL AS DOUBLE) AS sr, ic_mean FROM k""")  # fmt: skip
def trial_log(spark, sf_dir):
    """New variants of a campaign, numbered after the one that is known; a variant is told by its factor, parameters and horizon."""
    params = E.canonical_params({"n": 5, "lag": 1})
    schema = "campaign string, trial_id string, factor string, params string, horizon int, sr double, ic_mean double"
    log = spark.createDataFrame([("monthly", "monthly-00001", "f", params, 2, None, 0.0), ("other", "other-00001", "v", params, 1, None, 0.0)], schema)
    found = E.coefficients(_both(spark, sf_dir)).groupBy("factor", "horizon").agg(F.round(F.avg("ic"), 8).alias("ic_mean"))
    return E.add_trials(log, found.withColumn("params", F.lit(params)).withColumn("sr", F.lit(None).cast("double")), "monthly")


@register("feature_panel", f"""
WITH {_PANEL}, u AS (SELECT p.* FROM p WHERE code IN (SELECT p_partkey FROM part WHERE p_size > 5)),
lo AS (SELECT d, code, 'v' AS factor, v AS value FROM u UNION ALL SELECT d, code, 'f', f FROM u), me AS (SELECT *, median(value) OVER (PARTITION BY d, factor) AS m FROM lo), ab AS (SELECT *, 3 * 1.4826 * median(abs(value - m)) OVER (PARTITION BY d, factor) AS w FROM me),
cl AS (SELECT *, greatest(least(value, m + w), m - w) AS x FROM ab), z AS (SELECT d, code, factor, (x - avg(x) OVER (PARTITION BY d, factor)) / nullif(stddev_samp(x) OVER (PARTITION BY d, factor), 0) AS z FROM cl),
s AS (SELECT d, code, sum(z * CASE factor WHEN 'v' THEN 0.7 ELSE -0.3 END) AS s FROM z WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT d, code, factor, round(z, 6) AS value FROM z WHERE z IS NOT NULL UNION ALL SELECT d, code, 'score', round((s - avg(s) OVER (PARTITION BY d)) / nullif(stddev_samp(s) OVER (PARTITION BY d), 0), 6) FROM s""")  # fmt: skip
def feature_panel(spark, sf_dir):
    """From inputs to features: factors of the members of the universe, clipped and standardised each day, with their
    combination, in one long frame and one plan over all years."""
    members = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("code"))
    u = _panel(spark, sf_dir).join(members, "code", "left_semi")
    long = u.select("d", "code", F.expr("stack(2, 'v', v, 'f', f) as (factor, value)"))
    z = X.standardise(X.winsorise_mad(long, "value", ["d", "factor"], 3.0, "x"), "x", ["d", "factor"], "z").where("z is not null")
    weight = F.when(F.col("factor") == "v", 0.7).otherwise(-0.3)
    s = z.groupBy("d", "code").agg(F.sum(F.col("z") * weight).alias("s"), F.count("*").alias("n")).where("n >= 2")
    s = X.standardise(s, "s", ["d"], "z").select("d", "code", F.lit("score").alias("factor"), "z")
    return z.select("d", "code", "factor", "z").unionByName(s).select("d", "code", "factor", F.round("z", 6).alias("value"))


@register("history_start", """
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT d, lag(d, 20) OVER (ORDER BY d) AS start, min(d) OVER () AS first FROM s) SELECT d, coalesce(start, first) AS start FROM n""")  # fmt: skip
def history_start(spark, sf_dir):
    """Where reading must begin for a look back of 20 sessions from each day: the first session known, if there are not so many."""
    s = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    w = Window.orderBy("d")  # a row a session
    return s.select("d", F.coalesce(F.lag("d", 20).over(w), F.first("d").over(w)).alias("start"))


@register("filled_momentum", """
WITH m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS d FROM lineitem), p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_partkey AS code, sum(l_extendedprice) AS v, avg(l_discount) AS t FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2),
b AS (SELECT code, min(d) AS a, max(d) AS z FROM p GROUP BY 1), g AS (SELECT b.code, m.d, p.v, p.t FROM b JOIN m ON m.d BETWEEN a AND z LEFT JOIN p ON p.code = b.code AND p.d = m.d), f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY d) AS c FROM g)
SELECT code, d, round(lag(c, 3) OVER w / lag(c, 12) OVER w - 1, 6) AS momentum, round(-(c / lag(c, 3) OVER w - 1), 6) + 0.0 AS reversal, round(CASE WHEN count(t) OVER r >= 3 THEN -avg(t) OVER r END, 8) + 0.0 AS turnover FROM f WINDOW w AS (PARTITION BY code ORDER BY d), r AS (PARTITION BY code ORDER BY d ROWS 5 PRECEDING)""")  # fmt: skip
def filled_momentum(spark, sf_dir):
    """Momentum, reversal and mean turnover on the dense grid: prices carried forward over suspended days, turnover not."""
    from tarnlake.operators.windows import dense_grid, fill_forward, rolling_mean

    l = read(spark, sf_dir, "lineitem").withColumn("d", F.trunc("l_shipdate", "month"))  # noqa: E741
    p = l.where("l_quantity > 25").groupBy(F.col("l_partkey").alias("code"), "d").agg(F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("t"))
    f = rolling_mean(fill_forward(dense_grid(p, "code", "d", l.select("d"), ["v", "t"]), ["code"], "d", "v", "c"), ["code"], "d", "t", 6, 3, "u")
    w = Window.partitionBy("code").orderBy("d")
    return f.select("code", "d", F.round(F.lag("c", 3).over(w) / F.lag("c", 12).over(w) - 1, 6).alias("momentum"), (F.round(-(F.col("c") / F.lag("c", 3).over(w) - 1), 6) + 0.0).alias("reversal"), (F.round(-F.col("u"), 8) + 0.0).alias("turnover"))

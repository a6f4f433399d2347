"""Aggregations and windows: latest versions, filtered counts, digests, TTM, ladders, universe rules, factors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.operators import cross_section as X
from tarnlake.operators.windows import fifo_debts, keep_first, rolling_mean, top_n
from tarnlake.plans.joins import read


@register("latest_version", """
SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")  # fmt: skip
def latest_version(spark, sf_dir):
    return keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts")


@register("compaction", """
SELECT year(l_shipdate) AS year, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_dropped FROM
(SELECT DISTINCT * FROM lineitem) GROUP BY 1""")  # fmt: skip
def compaction(spark, sf_dir):
    """Distinct rows per year partition, and how many a key-wise latest-wins pass would drop."""
    rows = read(spark, sf_dir, "lineitem").distinct()
    return rows.groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey", "l_linenumber").alias("n_keys"), (F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("n_dropped"))


@register("quality_rates", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_totalprice > 150000) AS n_big,
round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS rate, round(avg(CAST(o_orderstatus = 'O' AS DOUBLE)), 6) AS mismatch FROM orders GROUP BY 1""")  # fmt: skip
def quality_rates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    f = F.count_if(F.col("o_orderstatus") == "F")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), f.alias("n_f"), F.count_if(F.col("o_totalprice") > 150000).alias("n_big"), F.round(f.cast("double") / F.count("*"), 6).alias("rate"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 6).alias("mismatch"))


@register("relative_difference", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_extendedprice / l_quantity - p_retailprice) / p_retailprice, 6) AS rel_diff, abs(l_extendedprice / l_quantity - p_retailprice) / p_retailprice > 0.1 AS mismatch
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND p_retailprice <> 0""")  # fmt: skip
def relative_difference(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_quantity > 0").join(read(spark, sf_dir, "part").where("p_retailprice <> 0"), F.col("l_partkey") == F.col("p_partkey"))
    diff = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) / F.col("p_retailprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(diff, 6).alias("rel_diff"), (diff > 0.1).alias("mismatch"))


@register("arg_extremes", """
SELECT o_custkey, max(o_totalprice) AS high, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS high_key, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_key, min(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS low_recent FROM orders GROUP BY 1""")  # fmt: skip
def arg_extremes(spark, sf_dir):
    order = F.struct("o_totalprice", "o_orderkey")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("high"), F.max_by("o_orderkey", order).alias("high_key"), F.min_by("o_orderkey", order).alias("low_key"), F.min(F.when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"), F.col("o_totalprice"))).alias("low_recent"))


@register("iso_week_close", """
SELECT o_orderstatus, strftime(o_orderdate, '%G-%V') AS week, max(o_orderdate) AS last_date, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders GROUP BY 1, 2""")  # fmt: skip
def iso_week_close(spark, sf_dir):
    week = F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")), F.weekofyear("o_orderdate"))
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus", week.alias("week")).agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("close"))


@register("consensus_window", """
SELECT o_custkey, median(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS mid, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'P') AS n_brokers, min(o_totalprice) AS low, max(o_totalprice) AS high
FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 365 DAY GROUP BY 1""")  # fmt: skip
def consensus_window(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderdate > timestamp'2001-08-01' - interval 365 day")
    return rows.groupBy("o_custkey").agg(F.median(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("mid"), F.countDistinct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).alias("n_brokers"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@register("content_digest", "SELECT md5(string_agg(r, chr(10) ORDER BY r)) AS digest, count(*) AS n FROM (SELECT concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment) AS r FROM customer)")
def content_digest(spark, sf_dir):
    """Digest of a table's contents whatever their order (a small table; see operators.digest for large ones)."""
    from tarnlake.operators.digest import exact_digest

    return exact_digest(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@register("scalable_digest", """
SELECT count(*) AS n, bit_xor(h) AS xor, CAST(sum(h) AS VARCHAR) AS total FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag)), 1, 15) AS BIGINT) AS h FROM lineitem)""")  # fmt: skip
def scalable_digest(spark, sf_dir):
    """Digest of a large table's contents whatever their order, by partial aggregates."""
    from tarnlake.operators.digest import scalable_digest as digest

    return digest(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


@register("running_state", """
WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS known_on, year(o_orderdate) * 100 + (o_orderkey * 7) % 12 + 1 AS period, o_totalprice AS value FROM orders)
SELECT o_orderkey, round(arg_max(value, (period, known_on, o_orderkey)) OVER (PARTITION BY o_custkey ORDER BY known_on, period, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS state,
max(period) OVER (PARTITION BY o_custkey ORDER BY known_on) AS latest_period FROM v""")  # fmt: skip
def running_state(spark, sf_dir):
    """Point-in-time state: the value of the latest period known so far; and the latest period by date, peers included."""
    v = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("known_on"), (F.year("o_orderdate") * 100 + F.col("o_orderkey") * 7 % 12 + 1).alias("period"), F.col("o_totalprice").alias("value"))
    window = Window.partitionBy("o_custkey").orderBy("known_on").rangeBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("period", "known_on", "o_orderkey", "value")).over(Window.partitionBy("o_custkey").orderBy("known_on", "period", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return v.select("o_orderkey", F.round(best["value"], 4).alias("state"), F.max("period").over(window).alias("latest_period"))


_QUARTERS = """q AS (SELECT o_custkey AS k, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
y AS (SELECT k, q, sum(v) OVER (PARTITION BY k, q // 4 ORDER BY q) AS ytd FROM q)"""


def _ytd(spark, sf_dir):
    q = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")).agg(F.sum("o_totalprice").alias("v"))
    return q.select("k", "q", F.sum("v").over(Window.partitionBy("k", F.floor(F.col("q") / 4)).orderBy("q")).alias("ytd"))


@register("trailing_twelve_months", f"""
WITH {_QUARTERS}, t AS (SELECT y.k, y.q, CASE WHEN y.q % 4 = 3 THEN y.ytd ELSE y.ytd + f.ytd - p.ytd END AS ttm FROM y
LEFT JOIN y f ON f.k = y.k AND f.q = (y.q // 4) * 4 - 1 LEFT JOIN y p ON p.k = y.k AND p.q = y.q - 4)
SELECT t.k, t.q, round(t.ttm, 2) AS ttm, round(CASE WHEN b.ttm > 0 THEN t.ttm / b.ttm - 1 END, 6) AS yoy FROM t LEFT JOIN t b ON b.k = t.k AND b.q = t.q - 4 WHERE t.ttm IS NOT NULL""")  # fmt: skip
def trailing_twelve_months(spark, sf_dir):
    """Year-to-date plus last full year less the same period a year ago; and its change on a year."""
    y = _ytd(spark, sf_dir)
    side = lambda n: y.select(F.col("k").alias(f"{n}k"), F.col("q").alias(f"{n}q"), F.col("ytd").alias(f"{n}v"))
    t = y.join(side("f"), (F.col("k") == F.col("fk")) & (F.col("fq") == F.floor(F.col("q") / 4) * 4 - 1), "left").join(side("p"), (F.col("k") == F.col("pk")) & (F.col("pq") == F.col("q") - 4), "left")
    t = t.select("k", "q", F.when(F.col("q") % 4 == 3, F.col("ytd")).otherwise(F.col("ytd") + F.col("fv") - F.col("pv")).alias("ttm")).where("ttm is not null")
    b = t.select(F.col("k").alias("bk"), (F.col("q") + 4).alias("bq"), F.col("ttm").alias("before"))
    out = t.join(b, (F.col("k") == F.col("bk")) & (F.col("q") == F.col("bq")), "left")
    return out.select("k", "q", F.round("ttm", 2).alias("ttm"), F.round(F.when(F.col("before") > 0, F.col("ttm") / F.col("before") - 1), 6).alias("yoy"))


@register("single_quarters", f"""
WITH {_QUARTERS} SELECT k, q, round(CASE WHEN q % 4 = 0 THEN ytd WHEN lag(q) OVER w = q - 1 THEN ytd - lag(ytd) OVER w END, 2) AS v FROM y WINDOW w AS (PARTITION BY k ORDER BY q)""")  # fmt: skip
def single_quarters(spark, sf_dir):
    """Year-to-date figures to single quarters; NULL if the quarter before is missing."""
    w = Window.partitionBy("k").orderBy("q")
    v = F.when(F.col("q") % 4 == 0, F.col("ytd")).when(F.lag("q").over(w) == F.col("q") - 1, F.col("ytd") - F.lag("ytd").over(w))
    return _ytd(spark, sf_dir).select("k", "q", F.round(v, 2).alias("v"))


@register("universe_rules", """
WITH s AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'exchange' END, CASE WHEN c_acctbal < 0 THEN 'st' END, CASE WHEN coalesce(n, 0) < 8 THEN 'new' END,
CASE WHEN last < TIMESTAMP '2001-01-01' THEN 'suspended' END, CASE WHEN p > 2 THEN 'delisting' END) AS reason,
CASE WHEN c_mktsegment = 'MACHINERY' OR c_acctbal < 0 OR coalesce(n, 0) < 8 OR last < TIMESTAMP '2001-01-01' OR p > 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS in_universe FROM customer LEFT JOIN s ON o_custkey = c_custkey""")  # fmt: skip
def universe_rules(spark, sf_dir):
    """Which rules keep a name out of the universe, comma-joined ('' for members); and whether it is in."""
    s = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    rows = read(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    rules = (("exchange", "c_mktsegment = 'MACHINERY'"), ("st", "c_acctbal < 0"), ("new", "coalesce(n, 0) < 8"), ("suspended", "last < timestamp'2001-01-01'"), ("delisting", "p > 2"))
    reason = F.concat_ws(",", *[F.when(F.expr(rule), name) for name, rule in rules])
    return rows.select("c_custkey", reason.alias("reason"), F.when(reason == "", 1.0).otherwise(0.0).alias("in_universe"))


@register("regression_by_group", """
SELECT p_brand, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 8""")  # fmt: skip
def regression_by_group(spark, sf_dir):
    """Sensitivity: slope, fit and count of a least-squares line per group."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    y, x = "l_extendedprice", "l_quantity"
    out = rows.groupBy("p_brand").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))
    return out.where("n >= 8")


@register("fifo_margin_ladder", """
WITH d AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS bought, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS repaid, o_orderdate AS t FROM orders),
s AS (SELECT *, sum(bought - repaid) OVER w AS s, sum(bought) OVER w AS c FROM d WINDOW w AS (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING)) AS debt FROM s),
e AS (SELECT *, max(c) OVER (PARTITION BY k) - last_value(debt) OVER (PARTITION BY k ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS paid FROM m)
SELECT i, round(greatest(0, least(bought, c - paid)), 2) AS debt FROM e WHERE bought > 0""")  # fmt: skip
def fifo_margin_ladder(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.struct("o_orderdate", "o_orderkey").alias("t"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0).alias("bought"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("repaid"))
    return fifo_debts(rows, ["k"], "t", "bought", "repaid", "debt").where("bought > 0").select("i", F.round("debt", 2).alias("debt"))


_PANEL = "p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_partkey AS code, sum(l_extendedprice) AS v, round(avg(l_discount), 6) AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _panel(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d"), F.col("l_partkey").alias("code")).agg(F.sum("l_extendedprice").alias("v"), F.round(F.avg("l_discount"), 6).alias("f"), F.count("*").alias("n"))


@register("momentum_reversal", f"""
WITH {_PANEL} SELECT d, code, round(lag(v, 1) OVER w / lag(v, 4) OVER w - 1, 6) AS momentum, round(-(v / lag(v, 1) OVER w - 1), 6) AS reversal,
round(CASE WHEN count(f) OVER r >= 3 THEN -avg(f) OVER r END, 6) AS turnover, round(lead(v, 2) OVER w / lead(v, 1) OVER w - 1, 6) AS forward FROM p
WINDOW w AS (PARTITION BY code ORDER BY d), r AS (PARTITION BY code ORDER BY d ROWS 4 PRECEDING)""")  # fmt: skip
def momentum_reversal(spark, sf_dir):
    """Factors on a panel: momentum, reversal, mean turnover with a least count; and the forward return."""
    p, w = _panel(spark, sf_dir), Window.partitionBy("code").orderBy("d")
    p = rolling_mean(p, ["code"], "d", "f", 5, 3, "t")
    ratio = lambda a, b: F.round(a / b - 1, 6)
    return p.select("d", "code", ratio(F.lag("v", 1).over(w), F.lag("v", 4).over(w)).alias("momentum"), F.round(-(F.col("v") / F.lag("v", 1).over(w) - 1), 6).alias("reversal"), F.round(-F.col("t"), 6).alias("turnover"), ratio(F.lead("v", 2).over(w), F.lead("v", 1).over(w)).alias("forward"))


@register("winsorised_zscore", f"""
WITH {_PANEL}, m AS (SELECT *, median(v) OVER (PARTITION BY d) AS m FROM p), a AS (SELECT *, 3 * 1.4826 * median(abs(v - m)) OVER (PARTITION BY d) AS w FROM m),
c AS (SELECT *, greatest(least(v, m + w), m - w) AS x FROM a)
SELECT d, code, round(x, 4) AS clipped, round((x - avg(x) OVER (PARTITION BY d)) / nullif(stddev_samp(x) OVER (PARTITION BY d), 0), 6) AS z FROM c""")  # fmt: skip
def winsorised_zscore(spark, sf_dir):
    p = X.standardise(X.winsorise_mad(_panel(spark, sf_dir), "v", ["d"], 3.0, "x"), "x", ["d"], "z")
    return p.select("d", "code", F.round("x", 4).alias("clipped"), F.round("z", 6).alias("z"))


@register("quantile_clip_weighted_zscore", f"""
WITH {_PANEL}, q AS (SELECT *, quantile_cont(v, 0.05) OVER (PARTITION BY d) AS lo, quantile_cont(v, 0.95) OVER (PARTITION BY d) AS hi FROM p), c AS (SELECT *, greatest(least(v, hi), lo) AS x FROM q)
SELECT d, code, round(x, 4) AS clipped, round((x - sum(x * n) OVER (PARTITION BY d) / sum(n) OVER (PARTITION BY d)) / nullif(stddev_samp(x) OVER (PARTITION BY d), 0), 6) AS z FROM c""")  # fmt: skip
def quantile_clip_weighted_zscore(spark, sf_dir):
    p = X.standardise(X.winsorise_quantile(_panel(spark, sf_dir), "v", ["d"], 0.05, "x"), "x", ["d"], "z", "n")
    return p.select("d", "code", F.round("x", 4).alias("clipped"), F.round("z", 6).alias("z"))


@register("neutralised_factor", f"""
WITH {_PANEL}, j AS (SELECT p.*, p_brand AS g, ln(p_retailprice) AS x FROM p JOIN part ON p_partkey = code), c AS (SELECT *, v - avg(v) OVER (PARTITION BY d, g) AS yd, x - avg(x) OVER (PARTITION BY d, g) AS xd FROM j)
SELECT d, code, round(CASE WHEN count(*) OVER (PARTITION BY d) >= 10 THEN yd - coalesce(sum(xd * yd) OVER (PARTITION BY d) / nullif(sum(xd * xd) OVER (PARTITION BY d), 0), 0) * xd END, 2) AS residual FROM c""")  # fmt: skip
def neutralised_factor(spark, sf_dir):
    p = _panel(spark, sf_dir).join(read(spark, sf_dir, "part"), F.col("code") == F.col("p_partkey")).withColumn("x", F.ln("p_retailprice"))
    return X.neutralise(p, "v", "x", "p_brand", ["d"], "r").select("d", "code", F.round("r", 2).alias("residual"))


_FORWARD = f"WITH {_PANEL}, j AS (SELECT d, code, f, lead(v) OVER (PARTITION BY code ORDER BY d) / v - 1 AS fwd FROM p), c AS (SELECT * FROM j WHERE f IS NOT NULL AND fwd IS NOT NULL)"
_RANK = "rank() OVER (PARTITION BY d ORDER BY {0}) + (count(*) OVER (PARTITION BY d, {0}) - 1) / 2.0"


def _forward(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return p.select("d", "code", "f", (F.lead("v").over(Window.partitionBy("code").orderBy("d")) / F.col("v") - 1).alias("fwd"))


@register("information_coefficient", f"""
{_FORWARD}, r AS (SELECT *, {_RANK.format('f')} AS a, {_RANK.format('fwd')} AS b FROM c)
SELECT d, round(corr(f, fwd), 6) AS ic, round(corr(a, b), 6) AS rank_ic, count(*) AS n FROM r GROUP BY d HAVING count(*) >= 30 AND var_pop(f) > 1e-15 AND var_pop(fwd) > 1e-15""")  # fmt: skip
def information_coefficient(spark, sf_dir):
    out = X.information_coefficient(_forward(spark, sf_dir), "f", "fwd", ["d"])
    return out.select("d", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"), "n")


@register("quantile_ladder", f"""
{_FORWARD}, r AS (SELECT *, ({_RANK.format('f')}) / count(*) OVER (PARTITION BY d) AS p FROM c), q AS (SELECT d, greatest(1, least(5, CAST(ceil(p * 5) AS INTEGER))) AS quantile, fwd FROM r),
l AS (SELECT d, quantile, avg(fwd) AS m, count(*) AS n FROM q GROUP BY 1, 2)
SELECT d, quantile, round(m, 6) AS mean_return, n FROM l UNION ALL SELECT d, 0, round(max(m) FILTER (WHERE quantile = 5) - max(m) FILTER (WHERE quantile = 1), 6), (sum(n) FILTER (WHERE quantile IN (1, 5)))::BIGINT FROM l GROUP BY d""")  # fmt: skip
def quantile_ladder(spark, sf_dir):
    out = X.quantile_ladder(_forward(spark, sf_dir), "f", "fwd", ["d"], 5)
    return out.select("d", "quantile", F.round("mean_return", 6).alias("mean_return"), F.col("count").alias("n"))


@register("combined_signal", f"""
WITH {_PANEL}, u AS (SELECT d, code, 'v' AS factor, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z, 0.7 AS w FROM p WINDOW w AS (PARTITION BY d) UNION ALL
SELECT d, code, 'f', (f - avg(f) OVER w) / nullif(stddev_samp(f) OVER w, 0), -0.3 FROM p WINDOW w AS (PARTITION BY d)),
s AS (SELECT d, code, sum(w * z) / sum(abs(w)) AS s, count(z) AS n FROM u WHERE z IS NOT NULL GROUP BY 1, 2)
SELECT d, code, round((s - avg(s) OVER (PARTITION BY d)) / nullif(stddev_samp(s) OVER (PARTITION BY d), 0), 6) AS score FROM s WHERE n >= 2""")  # fmt: skip
def combined_signal(spark, sf_dir):
    """Weighted mean of standardised factors with a least count, standardised again."""
    p = X.standardise(X.standardise(_panel(spark, sf_dir), "v", ["d"], "v"), "f", ["d"], "f")
    long = p.select("d", "code", F.expr("stack(2, 'v', v, 0.7D, 'f', f, -0.3D) as (factor, z, w)")).where("z is not null")
    s = long.groupBy("d", "code").agg((F.sum(F.col("w") * F.col("z")) / F.sum(F.abs("w"))).alias("s"), F.count("z").alias("n")).where("n >= 2")
    return X.standardise(s, "s", ["d"], "score").select("d", "code", F.round("score", 6).alias("score"))


@register("return_statistics", """
WITH m AS (SELECT o_orderstatus AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT k, d, v / lag(v) OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM m),
c AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY k ORDER BY d)) AS c FROM r WHERE r IS NOT NULL), e AS (SELECT *, c / greatest(1, max(c) OVER (PARTITION BY k ORDER BY d)) - 1 AS dd FROM c)
SELECT k, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe, round(min(dd), 6) AS drawdown, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS hit FROM e GROUP BY k""")  # fmt: skip
def return_statistics(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.trunc("o_orderdate", "month").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("k").orderBy("d")
    r = m.withColumn("r", F.col("v") / F.lag("v").over(w) - 1).where("r is not null").withColumn("c", F.exp(F.sum(F.ln(1 + F.col("r"))).over(w)))
    r = r.withColumn("dd", F.col("c") / F.greatest(F.lit(1.0), F.max("c").over(w)) - 1)
    sd = F.stddev_samp("r")
    return r.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(F.avg("r") / F.nullif(sd, F.lit(0.0)), 6).alias("sharpe"), F.round(F.min("dd"), 6).alias("drawdown"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("hit"))


@register("rolling_band", """
WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT d, round(CASE WHEN count(*) OVER w = 60 THEN ln(avg(v) OVER w) END, 8) AS mid, round(CASE WHEN count(*) OVER w = 60 THEN ln(avg(v) OVER w + 1.96 * stddev_samp(v) OVER w / sqrt(12)) END, 8) AS upper FROM m WINDOW w AS (ORDER BY d ROWS 59 PRECEDING)""")  # fmt: skip
def rolling_band(spark, sf_dir):
    """Logarithms of the rolling mean and band of one daily series, full windows only (a row a day, so one task is enough)."""
    m = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.orderBy("d").rowsBetween(-59, 0)
    full = lambda x: F.round(F.when(F.count("*").over(w) == 60, F.ln(x)), 8)
    return m.select("d", full(F.avg("v").over(w)).alias("mid"), full(F.avg("v").over(w) + 1.96 * F.stddev_samp("v").over(w) / F.sqrt(F.lit(12.0))).alias("upper"))


@register("multiple_testing", """
WITH p AS (SELECT p_brand AS test, exp(-5 * abs(corr(l_discount, l_quantity)) - avg(l_tax) * 100) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM p)
SELECT test, round(least(1, max((m - i + 1) * p) OVER (ORDER BY i)), 8) AS holm, round(least(1, min(m * p / i) OVER (ORDER BY i DESC)), 8) AS bh,
round(least(1, min(m * p / i * (SELECT sum(1.0 / k) FROM generate_series(1, m) t(k))) OVER (ORDER BY i DESC)), 8) AS bhy FROM i""")  # fmt: skip
def multiple_testing(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = rows.groupBy(F.col("p_brand").alias("test")).agg(F.exp(-5 * F.abs(F.corr("l_discount", "l_quantity")) - F.avg("l_tax") * 100).alias("p"))
    p = X.step_up(X.step_up(X.step_down(p, "p", "holm"), "p", "bh"), "p", "bhy", dependent=True)
    return p.select("test", *[F.round(c, 8).alias(c) for c in ("holm", "bh", "bhy")])


@register("segment_leaders", """
WITH s AS (SELECT p_brand, l_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, l_suppkey, CAST(row_number() OVER w AS INTEGER) AS rank, round(v / sum(v) OVER (PARTITION BY p_brand), 6) AS share, count(*) OVER (PARTITION BY p_brand) AS makers FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY v DESC, l_suppkey) QUALIFY row_number() OVER w <= 5""")  # fmt: skip
def segment_leaders(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = rows.groupBy("p_brand", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    w = Window.partitionBy("p_brand")
    s = s.withColumn("share", F.round(F.col("v") / F.sum("v").over(w), 6)).withColumn("makers", F.count("*").over(w))
    return top_n(s, ["p_brand"], [F.desc("v"), F.asc("l_suppkey")], 5).select("p_brand", "l_suppkey", "rank", "share", "makers")


@register("cap_detector", """
WITH c AS (SELECT o_custkey % 100 AS k, least(count(*), 100) AS n FROM orders GROUP BY 1), m AS (SELECT max(n) AS n, count(*) FILTER (WHERE c.n = (SELECT max(n) FROM c)) AS keys FROM c)
SELECT c.k, c.n FROM c JOIN m ON c.n = m.n WHERE m.n % 100 = 0 AND m.keys > 1""")  # fmt: skip
def cap_detector(spark, sf_dir):
    """Keys cut off by their source: more than one key has the greatest row count of all, and that is a multiple of 100.

    The source here hands out 100 rows a key at most.
    """
    n = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.least(F.count("*"), F.lit(100)).alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("keys"))
    most = sizes.agg(F.max(F.struct("n", "keys")).alias("m")).select("m.*").where("n % 100 = 0 and keys > 1")
    return n.join(most, "n", "left_semi").select("k", "n")


@register("main_contract", """
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_returnflag AS k, l_linenumber AS c, sum(l_quantity) AS oi, avg(l_extendedprice) AS px FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY d, k ORDER BY oi DESC, c) = 1)
SELECT d, k, c, CASE WHEN c = lag(c) OVER w THEN CASE WHEN px >= lag(px) OVER w THEN CASE WHEN oi >= lag(oi) OVER w THEN 'new_longs' ELSE 'short_covering' END ELSE CASE WHEN oi >= lag(oi) OVER w THEN 'new_shorts' ELSE 'long_liquidation' END END ELSE 'unclear' END AS regime FROM b WINDOW w AS (PARTITION BY k ORDER BY d)""")  # fmt: skip
def main_contract(spark, sf_dir):
    """The contract with most open interest a day, and the regime by changes of price and interest while it stays the same."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d"), F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("c")).agg(F.sum("l_quantity").alias("oi"), F.avg("l_extendedprice").alias("px"))
    b, w = keep_first(m, ["d", "k"], [F.desc("oi"), F.asc("c")]), Window.partitionBy("k").orderBy("d")
    up, more = F.col("px") >= F.lag("px").over(w), F.col("oi") >= F.lag("oi").over(w)
    regime = F.when(F.coalesce(F.col("c") != F.lag("c").over(w), F.lit(True)), "unclear").when(up & more, "new_longs").when(up, "short_covering").when(more, "new_shorts").otherwise("long_liquidation")
    return b.select("d", "k", "c", regime.alias("regime"))

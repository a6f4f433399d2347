"""Company and sector scoring: aggregates, pass-through, moats, claims, counterparties, revenue mixes, project reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.functions.exact import exact_deviation, exact_mean, exact_sum
from tarnlake.plans.joins import read

# Every supplier is a company of its nation's sector; a year of its lines is a fiscal year, discounts are margins.
_YEARS = "f AS (SELECT l_suppkey AS c, year(l_shipdate) AS y, sum(l_extendedprice) AS rev, avg(l_discount) AS gm, sum(l_extendedprice * l_tax) AS capex, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _years(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("c"), F.year("l_shipdate").cast("long").alias("y")).agg(
        F.sum("l_extendedprice").alias("rev"), F.avg("l_discount").alias("gm"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("capex"), F.sum("l_quantity").alias("q"))


@register("adjustment_steps", """
WITH a AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS d, max(1 + o_totalprice / 1e6) AS f FROM orders GROUP BY 1, 2), b AS (SELECT code, d, f * CASE WHEN code % 9 = 0 THEN 1.01 + (datediff('day', DATE '1995-01-01', d) % 5) / 100.0 ELSE 2 END AS f FROM a WHERE datediff('day', DATE '1995-01-01', d) % 3 <> 0),
x AS (SELECT code, d, f / lag(f) OVER (PARTITION BY code ORDER BY d) AS step FROM a), y AS (SELECT code, d, f / lag(f) OVER (PARTITION BY code ORDER BY d) AS step FROM b)
SELECT y.code, y.d, round(y.step, 8) AS other_step, round(x.step, 8) AS own_step, round(abs(y.step - x.step) / x.step, 8) AS rel_diff FROM y JOIN x ON x.code = y.code AND x.d = y.d WHERE x.step IS NOT NULL AND y.step IS NOT NULL""")  # fmt: skip
def adjustment_steps(spark, sf_dir):
    """The step of one source's adjustment factor at another's dates against that other's own step."""
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("d")).agg(F.max(1 + F.col("o_totalprice") / 1e6).alias("f"))
    days = F.datediff("d", F.lit("1995-01-01").cast("date"))
    b = a.where(days % 3 != 0).withColumn("f", F.col("f") * F.when(F.col("code") % 9 == 0, 1.01 + (days % 5) / 100.0).otherwise(2.0))
    w = Window.partitionBy("code").orderBy("d")
    step = lambda df, name: df.select("code", "d", (F.col("f") / F.lag("f").over(w)).alias(name)).where(F.col(name).isNotNull())
    both = step(b, "other").join(step(a, "own"), ["code", "d"])
    return both.select("code", "d", F.round("other", 8).alias("other_step"), F.round("own", 8).alias("own_step"), F.round(F.abs(F.col("other") - F.col("own")) / F.col("own"), 8).alias("rel_diff"))


@register("release_lag", """
WITH r AS (SELECT o_orderstatus AS dataset, CAST(o_orderdate AS DATE) AS rd FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND day(o_orderdate) <> 1), p AS (SELECT dataset, rd, rd - CASE WHEN day(rd) >= 25 THEN last_day(rd) ELSE last_day(rd - INTERVAL 1 MONTH) END AS lag FROM r)
SELECT dataset, count(*) AS releases, coalesce(max(lag), 0) AS observed_max, count(*) FILTER (WHERE lag > 20) AS later_than_rule, coalesce(strftime(max(rd), '%Y%m%d'), '') AS latest FROM p GROUP BY 1""")  # fmt: skip
def release_lag(spark, sf_dir):
    """How late releases came after the end of their period, against the lag that a rule allows. Releases from the 25th on
    belong to their own month, earlier ones to the month before; those on the 1st are left out."""
    r = read(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.day("o_orderdate") != 1)).select(F.col("o_orderstatus").alias("dataset"), F.to_date("o_orderdate").alias("rd"))
    end = F.when(F.day("rd") >= 25, F.last_day("rd")).otherwise(F.last_day(F.add_months("rd", -1)))
    p = r.withColumn("lag", F.datediff("rd", end).cast("long"))
    return p.groupBy("dataset").agg(F.count("*").alias("releases"), F.coalesce(F.max("lag"), F.lit(0)).alias("observed_max"), F.count_if(F.col("lag") > 20).alias("later_than_rule"), F.coalesce(F.date_format(F.max("rd"), "yyyyMMdd"), F.lit("")).alias("latest"))


@register("cross_check_years", """
WITH d AS (SELECT strftime(l_shipdate, '%Y%m%d') AS day, count(*) AS n, avg(CAST(abs(l_extendedprice / l_quantity - p_retailprice) > 0.5 * p_retailprice AS DOUBLE)) AS rate, avg(CAST(l_linenumber <= 3 AS DOUBLE)) AS agreement FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0 GROUP BY 1)
SELECT substr(day, 1, 4) AS year, count(*) AS days, sum(n)::BIGINT AS compared, count(*) FILTER (rate > 0.75) AS bad_days, round(min(agreement), 6) AS low, round(avg(agreement), 6) AS mean FROM d GROUP BY 1""")  # fmt: skip
def cross_check_years(spark, sf_dir):
    """Daily mismatch rates rolled up by year: days beyond a threshold, and the least and mean agreement."""
    rows = read(spark, sf_dir, "lineitem").where("l_quantity > 0").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    off = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) > 0.5 * F.col("p_retailprice")
    d = rows.groupBy(F.date_format("l_shipdate", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"), F.avg(off.cast("double")).alias("rate"), F.avg((F.col("l_linenumber") <= 3).cast("double")).alias("agreement"))
    return d.groupBy(F.substring("day", 1, 4).alias("year")).agg(F.count("*").alias("days"), F.sum("n").alias("compared"), F.count_if(F.col("rate") > 0.75).alias("bad_days"), F.round(F.min("agreement"), 6).alias("low"), F.round(F.avg("agreement"), 6).alias("mean"))


@register("sector_aggregates", f"""
WITH {_YEARS}, p AS (SELECT s_nationkey AS sector, a.y, a.c, a.rev, a.gm, a.capex, b.rev AS rev0, b.gm AS gm0, b.capex AS capex0 FROM f a JOIN f b ON b.c = a.c AND b.y = a.y - 1 JOIN supplier ON s_suppkey = a.c),
g AS (SELECT sector, y, count(*) AS n, sum(rev) / sum(rev0) - 1 AS demand, (sum(gm * rev) / sum(rev) - sum(gm0 * rev0) / sum(rev0)) * 100 AS margin_pp, sum(capex) / nullif(sum(capex0), 0) - 1 AS capex FROM p WHERE rev > 0 AND rev0 > 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT sector, y, n, round(demand, 6) AS demand, round(margin_pp, 6) AS margin_pp, round(capex, 6) AS capex FROM g""")  # fmt: skip
def sector_aggregates(spark, sf_dir):
    """Revenue-weighted growth, change of margin and growth of investment of each sector with three companies or more."""
    f = _years(spark, sf_dir).where("rev > 0")
    b = f.select("c", (F.col("y") + 1).alias("y"), F.col("rev").alias("rev0"), F.col("gm").alias("gm0"), F.col("capex").alias("capex0"))
    p = f.join(b, ["c", "y"]).join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c"))
    mean = lambda x, w: F.sum(F.col(x) * F.col(w)) / F.sum(w)
    growth = F.sum("capex") / F.nullif(F.sum("capex0"), F.lit(0.0)) - 1
    g = p.groupBy(F.col("s_nationkey").alias("sector"), "y").agg(F.count("*").alias("n"), F.round(F.sum("rev") / F.sum("rev0") - 1, 6).alias("demand"), F.round((mean("gm", "rev") - mean("gm0", "rev0")) * 100, 6).alias("margin_pp"), F.round(growth, 6).alias("capex"))
    return g.where("n >= 3")


@register("pass_through", """
WITH g AS (SELECT l_suppkey % 50 AS c, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, avg(l_discount) AS gm FROM lineitem GROUP BY 1, 2), i AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) AS q, avg(o_totalprice) AS px FROM orders GROUP BY 1),
d AS (SELECT c, (gm - lag(gm) OVER w) * 100 AS dgm, (px / lag(px) OVER w - 1) * 100 AS dpx FROM g JOIN i USING (q) WINDOW w AS (PARTITION BY c ORDER BY q)),
s AS (SELECT c, count(*) AS n, CASE WHEN count(*) >= 6 AND stddev_pop(dpx) >= 3 THEN regr_slope(dgm, dpx) END AS slope FROM d WHERE dgm IS NOT NULL AND dpx IS NOT NULL GROUP BY 1), v AS (SELECT c, CASE WHEN count(*) >= 8 THEN stddev_pop(gm) END AS volatility FROM g GROUP BY 1)
SELECT v.c, n, round(slope, 6) AS slope, round(volatility, 6) AS volatility FROM v LEFT JOIN s ON s.c = v.c""")  # fmt: skip
def pass_through(spark, sf_dir):
    """How far a company's margin follows an input price: slope over six or more quarters in which the price moved (population
    deviation of 3 % or more), and the population deviation of margins over eight or more."""
    quarter = lambda c: (F.year(c) * 4 + F.quarter(c)).cast("long")
    g = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("c"), quarter("l_shipdate").alias("q")).agg(F.avg("l_discount").alias("gm"))
    i = read(spark, sf_dir, "orders").groupBy(quarter("o_orderdate").alias("q")).agg(F.avg("o_totalprice").alias("px"))
    w = Window.partitionBy("c").orderBy("q")
    d = g.join(i, "q").select("c", ((F.col("gm") - F.lag("gm").over(w)) * 100).alias("dgm"), ((F.col("px") / F.lag("px").over(w) - 1) * 100).alias("dpx")).where("dgm is not null and dpx is not null")
    s = d.groupBy("c").agg(F.count("*").alias("n"), F.when((F.count("*") >= 6) & (F.stddev_pop("dpx") >= 3), F.regr_slope("dgm", "dpx")).alias("slope"))
    v = g.groupBy("c").agg(F.when(F.count("*") >= 8, F.stddev_pop("gm")).alias("volatility"))
    return v.join(s, "c", "left").select("c", "n", F.round("slope", 6).alias("slope"), F.round("volatility", 6).alias("volatility"))


_MOAT = f"""{_YEARS}, r AS (SELECT c, y, gm * 100 + (c % 13) - 3 + (y - 1998) * ((c % 5) - 2) * 0.4 AS roic FROM f), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY y DESC) <= 6),
e AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY y) AS i, count(*) OVER (PARTITION BY c) AS n FROM l),
m AS (SELECT c, count(*) AS n, count(*) FILTER (roic >= 8) AS above, count(*) FILTER (roic >= 15) AS wide, avg(roic) AS mean, avg(roic) FILTER (i > n - 3) - avg(roic) FILTER (i <= 3) AS trend, stddev_pop(roic) AS sd FROM e GROUP BY c),
w AS (SELECT m.*, s_nationkey AS peer, rank() OVER (PARTITION BY s_nationkey ORDER BY mean) * 1.0 / count(*) OVER (PARTITION BY s_nationkey) AS rank FROM m JOIN supplier ON s_suppkey = c),
k AS (SELECT *, CASE WHEN n < 4 THEN 'insufficient' WHEN wide >= 5 AND rank >= 0.5 AND trend > -5 THEN 'wide' WHEN above >= 4 THEN 'narrow' ELSE 'none' END AS width, trend - coalesce(CASE WHEN count(trend) FILTER (n >= 4) OVER (PARTITION BY peer) >= 3 THEN median(trend) FILTER (n >= 4) OVER (PARTITION BY peer) END, 0) AS rel FROM w)"""


@register("moat_width", f"""
WITH {_MOAT} SELECT c, width, round(trend, 6) AS trend_pp, round(rel, 6) AS trend_rel_pp, CASE WHEN n < 4 THEN NULL WHEN rel >= 1 THEN 'widening' WHEN rel <= -1 THEN 'eroding' ELSE 'stable' END AS trend FROM k""")  # fmt: skip
def moat_width(spark, sf_dir):
    """Width of a moat by years of high returns and rank among peers; its trend (last three years less first three of six) also
    less the peers' median, as a market-wide cycle is no change of a moat."""
    k = _moats(spark, sf_dir)
    rel = F.col("rel")
    trend = F.when(F.col("n") >= 4, F.when(rel >= 1, "widening").when(rel <= -1, "eroding").otherwise("stable"))
    return k.select("c", "width", F.round("trend", 6).alias("trend_pp"), F.round("rel", 6).alias("trend_rel_pp"), trend.alias("trend"))


def _moats(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("c"), F.year("l_shipdate").cast("long").alias("y")).agg(exact_mean(F.col("l_discount")).alias("gm"))
    drift = (F.col("y") - 1998) * (F.col("c") % 5 - 2) * 4 / F.lit(10.0)  # 0.4 as a decimal
    r = f.select("c", "y", (F.col("gm") * 100 + F.col("c") % 13 - 3 + drift).alias("roic"))
    l = r.withColumn("d", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("y")))).where("d <= 6")  # noqa: E741
    l = l.withColumn("size", F.count("*").over(Window.partitionBy("c")))  # noqa: E741
    late, early = F.avg(F.when(F.col("d") <= 3, F.col("roic"))), F.avg(F.when(F.col("size") - F.col("d") < 3, F.col("roic")))
    m = l.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("roic") >= 8).alias("above"), F.count_if(F.col("roic") >= 15).alias("wide"), F.avg("roic").alias("mean"), (late - early).alias("trend"), F.stddev_pop("roic").alias("sd"))
    peers = Window.partitionBy("s_nationkey")
    w = m.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c")).withColumn("rank", F.rank().over(peers.orderBy("mean")) / F.count("*").over(peers))
    some = F.when(F.col("n") >= 4, F.col("trend"))
    middle = F.when(F.count(some).over(peers) >= 3, F.median(some).over(peers))
    width = F.when(F.col("n") < 4, "insufficient").when((F.col("wide") >= 5) & (F.col("rank") >= 0.5) & (F.col("trend") > -5), "wide").when(F.col("above") >= 4, "narrow").otherwise("none")
    return w.withColumn("width", width).withColumn("rel", F.col("trend") - F.coalesce(middle, F.lit(0.0)))


@register("moat_claims", f"""
WITH {_MOAT}, sh AS (SELECT c, sum(rev) / sum(sum(rev)) OVER () AS share FROM f GROUP BY c), x AS (SELECT k.c, above, mean, rank, share * 10 AS share, sd, CASE k.c % 5 WHEN 0 THEN 'intangible' WHEN 1 THEN 'cost' WHEN 2 THEN 'switching' WHEN 3 THEN 'network' ELSE 'efficient_scale' END AS kind, median(mean) OVER (PARTITION BY peer) AS peer_mean, n FROM k JOIN sh ON sh.c = k.c)
SELECT c, kind, CASE WHEN n < 4 THEN NULL WHEN kind = 'intangible' THEN rank >= 2 / 3.0 AND sd < 3 WHEN kind = 'cost' THEN (rank < 2 / 3.0 AND mean >= peer_mean + 3) OR share >= 0.3 WHEN kind = 'switching' THEN sd < 2 AND mean >= 10 WHEN kind = 'network' THEN mean >= 15 AND share >= 0.3 ELSE share >= 0.3 AND above >= 4 END AS proven FROM x""")  # fmt: skip
def moat_claims(spark, sf_dir):
    """Claimed kinds of advantage against figures: returns, rank, steadiness and share; NULL where they are too short."""
    rev = _years(spark, sf_dir).groupBy("c").agg(F.sum("rev").alias("rev"))
    total = rev.agg(F.sum("rev").alias("total"))
    k = _moats(spark, sf_dir).join(rev, "c").join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("rev") / F.col("total") * 10)  # one row
    k = k.withColumn("peer_mean", F.median("mean").over(Window.partitionBy("s_nationkey")))
    kind = F.element_at(F.array(*map(F.lit, ("intangible", "cost", "switching", "network", "efficient_scale"))), (F.col("c") % 5 + 1).cast("int"))
    rank, mean, share, sd = (F.col(x) for x in ("rank", "mean", "share", "sd"))
    tests = {
        "intangible": (rank >= 2 / 3) & (sd < 3), "cost": ((rank < 2 / 3) & (mean >= F.col("peer_mean") + 3)) | (share >= 0.3),
        "switching": (sd < 2) & (mean >= 10), "network": (mean >= 15) & (share >= 0.3), "efficient_scale": (share >= 0.3) & (F.col("above") >= 4),
    }
    k = k.withColumn("kind", kind)
    proven = F.coalesce(*[F.when(F.col("kind") == name, test) for name, test in tests.items()])
    return k.select("c", "kind", F.when(F.col("n") >= 4, proven).alias("proven"))


@register("archetype_check", """
WITH m AS (SELECT l_suppkey AS c, avg(l_discount) AS gm, stddev_pop(l_discount) AS vol, sum(l_quantity) / count(*) AS turns FROM lineitem GROUP BY 1), t AS (SELECT *, ntile(3) OVER (ORDER BY vol, c) AS band FROM m),
a AS (SELECT t.*, s_nationkey % 3 AS archetype FROM t JOIN supplier ON s_suppkey = c), e AS (SELECT * FROM (VALUES (0, 0.0, 0.050, 1, 10, 26), (1, 0.049, 0.06, 2, 20, 30), (2, 0.04, 0.0505, 3, 25, 40)) x(archetype, lo, hi, want, low, high)),
k AS (SELECT c, archetype, CAST(gm BETWEEN lo AND hi AS INTEGER) + CAST(band = want OR band = 2 OR want = 2 AS INTEGER) + CAST(turns BETWEEN low AND high AS INTEGER) AS good FROM a JOIN e USING (archetype))
SELECT c, archetype, CASE WHEN good = 3 THEN 'consistent' WHEN good = 2 THEN 'partial' ELSE 'inconsistent' END AS status FROM k""")  # fmt: skip
def archetype_check(spark, sf_dir):
    """Measured margin, steadiness and turnover against what a company's archetype lets expect."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("c")).agg(exact_mean(F.col("l_discount")).alias("gm"), exact_deviation(F.col("l_discount")).alias("vol"), (exact_sum(F.col("l_quantity")) / F.count("*")).alias("turns"))
    t = m.withColumn("band", F.ntile(3).over(Window.orderBy("vol", "c")))  # a row a company
    a = t.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c")).withColumn("archetype", F.col("s_nationkey") % 3)
    expected = spark.createDataFrame([(0, 0.0, 0.050, 1, 10, 26), (1, 0.049, 0.06, 2, 20, 30), (2, 0.04, 0.0505, 3, 25, 40)], "archetype int, lo double, hi double, want int, low int, high int")
    k = a.join(F.broadcast(expected), "archetype")
    checks = (F.col("gm").between(F.col("lo"), F.col("hi")), (F.col("band") == F.col("want")) | (F.col("band") == 2) | (F.col("want") == 2), F.col("turns").between(F.col("low"), F.col("high")))
    good = sum((x.cast("int") for x in checks), F.lit(0))
    return k.select("c", "archetype", F.when(good == 3, "consistent").when(good == 2, "partial").otherwise("inconsistent").alias("status"))


@register("claim_subtypes", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)franchise|concession|exclusive') THEN 'franchise' WHEN regexp_matches(text, '(?i)licen[sc]e|permit') THEN 'license' WHEN regexp_matches(text, '(?i)patent|copyright') THEN 'patent' WHEN regexp_matches(text, '(?i)brand|reserved') THEN 'brand' ELSE lang END AS subtype FROM documents""")  # fmt: skip
def claim_subtypes(spark, sf_dir):
    """A finer label of a claim from its own words; its type where no rule finds any."""
    from tarnlake.functions.text import first_rule

    rules = [("franchise", "(?i)franchise|concession|exclusive", None), ("license", "(?i)licen[sc]e|permit", None), ("patent", "(?i)patent|copyright", None), ("brand", "(?i)brand|reserved", None)]
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(first_rule(F.col("text"), rules), F.col("lang")).alias("subtype"))


@register("chain_position", """
WITH b AS (SELECT o_custkey AS c, sum(o_totalprice) AS rev, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS advance, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS due, max(o_totalprice) * 100 / sum(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c, CASE WHEN top >= 50 OR coalesce(due, 0) / rev >= 0.4 THEN 'weak' WHEN (coalesce(advance, 0) / rev >= 0.1 OR coalesce(due, 0) / rev <= 0.05) AND top < 30 THEN 'strong' ELSE 'neutral' END AS position FROM b""")  # fmt: skip
def chain_position(spark, sf_dir):
    """Bargaining position by advances, receivables and dependence on the largest partner, each as a share of revenue."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0)) / F.sum("o_totalprice")
    b = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(part("P").alias("advance"), part("O").alias("due"), (F.max("o_totalprice") * 100 / F.sum("o_totalprice")).alias("top"))
    strong = ((F.col("advance") >= 0.1) | (F.col("due") <= 0.05)) & (F.col("top") < 30)
    return b.select("c", F.when((F.col("top") >= 50) | (F.col("due") >= 0.4), "weak").when(strong, "strong").otherwise("neutral").alias("position"))


@register("edge_labels", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS a, l_partkey % 100 AS b, CASE l_linenumber WHEN 1 THEN 'c' WHEN 2 THEN 'C' WHEN 3 THEN 's' WHEN 4 THEN 'S' WHEN 5 THEN 'P' ELSE 'x' END AS code, CASE WHEN l_discount > 0 THEN l_discount * 100 END AS pct FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN code IN ('s', 'S') THEN b ELSE a END AS src, CASE WHEN code IN ('s', 'S') THEN a ELSE b END AS dst, CASE code WHEN 'c' THEN 'sells' WHEN 'C' THEN 'named' WHEN 's' THEN 'buys' WHEN 'S' THEN 'buys' ELSE 'peer' END AS kind,
CASE code WHEN 'P' THEN 'competes' WHEN 'x' THEN 'cooperates' ELSE coalesce(printf('%.2f%%', pct), '') END AS label FROM e""")  # fmt: skip
def edge_labels(spark, sf_dir):
    """Codes of links decoded to direction, kind and label: sales run from the company, purchases to it."""
    code = F.element_at(F.array(*map(F.lit, ("c", "C", "s", "S", "P", "x", "x"))), F.least("l_linenumber", F.lit(7)))
    e = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), code.alias("code"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).alias("pct"))
    buys = F.lower("code") == "s"
    kind = F.when(F.col("code") == "c", "sells").when(F.col("code") == "C", "named").when(buys, "buys").otherwise("peer")
    label = F.when(F.col("code") == "P", "competes").when(F.col("code") == "x", "cooperates").otherwise(F.coalesce(F.when(F.col("pct").isNotNull(), F.format_string("%.2f%%", "pct")), F.lit("")))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.when(buys, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(buys, F.col("a")).otherwise(F.col("b")).alias("dst"), kind.alias("kind"), label.alias("label"))


@register("counterparty_profiles", """
WITH cust AS (SELECT s_suppkey AS c, abs(s_acctbal) * 20 AS amount, s_nationkey AS pct FROM supplier), line AS (SELECT l_suppkey AS c, p_type AS item, min(p_name) AS pid, sum(l_extendedprice) AS sales FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
pick AS (SELECT cust.c, item, pid, sales FROM cust JOIN line ON line.c = cust.c AND sales >= amount QUALIFY row_number() OVER (PARTITION BY cust.c ORDER BY sales DESC, item) <= 2), edge AS (SELECT p_name AS pid, p_brand AS node, min(p_size % 3) AS rel FROM part GROUP BY 1, 2), deg AS (SELECT node, count(*) AS deg FROM edge GROUP BY 1),
st AS (SELECT pick.c, edge.node, min(edge.rel) AS rel, max(len(list_intersect(list_distinct(string_split(lower(edge.node), '')), list_distinct(string_split(lower(pick.pid), ''))))) AS overlap, any_value(deg.deg) AS deg FROM pick JOIN edge ON edge.pid = pick.pid JOIN deg ON deg.node = edge.node GROUP BY 1, 2),
top AS (SELECT c, list(node ORDER BY edge_end, rel, -overlap, -deg, node) AS stages FROM (SELECT *, ends_with(node, '7') AS edge_end, row_number() OVER (PARTITION BY c ORDER BY ends_with(node, '7'), rel, -overlap, -deg, node) AS n FROM st) WHERE n <= 4 GROUP BY 1),
abroad AS (SELECT l_suppkey AS c, 100 * avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS overseas FROM lineitem GROUP BY 1)
SELECT cust.c, array_to_string(stages, ',') AS stages, CASE WHEN overseas IS NULL THEN 'unknown' WHEN pct * 4 > 100 - overseas + 0.01 THEN 'abroad' WHEN pct * 4 > overseas + 0.01 THEN 'home' WHEN overseas >= 80 THEN 'likely abroad' WHEN overseas <= 20 THEN 'likely home' ELSE 'unknown' END AS region FROM cust LEFT JOIN top ON top.c = cust.c LEFT JOIN abroad ON abroad.c = cust.c""")  # fmt: skip
def counterparty_profiles(spark, sf_dir):
    """What an unnamed customer may be: the lines large enough to hold its purchases (two), the downstream nodes of those (four,
    end markets last, by relation, shared letters and degree), and whether its share fits home or foreign sales."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c"), (F.abs("s_acctbal") * 20).alias("amount"), F.col("s_nationkey").alias("pct"))
    part = read(spark, sf_dir, "part")
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    line = l.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("c"), F.col("p_type").alias("item")).agg(F.min("p_name").alias("pid"), F.sum("l_extendedprice").alias("sales"))
    n = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("sales"), "item"))
    pick = s.join(line, "c").where("sales >= amount").withColumn("n", n).where("n <= 2").select("c", "pid")
    edge = part.groupBy(F.col("p_name").alias("pid"), F.col("p_brand").alias("node")).agg(F.min(F.col("p_size") % 3).alias("rel"))
    edge = edge.join(edge.groupBy("node").agg(F.count("*").alias("deg")), "node")
    letters = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    st = pick.join(edge, "pid").groupBy("c", "node").agg(F.min("rel").alias("rel"), F.max(F.size(F.array_intersect(letters(F.col("node")), letters(F.col("pid"))))).alias("overlap"), F.max("deg").alias("deg"))
    order = F.struct(F.col("node").endswith("7").alias("end"), "rel", (-F.col("overlap")).alias("o"), (-F.col("deg")).alias("d"), "node")
    st = st.withColumn("order", order).withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("order"))).where("n <= 4")
    top = st.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list("order")), lambda x: x["node"]), ",").alias("stages"))
    abroad = l.groupBy(F.col("l_suppkey").alias("c")).agg((100 * F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("overseas"))
    out = s.join(top, "c", "left").join(abroad, "c", "left")
    share, away = F.col("pct") * 4, F.col("overseas")
    region = F.when(away.isNull(), "unknown").when(share > 100 - away + 0.01, "abroad").when(share > away + 0.01, "home").when(away >= 80, "likely abroad").when(away <= 20, "likely home").otherwise("unknown")
    return out.select("c", "stages", region.alias("region"))


@register("concept_hints", "SELECT DISTINCT o_custkey AS c, c_mktsegment AS concept FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O', 'P') AND regexp_matches(c_mktsegment, '^(AUTO|BUILD|MACH)')")
def concept_hints(spark, sf_dir):
    """Concepts that members belong to, of the kinds and names in question."""
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).join(read(spark, sf_dir, "customer").where(F.col("c_mktsegment").rlike("^(AUTO|BUILD|MACH)")), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("o_custkey").alias("c"), F.col("c_mktsegment").alias("concept")).distinct()


@register("linked_companies", """
SELECT s_nationkey AS sector, s_suppkey AS c, count(DISTINCT l_partkey) AS links FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY sector, links DESC, c""")  # fmt: skip
def linked_companies(spark, sf_dir):
    """The companies of each sector by their number of links."""
    links = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("c")).agg(F.countDistinct("l_partkey").alias("links"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sector"), F.col("s_suppkey").alias("c")).join(links, "c", "left")
    return rows.select("sector", "c", F.coalesce("links", F.lit(0)).alias("links")).orderBy("sector", F.desc("links"), "c")


@register("call_graph", """
SELECT s_suppkey AS edge, a.n_name AS callee, b.n_name AS caller FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_nationkey LEFT JOIN nation b ON b.n_nationkey = s_suppkey % 30""")  # fmt: skip
def call_graph(spark, sf_dir):
    """Both ends of an edge named, where they are known."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    e = read(spark, sf_dir, "supplier").join(n.toDF("x", "callee"), F.col("x") == F.col("s_nationkey"), "left").join(n.toDF("y", "caller"), F.col("y") == F.col("s_suppkey") % 30, "left")
    return e.select(F.col("s_suppkey").alias("edge"), "callee", "caller")


@register("stale_report", """
SELECT 'customer' AS kind, c_name AS item, 'negative balance' AS reason FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'part', p_name || '#' || p_partkey, 'never ordered in bulk' FROM part WHERE p_size > 45 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)
UNION ALL SELECT 'supplier', s_name, 'ships after return' FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)""")  # fmt: skip
def stale_report(spark, sf_dir):
    """Findings of several checks in one list; correlated conditions are semi-joins."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    row = lambda df, kind, item, reason: df.select(F.lit(kind).alias("kind"), item.alias("item"), F.lit(reason).alias("reason"))
    a = row(read(spark, sf_dir, "customer").where("c_acctbal < -900"), "customer", F.col("c_name"), "negative balance")
    p = read(spark, sf_dir, "part").where("p_size > 45").join(l.where("l_quantity >= 50"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    s = read(spark, sf_dir, "supplier").join(l.where("l_returnflag = 'R' and l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    b = row(p, "part", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")), "never ordered in bulk")
    return a.unionByName(b).unionByName(row(s, "supplier", F.col("s_name"), "ships after return"))


@register("open_phases", """
SELECT o_custkey AS plan, o_orderpriority AS phase, o_orderstatus AS status, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(o_orderstatus) NOT LIKE 'f%' ORDER BY o_custkey, TRY_CAST(o_orderpriority AS INTEGER), o_orderpriority, o_orderkey""")  # fmt: skip
def open_phases(spark, sf_dir):
    """What is not done yet, in order of plan, number (where the text is one) and text."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").where(~F.lower("o_orderstatus").like("f%"))
    rows = rows.select(F.col("o_custkey").alias("plan"), F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return rows.orderBy("plan", F.asc_nulls_last(F.col("phase").try_cast("int")), "phase", "o_orderkey")


@register("merged_ids", "SELECT o_orderkey, coalesce(m.new, o_custkey) AS node FROM orders LEFT JOIN (SELECT c_custkey AS old, c_custkey + 1 AS new FROM customer WHERE c_custkey % 7 = 3) m ON m.old = o_custkey")
def merged_ids(spark, sf_dir):
    """Ids that were merged away read as their survivors, one step."""
    m = read(spark, sf_dir, "customer").where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return read(spark, sf_dir, "orders").join(m, F.col("old") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce("new", "o_custkey").alias("node"))


@register("segment_closure", """
WITH RECURSIVE e AS (SELECT c_custkey // 3 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0), t AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst WHERE e.dst <> t.src)
SELECT src AS segment, dst AS member, count(p_partkey) AS products FROM t LEFT JOIN part ON p_partkey = dst GROUP BY 1, 2""")  # fmt: skip
def segment_closure(spark, sf_dir):
    """Every segment below another one, at any depth, with the products of each."""
    from tarnlake.operators.graph import closure

    e = read(spark, sf_dir, "customer").where("c_custkey > 0").select(F.floor(F.col("c_custkey") / 3).alias("src"), F.col("c_custkey").alias("dst"))
    n = read(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("dst")).agg(F.count("*").alias("products"))
    return closure(e).join(n, "dst", "left").select(F.col("src").alias("segment"), F.col("dst").alias("member"), F.coalesce("products", F.lit(0)).alias("products"))


_MIX = """r AS (SELECT o_custkey AS c, CASE o_orderkey % 9 WHEN 0 THEN 'Total' WHEN 1 THEN 'Other income' WHEN 2 THEN 'Elimination: internal' WHEN 3 THEN 'Steel' WHEN 4 THEN 'Steel:Rods' WHEN 5 THEN 'Copper:Wire' WHEN 6 THEN 'Rings' ELSE 'Widgets ' || (o_orderkey % 3) END AS item, sum(o_totalprice) AS sales, sum(o_totalprice * 0.25) AS profit FROM orders GROUP BY 1, 2),
t AS (SELECT *, max(sales) OVER (PARTITION BY c) AS total, count(*) OVER (PARTITION BY c) AS n FROM r)"""


@register("revenue_mix", f"""
WITH {_MIX} SELECT c, item, round(sales, 4) AS sales, round(100 * sales / total, 4) AS pct, round(100 * profit / sales, 4) AS gm, CASE WHEN regexp_matches(item, '^Other') THEN 'generic' ELSE 'product' END AS how FROM t
WHERE NOT regexp_matches(item, '^(Total|Sum)') AND NOT regexp_matches(item, 'Elimination|Adjustment') AND NOT (sales >= total * 0.999 AND n > 1)
AND NOT (contains(item, ':') AND EXISTS (SELECT 1 FROM r WHERE r.c = t.c AND r.item = split_part(t.item, ':', 1)))""")  # fmt: skip
def revenue_mix(spark, sf_dir):
    """Reported lines less totals, adjustments, lines that are the whole, and parts of a line that is reported itself; with
    share of the largest line and margin."""
    item = F.element_at(F.array(*map(F.lit, ("Total", "Other income", "Elimination: internal", "Steel", "Steel:Rods", "Copper:Wire", "Rings"))), F.least(F.col("o_orderkey") % 9 + 1, F.lit(7)).cast("int"))
    item = F.when(F.col("o_orderkey") % 9 <= 6, item).otherwise(F.concat(F.lit("Widgets "), (F.col("o_orderkey") % 3).cast("string")))
    r = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), item.alias("item")).agg(F.sum("o_totalprice").alias("sales"), F.sum(F.col("o_totalprice") * 0.25).alias("profit"))
    mine = Window.partitionBy("c")
    t = r.withColumn("total", F.max("sales").over(mine)).withColumn("n", F.count("*").over(mine)).withColumn("names", F.collect_set("item").over(mine))  # the lines of one report
    part_of = F.col("item").contains(":") & F.array_contains("names", F.substring_index("item", ":", 1))
    t = t.where(~F.col("item").rlike("^(Total|Sum)") & ~F.col("item").rlike("Elimination|Adjustment") & ~((F.col("sales") >= F.col("total") * 0.999) & (F.col("n") > 1)) & ~part_of)
    return t.select("c", "item", F.round("sales", 4).alias("sales"), F.round(100 * F.col("sales") / F.col("total"), 4).alias("pct"), F.round(100 * F.col("profit") / F.col("sales"), 4).alias("gm"), F.when(F.col("item").rlike("^Other"), "generic").otherwise("product").alias("how"))


@register("pricing_power", """
WITH m AS (SELECT l_suppkey AS c, avg(l_discount) AS gm, stddev_pop(l_discount) AS sd, corr(l_discount, l_extendedprice) AS beta, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT m.*, median(gm) OVER (PARTITION BY s_nationkey) AS mid, median(sd) OVER (PARTITION BY s_nationkey) AS steady FROM m JOIN supplier ON s_suppkey = c),
v AS (SELECT c, CASE WHEN gm > mid THEN 1 WHEN gm < mid THEN -1 ELSE 0 END AS p1, CASE WHEN sd < steady THEN 1 WHEN sd > steady THEN -1 ELSE 0 END AS p2, CASE WHEN beta > 0.02 THEN 1 WHEN beta < -0.02 THEN -1 ELSE 0 END AS p3 FROM p), s AS (SELECT *, p1 + p2 + p3 AS score, abs(p1) + abs(p2) + abs(p3) AS votes FROM v)
SELECT c, score, CASE WHEN votes < 2 THEN 'insufficient' WHEN score >= 2 THEN 'maker' WHEN score = 1 THEN 'lean_maker' WHEN score <= -2 THEN 'taker' WHEN score = -1 THEN 'lean_taker' ELSE 'middle' END AS label, CASE WHEN votes = 0 THEN 0.0 ELSE round(abs(score) / CAST(votes AS DOUBLE), 4) END AS confidence FROM s""")  # fmt: skip
def pricing_power(spark, sf_dir):
    """Signals as votes for and against, summed to a label; confidence is the share of cast votes on the winning side's margin."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("c")).agg(exact_mean(F.col("l_discount")).alias("gm"), exact_deviation(F.col("l_discount")).alias("sd"), F.corr("l_discount", "l_extendedprice").alias("beta"))
    peers = Window.partitionBy("s_nationkey")
    p = m.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c")).withColumn("mid", F.median("gm").over(peers)).withColumn("steady", F.median("sd").over(peers))
    vote = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    each = (vote(F.col("gm") > F.col("mid"), F.col("gm") < F.col("mid")), vote(F.col("sd") < F.col("steady"), F.col("sd") > F.col("steady")), vote(F.col("beta") > 0.02, F.col("beta") < -0.02))
    v = p.select("c", sum(each, F.lit(0)).alias("score"), sum(map(F.abs, each), F.lit(0)).alias("votes"))
    s = F.col("score")
    label = F.when(F.col("votes") < 2, "insufficient").when(s >= 2, "maker").when(s == 1, "lean_maker").when(s <= -2, "taker").when(s == -1, "lean_taker").otherwise("middle")
    return v.select("c", "score", label.alias("label"), F.when(F.col("votes") == 0, 0.0).otherwise(F.round(F.abs(s) / F.col("votes"), 4)).alias("confidence"))


@register("lifecycle", f"""
WITH {_YEARS}, g AS (SELECT c, y, rev / lag(rev) OVER w - 1 AS g, capex / nullif(lag(capex) OVER w, 0) - 1 AS cx FROM f WINDOW w AS (PARTITION BY c ORDER BY y)), a AS (SELECT c, avg(g) AS g, avg(cx) AS cx, count(g) AS n FROM g GROUP BY c)
SELECT c, CASE WHEN n < 3 THEN 'unknown' WHEN g >= 0.2 AND cx > 0 THEN 'growth' WHEN g >= 0.05 THEN 'expansion' WHEN g >= -0.05 THEN 'mature' ELSE 'decline' END AS stage FROM a""")  # fmt: skip
def lifecycle(spark, sf_dir):
    """Stage of life by mean growth of revenue and investment over the years at hand."""
    w = Window.partitionBy("c").orderBy("y")
    g = _years(spark, sf_dir).select("c", (F.col("rev") / F.lag("rev").over(w) - 1).alias("g"), (F.col("capex") / F.nullif(F.lag("capex").over(w), F.lit(0.0)) - 1).alias("cx"))
    a = g.groupBy("c").agg(F.avg("g").alias("g"), F.avg("cx").alias("cx"), F.count("g").alias("n"))
    return a.select("c", F.when(F.col("n") < 3, "unknown").when((F.col("g") >= 0.2) & (F.col("cx") > 0), "growth").when(F.col("g") >= 0.05, "expansion").when(F.col("g") >= -0.05, "mature").otherwise("decline").alias("stage"))


@register("latest_revenue_lines", """
SELECT l_suppkey AS c, p_type AS item, round(sum(l_extendedprice), 2) AS sales FROM lineitem JOIN part ON p_partkey = l_partkey WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem) GROUP BY 1, 2""")  # fmt: skip
def latest_revenue_lines(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))  # noqa: E741
    last = l.agg(F.max("y").alias("y"))
    rows = l.join(F.broadcast(last), "y").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("l_suppkey").alias("c"), F.col("p_type").alias("item")).agg(F.round(F.sum("l_extendedprice"), 2).alias("sales"))

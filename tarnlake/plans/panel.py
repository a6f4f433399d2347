"""Point-in-time panels, statement versions, company histories, calendars and the factors made of them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.functions import dates as D
from tarnlake.functions.exact import round_half
from tarnlake.operators import pit as P
from tarnlake.plans.joins import read

FIRST, LAST = "1995-01-02", "2003-12-31"
_SESSIONS = f"s AS (SELECT CAST(d AS DATE) AS s FROM generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5)"
_STATEMENTS = """q0 AS (SELECT o_custkey AS code, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS period, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'O' THEN 0.8 ELSE 0.5 END * o_totalprice) AS cost, sum(CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0.05 END * o_totalprice) AS profit FROM orders GROUP BY 1, 2),
y0 AS (SELECT code, period, sum(revenue) OVER w AS revenue, sum(cost) OVER w AS cost, sum(profit) OVER w AS profit FROM q0 WINDOW w AS (PARTITION BY code, period // 4 ORDER BY period)),
st AS (SELECT *, last_day(make_date(CAST(period // 4 AS BIGINT), CAST(period % 4 * 3 + 3 AS BIGINT), 1)) + CAST(20 + code % 50 AS INTEGER) AS known_on FROM y0),
l0 AS (SELECT code, period, known_on, 'revenue' AS field, revenue AS value FROM st UNION ALL SELECT code, period, known_on, 'cost', cost FROM st UNION ALL SELECT code, period, known_on, 'profit', profit FROM st),
v AS (SELECT code, field, period, known_on, 0 AS flag, round(value, 4) AS value FROM l0 UNION ALL SELECT code, field, period, known_on + 150, 1, round(value * 1.1, 4) FROM l0 WHERE (code + period) % 6 = 0)"""


def _sessions(spark):
    return D.days_between(spark, FIRST, LAST, "weekdays").select(D.day(F.col("d")).alias("s"))


def _statements(spark, sf_dir):
    """Statement figures since the start of the year, with the day they became known."""
    o, status = read(spark, sf_dir, "orders"), F.col("o_orderstatus")
    q = o.groupBy(F.col("o_custkey").alias("code"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("period")).agg(
        F.sum("o_totalprice").alias("revenue"), F.sum(F.when(status == "O", 0.8).otherwise(0.5) * F.col("o_totalprice")).alias("cost"), F.sum(F.when(status == "F", 0.3).otherwise(0.05) * F.col("o_totalprice")).alias("profit"))
    year = Window.partitionBy("code", F.floor(F.col("period") / 4)).orderBy("period")
    end = F.last_day(F.make_date(F.floor(F.col("period") / 4).cast("int"), (F.col("period") % 4 * 3 + 3).cast("int"), F.lit(1)))
    return q.select("code", "period", *[F.sum(c).over(year).alias(c) for c in ("revenue", "cost", "profit")], F.date_add(end, (20 + F.col("code") % 50).cast("int")).alias("known_on"))


def _versions(spark, sf_dir):
    """Long statement versions; one in six is restated 150 days later."""
    long = _statements(spark, sf_dir).unpivot(["code", "period", "known_on"], ["revenue", "cost", "profit"], "field", "value").select("code", "field", "period", "known_on", "value")
    first = long.select("code", "field", "period", "known_on", F.lit(0).alias("flag"), round_half(F.col("value"), 4).alias("value"))
    again = long.where((F.col("code") + F.col("period")) % 6 == 0).select("code", "field", "period", F.date_add("known_on", 150).alias("known_on"), F.lit(1).alias("flag"), round_half(F.col("value") * 1.1, 4).alias("value"))
    return first.unionByName(again)


_STATES = f"""WITH {_SESSIONS}, {_STATEMENTS}, e AS (SELECT v.*, s.s AS effective FROM v ASOF JOIN s ON s.s > v.known_on),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY code, field, period, effective ORDER BY known_on DESC, flag DESC, value DESC) = 1),
r AS (SELECT code, field, effective, period AS p0, arg_max(value, (period, effective)) OVER w AS value, max(period) OVER w AS period FROM d WINDOW w AS (PARTITION BY code, field ORDER BY effective, period ROWS UNBOUNDED PRECEDING)),
states AS (SELECT code, field, effective, value, period FROM r QUALIFY row_number() OVER (PARTITION BY code, field, effective ORDER BY p0 DESC) = 1)"""


@register("pit_states", f"{_STATES} SELECT * FROM states")
def pit_states(spark, sf_dir):
    return P.states(_versions(spark, sf_dir), _sessions(spark), "s")


@register("pit_panel", f"""
{_STATES}, g AS (SELECT s AS trade_date, code, field FROM s, (SELECT DISTINCT code, field FROM states) WHERE s BETWEEN DATE '2000-12-18' AND DATE '2001-01-05')
SELECT g.trade_date, g.code, g.field, value, period FROM g ASOF JOIN states ON states.code = g.code AND states.field = g.field AND states.effective <= g.trade_date""")  # fmt: skip
def pit_panel(spark, sf_dir):
    """What was visible of every company on each session of three weeks."""
    days = _sessions(spark).where("s between date'2000-12-18' and date'2001-01-05'")
    return P.panel(P.states(_versions(spark, sf_dir), _sessions(spark), "s"), days, "s")


@register("statement_versions", f"WITH {_STATEMENTS} SELECT code, field, period, arg_max(value, (known_on, flag)) AS value FROM v WHERE known_on <= DATE '2000-06-30' GROUP BY 1, 2, 3")
def statement_versions(spark, sf_dir):
    return P.as_of(_versions(spark, sf_dir), F.lit("2000-06-30").cast("date"))


def _wide(spark, sf_dir):
    known = P.as_of(_versions(spark, sf_dir), F.lit("2001-06-30").cast("date"))
    wide = known.groupBy("code", "period").pivot("field", ["revenue", "cost", "profit"]).agg(F.first("value"))
    return wide.withColumn("core", F.col("profit") * 0.9).withColumn("equity", F.col("code") * 100.0 + 50_000.0).withColumn("assets", F.col("code") * 250.0 + 120_000.0)


_WIDE = f"""WITH {_STATEMENTS}, a AS (SELECT code, field, period, arg_max(value, (known_on, flag)) AS value FROM v WHERE known_on <= DATE '2001-06-30' GROUP BY 1, 2, 3),
w AS (SELECT code, period, max(value) FILTER (field = 'revenue') AS revenue, max(value) FILTER (field = 'cost') AS cost, max(value) FILTER (field = 'profit') AS profit FROM a GROUP BY 1, 2),
qs AS (SELECT x.code, x.period, x.revenue - coalesce(CASE WHEN x.period % 4 > 0 THEN y.revenue END, 0) AS revenue, x.cost - coalesce(CASE WHEN x.period % 4 > 0 THEN y.cost END, 0) AS cost, x.profit - coalesce(CASE WHEN x.period % 4 > 0 THEN y.profit END, 0) AS profit
FROM w x LEFT JOIN w y ON y.code = x.code AND y.period = x.period - 1 WHERE x.period % 4 = 0 OR y.code IS NOT NULL)"""


@register("company_cycle", f"""
{_WIDE}, l AS (SELECT code, max(period) AS period FROM w GROUP BY 1),
t AS (SELECT l.code, l.period, n.revenue AS rev_q, 1 - CASE WHEN n.revenue > 0 THEN n.cost / n.revenue END AS gm_q, n.profit AS np_q, CASE WHEN b.revenue > 0 THEN n.revenue / b.revenue END - 1 AS rev_yoy, CASE WHEN b.profit > 0 THEN n.profit / b.profit END - 1 AS np_yoy, CASE WHEN a.profit > 0 THEN n.profit / a.profit END - 1 AS np_qoq,
(1 - CASE WHEN n.revenue > 0 THEN n.cost / n.revenue END) - (1 - CASE WHEN b.revenue > 0 THEN b.cost / b.revenue END) AS dgm_yoy, (1 - CASE WHEN n.revenue > 0 THEN n.cost / n.revenue END) - (1 - CASE WHEN a.revenue > 0 THEN a.cost / a.revenue END) AS dgm_qoq,
CASE WHEN l.period % 4 = 3 THEN x.revenue ELSE x.revenue + f.revenue - s.revenue END AS rev_ttm, CASE WHEN l.period % 4 = 3 THEN x.profit ELSE x.profit + f.profit - s.profit END AS np_ttm
FROM l JOIN w x ON x.code = l.code AND x.period = l.period LEFT JOIN qs n ON n.code = l.code AND n.period = l.period LEFT JOIN qs a ON a.code = l.code AND a.period = l.period - 1 LEFT JOIN qs b ON b.code = l.code AND b.period = l.period - 4
LEFT JOIN w f ON f.code = l.code AND f.period = l.period - l.period % 4 - 1 LEFT JOIN w s ON s.code = l.code AND s.period = l.period - 4),
n AS (SELECT l.code, count(w.code) AS n_years, median(profit) AS np_med, max(profit / revenue) AS nm_max FROM l LEFT JOIN w ON w.code = l.code AND w.period % 4 = 3 AND w.period < l.period - l.period % 4 AND w.period >= l.period - l.period % 4 - 40 AND revenue > 0 GROUP BY 1)
SELECT t.code, period, round(rev_q, 4) AS rev_q, round(gm_q, 6) + 0.0 AS gm_q, round(np_q, 4) AS np_q, round(rev_yoy, 6) + 0.0 AS rev_yoy, round(np_yoy, 6) + 0.0 AS np_yoy, round(np_qoq, 6) + 0.0 AS np_qoq, round(dgm_yoy, 6) + 0.0 AS dgm_yoy, round(dgm_qoq, 6) + 0.0 AS dgm_qoq, round(rev_ttm, 4) AS rev_ttm, round(np_ttm, 4) AS np_ttm,
round(np_ttm / nullif(rev_ttm, 0), 6) AS nm_ttm, round(np_ttm / (t.code * 100.0 + 50000), 6) AS roe_ttm, round(rev_ttm / (t.code * 250.0 + 120000), 6) AS turnover_ttm, CASE WHEN n_years >= 3 THEN round(np_med, 4) END AS np_med, CASE WHEN n_years >= 3 THEN round(nm_max, 6) END AS nm_max, n_years,
CASE WHEN n_years >= 3 AND np_med > 0 THEN round(np_ttm / np_med, 6) END AS ttm_vs_med, coalesce(n_years >= 3 AND np_ttm / nullif(rev_ttm, 0) >= nm_max, false) AS margin_peak FROM t JOIN n ON n.code = t.code""")  # fmt: skip
def company_cycle(spark, sf_dir):
    """Each company's latest quarter, trailing sums and long-run norms, as known on a day."""
    out = P.cycle_panel(_wide(spark, sf_dir)).drop("core_ttm").withColumn("n_years", F.col("n_years").cast("long"))
    money = ("rev_q", "np_q", "rev_ttm", "np_ttm", "np_med")
    return out.select(*[(round_half(F.col(c), 4 if c in money else 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@register("quarter_history", f"{_WIDE} SELECT code, period, round(revenue, 4) AS rev_q, round(1 - CASE WHEN revenue > 0 THEN cost / revenue END, 6) AS gm_q, round(profit, 4) AS np_q FROM qs QUALIFY row_number() OVER (PARTITION BY code ORDER BY period DESC) <= 12")
def quarter_history(spark, sf_dir):
    q = P.quarters(_wide(spark, sf_dir), 12)
    return q.select("code", "period", F.round("revenue", 4).alias("rev_q"), F.round(1 - P.ratio(F.col("cost"), F.col("revenue"), True), 6).alias("gm_q"), F.round("profit", 4).alias("np_q"))


@register("last_eight_quarters", f"""
{_WIDE} SELECT a.code, a.period, round(a.revenue, 4) AS rev, round(1 - a.cost / nullif(a.revenue, 0), 4) AS gm, round(a.profit / nullif(a.revenue, 0), 4) AS npm, CASE WHEN b.revenue > 0 THEN round(a.revenue / b.revenue - 1, 4) END AS rev_yoy, CASE WHEN b.profit <> 0 THEN round((a.profit - b.profit) / abs(b.profit), 4) END AS np_yoy
FROM qs a LEFT JOIN qs b ON b.code = a.code AND b.period = a.period - 4 QUALIFY row_number() OVER (PARTITION BY a.code ORDER BY a.period DESC) <= 8""")  # fmt: skip
def last_eight_quarters(spark, sf_dir):
    """Margins of each company's last eight quarters and their change on a year, which looks further back than the eight."""
    q = P.quarters(_wide(spark, sf_dir), 12)
    b = q.select("code", (F.col("period") + 4).alias("period"), F.col("revenue").alias("r0"), F.col("profit").alias("p0"))
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("period")))
    rows = q.withColumn("n", n).where("n <= 8").join(b, ["code", "period"], "left")
    full = P.ratio(F.col("revenue"), F.col("r0"), True) - 1
    return rows.select("code", "period", F.round("revenue", 4).alias("rev"), F.round(1 - P.ratio(F.col("cost"), F.col("revenue")), 4).alias("gm"), F.round(P.ratio(F.col("profit"), F.col("revenue")), 4).alias("npm"), F.round(full, 4).alias("rev_yoy"), F.round(P.ratio(F.col("profit") - F.col("p0"), F.abs("p0")), 4).alias("np_yoy"))


@register("dupont", f"""
{_WIDE}, p AS (SELECT code, period, CASE period % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4 / 3.0 ELSE 1.0 END AS f, revenue, profit, code * 100.0 + 50000 AS equity, (code * 250.0 + 120000) AS assets, period = max(period) OVER (PARTITION BY code) AS latest FROM w),
x AS (SELECT code, period, round(profit / equity * 100 * f, 4) AS roe, round(revenue / assets * f, 3) AS turns, round(profit / nullif(revenue, 0) * 100, 4) AS npm, round(assets / equity, 4) AS lev FROM p WHERE period % 4 = 3 OR latest)
SELECT *, CASE WHEN npm IS NULL THEN 'mixed' WHEN npm >= 15 AND turns < 1 THEN 'margin' WHEN turns >= 1.2 AND lev < 3 THEN 'turnover' WHEN lev >= 3 THEN 'leverage' ELSE 'mixed' END AS driver,
CASE WHEN npm IS NULL THEN '' WHEN lev >= 5 THEN 'thin' WHEN npm * turns * lev * roe < 0 OR (abs(roe) > 2 AND abs(npm * turns * lev - roe) > 0.3 * abs(roe)) THEN 'gap' ELSE '' END AS flag FROM x""")  # fmt: skip
def dupont(spark, sf_dir):
    """Return on equity as margin, turnover and leverage: every full year and the latest period at an annual rate, with what
    drives it and whether the three explain it."""
    w = _wide(spark, sf_dir).withColumn("latest", F.col("period") == F.max("period").over(Window.partitionBy("code"))).where("period % 4 = 3 or latest")
    f = F.element_at(F.array(F.lit(4.0), F.lit(2.0), F.lit(4 / 3.0), F.lit(1.0)), (F.col("period") % 4 + 1).cast("int"))
    x = w.select("code", "period", F.round(F.col("profit") / F.col("equity") * 100 * f, 4).alias("roe"), F.round(F.col("revenue") / F.col("assets") * f, 3).alias("turns"), F.round(P.ratio(F.col("profit"), F.col("revenue")) * 100, 4).alias("npm"), F.round(F.col("assets") / F.col("equity"), 4).alias("lev"))
    npm, turns, lev, roe = F.col("npm"), F.col("turns"), F.col("lev"), F.col("roe")
    product = npm * turns * lev
    driver = F.when(npm.isNull(), "mixed").when((npm >= 15) & (turns < 1), "margin").when((turns >= 1.2) & (lev < 3), "turnover").when(lev >= 3, "leverage").otherwise("mixed")
    off = (product * roe < 0) | ((F.abs(roe) > 2) & (F.abs(product - roe) > 0.3 * F.abs(roe)))
    return x.withColumn("driver", driver).withColumn("flag", F.when(npm.isNull(), "").when(lev >= 5, "thin").when(off, "gap").otherwise(""))


@register("fundamental_factors", f"""
{_WIDE}, t AS (SELECT x.code, x.period, CASE WHEN x.period % 4 = 3 THEN x.profit ELSE x.profit + f.profit - s.profit END AS ttm FROM w x LEFT JOIN w f ON f.code = x.code AND f.period = x.period - x.period % 4 - 1 LEFT JOIN w s ON s.code = x.code AND s.period = x.period - 4),
j AS (SELECT t.code, t.period, t.ttm, b.ttm AS before, c_acctbal AS mv FROM t JOIN customer ON c_custkey = t.code LEFT JOIN t b ON b.code = t.code AND b.period = t.period - 4)
SELECT code, period, 'earnings_yield' AS factor, round(ttm / (mv * 1e4), 8) AS value FROM j WHERE mv > 0 AND ttm IS NOT NULL UNION ALL SELECT code, period, 'roe', round(ttm / (code * 100.0 + 50000), 8) FROM j WHERE ttm IS NOT NULL
UNION ALL SELECT code, period, 'profit_growth', round(ttm / before - 1, 8) FROM j WHERE before > 0 AND ttm IS NOT NULL""")  # fmt: skip
def fundamental_factors(spark, sf_dir):
    """Earnings yield, return on equity and profit growth, each through its registered factor, in one long frame."""
    from tarnlake.operators.factors import fundamentals

    h = P.histories(_wide(spark, sf_dir)).withColumn("p", F.explode(F.map_keys("ytd")))
    t = h.select("code", F.col("p").alias("period"), P.trailing(F.col("ytd"), F.col("p"), "profit").alias("ttm"), P.trailing(F.col("ytd"), F.col("p") - 4, "profit").alias("before"), F.try_element_at("ytd", F.col("p"))["equity"].alias("equity"))
    j = t.join(read(spark, sf_dir, "customer"), F.col("code") == F.col("c_custkey")).withColumn("market_value", F.col("c_acctbal"))
    return fundamentals(j, ["code", "period"])


@register("implied_expectations", f"""
{_WIDE}, n AS (SELECT code, count(*) AS n, median(profit) AS med, arg_max(profit, period) AS last FROM w WHERE period % 4 = 3 GROUP BY 1),
j AS (SELECT code, last, CASE WHEN n >= 3 THEN med END AS med, c_acctbal * 2000 AS mv FROM n JOIN customer ON c_custkey = code), b AS (SELECT *, med * 12 AS base, last - med AS excess FROM j)
SELECT code, round(mv, 4) AS total_mv, round(excess, 4) AS excess, round(base, 4) AS base_normal, CASE WHEN base > 0 THEN round(mv / base - 1, 6) END AS premium, CASE WHEN excess <= 0 OR excess IS NULL THEN NULL WHEN mv <= base THEN 0.0 WHEN 0.08 * (mv - base) / excess >= 1 THEN 50.0 ELSE round(least(50, -ln(1 - 0.08 * (mv - base) / excess) / ln(1.08)), 6) END AS years,
round(100 + (mv / 12 - last) / (1 + code % 7), 4) AS implied_price FROM b""")  # fmt: skip
def implied_expectations(spark, sf_dir):
    """What a market value pays for: years of excess profit over the normal one, premium, and the commodity price at which a
    normal multiple of profit, linear in that price, would be worth it."""
    from tarnlake.functions.finance import implied_price, years_paid

    n = _wide(spark, sf_dir).where("period % 4 = 3").groupBy("code").agg(F.count("*").alias("n"), F.median("profit").alias("med"), F.max_by("profit", "period").alias("last"))
    j = n.join(read(spark, sf_dir, "customer"), F.col("code") == F.col("c_custkey")).withColumn("med", F.when(F.col("n") >= 3, F.col("med"))).withColumn("mv", F.col("c_acctbal") * 2000)
    base, excess = F.col("med") * 12, F.col("last") - F.col("med")
    return j.select("code", F.round("mv", 4).alias("total_mv"), F.round(excess, 4).alias("excess"), F.round(base, 4).alias("base_normal"), F.round(F.when(base > 0, F.col("mv") / base - 1), 6).alias("premium"), F.round(years_paid(F.col("mv"), base, excess, 0.08, 50.0), 6).alias("years"), F.round(implied_price(F.col("mv"), F.col("last"), F.lit(100.0), (1 + F.col("code") % 7).cast("double"), 12.0), 4).alias("implied_price"))


@register("statement_union", f"""
{_WIDE}, t AS (SELECT x.code, x.period, CASE WHEN x.period % 4 = 3 THEN x.profit ELSE x.profit + f.profit - s.profit END AS ttm FROM w x LEFT JOIN w f ON f.code = x.code AND f.period = x.period - x.period % 4 - 1 LEFT JOIN w s ON s.code = x.code AND s.period = x.period - 4)
SELECT code, period, 'revenue' AS field, round(revenue, 4) AS value FROM w WHERE revenue IS NOT NULL UNION ALL SELECT code, period, 'cost', round(cost, 4) FROM w WHERE cost IS NOT NULL UNION ALL SELECT code, period, 'profit', round(profit, 4) FROM w WHERE profit IS NOT NULL UNION ALL SELECT code, period, 'profit_ttm', round(ttm, 4) FROM t WHERE ttm IS NOT NULL""")  # fmt: skip
def statement_union(spark, sf_dir):
    """All statements unpivoted into one long view, with trailing sums; a statement that is absent adds nothing."""
    from functools import reduce

    wide = _wide(spark, sf_dir)
    present = [wide.select("code", "period", F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("revenue", "cost", "profit", "dividend") if f in wide.columns]
    h = P.histories(wide).withColumn("p", F.explode(F.map_keys("ytd")))
    present.append(h.select("code", F.col("p").alias("period"), F.lit("profit_ttm").alias("field"), P.trailing(F.col("ytd"), F.col("p"), "profit").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), present).where("value is not null").withColumn("value", F.round("value", 4))


@register("calendar_lookups", f"""
WITH {_SESSIONS}, i AS (SELECT s, row_number() OVER (ORDER BY s) AS n FROM s), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o.day, x.s IS NOT NULL AS is_open, p.s AS previous, f.s AS next, a.n AS number, (SELECT count(*) FROM s WHERE s.s BETWEEN o.day AND o.day + 30) AS in_30_days
FROM o LEFT JOIN s x ON x.s = o.day ASOF LEFT JOIN s p ON p.s < o.day ASOF LEFT JOIN s f ON f.s > o.day ASOF LEFT JOIN i a ON a.s <= o.day""")  # fmt: skip
def calendar_lookups(spark, sf_dir):
    """Whether a day is a session, the ones before and after it, its number, and how many lie within the next 30 days."""
    s = _sessions(spark)
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = D.calendar(days, "day", s, "s", 30)
    return out.select("day", "is_open", "previous", "next", "number", "in_30_days")


@register("effective_rules", f"""
WITH {_SESSIONS}, k AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y%m') AS month, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT 'as_is' AS rule, day AS k, d AS t, 0 AS strict FROM k UNION SELECT 'period_start_lag', month, CAST(date_trunc('month', d) AS DATE) + 10, 0 FROM k UNION SELECT 'period_end_lag', month, last_day(d) + 8, 0 FROM k),
n AS (SELECT s, lead(s, 1) OVER (ORDER BY s) AS s2 FROM s)
SELECT rule, k, s.s AS effective FROM f ASOF LEFT JOIN s ON s.s >= f.t UNION ALL SELECT 'next_session', day, n.s2 FROM (SELECT DISTINCT day, d FROM k) ASOF LEFT JOIN n ON n.s > d""")  # fmt: skip
def effective_rules(spark, sf_dir):
    """The four rules of when a fact counts: as it is, on the second session after, and a lag after the start or end of its month."""
    o, s = read(spark, sf_dir, "orders"), _sessions(spark)
    days, months = (o.select(F.date_format("o_orderdate", f).alias("k")).distinct() for f in ("yyyyMMdd", "yyyyMM"))
    rules = (("as_is", days, 1, 0), ("next_session", days, 2, 0), ("period_start_lag", months, 1, 10), ("period_end_lag", months, 1, 8))
    out = None
    for rule, facts, ahead, lag in rules:
        part = D.effective_sessions(facts, "k", s, "s", rule, ahead, lag).select(F.lit(rule).alias("rule"), "k", "effective")
        out = part if out is None else out.unionByName(part)
    return out


@register("panel_read", """
WITH r AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS code, o_custkey % 10 = 0 AS retired, o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND o_custkey IN (10, 11, 20, 21, 42, 50, 51))
SELECT code, o_orderdate AS day, o_orderkey AS k, o_totalprice AS value FROM r WHERE code IN (11, 21, 42, 51) QUALIFY row_number() OVER (PARTITION BY code, o_orderdate ORDER BY retired, o_orderkey) = 1 ORDER BY code, day""")  # fmt: skip
def panel_read(spark, sf_dir):
    """A panel read: wanted codes with the retired ones they replaced, a range of dates, some columns; rows then go under the
    surviving code, whose own row wins, in order of their key."""
    from tarnlake.operators.codes import read_panel

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    aliases = o.select(F.col("code").alias("old")).where("old % 10 = 0").distinct().withColumn("new", F.col("old") + 1)
    return read_panel(o, aliases, [11, 21, 42, 51], "1996-01-01", "1998-12-31", "code", "day", ["code", "day"], ["k", "value"], [F.asc("k")])


@register("reference_read", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey")
def reference_read(spark, sf_dir):
    """A whole reference table in order of its key."""
    return read(spark, sf_dir, "nation").orderBy("n_nationkey")


@register("factor_fold", """
WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), c AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT k, y, round(v, 4) AS v, n, m FROM a JOIN b USING (k, y) JOIN c USING (k, y)""")  # fmt: skip
def factor_fold(spark, sf_dir):
    """Any number of inputs joined on the same keys, one after the other: they share one partitioning."""
    from functools import reduce

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"), "o_totalprice", "o_orderstatus")
    frames = [o.groupBy("k", "y").agg(F.round(F.sum("o_totalprice"), 4).alias("v")), o.where("o_orderstatus = 'F'").groupBy("k", "y").agg(F.count("*").alias("n")), o.where("o_orderstatus = 'O'").groupBy("k", "y").agg(F.max("o_totalprice").alias("m"))]
    return reduce(lambda a, b: a.join(b, ["k", "y"]), frames)

"""Derivatives and futures: option chains, volatility index, exposures, curves, positions, expiry clocks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.functions.finance import third_friday
from tarnlake.operators import volatility as V
from tarnlake.operators.windows import keep_first
from tarnlake.plans.joins import read

RATE = "ln(1 + 0.018 * days / 360) * 365 / days"

_MASTER = """m AS (SELECT p_partkey AS contract, DATE '2026-01-05' + CAST(substr(p_brand, 7) AS INTEGER) AS trade_date, CASE WHEN p_brand = 'Brand#7' OR (p_partkey // 2) % 2 = 0 THEN 26 ELSE 61 END AS days,
CAST(round(1.5 + p_size * 0.05, 2) AS DOUBLE) AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS side, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' A' ELSE p_name END AS name, p_partkey AS k FROM part),
v AS (SELECT *, strike - 3.04 AS x FROM m), x AS (SELECT *, round(greatest(CASE WHEN side = 'C' THEN -x ELSE x END, 0) + (0.06 + days / 800.0) * exp(-4 * x * x), 4) AS settle FROM v),
chain AS (SELECT trade_date, trade_date + days AS expiry, days, strike, side, name, contract, CASE WHEN k % 13 = 0 THEN 0.0 ELSE settle END AS close, settle, CAST(k % 5 AS DOUBLE) AS vol, CAST(1 + k % 17 AS DOUBLE) AS oi FROM x WHERE NOT ends_with(name, 'A'))"""


def _master(spark, sf_dir):
    """Listed contracts of one underlying: contract, name, side, strike, trade_date, days."""
    k = F.col("p_partkey")
    days = F.when((F.col("p_brand") == "Brand#7") | (F.floor(k / 2) % 2 == 0), 26).otherwise(61)
    day = F.date_add(F.lit("2026-01-05").cast("date"), F.substring("p_brand", 7, 9).cast("int"))
    name = F.when(k % 11 == 0, F.concat("p_name", F.lit(" A"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(k.alias("contract"), day.alias("trade_date"), days.alias("days"), F.round(1.5 + F.col("p_size") * 0.05, 2).alias("strike"), F.when(k % 2 == 0, "C").otherwise("P").alias("side"), name.alias("name"))


def _chain(spark, sf_dir):
    """Contracts joined with their quotes, less those whose strike was adjusted (names ending in A)."""
    m, x = _master(spark, sf_dir).where(~F.col("name").endswith("A")), F.col("strike") - 3.04
    worth = F.greatest(F.when(F.col("side") == "C", -x).otherwise(x), F.lit(0.0)) + (0.06 + F.col("days") / 800.0) * F.exp(-4 * x * x)
    quote = m.select("contract", F.round(worth, 4).alias("settle")).withColumn("close", F.when(F.col("contract") % 13 == 0, 0.0).otherwise(F.col("settle")))
    quote = quote.withColumn("vol", (F.col("contract") % 5).cast("double")).withColumn("oi", (1 + F.col("contract") % 17).cast("double"))
    return m.join(quote, "contract").withColumn("expiry", F.date_add("trade_date", F.col("days")))


@register("option_chain", f"WITH {_MASTER} SELECT contract, trade_date, expiry, CAST(days AS BIGINT) AS days, strike, side, close, settle, vol, oi FROM chain")
def option_chain(spark, sf_dir):
    c = _chain(spark, sf_dir)
    return c.select("contract", "trade_date", "expiry", F.datediff("expiry", "trade_date").cast("long").alias("days"), "strike", "side", "close", "settle", "vol", "oi")


_INDEX = f"""{_MASTER}, px AS (SELECT *, CASE WHEN coalesce(close <= 0, true) AND settle IS NOT NULL THEN settle ELSE close END AS px, coalesce(close <= 0, true) AND settle IS NOT NULL AS sw FROM chain),
q AS (SELECT trade_date, expiry, days, strike, avg(px) FILTER (side = 'C') AS c, avg(px) FILTER (side = 'P') AS p, avg(vol) FILTER (side = 'C') AS cv, avg(vol) FILTER (side = 'P') AS pv, max(CAST(sw AS INTEGER)) AS sw FROM px GROUP BY ALL),
tm AS (SELECT trade_date, expiry, days, days / 365.0 AS t, {RATE} AS rate, arg_min(strike + exp({RATE} * days / 365.0) * (c - p), (abs(c - p), strike)) FILTER (c IS NOT NULL AND p IS NOT NULL) AS fwd, max(sw) AS sw FROM q GROUP BY ALL),
k0 AS (SELECT tm.*, (SELECT max(strike) FROM q WHERE q.trade_date = tm.trade_date AND q.days = tm.days AND q.strike <= tm.fwd) AS k0, row_number() OVER (PARTITION BY trade_date ORDER BY days) AS term FROM tm WHERE days >= 7 QUALIFY term <= 2),
sd AS (SELECT q.*, t, rate, fwd, k0, CASE WHEN strike < k0 THEN -1 WHEN strike > k0 THEN 1 ELSE 0 END AS sd, CASE WHEN strike < k0 THEN p WHEN strike > k0 THEN c ELSE (c + p) / 2 END AS qt, CASE WHEN strike < k0 THEN pv ELSE cv END AS qv FROM q JOIN k0 USING (trade_date, expiry, days) WHERE k0 IS NOT NULL),
em AS (SELECT *, sd <> 0 AND NOT (coalesce(qt > 0, false) AND coalesce(qv > 0, false)) AS empty FROM sd),
tw AS (SELECT *, CAST(empty AND coalesce(lag(empty) OVER w, false) AS INTEGER) AS two FROM em WINDOW w AS (PARTITION BY trade_date, days, sd ORDER BY abs(strike - k0))),
ov AS (SELECT *, max(two) OVER (PARTITION BY trade_date, days, sd ORDER BY abs(strike - k0)) AS stop FROM tw),
wd AS (SELECT *, lag(strike) OVER w AS lo, lead(strike) OVER w AS hi FROM ov WHERE stop = 0 AND NOT empty WINDOW w AS (PARTITION BY trade_date, days ORDER BY strike)),
sm AS (SELECT trade_date, days, CASE WHEN count(qt) = count(*) THEN sum(coalesce((hi - lo) / 2, hi - strike, strike - lo, 0) / (strike * strike) * exp(rate * t) * qt) END AS total, count(*) AS n FROM wd GROUP BY ALL),
vr AS (SELECT k0.*, n, 2 / t * total - (fwd / k0 - 1) * (fwd / k0 - 1) / t AS var FROM k0 LEFT JOIN sm USING (trade_date, days)),
dy AS (SELECT d.trade_date, x.days AS days_near, x.fwd AS fwd_near, x.k0 AS k0_near, x.var AS var_near, x.n AS n_near, y.days AS days_next, y.fwd AS fwd_next, y.k0 AS k0_next, y.var AS var_next, y.n AS n_next, greatest(x.sw, y.sw) AS sw, y.trade_date IS NULL AS few,
x.var * x.t * (y.days - 30) / (y.days - x.days) + y.var * y.t * (30 - x.days) / (y.days - x.days) AS total FROM (SELECT DISTINCT trade_date FROM chain) d LEFT JOIN vr x ON x.trade_date = d.trade_date AND x.term = 1 LEFT JOIN vr y ON y.trade_date = d.trade_date AND y.term = 2),
vx AS (SELECT *, CASE WHEN total >= 0 THEN 100 * sqrt(total * 365 / 30) END AS vix FROM dy)"""


@register("volatility_index", f"""
WITH {_INDEX} SELECT trade_date, CAST(days_near AS BIGINT) AS days_near, round(fwd_near, 6) AS fwd_near, k0_near, round(var_near, 6) AS var_near, n_near, CAST(days_next AS BIGINT) AS days_next, round(fwd_next, 6) AS fwd_next, k0_next, round(var_next, 6) AS var_next, n_next,
CASE WHEN few OR fwd_near IS NULL OR fwd_next IS NULL OR k0_near IS NULL OR k0_next IS NULL THEN NULL ELSE round(vix, 6) END AS vix,
CASE WHEN few THEN 'failed: fewer than two expiries' WHEN fwd_near IS NULL OR fwd_next IS NULL THEN 'failed: no strike with both sides' WHEN k0_near IS NULL OR k0_next IS NULL THEN 'failed: forward below every strike' WHEN vix IS NULL THEN 'failed: no positive variance' WHEN sw = 1 THEN 'used_settle' ELSE 'ok' END AS quality_flag FROM vx""")  # fmt: skip
def volatility_index(spark, sf_dir):
    """The index of every day, with the facts of its two terms; days that cannot be computed are flagged."""
    out = V.index(_chain(spark, sf_dir), F.expr(RATE))
    return out.select("trade_date", *[(F.round(c, 6) if c.startswith(("fwd", "var")) else F.col(c).cast("long") if c.startswith("days") else F.col(c)).alias(c) for c in out.columns if c not in ("trade_date", "vix", "quality_flag")], F.round("vix", 6).alias("vix"), "quality_flag")


@register("gamma_exposure_rows")
def gamma_exposure_rows(spark, sf_dir):
    """Implied volatility, gamma and exposure of every option of 1 to 90 days."""
    return V.exposures(_chain(spark, sf_dir), F.expr(RATE), 10_000.0).select("contract", "trade_date", "expiry", "strike", "side", "price", "fwd", "iv", "gamma", "gex")


@register("gamma_flip")
def gamma_flip(spark, sf_dir):
    """The level at which each day's total exposure changes sign."""
    levels = [2.4 + 0.04 * i for i in range(36)]
    return V.flips(V.profile(V.exposures(_chain(spark, sf_dir), F.expr(RATE), 10_000.0), levels, 10_000.0))


@register("index_cross_check")
def index_cross_check(spark, sf_dir):
    """The index against a blend of the volatilities implied at each term's k0."""
    chain, rate = _chain(spark, sf_dir), F.expr(RATE)
    terms = V.forwards(V.quotes(chain), rate).where("k0 is not null")
    near = F.row_number().over(Window.partitionBy("trade_date").orderBy("days"))
    vols = V.exposures(chain, rate, 1.0).select("trade_date", "expiry", "days", "strike", "iv").join(terms.select("trade_date", "expiry", F.col("k0").alias("strike")), ["trade_date", "expiry", "strike"])
    each = vols.groupBy("trade_date", "days").agg(F.avg("iv").alias("iv")).withColumn("term", near)
    pair = each.groupBy("trade_date").agg(*[F.max(F.when(F.col("term") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("iv", "days")])
    blend = V.blended_index(F.col("iv1") ** 2, F.col("days1") * 1440.0, F.col("iv2") ** 2, F.col("days2") * 1440.0, V.TARGET_MINUTES, V.YEAR_MINUTES)
    return V.index(chain, rate).join(pair, "trade_date").select("trade_date", F.round("vix", 6).alias("vix"), F.round(blend, 6).alias("at_the_money"), F.round(F.col("vix") - blend, 6).alias("difference"))


@register("expiry_clock", f"""
WITH {_MASTER}, s AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '2026-01-01', DATE '2026-06-30', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5), e AS (SELECT DISTINCT trade_date, expiry, days FROM chain)
SELECT trade_date, expiry, any_value(days) * 1440.0::DOUBLE AS minutes, count(s.d) AS sessions FROM e LEFT JOIN s ON s.d > trade_date AND s.d <= expiry GROUP BY 1, 2""")  # fmt: skip
def expiry_clock(spark, sf_dir):
    """Time to expiry in calendar minutes and in sessions after the trade date, up to the expiry (by running session numbers)."""
    from tarnlake.functions.dates import days_between, day
    from tarnlake.operators.asof import asof_join

    s = days_between(spark, "2026-01-01", "2026-06-30", "weekdays").select(day(F.col("d")).alias("s"), F.lit(0).alias("j"))
    s = s.withColumn("number", F.row_number().over(Window.orderBy("s")))  # a row a session
    e = _chain(spark, sf_dir).select("trade_date", "expiry", "days").distinct().withColumn("j", F.lit(0))
    e = asof_join(e, s.withColumnRenamed("number", "a"), ["j"], "trade_date", "s", ["a"])
    e = asof_join(e, s.withColumnRenamed("number", "b"), ["j"], "expiry", "s", ["b"])
    return e.select("trade_date", "expiry", (F.col("days") * 1440.0).alias("minutes"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).cast("long").alias("sessions"))


_CURVE = """mo AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_returnflag AS family, l_partkey % 24 AS slot, sum(l_quantity) AS oi, avg(CASE WHEN l_linenumber <> 3 THEN l_extendedprice END) AS settle, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2, 3),
cv AS (SELECT d, family, slot - 3 AS ahead, oi, coalesce(settle, close) AS price FROM mo WHERE slot - 3 >= 0 AND coalesce(settle, close) IS NOT NULL)"""


def _curve(spark, sf_dir):
    """Quotes of each family and day joined with the listed months: those not expired, at settlement or else the close."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d"), F.col("l_returnflag").alias("family"), (F.col("l_partkey") % 24).alias("slot"))
    rows = rows.agg(F.sum("l_quantity").alias("oi"), F.avg(F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))).alias("settle"), F.avg("l_extendedprice").alias("close"))
    return rows.select("d", "family", (F.col("slot") - 3).alias("ahead"), "oi", F.coalesce("settle", "close").alias("price")).where("ahead >= 0 and price is not null")


@register("futures_curve", f"WITH {_CURVE} SELECT d, family, ahead, oi, round(price, 4) AS price FROM cv")
def futures_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("d", "family", "ahead", "oi", F.round("price", 4).alias("price"))


@register("curve_summary", f"""
WITH {_CURVE}, a AS (SELECT d, family, count(*) AS n, arg_min(price, ahead) AS front, arg_max(ahead, (oi, -ahead)) AS dominant, arg_max(price, (oi, -ahead)) AS dominant_price, arg_max(price, ahead) AS last,
arg_min(price, (abs(ahead - 6), ahead)) FILTER (abs(ahead - 6) <= 1) AS m6, arg_min(price, (abs(ahead - 12), ahead)) FILTER (abs(ahead - 12) <= 1) AS m12 FROM cv GROUP BY 1, 2),
l AS (SELECT a.*, coalesce((SELECT arg_min(price, (abs(ahead - dominant - 12), ahead)) FROM cv WHERE cv.d = a.d AND cv.family = a.family AND ahead > dominant AND abs(ahead - dominant - 12) <= 1), CASE WHEN EXISTS (SELECT 1 FROM cv WHERE cv.d = a.d AND cv.family = a.family AND ahead > dominant) THEN last END) AS far FROM a)
SELECT d, family, n, round(front, 4) AS front, dominant, round(dominant_price, 4) AS dominant_price, round(m6, 4) AS m6, round(m12, 4) AS m12, round(last, 4) AS last, round(far / dominant_price - 1, 6) AS slope,
CASE WHEN far IS NULL OR abs(far / dominant_price - 1) < 0.01 THEN 'flat' WHEN far > dominant_price THEN 'contango' ELSE 'backwardation' END AS shape FROM l""")  # fmt: skip
def curve_summary(spark, sf_dir):
    """Front, most-held, 6 and 12 months (one month off at most) and last prices; slope from the most-held month to about
    twelve months later, else the last later one; shape with a band of one per cent."""
    c = _curve(spark, sf_dir)
    near = lambda m: F.min_by(F.when(F.abs(F.col("ahead") - m) <= 1, F.col("price")), F.when(F.abs(F.col("ahead") - m) <= 1, F.struct(F.abs(F.col("ahead") - m).alias("g"), "ahead")))
    most = F.struct("oi", (-F.col("ahead")).alias("x"))
    a = c.groupBy("d", "family").agg(F.count("*").alias("n"), F.min_by("price", "ahead").alias("front"), F.max_by("ahead", most).alias("dominant"), F.max_by("price", most).alias("dominant_price"), F.max_by("price", "ahead").alias("last"), near(6).alias("m6"), near(12).alias("m12"), F.sort_array(F.collect_list(F.struct("ahead", "price"))).alias("points"))  # the months of one family and day
    gap = lambda p: F.abs(p["ahead"] - F.col("dominant") - 12)
    later = F.filter("points", lambda p: p["ahead"] > F.col("dominant"))
    best = F.array_min(F.transform(F.filter(later, lambda p: gap(p) <= 1), lambda p: F.struct(gap(p).alias("g"), p["ahead"].alias("a"), p["price"].alias("price"))))
    far = F.coalesce(best["price"], F.when(F.size(later) > 0, F.col("last")))
    slope = far / F.col("dominant_price") - 1
    shape = F.when(slope.isNull() | (F.abs(slope) < 0.01), "flat").when(slope > 0, "contango").otherwise("backwardation")
    return a.select("d", "family", "n", F.round("front", 4).alias("front"), "dominant", F.round("dominant_price", 4).alias("dominant_price"), F.round("m6", 4).alias("m6"), F.round("m12", 4).alias("m12"), F.round("last", 4).alias("last"), F.round(slope, 6).alias("slope"), shape.alias("shape"))


@register("dominant_series", f"WITH {_CURVE} SELECT family, d, arg_max(ahead, (oi, -ahead)) AS ahead, round(arg_max(price, (oi, -ahead)), 4) AS price FROM cv GROUP BY 1, 2")
def dominant_series(spark, sf_dir):
    """A continuous price: the most-held month of each day."""
    most = F.struct("oi", (-F.col("ahead")).alias("x"))
    return _curve(spark, sf_dir).groupBy("family", "d").agg(F.max_by("ahead", most).alias("ahead"), F.round(F.max_by("price", most), 4).alias("price"))


@register("broker_positions", """
SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 40 AS broker, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS long, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS short,
round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE 0 END), 2) AS net FROM orders GROUP BY 1, 2""")  # fmt: skip
def broker_positions(spark, sf_dir):
    """Gross and net positions of each broker on each day."""
    from tarnlake.functions.finance import position_sums

    return position_sums(_holdings(spark, sf_dir), ["d", "broker"])


def _holdings(spark, sf_dir):
    side = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)
    return read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 40).alias("broker"), F.col("o_orderkey").alias("k"), side("O").alias("long"), side("F").alias("short"))


@register("top_positions", """
WITH b AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 40 AS broker, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS long, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS short FROM orders GROUP BY 1, 2),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY d ORDER BY long + short DESC, broker) <= 20)
SELECT d, round(sum(long), 2) AS long, round(sum(short), 2) AS short, round(sum(long) - sum(short), 2) AS net FROM t GROUP BY d""")  # fmt: skip
def top_positions(spark, sf_dir):
    """Long, short and net of the twenty largest brokers of each day."""
    from tarnlake.functions.finance import position_sums

    b = _holdings(spark, sf_dir).groupBy("d", "broker").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))
    n = F.row_number().over(Window.partitionBy("d").orderBy(F.desc(F.col("long") + F.col("short")), "broker"))
    return position_sums(b.withColumn("n", n).where("n <= 20"), ["d"])


@register("positioning", """
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_linenumber AS c, sum(l_quantity) AS oi, avg(l_extendedprice) AS px FROM lineitem GROUP BY 1, 2),
t AS (SELECT d, arg_max(c, (oi, -c)) AS main, arg_max(px, (oi, -c)) AS price, sum(oi) AS oi, avg(px) AS spot FROM m GROUP BY d),
x AS (SELECT *, CASE WHEN main = lag(main) OVER w THEN price - lag(price) OVER w END AS price_change, oi - lag(oi) OVER w AS oi_change, CAST(date_trunc('month', d + to_months(CAST(main AS INTEGER))) AS DATE) AS delivery FROM t WINDOW w AS (ORDER BY d)),
e AS (SELECT *, delivery + CAST((12 - dayofweek(delivery)) % 7 AS INTEGER) + 14 AS expiry FROM x)
SELECT d, main, round(price, 4) AS price, round(price_change, 4) AS price_change, oi_change, expiry, CASE WHEN price_change > 0 AND oi_change > 0 THEN 'new_longs' WHEN price_change < 0 AND oi_change > 0 THEN 'new_shorts' WHEN price_change > 0 AND oi_change < 0 THEN 'short_covering' WHEN price_change < 0 AND oi_change < 0 THEN 'long_liquidation' ELSE 'unclear' END AS regime,
round((price / spot - 1) * 100, 6) AS basis_pct, round((price / spot - 1) * 100 / (greatest(expiry - d, 1) / 365.0), 6) AS basis_annualised FROM e""")  # fmt: skip
def positioning(spark, sf_dir):
    """A product a day: main contract, changes (of price only while it stays the same), regime, basis to spot and its annual rate
    to the third Friday of the delivery month."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d"), F.col("l_linenumber").alias("c")).agg(F.sum("l_quantity").alias("oi"), F.avg("l_extendedprice").alias("px"))
    most, w = F.struct("oi", (-F.col("c")).alias("x")), Window.orderBy("d")  # one product, a row a month
    t = m.groupBy("d").agg(F.max_by("c", most).alias("main"), F.max_by("px", most).alias("price"), F.avg("px").alias("spot"), F.sum("oi").alias("oi"))
    t = t.withColumn("price_change", F.when(F.col("main") == F.lag("main").over(w), F.col("price") - F.lag("price").over(w))).withColumn("oi_change", F.col("oi") - F.lag("oi").over(w))
    t = t.withColumn("expiry", third_friday(F.add_months("d", F.col("main"))))
    up, down, more, less = F.col("price_change") > 0, F.col("price_change") < 0, F.col("oi_change") > 0, F.col("oi_change") < 0
    regime = F.when(up & more, "new_longs").when(down & more, "new_shorts").when(up & less, "short_covering").when(down & less, "long_liquidation").otherwise("unclear")
    basis = (F.col("price") / F.col("spot") - 1) * 100
    years = F.greatest(F.datediff("expiry", "d"), F.lit(1)) / 365.0
    return t.select("d", "main", F.round("price", 4).alias("price"), F.round("price_change", 4).alias("price_change"), "oi_change", "expiry", regime.alias("regime"), F.round(basis, 6).alias("basis_pct"), F.round(basis / years, 6).alias("basis_annualised"))


@register("union_pivot", """
WITH u AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, o_orderstatus AS code, o_totalprice AS px FROM orders UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS DATE), l_returnflag, l_extendedprice FROM lineitem)
SELECT d, round(avg(px) FILTER (code = 'O'), 4) AS o, round(avg(px) FILTER (code = 'F'), 4) AS f, round(avg(px) FILTER (code = 'R'), 4) AS r, round(avg(px) FILTER (code = 'A'), 4) AS a FROM u GROUP BY d""")  # fmt: skip
def union_pivot(spark, sf_dir):
    """Two price tables as one, codes as columns."""
    a = read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("d"), F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("px"))
    b = read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("d"), F.col("l_returnflag").alias("code"), F.col("l_extendedprice").alias("px"))
    out = a.unionByName(b).groupBy("d").pivot("code", ["O", "F", "R", "A"]).agg(F.round(F.avg("px"), 4))
    return out.select("d", *[F.col(c).alias(c.lower()) for c in ("O", "F", "R", "A")])


@register("reconciliation", r"""
WITH h AS (SELECT regexp_extract(o_orderpriority, '^([0-9])-', 1) AS product, CAST(o_orderdate AS DATE) AS d, o_custkey, o_totalprice AS v FROM orders), b AS (SELECT product, d, o_custkey, sum(v) AS v FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product, d ORDER BY v DESC, o_custkey) AS n FROM b), a AS (SELECT product, d, sum(v) AS total, sum(v) FILTER (n <= 2) AS top FROM r GROUP BY 1, 2),
l AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS detail FROM lineitem GROUP BY 1)
SELECT product, a.d, round(total, 2) AS total, round(top / total, 6) AS top_share, round(detail / total, 4) AS coverage FROM a JOIN l ON l.d = a.d""")  # fmt: skip
def reconciliation(spark, sf_dir):
    """Totals by a key taken from a text, the share of the largest members, and the same day's detail from another table."""
    h = read(spark, sf_dir, "orders").groupBy(F.regexp_extract("o_orderpriority", "^([0-9])-", 1).alias("product"), F.to_date("o_orderdate").alias("d"), "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    n = F.row_number().over(Window.partitionBy("product", "d").orderBy(F.desc("v"), "o_custkey"))
    a = h.withColumn("n", n).groupBy("product", "d").agg(F.sum("v").alias("total"), F.sum(F.when(F.col("n") <= 2, F.col("v"))).alias("top"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_extendedprice").alias("detail"))
    return a.join(b, "d").select("product", "d", F.round("total", 2).alias("total"), F.round(F.col("top") / F.col("total"), 6).alias("top_share"), F.round(F.col("detail") / F.col("total"), 4).alias("coverage"))


@register("latest_contract", """
SELECT l_returnflag AS family, max(l_shipdate) AS at, arg_max(l_partkey, (l_shipdate, l_quantity, l_partkey)) AS contract FROM lineitem GROUP BY 1""")  # fmt: skip
def latest_contract(spark, sf_dir):
    best = keep_first(read(spark, sf_dir, "lineitem"), ["l_returnflag"], [F.desc("l_shipdate"), F.desc("l_quantity"), F.desc("l_partkey")])
    return best.select(F.col("l_returnflag").alias("family"), F.col("l_shipdate").alias("at"), F.col("l_partkey").alias("contract"))

"""A volatility index of each day from option chains: quotes, parity forward, out-of-the-money strip, constant maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.functions.finance import black76_gamma, blended_index, implied_vol

TERM = ["trade_date", "expiry", "days"]
#: Days to the near term at least; minutes of a day, of the target maturity and of a year.
LEAST_DAYS, DAY_MINUTES, TARGET_MINUTES, YEAR_MINUTES = 7, 1440.0, 43_200.0, 525_600.0


def quotes(chain: DataFrame) -> DataFrame:
    """TERM, strike, c, p (mean prices of the two sides), cv, pv (volumes), used_settle: settlement stands in for a close that
    is missing or not positive."""
    swap = F.coalesce(F.col("close") <= 0, F.lit(True)) & F.col("settle").isNotNull()
    rows = chain.withColumn("__px", F.when(swap, F.col("settle")).otherwise(F.col("close")))
    side = lambda c, s: F.avg(F.when(F.col("side") == s, F.col(c)))
    return rows.groupBy(*TERM, "strike").agg(side("__px", "C").alias("c"), side("__px", "P").alias("p"), side("vol", "C").alias("cv"), side("vol", "P").alias("pv"), F.max(swap).alias("used_settle"))


def forwards(table: DataFrame, rate: Column) -> DataFrame:
    """TERM, t, rate, fwd, k0, used_settle: parity at the strike where both sides cost most alike (ties: the lower strike);
    k0 is the last strike at or below the forward. Terms without such a strike have NULL there."""
    t = table.withColumn("t", F.col("days") / 365.0).withColumn("rate", rate)
    gap = F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), F.struct(F.abs(F.col("c") - F.col("p")).alias("g"), "strike"))
    value = F.col("strike") + F.exp(F.col("rate") * F.col("t")) * (F.col("c") - F.col("p"))
    found = t.groupBy(*TERM, "t", "rate").agg(F.min_by(value, gap).alias("fwd"), F.max("used_settle").alias("used_settle"), F.collect_set("strike").alias("__k"))  # the strikes of one term
    return found.withColumn("k0", F.array_max(F.filter("__k", lambda k: k <= F.col("fwd")))).drop("__k")


def strips(table: DataFrame, terms: DataFrame) -> DataFrame:
    """terms with var (variance a year) and n (strikes used).

    From k0 outwards, puts below and calls above; a quote without price or volume is left out, and two of them in a row
    end that side. At k0 both sides count half.
    """
    rows = table.join(terms.select(*TERM, "t", "rate", "fwd", "k0"), TERM).where("k0 is not null")
    put = F.col("strike") < F.col("k0")
    price, volume = F.when(put, F.col("p")).otherwise(F.col("c")), F.when(put, F.col("pv")).otherwise(F.col("cv"))
    side = F.when(put, -1).when(F.col("strike") > F.col("k0"), 1).otherwise(0)
    rows = rows.withColumn("side", side).withColumn("q", F.when(F.col("side") == 0, (F.col("c") + F.col("p")) / 2).otherwise(price))
    rows = rows.withColumn("empty", (F.col("side") != 0) & ~(F.coalesce(price > 0, F.lit(False)) & F.coalesce(volume > 0, F.lit(False))))
    out = Window.partitionBy(*TERM, "side").orderBy(F.abs(F.col("strike") - F.col("k0")))
    rows = rows.withColumn("two", (F.col("empty") & F.coalesce(F.lag("empty").over(out), F.lit(False))).cast("int"))
    rows = rows.withColumn("over", F.max("two").over(out)).where("over = 0 and not empty")
    line = Window.partitionBy(*TERM).orderBy("strike")
    low, high = F.lag("strike").over(line), F.lead("strike").over(line)
    width = F.coalesce((high - low) / 2, high - F.col("strike"), F.col("strike") - low, F.lit(0.0))
    rows = rows.withColumn("part", width / F.col("strike") ** 2 * F.exp(F.col("rate") * F.col("t")) * F.col("q"))
    sums = rows.groupBy(*TERM).agg(F.when(F.count("q") == F.count(F.lit(1)), F.sum("part")).alias("total"), F.count(F.lit(1)).alias("n"))
    both = terms.join(sums, TERM, "left")
    var = 2 / F.col("t") * F.col("total") - (F.col("fwd") / F.col("k0") - 1) ** 2 / F.col("t")
    return both.withColumn("var", var).drop("total")


def index(chain: DataFrame, rate: Column, units: Column | None = None, target: float = TARGET_MINUTES, year: float = YEAR_MINUTES) -> DataFrame:
    """One row a day: trade_date, near and next days, forwards, k0, variances and counts, vix, quality_flag.

    The two nearest expiries of LEAST_DAYS or more are blended to `target`; `units` is the time to expiry on the clock in
    use (calendar minutes unless given), on which each term's whole variance is expressed again. A day that cannot be
    computed has a NULL index and `failed: ...`; other days are not touched.
    """
    table = quotes(chain)
    near = Window.partitionBy("trade_date").orderBy("days")
    terms = chain.select(*TERM).distinct().where(F.col("days") >= LEAST_DAYS).withColumn("term", F.row_number().over(near)).where("term <= 2")
    kept = table.join(terms.select(*TERM), TERM, "left_semi")
    each = strips(kept, forwards(kept, rate)).join(terms, TERM)
    each = each.withColumn("units", F.col("days") * DAY_MINUTES if units is None else units)
    each = each.withColumn("clock_var", F.col("var") * F.col("t") / (F.col("units") / year))
    facts = F.struct("days", "rate", "fwd", "k0", "var", "n", "units", "clock_var", "used_settle")
    pick = lambda k: F.max(F.when(F.col("term") == k, facts))
    days = chain.select("trade_date").distinct().join(each.groupBy("trade_date").agg(pick(1).alias("x"), pick(2).alias("y")), "trade_date", "left")
    level = blended_index(F.col("x.clock_var"), F.col("x.units"), F.col("y.clock_var"), F.col("y.units"), target, year)
    days = days.withColumn("vix", F.when(~F.isnan(level), level))
    why = F.when(F.col("y").isNull(), "failed: fewer than two expiries").when(F.col("x.fwd").isNull() | F.col("y.fwd").isNull(), "failed: no strike with both sides")
    why = why.when(F.col("x.k0").isNull() | F.col("y.k0").isNull(), "failed: forward below every strike").when(F.col("vix").isNull(), "failed: no positive variance")
    flag = F.coalesce(why, F.when(F.col("x.used_settle") | F.col("y.used_settle"), F.lit("used_settle")), F.lit("ok"))
    columns = [F.col(f"{s}.{c}").alias(f"{c}_{n}") for s, n in (("x", "near"), ("y", "next")) for c in ("days", "fwd", "k0", "var", "n")]
    return days.select("trade_date", *columns, F.when(~flag.startswith("failed"), F.col("vix")).alias("vix"), flag.alias("quality_flag"))


def exposures(chain: DataFrame, rate: Column, multiplier: float, most_days: int = 90, call_sign: float = 1.0, put_sign: float = -1.0) -> DataFrame:
    """A row an option of 1 to `most_days` days with open interest and a price that some volatility gives: its term's forward,
    iv, gamma, and gex, the signed change of delta for a move of one per cent, in money."""
    some = chain.where(F.col("days").between(1, most_days))
    terms = forwards(quotes(some), rate).where("fwd is not null")
    price = F.when(F.col("close") > 0, F.col("close")).otherwise(F.col("settle"))
    rows = some.join(terms.select(*TERM, "t", "rate", "fwd"), TERM).withColumn("price", price).where("oi > 0 and price > 0")
    rows = rows.withColumn("iv", implied_vol("price", "fwd", "strike", "t", "rate", F.col("side") == "C")).where("iv is not null and not isnan(iv)")
    rows = rows.withColumn("sign", F.when(F.col("side") == "C", call_sign).otherwise(put_sign))
    rows = rows.withColumn("gamma", black76_gamma(F.col("fwd"), F.col("strike"), F.col("t"), F.col("rate"), F.col("iv")))
    return rows.withColumn("gex", F.col("sign") * F.col("gamma") * F.col("oi") * multiplier * F.col("fwd") ** 2 * 0.01)


def profile(rows: DataFrame, levels: list[float], multiplier: float) -> DataFrame:
    """(trade_date, level, gex): the exposure of each day if its nearest term's forward stood at each level and the others moved
    in proportion, volatilities held."""
    first = rows.groupBy("trade_date").agg(F.min_by("fwd", "expiry").alias("__ref"))
    moved = rows.join(first, "trade_date").withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    f = F.col("fwd") * F.col("level") / F.col("__ref")
    gamma = black76_gamma(f, F.col("strike"), F.col("t"), F.col("rate"), F.col("iv"))
    return moved.groupBy("trade_date", "level").agg(F.sum(F.col("sign") * gamma * F.col("oi") * multiplier * f**2 * 0.01).alias("gex"))


def flips(levels: DataFrame) -> DataFrame:
    """(trade_date, flip): the first level where the exposure is zero or changes sign, interpolated; days without one left out."""
    line = Window.partitionBy("trade_date").orderBy("level")
    rows = levels.withColumn("g0", F.lag("gex").over(line)).withColumn("l0", F.lag("level").over(line)).where("g0 is not null and (g0 = 0 or signum(g0) <> signum(gex))")
    at = F.when(F.col("g0") == 0, F.col("l0")).otherwise(F.col("l0") + F.col("g0") / (F.col("g0") - F.col("gex")) * (F.col("level") - F.col("l0")))
    return rows.groupBy("trade_date").agg(F.min_by(at, "level").alias("flip"))

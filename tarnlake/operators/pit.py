"""Point-in-time values: statement versions become visible on the session after they are known, and never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.operators.asof import asof_join
from tarnlake.operators.windows import keep_first


def on_sessions(facts: DataFrame, known: str, sessions: DataFrame, session: str, out: str, *, forward: bool = True, strict: bool = True) -> DataFrame:
    """Adds `out`: the first session after (forward) or the last before each known date, or on it unless strict.

    Only distinct dates are looked up, so no row of the facts moves to the calendar.
    """
    days = facts.select(F.col(known).alias("__k")).distinct().withColumn("__j", F.lit(0))
    calendar = sessions.select(F.col(session).alias(out), F.lit(0).alias("__j")).distinct()
    found = asof_join(days, calendar.withColumn("__s", F.col(out)), ["__j"], "__k", "__s", [out], forward=forward, strict=strict).select("__k", out)
    return facts.join(found, facts[known].eqNullSafe(found["__k"]), "left").drop("__k")


def states(versions: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """code, field, effective, value, period: one row for each change of what is visible.

    `versions`: code, field, period, known_on, flag, value. A version counts from the first session after it is known;
    visible is the latest period so far, in its latest restatement, so a restated older period displaces nothing.
    """
    seen = on_sessions(versions, "known_on", sessions, session, "effective").where("effective is not null")
    seen = keep_first(seen, ["code", "field", "period", "effective"], [F.desc("known_on"), F.desc_nulls_last("flag"), F.desc_nulls_last("value")])
    so_far = Window.partitionBy("code", "field").orderBy("effective", "period").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("period", "effective", "value")).over(so_far)
    running = seen.withColumn("best", best)
    last = keep_first(running, ["code", "field", "effective"], [F.desc("period")])
    return last.select("code", "field", "effective", F.col("best.value").alias("value"), F.col("best.period").alias("period"))


def panel(changes: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """trade_date, code, field, value, period: what is visible on each of the sessions, for every (code, field) visible by then."""
    days = sessions.select(F.col(session).alias("trade_date")).distinct()
    grid = changes.select("code", "field").distinct().join(F.broadcast(days), F.lit(True))  # the result's own rows; a session is a day
    return asof_join(grid, changes, ["code", "field"], "trade_date", "effective", ["value", "period"], inner=True)


def as_of(versions: DataFrame, day: Column) -> DataFrame:
    """code, field, period, value: each statement as known on a day."""
    last = F.max_by("value", F.struct("known_on", "flag"))
    return versions.where((F.col("known_on") <= day) & F.col("value").isNotNull()).groupBy("code", "field", "period").agg(last.alias("value"))


def ratio(a: Column, b: Column, positive: bool = False) -> Column:
    """a / b, NULL where either is missing or b is 0 (or, if positive, not above 0)."""
    return F.when((b > 0) if positive else (b != 0), a / b)


FLOWS = ("revenue", "cost", "profit", "core")


def histories(wide: DataFrame) -> DataFrame:
    """code, ytd (period -> flows since the start of its year), last period: a map of the quarters of one company."""
    rows = wide.where("revenue is not null")
    return rows.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("period", F.struct(*FLOWS, "equity", "assets")))).alias("ytd"), F.max("period").alias("period"))


def quarter(ytd: Column, p: Column) -> Column:
    """Flows of a single quarter: those since the start of the year less those up to the quarter before, which must be known."""
    now, before = F.try_element_at(ytd, p), F.try_element_at(ytd, p - 1)
    single = F.struct(*[(now[f] - before[f]).alias(f) for f in FLOWS])
    return F.when(now.isNull(), None).when(p % 4 == 0, F.struct(*[now[f].alias(f) for f in FLOWS])).when(before.isNotNull(), single)


def trailing(ytd: Column, p: Column, field: str) -> Column:
    """Flow of the last four quarters: the full year, or this year so far plus the last full year less its same part."""
    now, year, same = F.try_element_at(ytd, p), F.try_element_at(ytd, p - p % 4 - 1), F.try_element_at(ytd, p - 4)
    return F.when(p % 4 == 3, now[field]).when(year.isNotNull() & same.isNotNull(), now[field] + year[field] - same[field])


def margin(q: Column) -> Column:
    return 1 - ratio(q["cost"], q["revenue"], True)


def cycle_panel(wide: DataFrame, years: int = 10, least_years: int = 3) -> DataFrame:
    """One row a company: its latest period's quarter with changes on a year and on a quarter, trailing sums and ratios, and how
    they stand against the last `years` full years (median profit, highest net margin)."""
    h, p, ytd = histories(wide), F.col("period"), F.col("ytd")
    for name, at in (("now", p), ("quarter_ago", p - 1), ("year_ago", p - 4)):
        h = h.withColumn(name, quarter(ytd, at))
    now, qa, ya = F.col("now"), F.col("quarter_ago"), F.col("year_ago")
    first = p - p % 4 - 1
    full = F.filter(F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda i: F.try_element_at(ytd, first - 4 * i)), lambda x: x["revenue"].isNotNull() & x["profit"].isNotNull() & (x["revenue"] > 0))
    h = h.withColumn("full", full).withColumn("n_years", F.size("full"))
    sorted_profit = F.array_sort(F.transform("full", lambda x: x["profit"]))
    n = F.col("n_years")
    low, high = F.get(sorted_profit, F.floor((n - 1) / 2).cast("int")), F.get(sorted_profit, F.floor(n / 2).cast("int"))
    enough = n >= least_years
    h = h.withColumn("np_med", F.when(enough, (low + high) / 2)).withColumn("nm_max", F.when(enough, F.array_max(F.transform("full", lambda x: x["profit"] / x["revenue"]))))
    h = h.withColumn("rev_ttm", trailing(ytd, p, "revenue")).withColumn("np_ttm", trailing(ytd, p, "profit")).withColumn("core_ttm", trailing(ytd, p, "core"))
    stock = F.try_element_at(ytd, p)
    nm = ratio(F.col("np_ttm"), F.col("rev_ttm"))
    return h.select(
        "code", "period", now["revenue"].alias("rev_q"), margin(now).alias("gm_q"), now["profit"].alias("np_q"),
        (ratio(now["revenue"], ya["revenue"], True) - 1).alias("rev_yoy"), (ratio(now["profit"], ya["profit"], True) - 1).alias("np_yoy"), (ratio(now["profit"], qa["profit"], True) - 1).alias("np_qoq"),
        (margin(now) - margin(ya)).alias("dgm_yoy"), (margin(now) - margin(qa)).alias("dgm_qoq"), "rev_ttm", "np_ttm", "core_ttm", nm.alias("nm_ttm"),
        ratio(F.col("np_ttm"), stock["equity"]).alias("roe_ttm"), ratio(F.col("rev_ttm"), stock["assets"]).alias("turnover_ttm"), "np_med", "nm_max", "n_years",
        ratio(F.col("np_ttm"), F.col("np_med"), True).alias("ttm_vs_med"), F.coalesce(nm >= F.col("nm_max"), F.lit(False)).alias("margin_peak"),
    )


def quarters(wide: DataFrame, count: int) -> DataFrame:
    """code, period, the single quarter's flows: the last `count` quarters of each company that can be told apart."""
    h = histories(wide).withColumn("p", F.explode(F.map_keys("ytd"))).withColumn("q", quarter(F.col("ytd"), F.col("p"))).where("q is not null")
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("p")))
    return h.withColumn("n", n).where(F.col("n") <= count).select("code", F.col("p").alias("period"), "q.*", F.try_element_at("ytd", F.col("p"))["equity"].alias("equity"))

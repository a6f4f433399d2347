"""Date texts (YYYYMMDD), security codes and effective dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_day(text: Column) -> Column:
    """Eight digits that name a day of the calendar."""
    return F.coalesce(text.rlike(r"^\d{8}$") & F.try_to_date(text, "yyyyMMdd").isNotNull(), F.lit(False))


def day(text: Column) -> Column:
    return F.try_to_date(text, "yyyyMMdd")


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def days_between(spark: SparkSession, start: str, end: str, kind: str = "days") -> DataFrame:
    """`days`, `weekdays` or `quarter_ends` from start to end, inclusive, as texts in column d."""
    out = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("x"))
    if kind == "weekdays":
        out = out.where(F.weekday("x") < 5)
    if kind == "quarter_ends":
        out = out.where((F.col("x") == F.last_day("x")) & (F.month("x") % 3 == 0))
    return out.select(day_text(F.col("x")).alias("d"))


def canonical_code(code: Column) -> Column:
    """123456.XX from suffixed, prefixed and bare six-digit codes; the market of bare ones follows their first digit; NULL if none fits.

    First digit: 6 and 9 SH, 0, 2 and 3 SZ, 4 and 8 BJ.
    """
    c = F.upper(F.trim(code))
    number = F.regexp_extract(c, r"(\d{6})", 1)
    market = F.regexp_extract(c, r"(SH|SZ|BJ)", 1)
    guess = F.when(number.rlike("^[69]"), "SH").when(number.rlike("^[023]"), "SZ").when(number.rlike("^[48]"), "BJ")
    shaped = c.rlike(r"^\d{6}(\.(SH|SZ|BJ))?$|^(SH|SZ|BJ)\.?\d{6}$")
    return F.when(shaped, F.concat(number, F.lit("."), F.coalesce(F.nullif(market, F.lit("")), guess)))


def known_day(known_on: Column, rule: str, lag_days: int = 0) -> Column:
    """The day from which a fact counts, before it is moved to a session; months (YYYYMM) resolve to their start or end."""
    month = F.length(known_on) == 6
    start = F.when(month, F.try_to_date(F.concat(known_on, F.lit("01")), "yyyyMMdd")).otherwise(day(known_on))
    if rule == "period_end_lag":
        return F.date_add(F.when(month, F.last_day(start)).otherwise(start), lag_days)
    return F.date_add(start, lag_days) if rule == "period_start_lag" else start


def effective_sessions(facts: DataFrame, known: str, sessions: DataFrame, session: str, rule: str, lag_sessions: int = 1, lag_days: int = 0) -> DataFrame:
    """Adds `effective`: on or after the known day, or with next_session the n-th session strictly after it; NULL stays NULL.

    Only distinct known values are resolved, by one sorted pass over them and the sessions, which carry the one n - 1
    sessions on. Both are a row a day.
    """
    from tarnlake.operators.asof import asof_join

    ahead = (lag_sessions if rule == "next_session" else 1) - 1
    calendar = sessions.select(F.col(session).alias("__s")).where("__s is not null").distinct()
    calendar = calendar.select(F.lit(0).alias("__j"), "__s", F.lead("__s", ahead).over(Window.orderBy("__s")).alias("effective"))
    values = facts.select(F.col(known).alias("__k")).distinct().select("__k", F.lit(0).alias("__j"), known_day(F.col("__k"), rule, lag_days).alias("__d"))
    resolved = asof_join(values, calendar, ["__j"], "__d", "__s", ["effective"], forward=True, strict=rule == "next_session").select("__k", "effective")
    return facts.join(resolved, facts[known].eqNullSafe(resolved["__k"]), "left").drop("__k")


def calendar(days: DataFrame, day: str, sessions: DataFrame, session: str, span: int) -> DataFrame:
    """Adds is_open, previous and next session (strictly), number of the last session by then, and in_<span>_days: sessions
    from the day to `span` days later, by the difference of two numbers."""
    from tarnlake.operators.asof import asof_join

    s = sessions.select(F.col(session).alias("__s")).distinct()
    s = s.withColumn("__n", F.row_number().over(Window.orderBy("__s"))).withColumn("__j", F.lit(0))  # a row a session
    out = days.withColumn("__j", F.lit(0)).withColumn("__end", F.date_add(day, span))
    at = lambda frame, on, name, c, **how: asof_join(frame, s.withColumn(name, F.col(c)), ["__j"], on, "__s", [name], **how)
    out = at(at(out, day, "previous", "__s", strict=True), day, "next", "__s", forward=True, strict=True)
    out = at(at(at(out, day, "number", "__n"), day, "__last", "__s"), "__end", "__to", "__n")
    out = out.withColumn("is_open", F.coalesce(F.col("__last") == F.col(day), F.lit(False)))
    inside = F.coalesce("__to", F.lit(0)) - F.coalesce("number", F.lit(0)) + F.col("is_open").cast("int")
    return out.withColumn(f"in_{span}_days", inside.cast("long")).drop("__j", "__end", "__last", "__to")

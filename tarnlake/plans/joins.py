"""Joins: equi, semi, anti, full, interval, as-of, prefix, dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.operators.asof import asof_join
from tarnlake.operators.windows import backfill_gaps, dense_grid, fill_forward, keep_first, validity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("adjusted_prices", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * p_retailprice, 4) AS close_adj FROM lineitem
JOIN part ON l_partkey = p_partkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)""")  # fmt: skip
def adjusted_prices(spark, sf_dir):
    """Equi-join with a factor table, less what a reference table does not list."""
    part = read(spark, sf_dir, "part")
    rows = read(spark, sf_dir, "lineitem").join(part.where("p_size > 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    rows = rows.join(part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * F.col("p_retailprice"), 4).alias("close_adj"))


@register("customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@register("recent_wins_union", """
SELECT o_orderkey, o_totalprice, 'recent' AS src FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_totalprice, 'old' AS src FROM orders a WHERE NOT EXISTS
(SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey AND b.o_orderdate >= TIMESTAMP '2000-01-01' AND b.o_orderkey % 3 = 0)""")  # fmt: skip
def recent_wins_union(spark, sf_dir):
    """Rows of a recent source, and of an older one where the recent has none."""
    orders = read(spark, sf_dir, "orders")
    recent = orders.where("o_orderdate >= timestamp'2000-01-01' and o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice")
    old = orders.select("o_orderkey", "o_totalprice").join(recent, "o_orderkey", "left_anti")
    return recent.withColumn("src", F.lit("recent")).unionByName(old.withColumn("src", F.lit("old")))


@register("cross_source_full_join", """
SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(nc, 0) AS n_customer, coalesce(ns, 0) AS n_supplier, nc IS NOT NULL AND ns IS NOT NULL AS both_sides FROM
(SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN
(SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey""")  # fmt: skip
def cross_source_full_join(spark, sf_dir):
    """Full join of two pre-aggregated sources with agreement flags."""
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("nc"))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    out = a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return out.select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), F.coalesce("nc", F.lit(0)).alias("n_customer"), F.coalesce("ns", F.lit(0)).alias("n_supplier"), (F.col("nc").isNotNull() & F.col("ns").isNotNull()).alias("both_sides"))


_PURCHASES = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'"


def _asof_sql(sign: str, how: str) -> str:
    return f"""SELECT p.event_id, p.user_id, v.event_id AS matched FROM ({_PURCHASES}) p ASOF {how} JOIN
(SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts {sign} v.ts"""


def _asof(spark, sf_dir, **options):
    events = read(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select(F.col("user_id"), F.col("ts").alias("seen"), F.col("event_id").alias("matched"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, ["user_id"], "ts", "seen", ["matched"], ties=["matched"], **options).select("event_id", "user_id", "matched")


@register("asof_last_view", _asof_sql(">=", "LEFT"))
def asof_last_view(spark, sf_dir):
    return _asof(spark, sf_dir)


@register("asof_strict_inner", _asof_sql(">", ""))
def asof_strict_inner(spark, sf_dir):
    return _asof(spark, sf_dir, strict=True, inner=True)


@register("asof_forward", _asof_sql("<=", "LEFT"))
def asof_forward(spark, sf_dir):
    """First view at or after each purchase."""
    return _asof(spark, sf_dir, forward=True)


@register("asof_forward_strict", _asof_sql("<", ""))
def asof_forward_strict(spark, sf_dir):
    """The next session strictly after a known date."""
    return _asof(spark, sf_dir, forward=True, strict=True, inner=True)


@register("interval_join", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT c_custkey, d.day, s.o_orderkey FROM customer CROSS JOIN (VALUES (TIMESTAMP '1996-06-30'), (TIMESTAMP '1998-06-30'), (TIMESTAMP '2000-06-30')) d(day)
LEFT JOIN s ON s.o_custkey = c_custkey AND d.day >= s.valid_from AND (s.valid_to IS NULL OR d.day < s.valid_to)""")  # fmt: skip
def interval_join(spark, sf_dir):
    """States in effect on given sessions: intervals from the next start, joined by key and range."""
    orders = keep_first(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"], [F.desc("o_orderkey")])
    states = validity(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")
    days = spark.sql("select explode(array(timestamp'1996-06-30', timestamp'1998-06-30', timestamp'2000-06-30')) as day")
    grid = read(spark, sf_dir, "customer").select("c_custkey").withColumn("one", F.lit(1)).join(F.broadcast(days.withColumn("one", F.lit(1))), "one").drop("one")
    inside = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    return grid.join(states, (F.col("c_custkey") == F.col("o_custkey")) & inside, "left").select("c_custkey", "day", "o_orderkey")


@register("industry_intervals", """
WITH m AS (SELECT o_custkey AS k, o_orderpriority AS v, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 29 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
m2 AS (SELECT k, v, a, least(b, coalesce(lead(a) OVER (PARTITION BY k ORDER BY n) - 1, b)) AS b FROM m), m3 AS (SELECT * FROM m2 WHERE b >= a)
SELECT k, v, a AS valid_from, b AS valid_to, false AS backfilled FROM m3 UNION ALL
SELECT k, arg_min(v, a), DATE '1995-01-01', min(a) - 1, true FROM m3 GROUP BY k HAVING min(a) > DATE '1995-01-01' UNION ALL
SELECT k, nv, b + 1, na - 1, true FROM (SELECT k, b, lead(a) OVER (PARTITION BY k ORDER BY a) AS na, lead(v) OVER (PARTITION BY k ORDER BY a) AS nv FROM m3) WHERE na > b + 1""")  # fmt: skip
def industry_intervals(spark, sf_dir):
    """Membership intervals with the history before the first and the gaps between filled from what follows."""
    order = Window.partitionBy("k").orderBy("n")
    m = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.to_date("o_orderdate").alias("a"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))
    m = m.withColumn("b", F.least(F.date_add("a", 29), F.coalesce(F.date_sub(F.lead("a").over(order), 1), F.date_add("a", 29)))).where("b >= a")
    return backfill_gaps(m, "k", "v", "a", "b", "1995-01-01")


@register("dense_price_grid", """
WITH f AS (SELECT l_partkey AS part, date_trunc('month', l_shipdate) AS d, sum(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2),
s AS (SELECT DISTINCT d FROM f), b AS (SELECT part, min(d) AS a, max(d) AS z FROM f GROUP BY 1),
g AS (SELECT b.part, s.d, f.close FROM b JOIN s ON s.d BETWEEN b.a AND b.z LEFT JOIN f ON f.part = b.part AND f.d = s.d)
SELECT part, CAST(d AS DATE) AS d, round(close, 4) AS close, round(last_value(close IGNORE NULLS) OVER (PARTITION BY part ORDER BY d), 4) AS filled FROM g""")  # fmt: skip
def dense_price_grid(spark, sf_dir):
    """Every session between a key's first and last bar, suspended ones NULL, and the last price carried forward."""
    facts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.trunc("l_shipdate", "month").alias("d")).agg(F.sum("l_extendedprice").alias("close"))
    grid = fill_forward(dense_grid(facts, "part", "d", facts.select("d"), ["close"]), ["part"], "d", "close", "filled")
    return grid.select("part", "d", F.round("close", 4).alias("close"), F.round("filled", 4).alias("filled"))


@register("entity_prefix_match", r"""
WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' Holdings Ltd.' WHEN 2 THEN n_name || ' Steel Works' ELSE c_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT c_custkey, n_name, CASE WHEN upper(name) = upper(n_name) THEN 1 WHEN upper(regexp_replace(name, '(\s+(Holdings|Group|Co\.|Ltd\.|Inc\.))+$', '', 'i')) = upper(n_name) THEN 2 WHEN starts_with(upper(name), upper(n_name)) THEN 3 END AS rank FROM s, nation)
SELECT c_custkey, arg_min(n_name, (rank, -length(n_name), n_name)) AS matched, min(rank) AS rank FROM h WHERE rank IS NOT NULL GROUP BY 1""")  # fmt: skip
def entity_prefix_match(spark, sf_dir):
    """Entity resolution in order of priority: the full name, the name less its company suffixes, the longest prefix."""
    from tarnlake.functions.text import resolve_names

    n = read(spark, sf_dir, "nation")
    rows = read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit(" Holdings Ltd."))).when(k == 2, F.concat("n_name", F.lit(" Steel Works"))).otherwise(F.col("c_name"))
    found = resolve_names(rows.select("c_custkey", name.alias("name")), "c_custkey", "name", n, "n_name")
    return found.select("c_custkey", "matched", "rank")


@register("alias_replacement", """
WITH m AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS code, o_custkey % 10 = 0 AS is_alias, o_orderdate FROM orders)
SELECT code, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY code, o_orderdate ORDER BY is_alias, o_orderkey) AS n FROM m) WHERE n = 1""")  # fmt: skip
def alias_replacement(spark, sf_dir):
    """Retired codes become their successors; a native row wins over a renamed one with the same key."""
    old = read(spark, sf_dir, "orders").select("o_custkey").where("o_custkey % 10 = 0").distinct().select(F.col("o_custkey").alias("old"), (F.col("o_custkey") + 1).alias("new"))
    rows = read(spark, sf_dir, "orders").join(old, F.col("o_custkey") == F.col("old"), "left")
    rows = rows.select(F.coalesce("new", "o_custkey").alias("code"), F.col("new").isNotNull().alias("is_alias"), "o_orderdate", "o_orderkey")
    return keep_first(rows, ["code", "o_orderdate"], [F.asc("is_alias"), F.asc("o_orderkey")]).select("code", "o_orderdate", "o_orderkey")


@register("alias_detection", """
WITH p AS (SELECT a.o_custkey AS old_code, b.o_custkey AS new_code, count(*) AS n FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate AND a.o_orderpriority = b.o_orderpriority AND a.o_custkey < b.o_custkey GROUP BY 1, 2 HAVING count(*) >= 2),
d AS (SELECT old_code, new_code, count(*) AS shared, count(*) FILTER (WHERE x.p = y.p) AS equal FROM p JOIN (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS p FROM orders GROUP BY ALL) x ON x.o_custkey = old_code JOIN (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS p FROM orders GROUP BY ALL) y ON y.o_custkey = new_code AND y.o_orderdate = x.o_orderdate GROUP BY 1, 2)
SELECT p.old_code, p.new_code, n, shared, round(equal / shared, 6) AS equal_rate, count(*) OVER (PARTITION BY p.old_code) AS candidates FROM p JOIN d ON d.old_code = p.old_code AND d.new_code = p.new_code""")  # fmt: skip
def alias_detection(spark, sf_dir):
    """Codes that share at least so many (date, value) pairs, the share of their common days with equal values, and the
    number of candidates of each.

    Pairs are counted where packed blocks of codes meet; only codes with enough in common leave a task.
    """
    from tarnlake.operators.graph import shared_days

    return shared_days(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", "old_code", "new_code", 2)


@register("theta_reachability_match", """
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + s_suppkey) % 25 AS dst FROM supplier), r AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 3),
h AS (SELECT DISTINCT src, dst FROM r WHERE src <> dst)
SELECT a.s_suppkey AS seller, b.s_suppkey AS buyer FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 0.005 * abs(a.s_acctbal) JOIN h ON h.src = a.s_nationkey AND h.dst = b.s_nationkey
QUALIFY count(*) OVER (PARTITION BY a.s_suppkey) = 1 AND count(*) OVER (PARTITION BY b.s_suppkey) = 1""")  # fmt: skip
def theta_reachability_match(spark, sf_dir):
    """Counterparties inferred from amounts within half a percent and flows of at most three hops, unique on both sides.

    Buckets of the logarithm are wider than half a percent, so that the two of a pair lie in one or in neighbours.
    """
    from tarnlake.operators.graph import reachable
    from tarnlake.plans.reshape import supplier_edges

    step = F.coalesce(F.floor(F.ln(F.abs("s_acctbal")) / 0.0051), F.lit(0))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("bal"), F.signum("s_acctbal").alias("sign"), step.alias("step"))
    a = s.select(F.col("s_suppkey").alias("seller"), F.col("nation").alias("src"), F.col("bal").alias("due"), "sign", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)).alias("step"))
    b = s.select(F.col("s_suppkey").alias("buyer"), F.col("nation").alias("dst"), "bal", "sign", "step")
    pairs = a.join(b, ["sign", "step"]).where("seller <> buyer and abs(due - bal) <= 0.005 * abs(due)")
    pairs = pairs.join(reachable(supplier_edges(spark, sf_dir), 3), ["src", "dst"], "left_semi")
    pairs = pairs.withColumn("x", F.count("*").over(Window.partitionBy("seller"))).withColumn("y", F.count("*").over(Window.partitionBy("buyer")))
    return pairs.where("x = 1 and y = 1").select("seller", "buyer")


@register("broker_rows_relabelled", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_type, value FROM events
WHERE regexp_matches(event_type, '^[a-z]{5,}$') AND event_type NOT IN (SELECT * FROM (VALUES ('error')) t(x))""")  # fmt: skip
def broker_rows_relabelled(spark, sf_dir):
    """Relabel, keep by pattern, and leave out a literal list."""
    skip = spark.createDataFrame([("error",)], "x string")
    rows = read(spark, sf_dir, "events").where(F.col("event_type").rlike("^[a-z]{5,}$")).join(F.broadcast(skip), F.col("event_type") == F.col("x"), "left_anti")
    return rows.select("event_id", F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("event_type"), "value")


@register("one_sided_volumes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag IN ('R', 'A') AS two_sided,
CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag IN ('R', 'A') THEN l_quantity / 2 ELSE l_quantity END AS vol FROM lineitem""")  # fmt: skip
def one_sided_volumes(spark, sf_dir):
    """Two-sided counts of some venues are halved up to a date."""
    rows = read(spark, sf_dir, "lineitem").withColumn("two_sided", (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")) & F.col("l_returnflag").isin("R", "A"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "two_sided", F.when(F.col("two_sided"), F.col("l_quantity") / 2).otherwise(F.col("l_quantity")).alias("vol"))


@register("target_union", """
SELECT o_orderkey AS code, 'list' AS source, o_orderstatus = 'F' AS eligible FROM orders WHERE o_orderpriority LIKE '1%'
UNION ALL SELECT o_orderkey, 'proxy', coalesce(o_totalprice, 0) > 100000 FROM orders WHERE o_orderpriority LIKE '2%'""")  # fmt: skip
def target_union(spark, sf_dir):
    """An official list and a proxy for it, as one."""
    o = read(spark, sf_dir, "orders")
    a = o.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("code"), F.lit("list").alias("source"), (F.col("o_orderstatus") == "F").alias("eligible"))
    return a.unionByName(o.where("o_orderpriority like '2%'").select(F.col("o_orderkey").alias("code"), F.lit("proxy").alias("source"), (F.coalesce("o_totalprice", F.lit(0.0)) > 100000).alias("eligible")))


@register("latest_row_join", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")  # fmt: skip
def latest_row_join(spark, sf_dir):
    """The latest row of each key, without joining back: the struct of the greatest order."""
    best = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("b")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")

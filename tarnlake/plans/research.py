"""Research queries: documents to fetch, cached calls, broker statistics, curves, volatility index parts, verdicts, clocks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.operators.windows import keep_first
from tarnlake.plans.joins import read


@register("document_candidates", r"""
WITH c AS (SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)<table') THEN 'table' WHEN regexp_matches(html, '(?i)<h1') THEN 'report' END AS kind FROM pages),
k AS (SELECT * FROM c WHERE kind IS NOT NULL AND page_id IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT page_id, kind, kind || '/' || page_id || '.html' AS path FROM k WHERE page_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""")  # fmt: skip
def document_candidates(spark, sf_dir):
    """Typed by ordered patterns, listed, one per url, less those already fetched."""
    kind = F.when(F.col("html").rlike("(?i)<table"), "table").when(F.col("html").rlike("(?i)<h1"), "report")
    c = read(spark, sf_dir, "pages").select("page_id", "url", kind.alias("kind")).where("kind is not null")
    c = c.join(read(spark, sf_dir, "customer"), F.col("page_id") == F.col("c_custkey"), "left_semi")
    done = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    c = keep_first(c, ["url"], [F.asc("page_id")]).join(done, F.col("page_id") == F.col("o_custkey"), "left_anti")
    return c.select("page_id", "kind", F.concat("kind", F.lit("/"), F.col("page_id"), F.lit(".html")).alias("path"))


@register("upper_median_stats", """
WITH r AS (SELECT o_custkey AS k, year(o_orderdate) AS y, o_totalprice AS v, o_orderpriority AS m, o_orderkey AS i FROM orders)
SELECT k, y, count(DISTINCT i) AS n, list_sort(list(v))[count(v) // 2 + 1] AS upper_median, round(avg(CAST(v < 50000 AS DOUBLE)), 6) AS low_share FROM r GROUP BY 1, 2""")  # fmt: skip
def upper_median_stats(spark, sf_dir):
    """Reports, upper median and share of low values by broker and year."""
    r = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("y"))
    values = F.sort_array(F.collect_list("o_totalprice"))
    return r.agg(F.countDistinct("o_orderkey").alias("n"), F.get(values, F.floor(F.count("o_totalprice") / 2).cast("int")).alias("upper_median"), F.round(F.avg((F.col("o_totalprice") < 50000).cast("double")), 6).alias("low_share"))


@register("material_index", """
WITH q AS (SELECT l_returnflag || l_linestatus AS c, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS q, avg(l_extendedprice) AS px FROM lineitem GROUP BY 1, 2),
n AS (SELECT c, q, px / avg(px) OVER (PARTITION BY c) AS x FROM q), k AS (SELECT count(DISTINCT c) AS k FROM q)
SELECT q, round(avg(x), 6) AS idx, round(sum(x * CASE WHEN c LIKE 'R%' THEN 2 ELSE 1 END) / sum(CASE WHEN c LIKE 'R%' THEN 2 ELSE 1 END), 6) AS basket FROM n, k GROUP BY q, k HAVING count(*) = k""")  # fmt: skip
def material_index(spark, sf_dir):
    """Each contract over its own mean, averaged over the quarters that all have; and a weighted basket."""
    quarter = F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate"))
    q = read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("c"), quarter.alias("q")).agg(F.avg("l_extendedprice").alias("px"))
    n = q.withColumn("x", F.col("px") / F.avg("px").over(Window.partitionBy("c"))).withColumn("w", F.when(F.col("c").like("R%"), 2).otherwise(1))
    total = q.agg(F.countDistinct("c").alias("k"))
    out = n.groupBy("q").agg(F.round(F.avg("x"), 6).alias("idx"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("basket"), F.count("*").alias("k"))
    return out.join(F.broadcast(total), "k", "left_semi").select("q", "idx", "basket")


@register("nearest_terms", """
SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-08' QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) <= 2""")  # fmt: skip
def nearest_terms(spark, sf_dir):
    """The two nearest expiries at least a week after a day."""
    r = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate"))
    return read(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1997-01-01' + interval 7 day").withColumn("r", r).where("r <= 2").select("o_custkey", F.to_date("o_orderdate").alias("expiry")).distinct()


_CHAIN = """q AS (SELECT p_brand AS day, p_size AS k, round(avg(p_retailprice) FILTER (WHERE p_partkey % 2 = 0), 4) AS c, round(avg(p_retailprice) FILTER (WHERE p_partkey % 2 = 1), 4) AS p FROM part GROUP BY 1, 2),
b AS (SELECT * FROM q WHERE c IS NOT NULL AND p IS NOT NULL), f AS (SELECT day, arg_min(k + exp(0.02 * 0.25) * (c - p) / 1000, (abs(c - p), k)) AS fwd FROM b GROUP BY 1)"""


def _chain(spark, sf_dir):
    part, even = read(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 0
    q = part.groupBy(F.col("p_brand").alias("day"), F.col("p_size").alias("k")).agg(F.round(F.avg(F.when(even, F.col("p_retailprice"))), 4).alias("c"), F.round(F.avg(F.when(~even, F.col("p_retailprice"))), 4).alias("p"))
    value = F.col("k") + F.exp(F.lit(0.02 * 0.25)) * (F.col("c") - F.col("p")) / 1000
    return q, q.where("c is not null and p is not null").groupBy("day").agg(F.min_by(value, F.struct(F.abs(F.col("c") - F.col("p")), "k")).alias("fwd"))


@register("parity_forward", f"""
WITH {_CHAIN} SELECT f.day, round(any_value(fwd), 6) AS fwd, max(k) FILTER (WHERE k <= fwd) AS k0 FROM f JOIN q ON q.day = f.day GROUP BY f.day""")  # fmt: skip
def parity_forward(spark, sf_dir):
    """Forward from put-call parity at the strike where both cost most alike; the last strike at or below it."""
    q, f = _chain(spark, sf_dir)
    return f.join(q, "day").groupBy("day").agg(F.round(F.max("fwd"), 6).alias("fwd"), F.max(F.when(F.col("k") <= F.col("fwd"), F.col("k"))).alias("k0"))


@register("strip_stop", """
WITH q AS (SELECT p_brand AS day, p_size AS k, count(*) FILTER (WHERE p_partkey % 3 = 0) AS bid, round(avg(p_retailprice), 4) AS px FROM part WHERE p_size >= 10 GROUP BY 1, 2),
z AS (SELECT *, bid = 0 AND coalesce(lag(bid) OVER w, 1) = 0 AS two FROM q WINDOW w AS (PARTITION BY day ORDER BY k)), s AS (SELECT *, max(CAST(two AS INTEGER)) OVER (PARTITION BY day ORDER BY k) AS stopped FROM z)
SELECT day, count(*) AS n, round(sum(px), 4) AS total FROM s WHERE stopped = 0 AND bid > 0 GROUP BY day""")  # fmt: skip
def strip_stop(spark, sf_dir):
    """Walking out from the money, quotes without a bid are left out and two of them in a row end the strip."""
    q = read(spark, sf_dir, "part").where("p_size >= 10").groupBy(F.col("p_brand").alias("day"), F.col("p_size").alias("k")).agg(F.count_if(F.col("p_partkey") % 3 == 0).alias("bid"), F.round(F.avg("p_retailprice"), 4).alias("px"))
    w = Window.partitionBy("day").orderBy("k")
    q = q.withColumn("two", ((F.col("bid") == 0) & (F.coalesce(F.lag("bid").over(w), F.lit(1)) == 0)).cast("int"))
    return q.withColumn("stopped", F.max("two").over(w)).where("stopped = 0 and bid > 0").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("px"), 4).alias("total"))


@register("profile_flip", """
WITH p AS (SELECT p_brand AS day, p_size AS level, sum(p_retailprice - 1400) AS g FROM part GROUP BY 1, 2), l AS (SELECT *, lag(g) OVER w AS g0, lag(level) OVER w AS l0 FROM p WINDOW w AS (PARTITION BY day ORDER BY level))
SELECT day, round(arg_min(l0 + (level - l0) * g0 / (g0 - g), level), 6) AS flip FROM l WHERE g0 * g < 0 GROUP BY day""")  # fmt: skip
def profile_flip(spark, sf_dir):
    """The first change of sign of a profile, interpolated."""
    w = Window.partitionBy("day").orderBy("level")
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("day"), F.col("p_size").alias("level")).agg(F.sum(F.col("p_retailprice") - 1400).alias("g"))
    p = p.withColumn("g0", F.lag("g").over(w)).withColumn("l0", F.lag("level").over(w)).where("g0 * g < 0")
    at = F.col("l0") + (F.col("level") - F.col("l0")) * F.col("g0") / (F.col("g0") - F.col("g"))
    return p.groupBy("day").agg(F.round(F.min_by(at, "level"), 6).alias("flip"))


@register("exposure_profile", """
WITH lv AS (SELECT unnest(generate_series(1, 5)) AS level), x AS (SELECT p_brand, p_size, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sign, p_retailprice AS oi FROM part)
SELECT level, round(sum(sign * oi * exp(-abs(p_size / 10.0 - level))), 4) AS exposure, round(sum(oi) FILTER (WHERE p_size / 10.0 > level) / sum(oi), 6) AS share FROM x, lv GROUP BY level""")  # fmt: skip
def exposure_profile(spark, sf_dir):
    """Signed sums and conditional shares at each of a few levels, which every row carries as an array."""
    x = read(spark, sf_dir, "part").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("m", F.col("p_size") / 10.0)
    sign = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)
    return x.groupBy("level").agg(F.round(F.sum(sign * F.col("p_retailprice") * F.exp(-F.abs(F.col("m") - F.col("level")))), 4).alias("exposure"), F.round(F.sum(F.when(F.col("m") > F.col("level"), F.col("p_retailprice"))) / F.sum("p_retailprice"), 6).alias("share"))


@register("factor_acceptance", """
WITH t AS (SELECT p_brand AS factor, corr(l_discount, l_extendedprice) AS ic, corr(l_discount, l_extendedprice) * sqrt(count(*)) AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT factor, round(t, 6) AS t, CAST(abs(t) >= 1 AS INTEGER) + CAST(ic > 0 AS INTEGER) + CAST(n > 2300 AS INTEGER) AS passed, CASE WHEN abs(t) >= 1 AND ic > 0 AND n > 2300 THEN 'accept' WHEN abs(t) >= 1 THEN 'watch' ELSE 'reject' END AS verdict FROM t""")  # fmt: skip
def factor_acceptance(spark, sf_dir):
    """A verdict from three criteria."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = rows.groupBy(F.col("p_brand").alias("factor")).agg(F.corr("l_discount", "l_extendedprice").alias("ic"), F.count("*").alias("n")).withColumn("t", F.col("ic") * F.sqrt("n"))
    a, b, c = F.abs("t") >= 1, F.col("ic") > 0, F.col("n") > 2300
    return t.select("factor", F.round("t", 6).alias("t"), (a.cast("int") + b.cast("int") + c.cast("int")).alias("passed"), F.when(a & b & c, "accept").when(a, "watch").otherwise("reject").alias("verdict"))


@register("decay_profile", """
WITH m AS (SELECT l_linenumber AS h, l_returnflag AS f, abs(avg(l_discount)) * exp(-0.1 * l_linenumber) AS ic FROM lineitem GROUP BY 1, 2)
SELECT f, arg_max(h, (ic, -h)) AS peak, round(-ln(2) / regr_slope(ln(ic), h), 4) AS half_life FROM m GROUP BY f""")  # fmt: skip
def decay_profile(spark, sf_dir):
    """Horizon of the highest IC, and the half-life of an exponential fit."""
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("h"), F.col("l_returnflag").alias("f")).agg((F.abs(F.avg("l_discount")) * F.exp(-0.1 * F.col("l_linenumber"))).alias("ic"))
    return m.groupBy("f").agg(F.max_by("h", F.struct("ic", -F.col("h"))).alias("peak"), F.round(-F.ln(F.lit(2.0)) / F.regr_slope(F.ln("ic"), "h"), 4).alias("half_life"))


@register("rank_autocorrelation", """
WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_suppkey AS c, round(avg(l_discount), 6) AS f FROM lineitem GROUP BY 1, 2), i AS (SELECT *, dense_rank() OVER (ORDER BY d) AS i FROM p),
r AS (SELECT d, c, i, (rank() OVER (PARTITION BY d ORDER BY f) + (count(*) OVER (PARTITION BY d, f) - 1) / 2.0) / count(*) OVER (PARTITION BY d) AS r FROM i)
SELECT a.d, round(corr(a.r, b.r), 6) AS autocorr FROM r a JOIN r b ON a.c = b.c AND a.i = b.i + 1 GROUP BY a.d""")  # fmt: skip
def rank_autocorrelation(spark, sf_dir):
    """Correlation of each date's ranks with those of the date before."""
    from tarnlake.operators.cross_section import percent_rank

    p = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d"), F.col("l_suppkey").alias("c")).agg(F.round(F.avg("l_discount"), 6).alias("f"))
    p = p.withColumn("r", percent_rank("f", ["d"]))
    days = p.select("d").distinct().withColumn("before", F.lag("d").over(Window.orderBy("d")))  # a row a month
    b = p.select("c", F.col("d").alias("before"), F.col("r").alias("s"))
    return p.join(days, "d").join(b, ["c", "before"]).groupBy("d").agg(F.round(F.corr("r", "s"), 6).alias("autocorr"))


@register("thinned_observations", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE (n - 1) % 4 = 0""")  # fmt: skip
def thinned_observations(spark, sf_dir):
    """Every h-th observation of a series, so that overlapping returns do not count twice."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").withColumn("n", n).where("(n - 1) % 4 = 0").select("o_orderkey")


@register("note_context", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, n, max(CAST(regexp_matches(line, '[0-9]{3}') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n ROWS 5 PRECEDING) AS near FROM l)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS line FROM m WHERE near = 1""")  # fmt: skip
def note_context(spark, sf_dir):
    """Matching lines and the five that follow each."""
    l = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))  # noqa: E741
    near = F.max(F.col("x").rlike("[0-9]{3}").cast("int")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(-5, 0))
    return l.withColumn("near", near).where("near = 1").select("doc_id", "line")


@register("table_rows", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_rows, max(len(string_split(line, '|'))) AS n_cells FROM l WHERE regexp_matches(line, '[|].*[|]') GROUP BY doc_id""")  # fmt: skip
def table_rows(spark, sf_dir):
    l = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike("[|].*[|]"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max(F.size(F.split("x", "[|]"))).cast("long").alias("n_cells"))


@register("cycle_clock", """
WITH q AS (SELECT p_brand AS k, year(l_shipdate) AS y, sum(l_extendedprice) AS v, avg(l_discount) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), g AS (SELECT *, v / lag(v) OVER w - 1 AS g, m - lag(m) OVER w AS dm FROM q WINDOW w AS (PARTITION BY k ORDER BY y))
SELECT k, y, CASE WHEN g IS NULL THEN 'unknown' WHEN g >= 0 AND dm >= 0 THEN 'expansion' WHEN g >= 0 THEN 'peak' WHEN dm >= 0 THEN 'recovery' ELSE 'contraction' END AS phase FROM g""")  # fmt: skip
def cycle_clock(spark, sf_dir):
    """Phase by growth and change of margin."""
    w = Window.partitionBy("k").orderBy("y")
    q = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("k"), F.year("l_shipdate").cast("long").alias("y")).agg(F.sum("l_extendedprice").alias("v"), F.avg("l_discount").alias("m"))
    up, wider = F.col("v") / F.lag("v").over(w) - 1 >= 0, F.col("m") - F.lag("m").over(w) >= 0
    return q.select("k", "y", F.when(up.isNull(), "unknown").when(up & wider, "expansion").when(up, "peak").when(wider, "recovery").otherwise("contraction").alias("phase"))


@register("peer_relative", """
WITH s AS (SELECT s_nationkey AS peer, s_suppkey AS k, avg(l_discount) AS m FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT k, round(m - median(m) OVER (PARTITION BY peer), 8) AS to_median, round((rank() OVER (PARTITION BY peer ORDER BY m) - 1) / CAST(count(*) OVER (PARTITION BY peer) AS DOUBLE), 6) AS below FROM s""")  # fmt: skip
def peer_relative(spark, sf_dir):
    """Distance to the peers' median, and the share of peers below."""
    s = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("peer"), F.col("s_suppkey").alias("k")).agg(F.avg("l_discount").alias("m"))
    w = Window.partitionBy("peer")
    return s.select("k", F.round(F.col("m") - F.median("m").over(w), 8).alias("to_median"), F.round((F.rank().over(w.orderBy("m")) - 1) / F.count("*").over(w), 6).alias("below"))


@register("vote_scores", """
SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) - CAST(c_acctbal < -500 AS INTEGER) + CAST(c_nationkey < 12 AS INTEGER) + CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS score,
CASE WHEN CAST(c_acctbal > 0 AS INTEGER) - CAST(c_acctbal < -500 AS INTEGER) + CAST(c_nationkey < 12 AS INTEGER) + CAST(c_mktsegment = 'BUILDING' AS INTEGER) >= 2 THEN 'strong' ELSE 'weak' END AS label FROM customer""")  # fmt: skip
def vote_scores(spark, sf_dir):
    """Signals as votes, summed to a score and a label."""
    signals = (("c_acctbal > 0", 1), ("c_acctbal < -500", -1), ("c_nationkey < 12", 1), ("c_mktsegment = 'BUILDING'", 1))
    score = sum((F.expr(test).cast("int") * vote for test, vote in signals), F.lit(0))
    return read(spark, sf_dir, "customer").select("c_custkey", score.alias("score"), F.when(score >= 2, "strong").otherwise("weak").alias("label"))

"""Reshapes, set operations, recursion, graphs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.operators import graph as G
from tarnlake.plans.joins import read


@register("unpivot_statements", """
SELECT l_orderkey, l_linenumber, l_partkey, field, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem WHERE l_returnflag = 'R')
UNPIVOT (value FOR field IN (l_discount, l_tax))""")  # fmt: skip
def unpivot_statements(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")])
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "field", "value").where("value is not null")


@register("pivot_quotes", """
SELECT o_custkey, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS o FROM orders GROUP BY 1""")  # fmt: skip
def pivot_quotes(spark, sf_dir):
    p = read(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("o_custkey", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"))


@register("pivot_difference", """
WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS n FROM lineitem GROUP BY 1)
SELECT d, a, n, a - lag(a) OVER (ORDER BY d) AS da, n - lag(n) OVER (ORDER BY d) AS dn FROM p""")  # fmt: skip
def pivot_difference(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d")).pivot("l_returnflag", ["A", "N"]).agg(F.sum("l_quantity")).fillna(0.0)
    w = Window.orderBy("d")  # a row a month
    return p.select("d", F.col("A").alias("a"), F.col("N").alias("n"), (F.col("A") - F.lag("A").over(w)).alias("da"), (F.col("N") - F.lag("N").over(w)).alias("dn"))


@register("recursive_tree", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
t AS (SELECT id, 0 AS depth, name AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, t.depth + 1, t.path || '/' || e.name FROM e JOIN t ON e.parent = t.id) SELECT id, depth, path FROM t""")  # fmt: skip
def recursive_tree(spark, sf_dir):
    """Folder tree with depth and path."""
    for name in ("region", "nation", "supplier"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"tree_{name}")
    return spark.sql("""
        WITH RECURSIVE e AS (SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM tree_region
          UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM tree_nation
          UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM tree_supplier),
        t AS (SELECT id, 0 AS depth, name AS path FROM e WHERE parent IS NULL
          UNION ALL SELECT e.id, t.depth + 1, concat(t.path, '/', e.name) FROM e JOIN t ON e.parent = t.id)
        SELECT id, depth, path FROM t""")


_EDGES = "e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + s_suppkey) % 25 AS dst FROM supplier)"


def supplier_edges(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") * 7 + F.col("s_suppkey")) % 25).cast("long").alias("dst")).distinct()


@register("reachability", f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT r.src, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.dst WHERE r.hops < 3)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, min(hops) AS hops FROM r WHERE src <> dst GROUP BY 1, 2""")  # fmt: skip
def reachability(spark, sf_dir):
    return G.reachable(supplier_edges(spark, sf_dir), 3)


@register("signed_walk", f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT src AS a, dst AS b FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 2), u AS (SELECT dst AS a, src AS b FROM e QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 2),
x AS (SELECT 3 AS node, 0 AS k UNION SELECT d.b, k + 1 FROM x JOIN d ON d.a = x.node WHERE k < 3), y AS (SELECT 3 AS node, 0 AS k UNION SELECT u.b, k - 1 FROM y JOIN u ON u.a = y.node WHERE k > -3)
SELECT CAST(node AS BIGINT) AS node, arg_min(k, (abs(k), -k)) AS distance FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY node""")  # fmt: skip
def signed_walk(spark, sf_dir):
    return G.walk(supplier_edges(spark, sf_dir), spark.createDataFrame([(3,)], "node long"), 3, 2)


@register("peer_similarity", """
WITH i AS (SELECT l_suppkey AS k, p_brand AS f, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT k, sqrt(sum(w * w)) AS norm FROM i GROUP BY 1),
a AS (SELECT i.k, f, w / norm AS w FROM i JOIN n ON n.k = i.k), s AS (SELECT a.k, b.k AS peer, sum(a.w * b.w) AS score FROM a JOIN a b ON a.f = b.f AND a.k <> b.k GROUP BY 1, 2)
SELECT k, peer, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, peer) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, peer) <= 20""")  # fmt: skip
def peer_similarity(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("k"), F.col("p_brand").alias("f")).agg(F.sum("l_quantity").alias("w"))
    return G.cosine_neighbours(rows, "k", "f", "w", 20).select("k", "peer", F.round("score", 6).alias("score"), "rank")


@register("segment_edges", """
SELECT least(a.n_regionkey, b.n_regionkey) AS lo, greatest(a.n_regionkey, b.n_regionkey) AS hi, count(*) AS n FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY 1, 2""")  # fmt: skip
def segment_edges(spark, sf_dir):
    """Edges brought to one orientation, counted between groups."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    e = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    e = e.join(n.toDF("x", "rx"), F.col("x") == F.col("s_nationkey")).join(n.toDF("y", "ry"), F.col("y") == F.col("c_nationkey"))
    return e.groupBy(F.least("rx", "ry").alias("lo"), F.greatest("rx", "ry").alias("hi")).agg(F.count("*").alias("n"))


@register("network_top", """
WITH d AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS deg FROM lineitem GROUP BY 1), i AS (SELECT k, deg, s_nationkey < 10 AS inside FROM d JOIN supplier ON s_suppkey = k)
SELECT k, deg, inside FROM i QUALIFY row_number() OVER (PARTITION BY inside ORDER BY deg DESC, k) <= CASE WHEN inside THEN 9 ELSE 7 END""")  # fmt: skip
def network_top(spark, sf_dir):
    """The best-linked members inside a sector and outside it, with different limits."""
    d = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.countDistinct("l_partkey").alias("deg"))
    i = d.join(read(spark, sf_dir, "supplier"), F.col("k") == F.col("s_suppkey")).select("k", "deg", (F.col("s_nationkey") < 10).alias("inside"))
    n = F.row_number().over(Window.partitionBy("inside").orderBy(F.desc("deg"), F.asc("k")))
    i = i.withColumn("n", n).where("n <= 9")  # a fixed limit first: each task keeps nine before rows move
    return i.where(F.col("inside") | (F.col("n") <= 7)).drop("n")


@register("revenue_split", """
WITH m AS (SELECT p_partkey, list_distinct([p_brand, 'all', p_type[1:5]]) AS nodes, p_retailprice AS v FROM part), e AS (SELECT unnest(nodes) AS node, v / len(nodes) AS v FROM m)
SELECT node, round(sum(v), 2) AS v, count(*) AS makers FROM e GROUP BY node""")  # fmt: skip
def revenue_split(spark, sf_dir):
    """Amounts split equally over the nodes that each row is mapped to."""
    m = read(spark, sf_dir, "part").withColumn("nodes", F.array_distinct(F.array("p_brand", F.lit("all"), F.substring("p_type", 1, 5))))
    return m.select(F.explode("nodes").alias("node"), (F.col("p_retailprice") / F.size("nodes")).alias("v")).groupBy("node").agg(F.round(F.sum("v"), 2).alias("v"), F.count("*").alias("makers"))


@register("search", """
WITH h AS (SELECT 1 AS kind, c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '00001') UNION ALL SELECT 2, p_partkey, p_name FROM part WHERE contains(lower(p_name), '00001') OR contains(lower(p_brand), '00001'))
SELECT kind, id, name FROM h QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= 10""")  # fmt: skip
def search(spark, sf_dir):
    """Contains-search over names of two kinds, each with its limit."""
    has = lambda c: F.lower(c).contains("00001")
    a = read(spark, sf_dir, "customer").where(has("c_name")).select(F.lit(1).alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = read(spark, sf_dir, "part").where(has("p_name") | has("p_brand")).select(F.lit(2).alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return a.unionByName(b).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).where("n <= 10").drop("n")


@register("json_documents")
def json_documents(spark, sf_dir):
    """Nested documents: every conversation with its turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(F.struct("conv_id", "turns")).alias("document"))


@register("json_extraction", """
SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || json_keys(props)[1])) AS n_values FROM events GROUP BY 1""")  # fmt: skip
def json_extraction(spark, sf_dir):
    """Values of the first key of each JSON text."""
    m = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"), F.get(F.json_object_keys("props"), F.lit(0)).alias("k"))
    return m.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.try_element_at("m", "k")).alias("n_values"))

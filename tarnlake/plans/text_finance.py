"""Text operators on documents and pages; derivatives and valuation; significance of series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.catalog import register
from tarnlake.functions import dates as D
from tarnlake.functions import finance as M
from tarnlake.functions import text as T
from tarnlake.plans.joins import read


@register("document_classes", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') AND NOT regexp_matches(text, 'CC BY-NC') THEN 'licensed' WHEN regexp_matches(text, '[|].*[|]') THEN 'table' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' END AS kind FROM documents""")  # fmt: skip
def document_classes(spark, sf_dir):
    rules = [("licensed", "(?i)licen[sc]e", "CC BY-NC"), ("table", "[|].*[|]", None), ("numbers", "[0-9]{4}", None)]
    return read(spark, sf_dir, "documents").select("doc_id", T.first_rule(F.col("text"), rules).alias("kind"))


def _pages(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), lines.alias("page", "text"))


_PAGES = "pg AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"


@register("quote_evidence", f"""
WITH {_PAGES}, q AS (SELECT doc, page AS quote_id, substr(text, 5, 30) AS quote, page + 1 AS claimed FROM pg WHERE length(text) >= 40),
h AS (SELECT q.doc, q.quote_id, arg_min(pg.page, (pg.page <> claimed, pg.page)) AS page FROM q JOIN pg ON pg.doc = q.doc AND contains(regexp_replace(pg.text, '\\s+', '', 'g'), regexp_replace(quote, '\\s+', '', 'g')) GROUP BY 1, 2)
SELECT q.doc, q.quote_id, CAST(h.page AS INTEGER) AS page FROM q LEFT JOIN h ON h.doc = q.doc AND h.quote_id = q.quote_id""")  # fmt: skip
def quote_evidence(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    quotes = pages.where("length(text) >= 40").select("doc", F.col("page").alias("quote_id"), F.substring("text", 5, 30).alias("quote"), (F.col("page") + 1).alias("claimed"))
    return T.quote_page(pages, quotes)


@register("sections", f"""
WITH {_PAGES}, s AS (SELECT doc, 'a' AS section, min(page) AS first FROM pg WHERE regexp_matches(text, '\\.$') GROUP BY doc UNION ALL SELECT doc, 'b', min(page) FROM pg WHERE regexp_matches(text, '[|]') GROUP BY doc),
n AS (SELECT doc, first, lead(first) OVER (PARTITION BY doc ORDER BY first) AS nx FROM (SELECT DISTINCT doc, first FROM s)), e AS (SELECT doc, max(page) AS e FROM pg GROUP BY doc)
SELECT s.doc, section, CAST(s.first AS INTEGER) AS first, CAST(coalesce(nx - 1, e) AS INTEGER) AS last FROM s JOIN n ON n.doc = s.doc AND n.first = s.first JOIN e ON e.doc = s.doc""")  # fmt: skip
def sections(spark, sf_dir):
    return T.sections(_pages(spark, sf_dir), [("a", r"\.$"), ("b", "[|]")])


@register("page_headers", f"""
WITH {_PAGES}, k AS (SELECT *, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS mask, count(*) OVER (PARTITION BY doc) AS n FROM pg),
c AS (SELECT doc, mask FROM k WHERE regexp_matches(mask, '\\p{{L}}.*\\p{{L}}.*\\p{{L}}.*\\p{{L}}') AND n > 1 GROUP BY doc, mask, n HAVING count(DISTINCT page) >= 0.5 * n)
SELECT k.doc, CAST(k.page AS INTEGER) AS page, k.text FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = k.doc AND c.mask = k.mask)""")  # fmt: skip
def page_headers(spark, sf_dir):
    return T.without_headers(_pages(spark, sf_dir)).select("doc", "page", "text")


@register("prompt_budget", f"""
WITH {_PAGES} SELECT doc, CAST(page AS INTEGER) AS page FROM pg QUALIFY sum(length(text)) OVER (PARTITION BY doc ORDER BY page) <= 1500 OR row_number() OVER (PARTITION BY doc ORDER BY page) = 1""")  # fmt: skip
def prompt_budget(spark, sf_dir):
    return T.within_budget(_pages(spark, sf_dir), 1500).select("doc", "page")


@register("product_match", r"""
WITH a AS (SELECT p_partkey AS wanted_id, replace(CASE p_partkey % 5 WHEN 0 THEN p_name || ' set' WHEN 1 THEN substr(p_name, 1, length(p_name) - 3) WHEN 2 THEN 'x' || substr(p_name, 3) WHEN 3 THEN upper(p_name) ELSE p_type || ' ' || p_size END, ' ', '') AS a FROM part),
b AS (SELECT min(p_partkey) AS name_id, lower(replace(p_name, ' ', '')) AS b FROM part GROUP BY p_name),
ga AS (SELECT wanted_id, lower(a) AS a, list_distinct(list_transform(generate_series(1, greatest(length(a) - 1, 1)), lambda i: substr(lower(a), i, 2))) AS g FROM a), gb AS (SELECT name_id, b, list_distinct(list_transform(generate_series(1, greatest(length(b) - 1, 1)), lambda i: substr(b, i, 2))) AS h FROM b),
s AS (SELECT wanted_id, name_id, least(length(a), length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) AS r, a, b, 2.0 * len(list_intersect(g, h)) / (len(g) + len(h)) AS dice FROM ga, gb),
t AS (SELECT wanted_id, name_id, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) THEN 0.6 + 0.3 * r WHEN contains(b, a) THEN CASE WHEN length(a) >= 3 AND r >= 0.5 THEN 0.55 + 0.3 * r ELSE 0 END WHEN dice >= 0.5 THEN 0.6 * dice ELSE 0 END AS score FROM s)
SELECT wanted_id, name_id, round(score, 6) AS score FROM t WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY wanted_id ORDER BY score DESC, name_id) = 1""")  # fmt: skip
def product_match(spark, sf_dir):
    """Reported lines (names with words added, cut short or misspelt) against the names of a catalogue."""
    part, name, k = read(spark, sf_dir, "part"), F.col("p_name"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(name, F.lit(" set"))).when(k == 1, F.substring(name, F.lit(1), F.length(name) - 3)).when(k == 2, F.concat(F.lit("x"), F.substring(name, F.lit(3), F.length(name)))).when(k == 3, F.upper(name)).otherwise(F.concat_ws(" ", "p_type", "p_size"))
    a = part.select(F.col("p_partkey").alias("wanted_id"), text.alias("text"))
    b = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("name_id"))
    return T.match_names(a, b).withColumn("score", F.round("score", 6))


@register("code_canon", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey * 397 % 1000000 AS VARCHAR), 6, '0') WHEN 1 THEN 'sh' || lpad(CAST(c_custkey * 397 % 1000000 AS VARCHAR), 6, '0') WHEN 2 THEN lpad(CAST(c_custkey * 397 % 1000000 AS VARCHAR), 6, '0') || '.sz' ELSE c_name END AS code FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN upper(code[3:]) || '.SH' WHEN 2 THEN upper(code) WHEN 0 THEN CASE WHEN code[1] IN ('6', '9') THEN code || '.SH' WHEN code[1] IN ('0', '2', '3') THEN code || '.SZ' WHEN code[1] IN ('4', '8') THEN code || '.BJ' END END AS code FROM c""")  # fmt: skip
def code_canon(spark, sf_dir):
    number = F.lpad((F.col("c_custkey") * 397 % 1000000).cast("string"), 6, "0")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, number).when(k == 1, F.concat(F.lit("sh"), number)).when(k == 2, F.concat(number, F.lit(".sz"))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", D.canonical_code(raw).alias("code"))


@register("date_checks", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '2024' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '31' ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
SELECT o_orderkey, d, try_strptime(d, '%Y%m%d') IS NOT NULL AS valid FROM t""")  # fmt: skip
def date_checks(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("2024"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("31"))).otherwise(D.day_text(F.col("o_orderdate")))
    return read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), D.valid_day(d).alias("valid"))


@register("quarter_ends", "SELECT strftime(last_day(d), '%Y%m%d') AS d FROM generate_series(DATE '2019-03-01', DATE '2026-09-01', INTERVAL 3 MONTH) t(d)")
def quarter_ends(spark, sf_dir):
    return D.days_between(spark, "2019-01-01", "2026-11-30", "quarter_ends")


@register("effective_dates", """
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5), k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS k FROM orders)
SELECT o_orderkey, d AS effective FROM k ASOF LEFT JOIN s ON s.d > k.k""")  # fmt: skip
def effective_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    sessions = o.where(F.dayofweek("o_orderdate").between(2, 6)).select(F.to_date("o_orderdate").alias("d")).distinct()
    facts = o.select("o_orderkey", D.day_text(F.col("o_orderdate")).alias("k"))
    return D.effective_sessions(facts, "k", sessions, "d", "next_session").select("o_orderkey", "effective")


@register("third_fridays", """
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((12 - dayofweek(date_trunc('month', o_orderdate))) % 7 AS INTEGER) + 14 AS expiry FROM orders""")  # fmt: skip
def third_fridays(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), M.third_friday(F.col("o_orderdate")).alias("expiry")).distinct()


@register("gamma_exposure", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3.04 AS f, 1.5 + l_quantity / 20 AS k, (1 + l_linenumber) / 12.0 AS t, 0.02 AS r, 0.1 + l_discount AS v FROM lineitem), d AS (SELECT *, (ln(f / k) + 0.5 * v * v * t) / (v * sqrt(t)) AS d1 FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(-r * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (f * v * sqrt(t)), 8) AS gamma FROM d""")  # fmt: skip
def gamma_exposure(spark, sf_dir):
    gamma = M.black76_gamma(F.lit(3.04), 1.5 + F.col("l_quantity") / 20, (1 + F.col("l_linenumber")) / 12.0, F.lit(0.02), 0.1 + F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(gamma, 8).alias("gamma"))


@register("option_prices_and_vols")
def option_prices_and_vols(spark, sf_dir):
    """Black-76 values and the volatility found back from them."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit(3.04).alias("f"), (2.0 + F.col("p_size") / 25).alias("k"), F.lit(0.25).alias("t"), F.lit(0.02).alias("r"), (0.1 + F.col("p_size") / 100).alias("v"), (F.col("p_partkey") % 2 == 0).alias("call"))
    rows = rows.withColumn("price", M.black76_price("f", "k", "t", "r", "v", "call"))
    return rows.select("p_partkey", "price", "v", M.implied_vol("price", "f", "k", "t", "r", "call").alias("found"))


@register("annuity_years", """
SELECT c_custkey, round(CASE WHEN c_acctbal * 10 <= 20000 THEN 0 ELSE least(100, CASE WHEN (c_acctbal * 10 - 20000) * 0.08 / 8000 < 1 THEN -ln(1 - (c_acctbal * 10 - 20000) * 0.08 / 8000) / ln(1.08) ELSE 100 END) END, 6) AS years FROM customer""")  # fmt: skip
def annuity_years(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(M.annuity_years(F.col("c_acctbal") * 10, F.lit(20000.0), F.lit(8000.0), 0.08, 100.0), 6).alias("years"))


@register("implied_growth")
def implied_growth(spark, sf_dir):
    """Growth that a price implies, by 80 halvings inside one expression."""
    return read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.round(M.implied_growth(F.col("c_acctbal") * 20, F.col("c_acctbal"), 0.08, 10), 8).alias("growth"))


@register("risk_free_rates", """
WITH d AS (SELECT DISTINCT l_linenumber * 20 - 10 AS days FROM lineitem), s AS (SELECT days, CASE WHEN days <= 7 THEN 0.015 WHEN days <= 30 THEN 0.015 + (days - 7) / 23.0 * 0.003 WHEN days <= 90 THEN 0.018 + (days - 30) / 60.0 * 0.004 ELSE 0.022 END AS r FROM d)
SELECT CAST(days AS INTEGER) AS days, round(ln(1 + r * days / 360) * 365 / days, 8) AS rate FROM s""")  # fmt: skip
def risk_free_rates(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 20 - 10).alias("days")).distinct()
    return d.select("days", F.round(M.interpolated_rate(F.col("days"), [7, 30, 90], [F.lit(0.015), F.lit(0.018), F.lit(0.022)]), 8).alias("rate"))


@register("variance_strip", """
WITH q AS (SELECT p_brand AS day, p_size AS k, round(avg(p_retailprice), 4) AS px FROM part GROUP BY 1, 2), w AS (SELECT *, lag(k) OVER o AS a, lead(k) OVER o AS b FROM q WINDOW o AS (PARTITION BY day ORDER BY k))
SELECT day, round(sum(coalesce((b - a) / 2.0, b - k, k - a) / (k * k) * px), 6) AS strip, max(k) FILTER (WHERE k <= 25) AS k0 FROM w GROUP BY day""")  # fmt: skip
def variance_strip(spark, sf_dir):
    """Sum of strike gaps over squared strikes times quotes, gaps one-sided at both ends."""
    q = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("day"), F.col("p_size").alias("k")).agg(F.round(F.avg("p_retailprice"), 4).alias("px"))
    o = Window.partitionBy("day").orderBy("k")
    q = q.withColumn("a", F.lag("k").over(o)).withColumn("b", F.lead("k").over(o))
    gap = F.coalesce((F.col("b") - F.col("a")) / 2.0, (F.col("b") - F.col("k")).cast("double"), (F.col("k") - F.col("a")).cast("double"))
    return q.groupBy("day").agg(F.round(F.sum(gap / (F.col("k") * F.col("k")) * F.col("px")), 6).alias("strip"), F.max(F.when(F.col("k") <= 25, F.col("k"))).alias("k0"))


@register("realised_volatility", """
WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT d, ln(v / lag(v) OVER (ORDER BY d)) AS r FROM m)
SELECT d, round(CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(244) * 100 END, 6) AS vol FROM r WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)""")  # fmt: skip
def realised_volatility(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    m = m.withColumn("r", F.ln(F.col("v") / F.lag("v").over(Window.orderBy("d"))))  # one series, a row a day
    w = Window.orderBy("d").rowsBetween(-19, 0)
    return m.select("d", F.round(F.when(F.count("r").over(w) == 20, F.stddev_samp("r").over(w) * F.sqrt(F.lit(244.0)) * 100), 6).alias("vol"))


@register("watch_status", """
SELECT c_custkey, CASE WHEN c_acctbal <= 1000 THEN 'in' WHEN c_acctbal <= 1000 * 1.1 THEN 'near' ELSE 'far' END AS status, round_even(c_acctbal / 997 - 1, 4) AS gap FROM customer""")  # fmt: skip
def watch_status(spark, sf_dir):
    gap = F.bround(F.col("c_acctbal") / 997 - 1, 4)
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") <= 1000, "in").when(F.col("c_acctbal") <= 1000 * 1.1, "near").otherwise("far").alias("status"), gap.alias("gap"))

"""Reports read page by page: a page is a line of a document here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.catalog import register
from tarnlake.functions import reports as R
from tarnlake.plans.joins import read
from tarnlake.plans.text_finance import _PAGES, _pages

PATTERNS = {"licence": "(?i)licen[sc]e", "rights": "(?i)reserved", "numbers": "[0-9]{3}"}


@register("report_sections", f"""
WITH {_PAGES}, s AS (SELECT doc, 'licence' AS section, min(page) AS first FROM pg WHERE regexp_matches(text, '(?i)licen[sc]e') GROUP BY doc UNION ALL SELECT doc, 'rights', min(page) FROM pg WHERE regexp_matches(text, '(?i)reserved') GROUP BY doc UNION ALL SELECT doc, 'numbers', min(page) FROM pg WHERE regexp_matches(text, '[0-9]{{3}}') GROUP BY doc),
n AS (SELECT doc, first, lead(first) OVER (PARTITION BY doc ORDER BY first) AS nx FROM (SELECT DISTINCT doc, first FROM s)), e AS (SELECT doc, max(page) AS e, count(*) AS n_pages, sum(length(text)) AS size FROM pg GROUP BY doc),
b AS (SELECT s.doc, section, s.first, coalesce(nx - 1, e) AS last FROM s JOIN n ON n.doc = s.doc AND n.first = s.first JOIN e ON e.doc = s.doc),
c AS (SELECT b.doc, sum(length(text)) AS inside FROM b JOIN pg ON pg.doc = b.doc AND page BETWEEN first AND last WHERE section = 'numbers' GROUP BY 1)
SELECT e.doc, n_pages, round(CASE WHEN size > 0 THEN coalesce(inside, 0) / size ELSE 0 END, 6) AS share, CAST(l.first AS INTEGER) AS licence_first, CAST(l.last AS INTEGER) AS licence_last FROM e LEFT JOIN c ON c.doc = e.doc LEFT JOIN b l ON l.doc = e.doc AND l.section = 'licence'""")  # fmt: skip
def report_sections(spark, sf_dir):
    """Sections of a report between the first pages of its headings, and the part of its characters that one of them holds."""
    pages = _pages(spark, sf_dir)
    bounds = R.bounded(pages, R.headings(pages, PATTERNS))
    out = R.chapter_share(pages, bounds, "numbers").join(bounds.where("section = 'licence'").select("doc", F.col("first").alias("licence_first"), F.col("last").alias("licence_last")), "doc", "left")
    return out.select("doc", "n_pages", F.round("share", 6).alias("share"), "licence_first", "licence_last")


@register("valuation_pages", f"WITH {_PAGES} SELECT doc, CAST(page + 1 AS INTEGER) AS page FROM pg WHERE page + 1 <= 2 OR regexp_matches(text, '[0-9]{{2}}')")
def valuation_pages(spark, sf_dir):
    """The first two pages and those with a keyword."""
    pages = _pages(spark, sf_dir).withColumn("page", F.col("page") + 1)
    return R.worth_reading(pages, "[0-9]{2}").select("doc", "page")


@register("note_lengths", r"""
WITH c AS (SELECT doc_id AS doc, text, regexp_matches(text, '(?i)licen[sc]e') AS has FROM documents WHERE text IS NOT NULL)
SELECT doc, CAST(length(regexp_replace(regexp_replace(substr(text, length(regexp_extract(text, '(?is)^.*?licen[sc]e', 0)) + 1), '(?i)all rights reserved', '', 'g'), '\s+', '', 'g')) AS INTEGER) AS chars FROM c WHERE has""")  # fmt: skip
def note_lengths(spark, sf_dir):
    """Characters behind the first heading of a note, less a standard phrase and blanks."""
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)licen[sc]e")).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.col("text").alias("kept"))
    return R.note_chars(d, "(?i)licen[sc]e", "(?i)all rights reserved")


@register("digest_budget", """
WITH d AS (SELECT source AS scope, doc_id AS ref, text FROM documents WHERE text IS NOT NULL), r AS (SELECT *, sum(length(text)) OVER (PARTITION BY scope ORDER BY ref) AS t, row_number() OVER (PARTITION BY scope ORDER BY ref) AS n FROM d) SELECT scope, ref FROM r WHERE t <= 20000 OR n = 1""")  # fmt: skip
def digest_budget(spark, sf_dir):
    """As many digests of each scope as fit a budget, in order."""
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("scope"), F.col("doc_id").alias("ref"), F.col("doc_id").alias("age"), "text")
    return R.digests_within(d, 20_000).select("scope", "ref")


@register("cited_points", """
WITH d AS (SELECT source AS scope, doc_id AS ref, text FROM documents WHERE text IS NOT NULL), g AS (SELECT scope, ref FROM (SELECT *, sum(length(text)) OVER (PARTITION BY scope ORDER BY ref) AS t, row_number() OVER (PARTITION BY scope ORDER BY ref) AS n FROM d) WHERE t <= 20000 OR n = 1),
p AS (SELECT source AS scope, doc_id AS point, unnest([doc_id, doc_id + 1, doc_id // 2]) AS ref FROM documents) SELECT p.scope, point, count(DISTINCT p.ref) AS n_sources FROM p JOIN g ON g.scope = p.scope AND g.ref = p.ref GROUP BY 1, 2""")  # fmt: skip
def cited_points(spark, sf_dir):
    """Points keep only the sources that were within the budget; points without one go."""
    docs = read(spark, sf_dir, "documents")
    d = docs.where("text is not null").select(F.col("source").alias("scope"), F.col("doc_id").alias("ref"), F.col("doc_id").alias("age"), "text")
    points = docs.select(F.col("source").alias("scope"), F.col("doc_id").alias("point"), F.array("doc_id", F.col("doc_id") + 1, F.floor(F.col("doc_id") / 2)).alias("sources"))
    out = R.cited_points(points, R.digests_within(d, 20_000))
    return out.select("scope", "point", F.size(F.array_distinct("sources")).cast("long").alias("n_sources"))

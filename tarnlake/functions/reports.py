"""Paged reports: tables of contents, chapters, notes, partner tables, pages worth reading, digests within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A page is a table of contents if it has so many lines that end in dots and a number.
CONTENTS_LINES = 3
CONTENTS = r"\.{3,}\s*\d+\s*$"


def is_contents(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(CONTENTS))) >= CONTENTS_LINES


def headings(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc, section, first): the first page, tables of contents aside, on which each heading stands."""
    kept = pages.where(~is_contents(F.col("text")))
    each = F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns.items()])
    hits = kept.select("doc", "page", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("section"))
    return hits.groupBy("doc", "section").agg(F.min("page").alias("first"))


def bounded(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc, section, first, last): a section ends on the page before the next later start, the last one with the report."""
    ends = pages.groupBy("doc").agg(F.max("page").alias("__end"))
    later = starts.select("doc", "first").distinct().withColumn("__next", F.lead("first").over(Window.partitionBy("doc").orderBy("first")))
    rows = starts.join(later, ["doc", "first"]).join(ends, "doc")
    return rows.select("doc", "section", "first", F.coalesce(F.col("__next") - 1, "__end").alias("last"))


def chapter_share(pages: DataFrame, bounds: DataFrame, section: str) -> DataFrame:
    """(doc, n_pages, share): the part of a report's characters that lie in one section; 0 without it."""
    part = bounds.where(F.col("section") == section).select("doc", "first", "last")
    rows = pages.join(part, "doc", "left").withColumn("__in", F.coalesce(F.col("page").between(F.col("first"), F.col("last")), F.lit(False)))
    size = F.length("text")
    total = F.sum(size)
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.when(total > 0, F.sum(F.when(F.col("__in"), size).otherwise(0)) / total).otherwise(0.0).alias("share"))


#: A row of a partner table: rank, name, amount, share in per cent.
PARTNER = r"^\s*(\d)\s*[|]\s*([^|]+?)\s*[|]\s*([\d,]+(?:\.\d+)?)\s*[|]\s*(\d+(?:\.\d+)?)%?\s*[|]?\s*$"


def partner_rows(pages: DataFrame, unit: float = 1.0, most: int = 5, tolerance: float = 0.05) -> DataFrame:
    """(doc, rank, name, amount, pct, consistent): rows of the tables of largest partners on a report's pages, amounts scaled by
    their unit. consistent: the shares of a report's rows follow from its amounts within `tolerance` points of each other."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(PARTNER))
    pick = lambda k: F.regexp_extract("line", PARTNER, k)
    rows = lines.select("doc", "page", "at", pick(1).cast("int").alias("rank"), F.trim(pick(2)).alias("name"), (F.regexp_replace(pick(3), ",", "").cast("double") * unit).alias("amount"), pick(4).cast("double").alias("pct"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc", "rank").orderBy("page", "at"))).where((F.col("n") == 1) & (F.col("rank") <= most))
    whole = F.try_divide(F.col("amount") * 100, F.col("pct"))
    first = F.min_by(whole, "rank").over(Window.partitionBy("doc"))
    fits = F.abs(F.try_divide(F.col("amount") * 100, first) - F.col("pct")) <= tolerance
    return rows.select("doc", "rank", "name", "amount", "pct", F.coalesce(fits, F.lit(False)).alias("consistent"))


def worth_reading(pages: DataFrame, keywords: str, lead: int = 2) -> DataFrame:
    """The first `lead` pages (numbered from 1) and those with a keyword."""
    return pages.where((F.col("page") <= lead) | F.col("text").rlike(keywords))


def note_pages(pages: DataFrame, start: str, end: str, note: str, operating: str, context: int = 5) -> DataFrame:
    """(doc, page, kept): the narrative of a periodic report, from the page with the start mark to the end mark.

    Before the heading of the note only operating lines stay, with the `context` lines that follow each on their page; from
    that heading on everything does. Pages of which nothing is left go.
    """
    firsts = pages.where(F.col("text").rlike(start)).groupBy("doc").agg(F.min("page").alias("__first"))
    rows = pages.join(firsts, "doc").where("page >= __first")
    ends = rows.where(F.col("text").rlike(end)).groupBy("doc").agg(F.min("page").alias("__last"))
    rows = rows.join(ends, "doc", "left").where("__last is null or page <= __last")
    rows = rows.withColumn("text", F.when(F.col("page") == F.col("__last"), F.element_at(F.split("text", end, 2), 1)).otherwise(F.col("text")))
    heads = rows.where(F.col("text").rlike(note)).groupBy("doc").agg(F.min("page").alias("__note"))
    rows = rows.join(heads, "doc", "left").withColumn("__lines", F.split("text", "\n"))
    on = F.col("page") == F.col("__note")
    # the line of the heading on its page: lines before it count as head, it and those after are the note
    numbered = F.transform(F.col("__lines"), lambda x, i: F.when(x.rlike(note), i))
    cut = F.when(on, F.array_min(numbered)).otherwise(F.when(F.col("page") > F.col("__note"), F.lit(0)).otherwise(F.size("__lines")))
    rows = rows.withColumn("__cut", cut)
    near = lambda i: F.exists(F.slice("__lines", F.greatest(i - context + 1, F.lit(1)), F.least(i + 1, F.lit(context + 1))), lambda x: x.rlike(operating))
    kept = F.filter(F.col("__lines"), lambda x, i: (i >= F.col("__cut")) | near(i))
    return rows.select("doc", "page", F.array_join(kept, "\n").alias("kept")).where(F.trim("kept") != "")


def note_chars(kept: DataFrame, note: str, empty: str) -> DataFrame:
    """(doc, chars): characters behind the note's heading, less standard phrases and blanks; 0 without the heading."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "kept"))), lambda x: x["kept"]), "\n")
    whole = kept.groupBy("doc").agg(text.alias("t"))  # the pages of one note
    rest = F.when(F.col("t").rlike(note), F.element_at(F.split("t", note, 2), 2)).otherwise("")
    return whole.select("doc", F.length(F.regexp_replace(F.regexp_replace(rest, empty, ""), r"\s+", "")).alias("chars"))


def digests_within(digests: DataFrame, budget: int) -> DataFrame:
    """Digests (scope, ref, age, text), newest first, as long as their characters fit the budget together; the first always.
    The first that does not fit ends the list."""
    w = Window.partitionBy("scope").orderBy("age", "ref").rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy("scope").orderBy("age", "ref"))
    return digests.withColumn("__t", F.sum(F.length("text")).over(w)).withColumn("__n", n).where(f"__t <= {budget} or __n = 1").drop("__t", "__n")


def cited_points(points: DataFrame, given: DataFrame) -> DataFrame:
    """Points (scope, point, sources) with only the sources that were given to the reader; points without any go."""
    refs = given.groupBy("scope").agg(F.collect_set("ref").alias("__refs"))  # those within one budget
    rows = points.join(refs, "scope").withColumn("sources", F.filter("sources", lambda x: F.array_contains("__refs", x)))
    return rows.where(F.size("sources") > 0).drop("__refs")

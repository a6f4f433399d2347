"""Text operators: ordered rules, quotes, page headers, sections, tables, fuzzy product matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rule(text: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """Name of the first rule (name, include, exclude) whose pattern is found and whose exclusion is not."""
    tests = [F.when(text.rlike(inc) & (~text.rlike(exc) if exc else F.lit(True)), name) for name, inc, exc in rules]
    return F.coalesce(*tests)


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(pairs)


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


#: A wanted text within a name counts from so many characters and so large a share of the name on; overlap from so large a
#: Dice coefficient on; matches from this score on.
LEAST_INSIDE, LEAST_SHARE, LEAST_DICE, LEAST_SCORE = 3, 0.5, 0.5, 0.45


def match_score(wanted: Column, name: Column, overlap: Column, broad: Column | None = None, near: Column | None = None) -> Column:
    """1 for equal texts; 0.6 + 0.3 r if the wanted text holds the name; 0.55 + 0.3 r if it lies in the name, is no broad word
    and is long enough (r: shorter over longer); 0.6 times a large enough Dice overlap where the name is `near`; else 0."""
    r = F.least(F.length(wanted), F.length(name)) / F.greatest(F.length(wanted), F.length(name))
    long_enough = (F.length(wanted) >= LEAST_INSIDE) & (r >= LEAST_SHARE) & ~(F.lit(False) if broad is None else broad)
    close = (overlap >= LEAST_DICE) & (F.lit(True) if near is None else near)
    inside = F.when(long_enough, 0.55 + 0.3 * r).otherwise(0.0)
    return F.when(wanted == name, 1.0).when(wanted.contains(name), 0.6 + 0.3 * r).when(name.contains(wanted), inside).when(close, 0.6 * overlap).otherwise(0.0)


def match_names(wanted: DataFrame, names: DataFrame, least: float = LEAST_SCORE, broad: tuple[str, ...] = ()) -> DataFrame:
    """(wanted_id, name_id, score): the best-scoring name of each wanted text (ties: the smaller id).

    `wanted` has wanted_id, text; `names` has name_id, text. Texts are compared lower-cased and without blanks. Pairs of
    characters are ordered by how many names hold them, the rarest first, and three equi-joins on pairs find all that can
    score: a name that lies in a wanted text has its rarest pair there; a wanted text that lies in a name likewise; texts
    with a sufficient overlap share one of the rarest pairs of both, all but so many that the rest could not make it up.
    """
    a = wanted.select("wanted_id", F.lower(squeezed(F.col("text"))).alias("a")).withColumn("ga", bigrams(F.col("a")))
    b = names.select("name_id", F.lower(squeezed(F.col("text"))).alias("b")).withColumn("gb", bigrams(F.col("b")))
    counts = b.select(F.explode("gb").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    left, right = _ranked(a, "wanted_id", "ga", counts), _ranked(b, "name_id", "gb", counts)
    met = [
        left.join(right.where("n = 1").select("name_id", "g"), "g"),
        left.where("n = 1").join(right.select("name_id", "g"), "g"),
        left.where("n <= take").join(right.where("n <= take").select("name_id", "g"), "g"),
    ]
    pairs = None
    for part in met:
        part = part.select("wanted_id", "name_id")
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.distinct().join(a, "wanted_id").join(b, "name_id")
    common = F.size(F.array_intersect("ga", "gb"))
    score = match_score(F.col("a"), F.col("b"), 2.0 * common / (F.size("ga") + F.size("gb")), F.col("a").isin(*broad) if broad else None)
    pairs = pairs.withColumn("score", score).where((F.col("score") >= least) & (F.col("score") > 0))
    best = pairs.groupBy("wanted_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "name_id")).alias("x"))
    return best.select("wanted_id", "x.name_id", (-F.col("x.s")).alias("score"))


def _ranked(texts: DataFrame, key: str, grams: str, counts: DataFrame) -> DataFrame:
    """(key, g, n, take): the pairs of each text from the rarest on, and how many of them an overlap must reach into.

    With |x| pairs, an overlap of LEAST_DICE with any text takes at least ceil(LEAST_DICE |x| / (2 - LEAST_DICE)) shared
    ones, so the first of them in this order is among the |x| less that, plus one, rarest.
    """
    need = F.ceil(F.lit(LEAST_DICE / (2 - LEAST_DICE)) * F.size(grams) - 1e-9)
    each = texts.select(key, (F.size(grams) - need + 1).alias("take"), F.explode(grams).alias("g")).join(counts, "g", "left")
    order = Window.partitionBy(key).orderBy(F.coalesce("c", F.lit(0)), "g")
    return each.select(key, "g", "take", F.row_number().over(order).alias("n"))


#: Endings that name a form of company rather than the company.
COMPANY_SUFFIXES = r"(?i)(\s+(Holdings|Group|Co\.|Ltd\.|Inc\.))+$"


def resolve_names(rows: DataFrame, key: str, name: str, known: DataFrame, known_name: str, suffixes: str = COMPANY_SUFFIXES) -> DataFrame:
    """(key, matched, rank): rank 1 for equal names (letter case aside), 2 for names equal less their suffixes, 3 for the
    longest known name that the name starts with; rows without a match are left out.

    Every prefix of a name is a row, so the longest known one is found by an equi-join.
    """
    upper = F.upper(F.col(name))
    known = known.select(F.col(known_name).alias("matched"), F.upper(F.col(known_name)).alias("__u")).distinct()
    lengths = known.agg(F.max(F.length("__u"))).first()[0] or 0
    full = rows.select(key, upper.alias("__u"), F.lit(1).alias("rank"))
    bare = rows.select(key, F.upper(F.regexp_replace(name, suffixes, "")).alias("__u"), F.lit(2).alias("rank"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length(upper), F.lit(lengths))), lambda n: F.substring(upper, 1, n))
    prefix = rows.where(F.length(name) > 0).select(key, F.explode(starts).alias("__u"), F.lit(3).alias("rank"))
    hits = full.unionByName(bare).unionByName(prefix).join(known, "__u")
    best = hits.groupBy(key).agg(F.min(F.struct("rank", (-F.length("__u")).alias("l"), "matched")).alias("x"))
    return best.select(key, "x.matched", "x.rank")


def quote_page(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc, quote_id, page): the claimed page if it holds the quote (blanks aside), else the first page that does, else NULL.

    `pages`: doc, page, text. `quotes`: doc, quote_id, quote, claimed.
    """
    tight = pages.select("doc", "page", squeezed(F.col("text")).alias("tight"))
    hits = quotes.withColumn("wanted", squeezed(F.col("quote"))).join(tight, "doc").where(F.col("tight").contains(F.col("wanted")))
    found = hits.groupBy("doc", "quote_id").agg(F.min_by("page", F.struct((F.col("page") != F.col("claimed")).alias("other"), "page")).alias("found"))
    return quotes.join(found, ["doc", "quote_id"], "left").select("doc", "quote_id", F.col("found").alias("page"))


def without_headers(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, page, text) less the lines that stand on at least `share` of a document's pages (digits masked, four letters or more)."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("mask", F.regexp_replace(F.trim("line"), r"\d+", "#"))
    n = pages.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    common = lines.where(F.col("mask").rlike(r"\p{L}.*\p{L}.*\p{L}.*\p{L}")).groupBy("doc", "mask").agg(F.countDistinct("page").alias("k"))
    common = common.join(n, "doc").where((F.col("k") >= share * F.col("n_pages")) & (F.col("n_pages") > 1)).select("doc", "mask")
    kept = lines.join(common, ["doc", "mask"], "left_anti")
    return kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))


def sections(pages: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(doc, section, first, last): the first page with each heading; a section ends before the next later start."""
    rows = None
    for name, pattern in patterns:
        hit = pages.where(F.col("text").rlike(pattern)).groupBy("doc").agg(F.min("page").alias("first")).withColumn("section", F.lit(name))
        rows = hit if rows is None else rows.unionByName(hit)
    ends = pages.groupBy("doc").agg(F.max("page").alias("end"))
    starts = rows.select("doc", "first").distinct().withColumn("next", F.lead("first").over(Window.partitionBy("doc").orderBy("first")))
    return rows.join(starts, ["doc", "first"]).join(ends, "doc").select("doc", "section", "first", F.coalesce(F.col("next") - 1, "end").alias("last"))


def within_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Pages of each document while their characters fit the budget; the first always."""
    total = F.sum(F.length("text")).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    return pages.withColumn("__t", total).withColumn("__n", first).where((F.col("__t") <= budget) | (F.col("__n") == 1)).drop("__t", "__n")

"""Benchmark decontamination by spaced seeds (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import BROADCAST_ROWS, durable, less

#: A window has so many words (a shorter item is one window), of which two in WINDOW may differ: need(n) must agree.
WINDOW, FREE = 13, 2
#: Items of fewer words are no evidence: their words stand together in texts that never saw them.
LEAST_ITEM = 3
#: 1: the word counts, 0: any word may stand there. Together they hit every window of 13 words with up to two substitutions.
MASKS = ("111111", "11001010011")
#: For items below WINDOW words, of which one may differ from seven words on: three words in a row always agree.
SHORT_MASKS = ("111",)


def need(n: Column) -> Column:
    """Words that must agree in a window of n."""
    return n - F.floor(n * FREE / WINDOW).cast("int")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masked(hashes: Column, mask: str, number: int) -> Callable[[Column], Column]:
    kept = [i for i, c in enumerate(mask) if c == "1"]
    return lambda at: F.xxhash64(F.lit(number), *[F.get(hashes, at + k) for k in kept])


def seeds(table: DataFrame, key: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, seed, at): a hash of the words that each mask keeps, at each place of each text."""
    hashed = table.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    h, arrays, sizes = F.col("h"), [], []
    for number, mask in enumerate(masks):
        places = F.size(h) - len(mask)
        hit = F.transform(F.sequence(F.lit(0), places), masked(h, mask, number))
        arrays.append(F.when(places >= 0, hit).otherwise(F.array().cast("array<bigint>")))
        sizes.append(F.greatest(places + 1, F.lit(0)))
    out = hashed.select(key, F.size(h).alias("n"), F.concat(*arrays).alias("all"))
    # outer: else Spark infers a filter on the array and pushes it down, hashes inlined, below its own projection
    out = out.select(key, "n", F.posexplode_outer("all").alias("at", "seed")).where("seed is not null")
    at, before = F.col("at"), F.lit(0)
    place = at
    for mask in masks[:-1]:
        before = before + F.greatest(F.col("n") - len(mask) + 1, F.lit(0))
        place = F.when(at >= before, at - before).otherwise(place)
    return out.select(key, "seed", place.alias("at"))


def hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(doc_id, item_id, shift): where a seed of an item stands in a text, by the distance of the two places."""
    test = seeds(items, "item_id", masks).distinct()
    # the test side is broadcast only after a count; beyond it, Spark's own join stands, whose large keys AQE splits
    side = F.broadcast(test) if test.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else test
    found = seeds(docs, "doc_id", masks).join(side.withColumnRenamed("at", "q"), "seed")
    return found.select("doc_id", "item_id", (F.col("at") - F.col("q")).alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_ITEM) -> DataFrame:
    """(doc_id, item_id, matched): pairs with a window of WINDOW words of which need(WINDOW) agree, and the most that do.

    An item of fewer words is one window and must occur whole: of 7 to 12 words with one substitution at most, of
    `least_item` to 6 unchanged; shorter ones never match. Texts are read twice, once for seeds and once around hits, and
    do not move unless the hits are too many to broadcast.
    """
    known = benchmark.where("item_id is not null").withColumn("n", F.size(words(F.col("text"))))
    long, short = known.where(F.col("n") >= WINDOW), known.where((F.col("n") < WINDOW) & (F.col("n") >= least_item))
    found = hits(docs, long, MASKS)
    if not short.isEmpty():
        found = found.unionByName(hits(docs, short, SHORT_MASKS)).distinct()
    found = durable(found, "hits")
    marked = found.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "shift")).alias("hits"))  # bounded by the places of one text
    if found.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    texts = docs.select("doc_id", "text").join(marked, "doc_id").select("doc_id", words(F.col("text")).alias("w"), "hits")
    items = benchmark.select(F.col("item_id").alias("i"), words(F.col("text")).alias("v"))
    pairs = texts.select("doc_id", "w", F.explode("hits").alias("hit")).select("doc_id", "w", "hit.*").join(items, F.col("item_id") == F.col("i"))
    first, start = F.greatest(-F.col("shift"), F.lit(0)), F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.size("v") - first, F.size("w") - start)
    same = F.zip_with(F.slice("v", first + 1, length), F.slice("w", start + 1, length), lambda a, b: (a == b).cast("int"))
    pairs = durable(pairs.select("doc_id", "item_id", F.size("v").alias("n"), same.alias("same")), "aligned")
    window = F.least(F.lit(WINDOW), F.col("n"))
    total = F.aggregate(F.slice("same", 1, window), F.lit(0), lambda s, x: s + x)
    step = lambda s, i: F.struct(  # noqa: E731  the sum of the window that ends at i, and the greatest so far
        (s["now"] + F.get("same", i) - F.get("same", i - window)).alias("now"),
        F.greatest(s["most"], s["now"] + F.get("same", i) - F.get("same", i - window)).alias("most"),
    )
    rest = F.when(F.size("same") > window, F.sequence(window, F.size("same") - 1)).otherwise(F.array().cast("array<int>"))
    most = F.aggregate(rest, F.struct(total.alias("now"), total.alias("most")), step, lambda s: s["most"])
    found = pairs.where(F.size("same") >= window).select("doc_id", "item_id", "n", most.alias("matched"))
    found = found.where(F.col("matched") >= need(F.least(F.col("n"), F.lit(WINDOW))))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending), matched (most agreeing words of a window, 0 if none) for every row.

    Null and short texts are clean; rows that repeat a doc_id share what any of them holds; an empty benchmark leaves all
    rows clean.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("long"))).alias("item_ids"), F.max("matched").cast("long").alias("matched"))
    out = docs.select("doc_id").join(found.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d"), "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that share no window with the benchmark; all columns stay."""
    return less(docs, overlaps(docs, benchmark).select("doc_id").distinct())


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n_doc, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
bw AS (SELECT item_id, len(v) AS n_item, unnest(v) AS word, generate_subscripts(v, 1) AS q FROM b),
hit AS (SELECT doc_id, item_id, n_doc, n_item, p - q AS shift, q FROM dw JOIN bw USING (word) WHERE n_item >= 3),
few AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS c FROM hit),
run AS (SELECT doc_id, item_id, n_item, least(13, n_item) AS win,
  least(n_item, n_doc - shift) - greatest(0, -shift) AS both_have,
  count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS same
  FROM few WHERE c >= least(13, n_item) - least(13, n_item) * 2 // 13),
found AS (SELECT doc_id, item_id, max(least(same, win)) AS matched FROM run
  WHERE both_have >= win AND same >= win - win * 2 // 13 GROUP BY ALL),
per AS (SELECT doc_id, list_sort(list(CAST(item_id AS BIGINT))) AS item_ids, max(matched) AS matched FROM found GROUP BY doc_id)
SELECT documents.doc_id, per.item_ids IS NOT NULL AS contaminated, coalesce(per.item_ids, CAST([] AS BIGINT[])) AS item_ids,
  CAST(coalesce(per.matched, 0) AS BIGINT) AS matched
FROM documents LEFT JOIN per ON documents.doc_id = per.doc_id
"""

"""Proportional stratified interleaving (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import buckets_for, global_rank

SHARDS, SEED = 24, "mix-1"


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Every document with its shard and gapless slot; shards differ by at most one row and each follows the mixture.

    Rows are ranked within their source by a seeded hash of doc_id, then all rows are ordered by fractional rank
    (2 rank + 1) / (2 rows of the source), ties by source and doc_id, and cut into equal runs. Both orders are ranked over
    equal slices of their range, whose counts alone are summed up: no source meets in one task. A null source is a source
    of its own; null texts have size 8 and the checksum of no bytes; repeated rows take places of their own.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("mixed", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    total = docs.select(F.lit(1)).count()
    slices = buckets_for(docs.sparkSession, total)
    point = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("slice", F.shiftright(point * F.lit(slices), 32))
    ranked = global_rank(rows, "slice", [F.col("mixed"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "rank", ("source", "unnamed"))
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("source").isNull().alias("u")).agg(F.count(F.lit(1)).alias("n_source"))
    ranked = ranked.join(sizes, (F.col("source") == F.col("s")) & (F.col("unnamed") == F.col("u"))).withColumn("share", (2 * F.col("rank") + 1) / (2 * F.col("n_source")))
    ranked = ranked.withColumn("slice", F.floor(F.col("share") * F.lit(slices)))
    order = [F.col("share"), F.col("unnamed"), F.col("source"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("rank")]
    placed = global_rank(ranked, "slice", order, "position")
    number = F.floor(F.col("position") * F.lit(shards) / F.lit(max(1, total)))
    first = F.ceil(number * F.lit(total) / F.lit(shards))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.cast("int").alias("shard"),
        (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.when(~F.col("unnamed"), F.col("source")).alias("source"),
    )


SQL = """
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS u, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, tbl),
r AS (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY mixed, doc_id, text_crc32, size) - 1 AS k, count(*) OVER (PARTITION BY s, u) AS n FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * k + 1) / (2 * n), u, s, doc_id, text_crc32, size, k) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 24 // total AS INTEGER) AS shard, CAST(pos - ((pos * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""

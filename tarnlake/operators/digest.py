"""Content digests that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """md5 of all rows' texts in order, and the count: for tables that fit one task."""
    rows = df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("r"))
    return rows.agg(F.md5(F.array_join(F.sort_array(F.collect_list("r")), "\n")).alias("digest"), F.count(F.lit(1)).alias("n"))


def scalable_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, and xor and sum of 60 bits of each row's md5: partial aggregates only, for tables of any size."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))

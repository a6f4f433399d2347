"""Shared plumbing of the corpus operators: tables, durable intermediates, components, offsets."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Broadcasts by this package happen only below this many rows of at most 32 bytes (about 64 MB).
BROADCAST_ROWS = 2_000_000


#: Rows of an Arrow batch at most: texts and sets can be long, and a batch is held whole by Spark and by Python.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow or mapInPandas, giving back to the system what its buffers took once its task ends: workers
    outlive their tasks, and what they keep counts against the executor."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir; where that is unset, a local temporary folder on a local master only."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tarnlake-checkpoints")
    return f"{base.rstrip('/')}/tarnlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application left below its workspace; call it when no result is read any more."""
    _delete(spark, os.path.dirname(workspace(spark, "none")))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Rows of an intermediate's file at least, where their number is about known: small tables don't become many tiny files.
FILE_ROWS = 10_000


def durable(df: DataFrame, label: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of executors.

    rows: about how many there are; tasks are merged down to FILE_ROWS rows each, never split.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // FILE_ROWS)))
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnlake_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what durable() wrote, once nothing reads it any more."""
    path = getattr(df, "_tarnlake_path", None)
    if path:
        _delete(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def less(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not in the one column of `ids`; all columns stay, whatever their names."""
    gone = fresh(docs, "gone")
    return docs.join(ids.toDF(gone), F.col("doc_id") == F.col(gone), "left_anti")


def small_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint behind a count; larger frames keep the shuffle join that Spark picks."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def buckets_for(spark: SparkSession, rows: int, per_bucket: int = 20_000, least: int = 100) -> int:
    """Buckets of about so many rows, and one for each shuffle partition if that leaves them `least` rows."""
    return max(1, -(-rows // per_bucket), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // least))


def global_rank(df: DataFrame, bucket: str, order: list[Column], out: str, within: tuple[str, ...] = ()) -> DataFrame:
    """0-based rank over (bucket, order), for each combination of `within`.

    Buckets must ascend with the order. Only bucket counts meet in one task; the rows of a group are ranked bucket by
    bucket, so a group that holds a third of all rows is spread over as many tasks as it has buckets.
    """
    keys = [*within, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = ranked.join(offsets, match)
    return joined.withColumn(out, F.col("__rn") - 1 + F.col("__offset")).drop("__rn", "__offset", *[f"__k{i}" for i in range(len(keys))])


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long), component being the smallest node reachable.

    Alternating large-star and small-star until the edges no longer change. Minima are map-side combined before each
    shuffle and joined back, so that a node with very many neighbours is an ordinary skewed join for Spark to split.
    Empty edges give an empty result.
    """
    current = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large, label, mark[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = durable(small, label, mark[0])
        discard(large)
        discard(current)
        before, mark, current = mark, _mark(after), after
        if before == mark:
            break
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)

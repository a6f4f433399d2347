"""The lake: raw files per key, curated year partitions, derived tables; a log of what was fetched; views over all of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.sources.schema import Contract

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ZONES = ("raw", "curated", "derived", "meta")
#: Rows of a Parquet row group at most.
ROW_GROUP = 256 * 1024
LOG = "dataset string, key string, n_rows long, path string, fetched_at timestamp"


def checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


class Lake:
    """Paths below one root; every write goes through Spark's committer, so readers see whole files only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, zone: str, name: str) -> str:
        if zone not in ZONES:
            raise ValueError(f"unknown zone {zone}")
        return f"{self.root}/{zone}/{checked(name)}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def names(self, path: str) -> list[str]:
        """What lies directly below a folder, less hidden files; nothing if there is no such folder."""
        fs, target = self._fs(path)
        if not fs.exists(target):
            return []
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(target)) if n[0] not in "._")

    def write_raw(self, dataset: str, key: str, df: DataFrame) -> int:
        """One folder per fetch key; nothing is written for an empty frame; the oldest former copy is kept as <key>.prev.

        The frame is evaluated once: it is written beside its place, counted there, and moved in.
        """
        path = f"{self.path('raw', dataset)}/{re.sub('[^A-Za-z0-9_.-]', '_', key)}"
        fs, target = self._fs(path)
        _, former = self._fs(f"{self.path('raw', dataset)}.prev/{target.getName()}")
        _, fresh = self._fs(f"{self.path('raw', dataset)}.new/{target.getName()}")
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", str(ROW_GROUP)).parquet(fresh.toString())
        n = self.spark.read.parquet(fresh.toString()).count()
        if not n:
            fs.delete(fresh, True)
            return 0
        if fs.exists(target):
            if fs.exists(former):
                fs.delete(target, True)
            else:
                fs.mkdirs(former.getParent())
                fs.rename(target, former)
        fs.mkdirs(target.getParent())
        fs.rename(fresh, target)
        self.log(dataset, key, n, path)
        return n

    def log(self, dataset: str, key: str, n_rows: int, path: str) -> None:
        row = self.spark.range(1).select(F.lit(dataset).alias("dataset"), F.lit(key).alias("key"), F.lit(n_rows).cast("long").alias("n_rows"), F.lit(path).alias("path"), F.current_timestamp().alias("fetched_at"))
        row.write.mode("append").parquet(self.path("meta", "fetch_log"))

    def fetched(self) -> DataFrame:
        """The latest entry of each (dataset, key) of the append-only log."""
        if not self.exists(self.path("meta", "fetch_log")):
            return self.spark.createDataFrame([], LOG)
        log = self.spark.read.schema(LOG).parquet(self.path("meta", "fetch_log"))
        w = Window.partitionBy("dataset", "key").orderBy(F.desc("fetched_at"), F.desc("n_rows"))
        return log.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    def due_keys(self, dataset: str, keys: DataFrame, refetch: int = 0, force: bool = False) -> DataFrame:
        """Keys not fetched yet, and the last `refetch` ones; all of them if forced."""
        if force:
            return keys
        pending = keys.join(self.fetched().where(F.col("dataset") == dataset).select("key"), "key", "left_anti")
        return pending.unionByName(keys.orderBy(F.desc("key")).limit(refetch)).distinct() if refetch else pending

    def orphans(self) -> DataFrame:
        """Logged keys with rows whose files are gone: the log against one listing of each dataset's folder."""
        there = [(d, n) for d in self.names(f"{self.root}/raw") if _NAME.match(d) for n in self.names(self.path("raw", d))]
        files = self.spark.createDataFrame(there, "dataset string, __file string")
        log = self.fetched().where("n_rows > 0").withColumn("__file", F.element_at(F.split("path", "/"), -1))
        return log.join(files, ["dataset", "__file"], "left_anti").drop("__file")

    def raw(self, dataset: str, schema=None) -> DataFrame:
        """All keys of a dataset, columns united by name; with the file each row came from."""
        reader = self.spark.read.option("recursiveFileLookup", "true")
        reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
        return reader.parquet(self.path("raw", dataset)).withColumn("__file", F.col("_metadata.file_path"))

    def compact(self, dataset: str, contract: Contract, year_of: str, defaults: dict | None = None) -> DataFrame:
        """Raw to curated: key defaults filled, exact repeats and all but the last file's row of each key dropped, the contract
        checked, rows sorted within year partitions. Returns the manifest: year, n_rows; it is also kept with the counts of
        raw and dropped rows as the table manifest of the meta zone."""
        rows = self.raw(dataset)
        if defaults:
            rows = rows.fillna(defaults)
        names = rows.columns
        rest = [F.col(c).cast("string").desc_nulls_last() for c in contract.columns if c in names and c not in contract.key]
        w = Window.partitionBy(*contract.key).orderBy(F.desc("__file"), *rest)
        best = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__file")
        out = contract.normalize(best).withColumn("year", F.substring(year_of, 1, 4))
        self.write_partitioned("curated", dataset, out, list(contract.key))
        written = self.spark.read.parquet(self.path("curated", dataset))
        contract.validate(contract.normalize(written.drop("year")))
        kept = written.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))
        totals = self.raw(dataset).agg(F.count(F.lit(1)).alias("n_raw")).join(kept.agg(F.sum("n_rows").alias("n_kept")), F.lit(True))  # a row each
        manifest = totals.select(F.lit(dataset).alias("dataset"), "n_raw", "n_kept", (F.col("n_raw") - F.col("n_kept")).alias("n_dropped"), F.current_timestamp().alias("at"))
        manifest.write.mode("append").parquet(self.path("meta", "manifest"))
        return kept

    def write_partitioned(self, zone: str, name: str, df: DataFrame, sort: list[str]) -> None:
        """One run of files per year; only the years at hand are replaced. A year is spread over tasks by its key."""
        df.repartition("year", *sort).sortWithinPartitions("year", *sort).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").option("parquet.block.row.count.limit", str(ROW_GROUP)).partitionBy("year").parquet(self.path(zone, name))

    def read(self, zone: str, name: str, start: str | None = None, end: str | None = None, day: str = "trade_date", codes: list[str] | None = None, code: str = "ts_code") -> DataFrame:
        """Range scan: the year partitions are pruned, the day and the codes reach the file scan."""
        df = self.spark.read.parquet(self.path(zone, name))
        if start:
            df = df.where(F.col(day) >= start)
        if end:
            df = df.where(F.col(day) <= end)
        if "year" in df.columns:
            if start:
                df = df.where(F.col("year") >= int(start[:4]))
            if end:
                df = df.where(F.col("year") <= int(end[:4]))
        return df.where(F.col(code).isin(codes)) if codes else df

    def register(self) -> list[str]:
        """Views <zone>_<name> over every table that has files; nothing for absent ones."""
        names = []
        for zone in ZONES:
            fs, target = self._fs(f"{self.root}/{zone}")
            if not fs.exists(target):
                continue
            for status in fs.listStatus(target):
                name = status.getPath().getName()
                if status.isDirectory() and _NAME.match(name):
                    df = self.raw(name).drop("__file") if zone == "raw" else self.spark.read.option("mergeSchema", "true").parquet(self.path(zone, name))
                    df.createOrReplaceTempView(f"{zone}_{name}")
                    names.append(f"{zone}_{name}")
        return sorted(names)

    def sql(self, text: str, *args) -> DataFrame:
        """A query with ? parameters over the registered views."""
        return self.spark.sql(text, args=list(args))


def sweep_keys(spark: SparkSession, kind: str, start: str | None = None, end: str | None = None, values: list[str] | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Keys of a source sweep: single, enum (values), dates, weekdays, sessions (of a frame with column d), periods (quarter
    ends), or windows of months or years times values."""
    from tarnlake.functions.dates import days_between

    if kind == "single":
        return spark.createDataFrame([("all",)], "key string")
    if kind == "enum":
        return spark.createDataFrame([(v,) for v in values or []], "key string")
    if kind == "sessions":
        return sessions.where(F.col("d").between(start, end)).select(F.col("d").alias("key")).distinct()
    if kind in ("dates", "weekdays", "periods"):
        how = {"dates": "days", "weekdays": "weekdays", "periods": "quarter_ends"}[kind]
        return days_between(spark, start, end, how).withColumnRenamed("d", "key")
    if kind in ("months", "years"):
        windows = days_between(spark, start, end).select(F.substring("d", 1, 6 if kind == "months" else 4).alias("m")).distinct()
        if not values:
            return windows.withColumnRenamed("m", "key")
        return windows.withColumn("v", F.explode(F.array(*[F.lit(v) for v in values]))).select(F.concat_ws("_", "m", "v").alias("key"))
    raise ValueError(f"unknown sweep {kind}")


def values_from(lake: Lake, dataset: str, column: str, where: str = "true") -> list[str]:
    """The distinct values of a curated column, in order: what an enum sweep runs over."""
    rows = lake.spark.read.parquet(lake.path("curated", dataset)).where(where).select(F.col(checked(column)).cast("string").alias("v")).where("v is not null").distinct()
    return [r["v"] for r in rows.orderBy("v").collect()]

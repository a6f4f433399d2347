"""Upkeep of a lake: dataset facts, inventories, named tables, views of attempts, logs rebuilt from files, audits, a cache."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.windows import keep_first
from tarnlake.sources.lake import ZONES, Lake, checked
from tarnlake.sources.schema import Contract


def dataset_meta(lake: Lake, specs: dict[str, Contract]) -> DataFrame:
    """(dataset, columns, text, key): a row a dataset, lists as JSON text; also kept as meta.dataset_meta."""
    rows = [(name, *[json.dumps(list(x)) for x in (c.columns, c.text, c.key)]) for name, c in sorted(specs.items())]
    df = lake.spark.createDataFrame(rows, "dataset string, columns string, text string, key string")
    return write_table(lake, "meta", "dataset_meta", df)


def inventory(lake: Lake) -> DataFrame:
    """(zone, name, n_files, bytes, modified) of all Parquet files below the zones; only names and facts of files are read."""
    found = None
    for zone in ZONES:
        if lake.names(f"{lake.root}/{zone}"):
            files = lake.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{lake.root}/{zone}").select("path", "length", "modificationTime")
            part = files.select(F.lit(zone).alias("zone"), F.regexp_extract("path", f"/{zone}/([^/]+)/", 1).alias("name"), "length", "modificationTime")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return lake.spark.createDataFrame([], "zone string, name string, n_files long, bytes long, modified timestamp")
    return found.groupBy("zone", "name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def inventory_text(rows: DataFrame) -> str:
    """The inventory as a Markdown table, a line a dataset."""
    lines = [f"| {r.zone} | {r.name} | {r.n_files} | {r.modified:%Y-%m-%d %H:%M} |" for r in rows.orderBy("zone", "name").collect()]
    return "\n".join(["| zone | dataset | files | last change |", "|---|---|---|---|", *lines])


def write_table(lake: Lake, zone: str, name: str, df: DataFrame) -> DataFrame:
    """A whole named table of the derived or meta zone, replaced at once: written beside its place, then moved in."""
    if zone not in ("derived", "meta"):
        raise ValueError(f"no named tables in zone {zone}")
    path = lake.path(zone, name)
    fs, target = lake._fs(path)
    _, fresh = lake._fs(f"{lake.root}/{zone}/.new-{checked(name)}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(fresh.toString())
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    fs.rename(fresh, target)
    return lake.spark.read.parquet(path)


def read_table(lake: Lake, zone: str, name: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A materialised table with a fixed schema and columns; folder names add none."""
    return lake.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(lake.path(zone, name)).select(*(columns or ["*"]))


def document_views(lake: Lake, manifest: str = "documents") -> list[str]:
    """Views document_attempts (all attempts) and documents (the last of each doc_id); dropped where there is no manifest."""
    catalog = lake.spark.catalog
    if not lake.names(lake.path("meta", manifest)):
        for name in ("document_attempts", "documents"):
            catalog.dropTempView(name)
        return []
    attempts = lake.spark.read.option("mergeSchema", "true").parquet(lake.path("meta", manifest))
    attempts.createOrReplaceTempView("document_attempts")
    keep_first(attempts, ["doc_id"], [F.desc("downloaded_at")]).createOrReplaceTempView("documents")
    return ["document_attempts", "documents"]


def footer_rows(lake: Lake, dataset: str) -> DataFrame:
    """(dataset, key, n_rows, path) of each raw key, from its files; Parquet answers counts from the footers."""
    rows = lake.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(lake.path("raw", dataset))
    key = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(dataset).alias("dataset"), "key", "n_rows", F.concat(F.lit(f"{lake.path('raw', dataset)}/"), "key").alias("path"))


def rebuild_log(lake: Lake, datasets: list[str]) -> DataFrame:
    """Adds raw keys that the log does not know, then saves it sorted, a row a key; returns it."""
    for dataset in datasets:
        if lake.names(lake.path("raw", dataset)):
            fresh = footer_rows(lake, dataset).join(lake.fetched().select("dataset", "key"), ["dataset", "key"], "left_anti")
            fresh.withColumn("fetched_at", F.current_timestamp()).write.mode("append").parquet(lake.path("meta", "fetch_log"))
    return save_log(lake, lake.fetched())


def save_log(lake: Lake, log: DataFrame) -> DataFrame:
    return write_table(lake, "meta", "fetch_log", log.orderBy("dataset", "key"))


def remove_orphans(lake: Lake) -> DataFrame:
    """Drops logged keys with rows whose files are gone, and notes them in meta.removed; returns them."""
    noted, batch = lake.path("meta", "removed"), uuid.uuid4().hex
    found = lake.orphans().select(F.lit(batch).alias("batch"), "dataset", "key", "n_rows", F.current_timestamp().alias("removed_at"))
    found.write.mode("append").parquet(noted)
    gone = lake.spark.read.parquet(noted).where(F.col("batch") == batch).select("dataset", "key", "n_rows")
    save_log(lake, lake.fetched().join(gone.select("dataset", "key"), ["dataset", "key"], "left_anti"))
    return gone


def rewrites(lake: Lake, dataset: str) -> DataFrame:
    """(key, previous_rows, current_rows) of raw keys that were written again, current NULL if gone; then the former copies go."""
    former = f"{lake.path('raw', dataset)}.prev"
    if not lake.names(former):
        return lake.spark.createDataFrame([], "key string, previous_rows long, current_rows long")
    key = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("key")
    count = lambda path, name: lake.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(former, "previous_rows").join(count(lake.path("raw", dataset), "current_rows"), "key", "left")
    out = write_table(lake, "meta", f"rewrites_{checked(dataset)}", both)
    fs, target = lake._fs(former)
    fs.delete(target, True)
    return out


EVENTS = "run_id string, at timestamp, dataset string, key string, status string, n_rows long, message string"


class RunLog:
    """Append-only events of runs; a run's state is its last event without a dataset."""

    def __init__(self, lake: Lake):
        self.lake = lake

    def _append(self, *row) -> None:
        df = self.lake.spark.createDataFrame([row], "run_id string, dataset string, key string, status string, n_rows long, message string")
        df.withColumn("at", F.current_timestamp()).select(*[c.split()[0] for c in EVENTS.split(", ")]).write.mode("append").parquet(self.lake.path("meta", "run_log"))

    def open(self, kind: str) -> str:
        run_id = uuid.uuid4().hex[:12]
        self._append(run_id, None, kind, "running", 0, "")
        return run_id

    def event(self, run_id: str, dataset: str, key: str, status: str, n_rows: int = 0, message: str = "") -> None:
        self._append(run_id, dataset, key, status, n_rows, message)

    def close(self, run_id: str, status: str, message: str = "") -> None:
        self._append(run_id, None, "", status, 0, message)

    def events(self) -> DataFrame:
        return self.lake.spark.read.schema(EVENTS).parquet(self.lake.path("meta", "run_log"))

    def runs(self) -> DataFrame:
        """(run_id, kind, started_at, status, message, finished_at): finished_at is NULL while a run goes on."""
        heads = self.events().where("dataset is null")
        last = F.max(F.struct("at", "status", "message"))
        out = heads.groupBy("run_id").agg(F.min_by("key", "at").alias("kind"), F.min("at").alias("started_at"), last.alias("x"))
        return out.select("run_id", "kind", "started_at", "x.status", "x.message", F.when(F.col("x.status") != "running", F.col("x.at")).alias("finished_at"))


def register_frame(df: DataFrame, name: str) -> str:
    """A frame as a temporary view under a plain name."""
    df.createOrReplaceTempView(checked(name))
    return name


def views(lake: Lake) -> list[str]:
    return sorted(t.name for t in lake.spark.catalog.listTables() if t.isTemporary)


class PanelCache:
    """Results kept by key within a budget of bytes, the least recently used given up first. Sizes are Spark's own estimates;
    a result over the budget alone is not kept."""

    def __init__(self, most_bytes: int = 2 << 30):
        self.most, self.entries = most_bytes, OrderedDict()
        self.hits = self.misses = 0

    @property
    def size(self) -> int:
        return sum(n for _, n in self.entries.values())

    def get(self, key: Hashable, build: Callable[[], DataFrame]) -> DataFrame:
        if key in self.entries:
            self.hits += 1
            self.entries.move_to_end(key)
            return self.entries[key][0]
        self.misses += 1
        df = build()
        n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if n <= self.most:
            while self.entries and self.size + n > self.most:
                self.entries.popitem(last=False)[1][0].unpersist()
            self.entries[key] = (df.persist(StorageLevel.MEMORY_AND_DISK), n)
        return df

    def clear(self) -> None:
        for df, _ in self.entries.values():
            df.unpersist()
        self.entries.clear()

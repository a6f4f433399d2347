"""Feeds of vendors as a Spark data source: a partition a key, over a client that is named and not built in.

A client is any callable (api, params) -> list of rows (dicts); it is named `module:attribute`, so that executors import it.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnlake.operators.steps import Blocked
from tarnlake.sources.lake import Lake
from tarnlake.sources.upkeep import RunLog


class RateLimited(Exception):
    """The vendor asks to wait."""


def paged(call: Callable[[int, int], list[dict]], size: int) -> list[dict]:
    """All rows of a query by offsets. A page shorter than asked ends it, unless its length is a multiple of 100, as some vendors
    cap pages below what is asked; a page that begins like the one before shows that the offset is ignored."""
    rows: list[dict] = []
    before = None
    while True:
        page = call(len(rows), size)
        if not page:
            return rows
        if before is not None and page[0] == before:
            raise ValueError("the source ignores the offset")
        before = page[0]
        rows += page
        if len(page) < size and len(page) % 100:
            return rows


class Pacer:
    """Calls at least `interval` seconds apart, tried again `retries` times; a rate limit waits for `cooldown` first. Refused access
    is not tried again."""

    def __init__(self, interval: float, retries: int = 3, cooldown: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.retries, self.cooldown, self.clock, self.sleep = interval, retries, cooldown, clock, sleep
        self.last: float | None = None

    def run(self, call: Callable[[], object]) -> object:
        for attempt in range(self.retries + 1):
            if self.last is not None and (rest := self.last + self.interval - self.clock()) > 0:
                self.sleep(rest)
            self.last = self.clock()
            try:
                return call()
            except Blocked:
                raise
            except RateLimited:
                if attempt == self.retries:
                    raise
                self.sleep(self.cooldown)
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
        raise AssertionError


def split_queries(count: Callable[[date, date, str | None], int], first: date, last: date, plates: tuple[str, ...], most: int = 3000) -> list[tuple[date, date, str | None]]:
    """Ranges (first, last, plate) that each find at most `most` rows, by halving dates, then days by plate (which stay whole)."""
    if count(first, last, None) <= most:
        return [(first, last, None)]
    if first == last:
        return [(first, last, p) for p in plates] or [(first, last, None)]
    middle = first + timedelta(days=(last - first).days // 2)
    return split_queries(count, first, middle, plates, most) + split_queries(count, middle + timedelta(days=1), last, plates, most)


def client_of(name: str) -> Callable[[str, dict], list[dict]]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class SweepSource(DataSource):
    """spark.read.format("sweep"): options client, api, keys (JSON list of {key, params}), page (0: one call), interval."""

    @classmethod
    def name(cls) -> str:
        return "sweep"

    def schema(self) -> str:
        raise ValueError("a sweep needs a schema: read.schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return SweepReader(dict(self.options), schema.names)


class SweepReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(json.dumps(k)) for k in json.loads(self.options["keys"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        entry = json.loads(partition.value)
        client, api, page = client_of(self.options["client"]), self.options.get("api", ""), int(self.options.get("page", "0"))
        pacer = Pacer(float(self.options.get("interval", "0")))
        params = entry.get("params", {})
        if page:
            rows = paged(lambda offset, size: pacer.run(lambda: client(api, params | {"offset": offset, "limit": size})), page)
        else:
            rows = pacer.run(lambda: client(api, params))
        for row in rows:
            yield tuple(entry["key"] if n == "sweep_key" else row.get(n) for n in self.names)


def read_sweep(spark: SparkSession, client: str, api: str, schema: str, keys: list[tuple[str, dict]], page: int = 0, interval: float = 0.0) -> DataFrame:
    """Rows of every key, with sweep_key; as many tasks as keys, so coalesce(1) keeps one caller where the vendor asks for it."""
    spark.dataSource.register(SweepSource)
    listed = json.dumps([{"key": k, "params": p} for k, p in keys])
    return spark.read.format("sweep").schema(f"sweep_key string, {schema}").options(client=client, api=api, keys=listed, page=str(page), interval=str(interval)).load()


def run_sweep(lake: Lake, log: RunLog, dataset: str, fetch: Callable[[str], DataFrame], keys: DataFrame, refetch: int = 0, force: bool = False, recent: int = 3) -> dict[str, int]:
    """Fetches every due key into the raw zone and notes it; rows by key. An empty key is noted as done, unless it is one of the
    `recent` last ones, which may fill yet. Refused access ends the run as blocked, an error as failed; what was fetched stays."""
    every = [r["key"] for r in keys.orderBy("key").collect()]  # a row a day or window
    due = [r["key"] for r in lake.due_keys(dataset, keys, refetch, force).orderBy("key").collect()]
    run_id, out = log.open(dataset), {}
    try:
        for key in due:
            n = lake.write_raw(dataset, key, fetch(key))
            if not n and key not in every[-recent:]:
                lake.log(dataset, key, 0, "")
            log.event(run_id, dataset, key, "fetched" if n else "empty", n)
            out[key] = n
        log.close(run_id, "ok")
    except Exception as why:
        status = "blocked" if isinstance(why, Blocked) or "Blocked" in str(why) else "failed"
        log.close(run_id, status, str(why)[:500])
        if status == "failed":
            raise
    return out


def compact_day(text: Column) -> Column:
    """YYYY-MM-DD (with or without a time) as YYYYMMDD; other texts stay."""
    day = F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    return F.when(day != "", F.regexp_replace(day, "-", "")).otherwise(text)


def lossless_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns become numbers where every text is one that reads back as it was (blanks and trailing zeros aside)."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")

    def lost(c: str) -> Column:
        number = F.col(c).try_cast("double")
        leading = F.trim(F.col(c)).rlike(r"^-?0\d")
        return F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & (number.isNull() | leading | (F.length(F.regexp_replace(plain(F.col(c)), r"[-.]", "")) > 15)))

    bad = df.agg(*[lost(c).alias(c) for c in columns]).first()
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in columns and not bad[c] else F.col(c) for c in df.columns])


DOWNLOADS = "doc_id string, status string, sha256 string, n_bytes long, content binary, message string"


def downloads(candidates: DataFrame, client: Callable[[str], bytes], magic: bytes = b"%PDF", batch: int = 200) -> DataFrame:
    """(doc_id, url) -> an attempt each: ok with content and its SHA-256, or failed and why (also content without the magic bytes).

    Rows are written by the caller as they come, `batch` at a time a task, so a lost executor costs its own batches only.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DOWNLOADS.split(", ")]
        for f in frames:
            for at in range(0, len(f), batch):
                rows = []
                for doc, url in f[["doc_id", "url"]].iloc[at : at + batch].itertuples(index=False):
                    try:
                        data = client(url)
                        good = data.startswith(magic)
                        rows.append((doc, "ok" if good else "failed", hashlib.sha256(data).hexdigest() if good else None, len(data), data if good else None, "" if good else "magic bytes"))
                    except (OSError, ValueError) as why:
                        rows.append((doc, "failed", None, None, None, str(why)))
                yield pd.DataFrame(rows, columns=names)

    return candidates.select(F.col("doc_id").cast("string").alias("doc_id"), "url").mapInPandas(fetch, DOWNLOADS).withColumn("downloaded_at", F.current_timestamp())

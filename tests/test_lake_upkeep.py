"""Upkeep of the lake and feeds, against what is written on purpose."""

import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import steps
from tarnlake.sources import feeds, upkeep
from tarnlake.sources.lake import Lake, sweep_keys, values_from
from tarnlake.sources.schema import Contract, ContractError

BARS = Contract(("ts_code", "trade_date", "close"), ("ts_code", "trade_date"), ("ts_code", "trade_date"))


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}")


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), "ts_code string, trade_date string, close double")


def test_meta_inventory_and_tables(spark, lake):
    meta = upkeep.dataset_meta(lake, {"bars": BARS})
    assert meta.first().columns == '["ts_code", "trade_date", "close"]'
    lake.write_raw("bars", "k1", bars(spark, ("A", "20240102", 1.0)))
    found = {(r.zone, r.name): r.n_files for r in upkeep.inventory(lake).collect()}
    assert found["raw", "bars"] >= 1 and ("meta", "dataset_meta") in found
    assert "| raw | bars |" in upkeep.inventory_text(upkeep.inventory(lake))
    first = upkeep.write_table(lake, "derived", "t", spark.range(3))
    assert first.count() == 3 and upkeep.write_table(lake, "derived", "t", spark.range(5)).count() == 5
    assert upkeep.read_table(lake, "derived", "t", "id long, extra string").where("extra is null").count() == 5
    with pytest.raises(ValueError):
        upkeep.write_table(lake, "derived", "../t", spark.range(1))
    with pytest.raises(ValueError):
        upkeep.write_table(lake, "raw", "t", spark.range(1))


def test_log_rebuilt_orphans_and_rewrites(spark, lake):
    lake.write_raw("bars", "k1", bars(spark, ("A", "20240102", 1.0)))
    lake.write_raw("bars", "k2", bars(spark, ("A", "20240103", 1.0), ("B", "20240103", 2.0)))
    bars(spark, ("C", "20240104", 3.0)).write.parquet(f"{lake.path('raw', 'bars')}/k3")  # not logged
    log = {r.key: r.n_rows for r in upkeep.rebuild_log(lake, ["bars"]).collect()}
    assert log == {"k1": 1, "k2": 2, "k3": 1}
    lake.write_raw("bars", "k1", bars(spark, ("A", "20240102", 1.0), ("B", "20240102", 1.0)))
    lake.write_raw("bars", "k1", bars(spark, ("A", "20240102", 7.0)))  # the oldest former copy stays
    assert [(r.key, r.previous_rows, r.current_rows) for r in upkeep.rewrites(lake, "bars").collect()] == [("k1", 1, 1)]
    assert upkeep.rewrites(lake, "bars").count() == 0
    fs, target = lake._fs(f"{lake.path('raw', 'bars')}/k2")
    fs.delete(target, True)
    assert [(r.dataset, r.key, r.n_rows) for r in upkeep.remove_orphans(lake).collect()] == [("bars", "k2", 2)]
    assert {r.key for r in lake.fetched().collect()} == {"k1", "k3"} and upkeep.remove_orphans(lake).count() == 0


def test_compaction_checks_its_contract(spark, lake):
    lake.write_raw("bars", "a", bars(spark, ("A", "20231229", 1.0), ("A", "20231229", 1.0)))
    lake.write_raw("bars", "b", bars(spark, ("A", "20231229", 2.0), ("B", "20240102", 3.0)))
    assert {(str(r.year), r.n_rows) for r in lake.compact("bars", BARS, "trade_date").collect()} == {("2023", 1), ("2024", 1)}
    row = spark.read.parquet(lake.path("meta", "manifest")).first()
    assert (row.dataset, row.n_raw, row.n_kept, row.n_dropped) == ("bars", 4, 2, 2)
    lake.write_raw("bars", "c", spark.createDataFrame([(None, "20240105", 1.0)], "ts_code string, trade_date string, close double"))
    with pytest.raises(ContractError):
        lake.compact("bars", BARS, "trade_date")


def test_documents_run_log_views_and_cache(spark, lake):
    attempts = spark.createDataFrame([("d1", "2024-01-01", "failed"), ("d1", "2024-01-02", "ok"), ("d2", "2024-01-01", "ok")], "doc_id string, downloaded_at string, status string")
    assert upkeep.document_views(lake) == []
    attempts.write.parquet(lake.path("meta", "documents"))
    upkeep.document_views(lake)
    assert {(r.doc_id, r.status) for r in spark.table("documents").collect()} == {("d1", "ok"), ("d2", "ok")} and spark.table("document_attempts").count() == 3
    log = upkeep.RunLog(lake)
    run = log.open("sweep")
    log.event(run, "bars", "k", "fetched", 3)
    assert [(r.status, r.finished_at) for r in log.runs().collect()] == [("running", None)]
    log.close(run, "ok")
    assert [(r.kind, r.status, r.finished_at is not None) for r in log.runs().collect()] == [("sweep", "ok", True)] and log.events().count() == 3
    assert upkeep.register_frame(attempts, "frame_1") in upkeep.views(lake)
    with pytest.raises(ValueError):
        upkeep.register_frame(attempts, "a b")
    cache = upkeep.PanelCache(most_bytes=2 * 8 * 100 + 10)
    build = lambda n: lambda: spark.range(n)
    a = cache.get("a", build(100))
    assert cache.get("a", build(100)) is a and (cache.hits, cache.misses) == (1, 1)
    cache.get("b", build(100))
    cache.get("a", build(100))
    cache.get("c", build(100))  # b was used longest ago
    assert list(cache.entries) == ["a", "c"] and cache.size <= cache.most
    cache.get("huge", build(10_000))
    assert "huge" not in cache.entries
    cache.clear()


def test_sweeps(spark, lake):
    keys = lambda *a, **k: sorted(r.key for r in sweep_keys(spark, *a, **k).collect())
    assert keys("years", "2023-12-30", "2024-01-02", ["x", "y"]) == ["2023_x", "2023_y", "2024_x", "2024_y"]
    days = spark.createDataFrame([("20240102",), ("20240105",)], "d string")
    assert keys("sessions", "20240101", "20240104", sessions=days) == ["20240102"]
    read = feeds.read_sweep(spark, "tests.fake_vendor:query", "bars", "ts_code string, trade_date string, close string", [("A", {"code": "A"}), ("B", {"code": "B"})], page=250)
    assert {(r.sweep_key, r.n) for r in read.groupBy("sweep_key").agg(F.count("*").alias("n")).collect()} == {("A", 248), ("B", 248)}
    tidy = feeds.lossless_numbers(read.distinct().withColumn("trade_date", feeds.compact_day(F.col("trade_date"))), ["ts_code", "close"])
    row = tidy.orderBy("ts_code", "trade_date").first()
    assert (row.ts_code, row.trade_date, row.close) == ("A", "20240101", 10.0)
    log = upkeep.RunLog(lake)
    fetch = lambda key: feeds.read_sweep(spark, "tests.fake_vendor:query", "bars", "ts_code string, trade_date string, close string", [(key, {"n": 0 if key >= "20240103" or key == "20240101" else 2})])
    four = spark.createDataFrame([(f"2024010{d}",) for d in range(1, 6)], "key string")
    assert feeds.run_sweep(lake, log, "bars", fetch, four) == {"20240101": 0, "20240102": 2, "20240103": 0, "20240104": 0, "20240105": 0}
    assert sorted(r.key for r in lake.due_keys("bars", four).collect()) == ["20240103", "20240104", "20240105"]  # recent and empty: still due
    blocked = lambda key: feeds.read_sweep(spark, "tests.fake_vendor:query", "closed", "ts_code string", [(key, {})])
    feeds.run_sweep(lake, log, "closed", blocked, four)
    assert {r.status for r in log.runs().collect()} == {"ok", "blocked"}
    lake.write_raw("codes", "all", spark.createDataFrame([("B", "20240102", 1.0), ("A", "20240102", 2.0)], "ts_code string, trade_date string, close double"))
    lake.compact("codes", BARS, "trade_date")
    assert values_from(lake, "codes", "ts_code") == ["A", "B"] and values_from(lake, "codes", "ts_code", "close > 1") == ["A"]


def test_pages_paces_and_splits():
    from tests import fake_vendor

    rows = [{"i": i} for i in range(250)]
    assert feeds.paged(lambda o, n: rows[o : o + n], 100) == rows and len(feeds.paged(lambda o, n: rows[o : o + min(n, 100)], 120)) == 250
    with pytest.raises(ValueError):
        feeds.paged(lambda o, n: fake_vendor.stuck("", {"limit": n}), 100)
    slept, now, calls = [], [0.0], []

    def call():
        calls.append(now[0])
        if len(calls) == 1:
            raise feeds.RateLimited
        if len(calls) == 2:
            raise OSError("reset")
        return "done"

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert feeds.Pacer(2.0, 3, 60.0, lambda: now[0], sleep).run(call) == "done" and slept == [60.0, 2.0]
    with pytest.raises(steps.Blocked):
        feeds.Pacer(0.0).run(lambda: (_ for _ in ()).throw(steps.Blocked("no")))
    count = lambda a, b, p: 1000 * ((b - a).days + 1) + (9000 if a <= date(2024, 1, 5) <= b else 0)
    parts = feeds.split_queries(count, date(2024, 1, 1), date(2024, 1, 9), ("x", "y"))
    assert (date(2024, 1, 5), date(2024, 1, 5), "x") in parts and sorted({d for a, b, _ in parts for d in (a, b)})[0] == date(2024, 1, 1)
    assert all(p is not None or count(a, b, p) <= 3000 for a, b, p in parts)


def test_downloads(spark):
    rows = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "gone")], "doc_id string, url string")

    def client(url):
        if url == "gone":
            raise OSError("404")
        return b"%PDF-1" if url == "good" else b"<html>"

    got = {r.doc_id: (r.status, r.sha256, r.message) for r in feeds.downloads(rows, client).collect()}
    assert got == {"1": ("ok", hashlib.sha256(b"%PDF-1").hexdigest(), ""), "2": ("failed", None, "magic bytes"), "3": ("failed", None, "404")}


def test_calls_are_paid_once(spark, tmp_path):
    paid = tmp_path / "paid"
    paid.mkdir()

    def client(payload):
        import uuid

        (paid / uuid.uuid4().hex).write_text(payload)
        return f"reply to {payload}", 10, 5

    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, payload string").repartition(3)
    cache = spark.createDataFrame([("b",)], "p string").select(F.sha2("p", 256).alias("key"), F.lit("known").alias("reply"))
    answers, new = steps.cached_calls(requests, cache, client, str(tmp_path), 0.5, 2.0)
    assert {r.id: r.reply for r in answers.collect()} == {1: "reply to a", 2: "known", 3: "reply to a", 4: "reply to c"}
    assert [r.cost for r in new.collect()] == [15.0, 15.0] and answers.count() == 4
    assert sorted(p.read_text() for p in paid.iterdir()) == ["a", "c"]

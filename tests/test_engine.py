"""Operators and lake on small frames, and every registered query against its SQL."""

import glob
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake import catalog
from tarnlake.functions import dates, finance, statistics, text
from tarnlake.operators import cross_section as X
from tarnlake.operators import digest, graph, windows
from tarnlake.operators.asof import asof_join
from tarnlake.sources.lake import Lake, sweep_keys
from tarnlake.sources.schema import Contract, ContractError
from tarnlake.streaming import incremental

TABLES = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.8g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    frame = catalog.queries()[name](spark, TABLES)
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    columns = want.columns
    assert sorted(columns) == names
    assert got == sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, forward, strict):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(10)])) for i in range(40)]
    right = [(rng.choice("abc"), rng.choice([None, *range(10)]), rng.choice([None, i])) for i in range(30)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame([(*r, i) for i, r in enumerate(right)], "k string, u int, v int, o int")
    got = {r.id: r.v for r in asof_join(a, b, ["k"], "t", "u", ["v"], forward=forward, strict=strict, ties=["o"]).collect()}
    for i, k, t in left:
        hits = [(u, o, v) for o, (kk, u, v) in enumerate(right) if kk == k and u is not None and t is not None and (u != t or not strict) and (u >= t if forward else u <= t)]
        assert got[i] == ((min(hits) if forward else max(hits))[2] if hits else None)
    inner = asof_join(a, b, ["k"], "t", "u", ["v"], forward=forward, strict=strict, inner=True, ties=["o"])
    assert inner.count() <= 40


def test_ranks_and_nulls(spark):
    rows = spark.createDataFrame([("d", x) for x in (3.0, 1.0, 3.0, None, 2.0)], "d string, v double")
    got = rows.select("v", X.average_rank("v", ["d"]).alias("r"), X.percent_rank("v", ["d"]).alias("p")).collect()
    assert {(r.v, r.r, r.p) for r in got} == {(3.0, 3.5, 0.875), (1.0, 1.0, 0.25), (None, None, None), (2.0, 2.0, 0.5)}


def test_neutralise_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    g, x, y = rng.integers(0, 3, 40), rng.standard_normal(40), rng.standard_normal(40)
    frame = spark.createDataFrame([(1, i, str(g[i]), float(x[i]), float(y[i])) for i in range(40)], "d int, i int, g string, x double, y double")
    got = [r.r for r in X.neutralise(frame, "y", "x", "g", ["d"], "r").orderBy("i").collect()]
    a = np.column_stack([g == k for k in range(3)] + [x]).astype(float)
    assert np.allclose(got, y - a @ np.linalg.lstsq(a, y, rcond=None)[0])
    assert all(r.r is None for r in X.neutralise(frame.limit(9), "y", "x", "g", ["d"], "r").collect())


def test_fifo_equals_a_queue(spark):
    rng = random.Random(2)
    rows = [("k", i, float(rng.choice([0, 5, 10])), float(rng.choice([0, 3, 20]))) for i in range(30)]
    debts, queue = {}, []
    for _, i, bought, repaid in rows:
        debts[i] = bought
        queue.append(i)
        while repaid > 0 and queue:
            paid = min(repaid, debts[queue[0]])
            debts[queue[0]] -= paid
            repaid -= paid
            if debts[queue[0]] == 0:
                queue.pop(0)
    got = windows.fifo_debts(spark.createDataFrame(rows, "k string, i int, b double, r double"), ["k"], "i", "b", "r", "debt").collect()
    assert {r.i: r.debt for r in got} == pytest.approx(debts)


def test_running_best_ignores_old_restatements(spark):
    rows = spark.createDataFrame([("c", 1, 10, "a"), ("c", 2, 20, "b"), ("c", 3, 10, "old"), ("c", 4, 20, "new")], "k string, t int, period int, v string")
    got = windows.running_best(rows, ["k"], "t", ["period", "t"], "v", "state").orderBy("t").collect()
    assert [r.state for r in got] == ["a", "b", "b", "new"]


def test_contract(spark):
    contract = Contract(("code", "day", "x"), ("code", "day"), ("code", "day"))
    frame = spark.createDataFrame([("a", "20240101", float("nan"))], "code string, day string, x double")
    assert contract.validate(contract.normalize(frame)).first().x is None
    assert contract.normalize(frame.drop("x")).columns == ["code", "day", "x"]
    with pytest.raises(ContractError):
        contract.normalize(frame.withColumn("extra", F.lit(1)))
    with pytest.raises(ContractError):
        contract.validate(contract.normalize(frame.union(frame)))
    with pytest.raises(ContractError):
        contract.validate(frame.select("day", "code", "x"))


def test_lake_round_trip(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}")
    contract = Contract(("ts_code", "trade_date", "close"), ("ts_code", "trade_date"), ("ts_code", "trade_date"))
    make = lambda *rows: spark.createDataFrame(list(rows), "ts_code string, trade_date string, close double")
    lake.write_raw("bars", "20231229", make(("A", "20231229", 1.0), ("B", "20231229", 2.0)))
    lake.write_raw("bars", "20240102", make(("A", "20240102", 3.0), ("A", "20231229", 1.5)))
    assert lake.write_raw("bars", "20240103", make(("A", "x", 0.0)).limit(0)) == 0
    keys = spark.createDataFrame([("20231229",), ("20240102",), ("20240103",)], "key string")
    assert [r.key for r in lake.due_keys("bars", keys).collect()] == ["20240103"]
    assert lake.due_keys("bars", keys, refetch=2).count() == 2 and lake.due_keys("bars", keys, force=True).count() == 3
    assert {(int(r.year), r.n_rows) for r in lake.compact("bars", contract, "trade_date").collect()} == {(2023, 2), (2024, 1)}
    rows = lake.read("curated", "bars", "20230101", "20231231").orderBy("ts_code").collect()
    assert [r.close for r in rows] == [1.5, 2.0]
    assert {"raw_bars", "curated_bars", "meta_fetch_log"} <= set(lake.register())
    assert lake.sql("SELECT close FROM curated_bars WHERE trade_date = ?", "20240102").first().close == 3.0
    assert lake.orphans().count() == 0
    with pytest.raises(ValueError):
        lake.path("derived", "../x")


def test_sweeps(spark):
    keys = lambda *a, **k: sorted(r.key for r in sweep_keys(spark, *a, **k).collect())
    assert keys("periods", "2024-01-01", "2024-12-31") == ["20240331", "20240630", "20240930", "20241231"]
    assert keys("weekdays", "2024-01-05", "2024-01-08") == ["20240105", "20240108"]
    assert keys("months", "2024-01-30", "2024-02-02", values=["a", "b"]) == ["202401_a", "202401_b", "202402_a", "202402_b"]
    assert keys("enum", values=["L", "D"]) == ["D", "L"] and keys("single") == ["all"]


def test_codes_and_days(spark):
    rows = spark.createDataFrame([(c,) for c in ("600000", "sz000001", "830001.bj", "SH.600001", "abc", None, "500000")], "c string")
    assert [r[0] for r in rows.select(dates.canonical_code(F.col("c"))).collect()] == ["600000.SH", "000001.SZ", "830001.BJ", "600001.SH", None, None, None]
    days = spark.createDataFrame([("20240229",), ("20230229",), ("2024-1-1",), (None,)], "d string")
    assert [r[0] for r in days.select(dates.valid_day(F.col("d"))).collect()] == [True, False, False, False]


def test_black76_round_trip(spark):
    rows = spark.createDataFrame([(3.0, 2.9, 0.3, 0.02, 0.25, True), (3.0, 3.4, 0.3, 0.02, 0.4, False)], "f double, k double, t double, r double, v double, c boolean")
    priced = rows.withColumn("p", finance.black76_price("f", "k", "t", "r", "v", "c"))
    assert all(abs(r.v - r.x) < 1e-6 for r in priced.withColumn("x", finance.implied_vol("p", "f", "k", "t", "r", "c")).collect())
    assert priced.select(finance.implied_vol(F.lit(99.0), "f", "k", "t", "r", "c").alias("x")).first().x is None


def test_statistics():
    assert statistics.student_p(2.0, 10) == pytest.approx(0.0733880348, abs=1e-8)
    assert statistics.student_p(0.0, 5) == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(80), 3 + rng.standard_normal(80)])
    at, stat = statistics.sup_f_break(x)
    assert abs(at - 80) < 6 and stat > 8.68
    low, high, p = statistics.bootstrap_interval(x, 5.0)
    assert low < x.mean() < high and p < 0.05
    t, p = statistics.hac_t(rng.standard_normal(300))
    assert abs(t) < 4 and 0 < p <= 1
    found = statistics.directional_test(x, x + 0.1 * rng.standard_normal(160))
    s, p = found["pt_1992"], found["p_1992"]
    assert s > 3 and p < 0.01
    assert (np.diff(statistics.romano_wolf(np.array([5.0, 1.0, 0.1]), rng.standard_normal((500, 3)))) >= 0).all()


def test_text_operators(spark):
    pages = spark.createDataFrame([("d", 1, "Company Report 1\nChapter one\nabc def"), ("d", 2, "Company Report 2\nmore"), ("d", 3, "Company Report 3\nChapter two")], "doc string, page int, text string")
    assert {r.page: r.text for r in text.without_headers(pages).collect()} == {1: "Chapter one\nabc def", 2: "more", 3: "Chapter two"}
    assert {(r.section, r.first, r.last) for r in text.sections(pages, [("one", "Chapter one"), ("two", "Chapter two")]).collect()} == {("one", 1, 2), ("two", 3, 3)}
    quotes = spark.createDataFrame([("d", 1, "ab cdef", 3), ("d", 2, "Report", 2), ("d", 3, "absent", 1)], "doc string, quote_id int, quote string, claimed int")
    assert {r.quote_id: r.page for r in text.quote_page(pages, quotes).collect()} == {1: 1, 2: 2, 3: None}


def test_graph_and_digest(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    assert {(r.src, r.dst, r.hops) for r in graph.reachable(edges, 3).where("src = 1").collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 3)}
    assert {r.node: r.distance for r in graph.walk(edges, spark.createDataFrame([(3,)], "node long"), 2, 5).collect()} == {3: 0, 4: 1, 5: 2, 2: -1, 1: -2}
    assert digest.scalable_digest(edges, ["src", "dst"]).first() == digest.scalable_digest(edges.orderBy(F.desc("src")).repartition(3), ["src", "dst"]).first()


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{TABLES}/events.parquet").select("event_id", "ts", "event_type", "value", "user_id")
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(raw)
    schema = spark.read.parquet(raw).schema
    incremental.compact_stream(spark, raw, schema, out, f"{tmp_path}/ck", ["user_id"], "ts").awaitTermination()
    want = {r.user_id: r.ts for r in spark.read.parquet(raw).groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.user_id: r.ts for r in incremental.latest(spark, out, ["user_id"], "ts").collect()} == want
    stream = incremental.windowed_counts(spark.readStream.schema(schema).parquet(raw)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.sql("SELECT sum(n) AS n FROM counts").first().n == spark.read.parquet(raw).count()
    assert incremental.sessions(spark.read.parquet(raw)).agg(F.sum("n")).first()[0] == spark.read.parquet(raw).count()


@pytest.mark.parametrize("broken", [False, True])
def test_works_without_the_corpus_operators(tmp_path, broken):
    """On a copy that lacks them, and on one where they cannot be imported."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(f"{root}/tarnlake", copy / "tarnlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", copy)
    if broken:
        (copy / "tarnlake" / "llm").mkdir()
        (copy / "tarnlake" / "llm" / "__init__.py").write_text("raise ImportError('a library is missing')")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not [q for q in [*e.queries(), *e.oracle_sql()] if q == 'pipeline' or q[:2] == 'op' and q[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(copy)})

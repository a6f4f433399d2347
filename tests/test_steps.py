"""Steps, factors, cached calls and evidence filters."""

from pyspark.sql import functions as F

from tarnlake.operators import steps


def test_runner():
    def fail():
        raise ValueError("bad")

    def refuse():
        raise steps.Blocked("no permission")

    report = steps.run_steps([("a", lambda: 3), ("b", refuse), ("c", fail), ("d", lambda: None)])
    assert report.lines == [("a", "done", "3"), ("b", "blocked", "no permission"), ("c", "failed", "bad")] and not report.ok
    assert steps.run_steps([("a", fail)], dry=True).lines == [("a", "planned", "")]


def test_factors(spark):
    @steps.factor("double_close")
    def build(panel):
        return panel.select("trade_date", "ts_code", (2 * F.col("close")).alias("value_raw"))

    panel = spark.createDataFrame([("20240101", "A", 1.0), ("20240102", "A", None), ("20240103", "A", 3.0)], "trade_date string, ts_code string, close double")
    got = steps.factor_panel(panel, ["double_close"], "20240101", "20240102").collect()
    assert [(r.trade_date, r.factor, r.value_raw) for r in got] == [("20240101", "double_close", 2.0)]


def test_cached_calls(spark, tmp_path):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, payload string")
    cache = requests.where("id = 2").select(F.sha2("payload", 256).alias("key"), F.lit("known").alias("reply"))
    answers, new = steps.cached_calls(requests.where("payload is not null"), cache, lambda p: f"reply to {p}", str(tmp_path))
    assert {r.id: r.reply for r in answers.collect()} == {1: "reply to a", 2: "known", 3: "reply to a"}
    assert new.count() == 1


def test_evidence(spark):
    rows = spark.createDataFrame([("one two three", [("x", "two  three"), ("x", "four"), ("y", "one")])], "text string, items array<struct<kind:string,quote:string>>")
    assert [i.quote for i in steps.evidence_only(rows, "items", "quote", "text", ["x"], "kind").first()["items"]] == ["two  three"]

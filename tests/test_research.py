"""Statistics, volatility index, campaign and panels against plain loops and worked examples."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import reports as R
from tarnlake.functions import statistics as S
from tarnlake.functions.finance import black76, erf
from tarnlake.operators import cross_section as X
from tarnlake.operators import evaluation as E
from tarnlake.operators import pit as P
from tarnlake.operators import volatility as V


def plain_variance(x, horizon=1):
    n, mean = len(x), sum(x) / len(x)
    e = [v - mean for v in x]
    rho = min(sum(a * b for a, b in zip(e[1:], e[:-1], strict=True)) / sum(a * a for a in e[:-1]), 0.97)
    u = [e[i] - rho * e[i - 1] for i in range(1, n)]
    m = sum(u) / len(u)
    u = [v - m for v in u]
    lag = max(horizon - 1, math.floor(4 * (len(u) / 100) ** (2 / 9)))
    total = sum(v * v for v in u) / len(u)
    for k in range(1, lag + 1):
        total += 2 * (1 - k / (lag + 1)) * sum(u[i] * u[i - k] for i in range(k, len(u))) / len(u)
    return max(total, 0) / (1 - rho) ** 2


def test_long_run_variance_and_break():
    rng = np.random.default_rng(3)
    for n in (25, 60, 140):
        x = np.cumsum(rng.standard_normal(n)) * 0.1 + rng.standard_normal(n)
        assert math.isclose(S.long_run_variance(x, 3), plain_variance(x.tolist(), 3), rel_tol=1e-9)
        best = max(range(int(0.15 * n), int(0.85 * n) + 1), key=lambda k: (lambda a, b: (b.mean() - a.mean()) ** 2 / (plain_variance([*(a - a.mean()), *(b - b.mean())]) * (1 / len(a) + 1 / len(b))))(x[:k], x[k:]))
        assert S.sup_f_break(x)[0] == best
    down = -np.arange(30.0) % 3
    assert S.long_run_variance(down) > 0 and S.hac_mean(np.ones(30))[2:] == (math.inf, 0.0)
    step = np.r_[rng.standard_normal(40) * 0.1, 1 + rng.standard_normal(40) * 0.1]
    at, stat = S.sup_f_break(step)
    assert at == 40 and stat > S.BREAK_CRITICAL and math.isnan(S.sup_f_break(np.ones(10))[1])


def test_bootstrap_and_family():
    rows = S.block_indices(50, 20, 30, 7)
    rng, want = np.random.default_rng(7), []
    while len(want) < 50:  # the draws of the first row: a start, then a length
        start, length = int(rng.integers(50)), int(rng.geometric(1 / 20))
        want += [(start + k) % 50 for k in range(min(length, 50 - len(want)))]
    assert rows.shape == (30, 50) and rows[0].tolist() == want and S.block_length(5) == 20 and S.block_length(60) == 60
    x = np.random.default_rng(1).standard_normal(40) + 0.4
    low, high, p = S.bootstrap_interval(x, 20, 200)
    draws = [x[r].mean() for r in S.block_indices(40, 20, 200, 7)]
    assert low < x.mean() < high and p == np.mean([abs(d - x.mean()) >= abs(x.mean()) for d in draws])
    boot = np.random.default_rng(2).standard_normal((400, 3))
    t = np.array([0.5, -3.0, 1.5])
    got = S.romano_wolf(t, boot)
    a = (np.abs(boot).max(1) >= 3.0).mean()
    b = max(a, (np.abs(boot[:, [0, 2]]).max(1) >= 1.5).mean())
    assert np.allclose(got, [max(b, (np.abs(boot[:, 0]) >= 0.5).mean()), a, b])


def test_directional_and_decay():
    rng = np.random.default_rng(5)
    f = rng.standard_normal(400)
    r = S.directional_test(f, f + rng.standard_normal(400))
    assert r["pt_1992"] > 5 and r["p_2009"] < 1e-4 and r["hit_rate"] > 0.6
    r = S.directional_test(f, rng.standard_normal(400))
    assert abs(r["pt_1992"]) < 3.5 and 0 <= r["p_1992"] <= 1
    d = S.decay_profile({1: 0.02, 5: 0.04, 20: 0.04 * 0.5, 60: 0.04 * 0.5 ** (55 / 15)})
    assert d["peak_horizon"] == 5 and math.isclose(d["half_life"], 15, rel_tol=1e-9) and math.isclose(d["r2"], 1) and math.isclose(d["accumulation_ratio"], 0.5 ** (40 / 15))
    assert S.decay_profile({1: -0.01, 5: -0.03})["rising"] == 1.0
    x = np.linspace(-6, 6, 4001)
    assert np.abs(erf(x) - [math.erf(v) for v in x]).max() < 1e-15


def test_ladder_counts_and_adjusted_p(spark):
    rows = [("d", i, float(i), i / 100) for i in range(50)]
    frame = spark.createDataFrame(rows, "d string, code int, f double, r double")
    got = {r.quantile: (r["count"], round(r.mean_return, 9)) for r in X.quantile_ladder(frame, "f", "r", ["d"], 5).collect()}
    assert got[0] == (20, 0.4) and sum(n for q, (n, _) in got.items() if q) == 50
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    out = {r.p: (r.holm, r.bh, r.bhy) for r in X.step_up(X.step_up(X.step_down(p, "p", "holm"), "p", "bh"), "p", "bhy", dependent=True).collect()}
    c = 25 / 12
    want = {0.01: (0.03, 0.02, 0.02 * c), 0.04: (0.06, 0.04, 0.04 * c), 0.03: (0.06, 0.04, 0.04 * c), 0.005: (0.02, 0.02, 0.02 * c)}
    assert all(np.allclose(out[k], v) for k, v in want.items())


def test_return_statistics(spark):
    rows = [("flat", i, 0.01) for i in range(10)] + [("swing", 0, 0.2), ("swing", 1, -0.25)] + [("rand", i, x) for i, x in enumerate(np.random.default_rng(6).standard_normal(40) * 0.02)]
    out = {r.k: r for r in E.return_statistics(spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "k string, d int, r double"), ["k"], "d", "r", 244.0).collect()}
    assert math.isclose(out["flat"].ann_return, 2.44) and out["flat"].max_drawdown == 0 and out["flat"].sharpe is None and out["flat"].kurtosis == 3
    assert math.isclose(out["swing"].max_drawdown, -0.25)
    x = np.array([c for k, _, c in rows if k == "rand"])
    z = (x - x.mean()) / x.std()
    assert math.isclose(out["rand"].skew, (z**3).mean(), rel_tol=1e-6) and math.isclose(out["rand"].kurtosis, (z**4).mean(), rel_tol=1e-6)
    assert math.isclose(out["rand"].sharpe, x.mean() / x.std(ddof=1) * math.sqrt(244), rel_tol=1e-9)


def test_campaign_tests_and_family(spark):
    rng = np.random.default_rng(8)
    rows = [(date(2020, 1, 1) + timedelta(days=i), f, h, float(rng.normal(m, 0.1)), 50) for i in range(60) for f, m in (("good", 0.08), ("none", 0.0)) for h in (1, 5)]
    ic = spark.createDataFrame(rows, "trade_date date, factor string, horizon int, ic double, n long")
    tests = E.series_tests(ic, {"half": ("2020-01-01", "2020-01-30")}, draws=99).collect()
    by = {(r.factor, r.horizon, r.metric, r.window): r for r in tests}
    x = np.array([r[3] for r in rows if r[1:3] == ("good", 5)])
    mean, se, t, p = S.hac_mean(x, 5)
    full = by["good", 5, "ic_mean", "full"]
    assert np.allclose((full.value, full.se, full.t, full.p), (mean, se, t, p)) and by["good", 5, "ic_mean", "half"].value == pytest.approx(x[:30].mean())
    assert by["good", 5, "fisher_z", "full"].value == pytest.approx(S.stouffer_z(x, np.full(60, 50.0))[0])
    family = {(r.factor, r.horizon): r for r in E.family(E.series_tests(ic, draws=99), ic, draws=99).collect()}
    ps = sorted(r.p for r in family.values())
    assert len(family) == 4 and family["good", 1].hurdle == 1.0 and family["none", 1].p_romano_wolf > 0.05 > family["good", 1].p_romano_wolf
    assert min(r.p_holm for r in family.values()) == pytest.approx(min(1, 4 * ps[0]))


def test_trials_are_numbered_once(spark):
    schema = "campaign string, trial_id string, factor string, params string, horizon int, sr double, ic_mean double"
    params = E.canonical_params({"b": 1, "a": 2})
    assert params == E.canonical_params({"a": 2, "b": 1})
    found = spark.createDataFrame([("f", params, 1, None, 0.1), ("f", params, 5, 1.0, 0.2), ("f", params, 5, 1.0, 0.2)], "factor string, params string, horizon int, sr double, ic_mean double")
    log = spark.createDataFrame([], schema)
    first = E.add_trials(log, found, "c")
    assert [(r.trial_id, r.horizon) for r in first.orderBy("trial_id").collect()] == [("c-00001", 1), ("c-00002", 5)]
    more = found.unionByName(found.where("horizon = 1").withColumn("horizon", F.lit(20)))
    assert [(r.trial_id, r.horizon) for r in E.add_trials(first, more, "c").collect()] == [("c-00003", 20)]


def chain_rows(sigma=0.2):
    rows, forward, rate = [], 3.04, 0.018
    for day, terms in ((date(2026, 1, 5), (26, 61)), (date(2026, 1, 6), (25,)), (date(2026, 1, 7), (24, 59))):
        for days in terms:
            t = days / 365
            for i in range(71):
                k = round(1.5 + 0.05 * i, 2)
                for side in "CP":
                    price = float(black76(np.array([forward]), np.array([k]), np.array([t]), np.array([math.log(1 + rate * days / 360) / t]), np.array([sigma]), np.array([side == "C"]))[0])
                    rows.append((day, day + timedelta(days=days), days, k, side, price if price > 1e-9 else 0.0, None, 5.0 if price > 1e-6 else 0.0, 10.0))
    return rows


CHAIN = "trade_date date, expiry date, days int, strike double, side string, close double, settle double, vol double, oi double"


def test_volatility_index_of_a_flat_chain(spark):
    rate = F.expr("ln(1 + 0.018 * days / 360) * 365 / days")
    chain = spark.createDataFrame(chain_rows(), CHAIN)
    out = {r.trade_date.day: r for r in V.index(chain, rate).collect()}
    assert abs(out[5].vix - 20) < 0.3 and abs(out[7].vix - 20) < 0.3 and out[5].quality_flag == "ok" and out[5].k0_near == 3.0
    assert out[6].vix is None and out[6].quality_flag.startswith("failed:")
    sessions = F.when(F.col("days") > 40, 42.0).otherwise(18.0)
    traded = {r.trade_date.day: r.vix for r in V.index(chain, rate, sessions, 21.0, 244.0).collect()}
    assert traded[6] is None and abs(traded[5] - 20) < 1.5
    rows = V.exposures(chain, rate, 10_000.0).collect()
    assert rows and all(abs(r.iv - 0.2) < 1e-4 for r in rows if 2.6 < r.strike < 3.5)
    r = next(r for r in rows if r.strike == 3.0 and r.side == "C" and r.days == 26)
    d1 = (math.log(r.fwd / 3.0) + 0.5 * r.iv**2 * r.t) / (r.iv * math.sqrt(r.t))
    gamma = math.exp(-r.rate * r.t) * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) / (r.fwd * r.iv * math.sqrt(r.t))
    assert math.isclose(r.gex, gamma * 10.0 * 10_000.0 * r.fwd**2 * 0.01, rel_tol=1e-9)
    levels = spark.createDataFrame([(date(2026, 1, 5), x, x - 2.5) for x in (2.0, 3.0, 4.0)] + [(date(2026, 1, 6), x, 1.0) for x in (2.0, 3.0)], "trade_date date, level double, gex double")
    assert [(r.trade_date.day, r.flip) for r in V.flips(levels).collect()] == [(5, 2.5)]


def test_point_in_time_states(spark):
    days = [date(2026, 3, 1) + timedelta(days=i) for i in range(90)]
    sessions = spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "s date")
    rows = [("A", 20254, date(2026, 3, 20), 0, 1.0), ("A", 20254, date(2026, 4, 10), 1, 2.0), ("A", 20253, date(2026, 4, 15), 1, 9.0), ("A", 20261, date(2026, 4, 24), 0, 3.0)]
    versions = spark.createDataFrame([(c, "np", p, k, f, v) for c, p, k, f, v in rows], "code string, field string, period long, known_on date, flag int, value double")
    states = P.states(versions, sessions, "s")
    got = sorted((r.effective, r.value, r.period) for r in states.collect())
    assert got == [(date(2026, 3, 23), 1.0, 20254), (date(2026, 4, 13), 2.0, 20254), (date(2026, 4, 16), 2.0, 20254), (date(2026, 4, 27), 3.0, 20261)]
    seen = P.panel(states, sessions.where("s between date'2026-04-23' and date'2026-04-28'"), "s")
    assert [(r.trade_date.day, r.value) for r in seen.orderBy("trade_date").collect()] == [(23, 2.0), (24, 2.0), (27, 3.0), (28, 3.0)]


def test_report_pages(spark):
    toc = "1 Summary ....... 3\n2 Customers ..... 5\n3 Risks ........ 9"
    pages = [toc, "Cover", "Summary\ntext text", "Customers\n1 | Alpha Works | 1,200.00 | 12.00% |\n2 | Beta | 600 | 6.00 |\n3 | Gamma | 450 | 9.99% |", "Risks", "end"]
    frame = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(pages)], "doc long, page int, text string")
    bounds = R.bounded(frame, R.headings(frame, {"summary": "Summary", "customers": "Customers", "risks": "Risks"}))
    assert {(r.section, r.first, r["last"]) for r in bounds.collect()} == {("summary", 3, 3), ("customers", 4, 4), ("risks", 5, 6)}
    share = R.chapter_share(frame, bounds, "customers").first()
    assert share.n_pages == 6 and math.isclose(share.share, len(pages[3]) / sum(map(len, pages)))
    found = {r["rank"]: (r.name, r.amount, r.pct, r.consistent) for r in R.partner_rows(frame, unit=10_000.0).collect()}
    assert found == {1: ("Alpha Works", 12e6, 12.0, True), 2: ("Beta", 6e6, 6.0, True), 3: ("Gamma", 4.5e6, 9.99, False)}
    note = ["start here\nplain\nrevenue grew\nwhy 1\nwhy 2\nother", "Other matters\n not applicable \nreal text", "more END tail", "after"]
    frame = spark.createDataFrame([(7, i + 1, t) for i, t in enumerate(note)], "doc long, page int, text string")
    kept = R.note_pages(frame, "start", "END", "Other matters", "revenue", 2)
    assert [(r.page, r.kept) for r in kept.orderBy("page").collect()] == [(1, "revenue grew\nwhy 1\nwhy 2"), (2, note[1]), (3, "more ")]
    assert R.note_chars(kept, "Other matters", "not applicable").first().chars == len("realtextmore")


def test_hot_groups_are_dealt_in_blocks(spark, monkeypatch):
    from tarnlake.operators import graph

    monkeypatch.setattr(graph, "GROUP_BLOCK", 4)
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), rng.randrange(15)) for _ in range(120)]
    frame = spark.createDataFrame(rows, "g string, m int")
    got = {(r.a, r.b): r.n for r in graph.pairs_within(frame, ["g"], "m", "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    want = {}
    for g, a in rows:
        for h, b in rows:
            if g == h and a < b:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    tree = spark.createDataFrame([(i // 2, i) for i in range(1, 40)], "src long, dst long")
    paths = {(r.src, r.dst) for r in graph.closure(tree).collect()}
    up = {i: i // 2 for i in range(1, 40)}
    for i in range(1, 40):
        j, above = i, set()
        while j in up and up[j] != j:
            j = up[j]
            above.add(j)
        assert {a for a, b in paths if b == i} == above

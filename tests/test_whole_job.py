"""Registered queries on tables built so that a cut of rows would show, against brute force or SQL over whole tables."""

import datetime
import math
import random

from tarnlake import catalog


def saved(spark, folder, **tables):
    """Folder with each (rows, schema) written as a table."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, folder):
    return catalog.queries()[name](spark, folder)


def best_name(wanted, names, least=0.45):
    """(name_id, score) by plain loops."""
    grams = lambda x: {x[i : i + 2] for i in range(max(len(x) - 1, 1))}
    a, best = "".join(wanted.split()).lower(), None
    for key, name in names:
        b = "".join(name.split()).lower()
        g, h = grams(a), grams(b)
        r = min(len(a), len(b)) / max(len(a), len(b))
        dice = 2 * len(g & h) / (len(g) + len(h))
        inside = 0.55 + 0.3 * r if len(a) >= 3 and r >= 0.5 else 0.0
        score = 1.0 if a == b else 0.6 + 0.3 * r if b in a else inside if a in b else 0.6 * dice if dice >= 0.5 else 0.0
        if score >= least and (best is None or (-score, key) < (-best[1], best[0])):
            best = (key, score)
    return best


def test_matcher_finds_the_best_name(spark):
    from tarnlake.functions.text import match_names

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    names = sorted({(i, f"{word()} {word()}") for i in range(60)} | {(100, "photoresist"), (101, "photoresist reagents for chips"), (102, "ab")})
    wanted = [(i, rng.choice([word(), f"{word()} {word()}", names[i % 60][1][:-2] or "x", names[i % 60][1] + word()])) for i in range(150)] + [(900, "Photo Resist"), (901, "a"), (902, "photoresist reagents")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    got = {r.wanted_id: (r.name_id, round(r.score, 9)) for r in match_names(frame(wanted, "wanted_id"), frame(names, "name_id")).collect()}
    want = {k: best_name(text, names) for k, text in wanted}
    assert got == {k: (v[0], round(v[1], 9)) for k, v in want.items() if v} and len(got) > 60
    assert got[900] == (100, 1.0) and 902 in got
    from pyspark.sql import functions as F
    from tarnlake.functions.text import match_score

    none = spark.range(1).select(match_score(F.lit("parts"), F.lit("spare parts"), F.lit(0.9), F.lit(True)).alias("s")).first().s
    assert none == 0.0


def test_quote_evidence_looks_up_every_long_line(spark, tmp_path):
    line = lambda i: f"line {i:02d} of a document with forty characters and more"
    lines = [line(i) for i in range(9)] + ["short", line(2), "x" * 40, "y" * 39]
    folder = saved(spark, tmp_path, documents=([(1, "\n".join(lines)), (2, "short\n" * 6 + line(0)), (3, None)], "doc_id long, text string"))
    got = {(r.doc, r.quote_id): r.page for r in run(spark, "quote_evidence", folder).collect()}
    want = {}
    for doc, pages in ((1, lines), (2, ["short"] * 6 + [line(0)])):
        tight = ["".join(p.split()) for p in pages]
        for k, p in enumerate(pages):
            if len(p) >= 40:
                hits = [j for j, t in enumerate(tight) if "".join(p[4:34].split()) in t]
                want[doc, k] = k + 1 if k + 1 in hits else hits[0]
    assert got == want
    assert {k for d, k in got if d == 1} == {*range(9), 10, 11} and got[2, 6] == 6


def test_effective_dates_covers_every_order(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(days=i * 5 % 23, hours=i % 24)) for i in range(1, 30)]
    folder = saved(spark, tmp_path, orders=(rows, "o_orderkey long, o_orderdate timestamp"))
    got = {r.o_orderkey: r.effective for r in run(spark, "effective_dates", folder).collect()}
    sessions = sorted({d.date() for _, d in rows if d.weekday() < 5})
    assert got == {k: next((s for s in sessions if s > d.date()), None) for k, d in rows}
    assert len(got) == 29


def supplier_links(rows):
    return sorted({(nation, (nation * 7 + key) % 25) for key, nation, *_ in rows})


def hops(edges, most):
    """{(src, dst): least steps} by breadth-first search."""
    out = {}
    for start in {a for a, _ in edges}:
        seen, front = {start}, {start}
        for k in range(1, most + 1):
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            out |= {(start, b): k for b in front}
    return out


def test_reachability_and_walk_use_every_supplier(spark, tmp_path):
    rows = [(key, key * 11 % 25) for key in range(1, 26)]
    folder = saved(spark, tmp_path, supplier=(rows, "s_suppkey long, s_nationkey int"))
    edges = supplier_links(rows)
    assert {(r.src, r.dst): r.hops for r in run(spark, "reachability", folder).collect()} == hops(edges, 3)
    want = {3: 0}
    for sign, links in ((1, edges), (-1, sorted((b, a) for a, b in edges))):
        front = {3}
        for k in range(1, 4):
            front = {b for x in front for b in [b for a, b in links if a == x][:2]}
            for b in front:
                if b not in want or (k, -sign) < (abs(want[b]), -want[b]):
                    want[b] = sign * k
    assert {r.node: r.distance for r in run(spark, "signed_walk", folder).collect()} == want


def test_theta_match_follows_flows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(key, rng.randrange(25), rng.choice([-1, 1]) * round(100 * 1.003 ** rng.randrange(90), 2)) for key in range(1, 31)]
    rows += [(31, 3, 9000.0), (32, 3, 9001.0), (33, 5, 0.0), (34, 6, 0.0), (35, 7, None)]
    folder = saved(spark, tmp_path, supplier=(rows, "s_suppkey long, s_nationkey int, s_acctbal double"))
    reach = hops(supplier_links(rows), 3)
    some = [r for r in rows if r[2] is not None]
    pairs = [(a[0], b[0]) for a in some for b in some if a[0] != b[0] and abs(a[2] - b[2]) <= 0.005 * abs(a[2]) and (a[1], b[1]) in reach]
    want = {(s, b) for s, b in pairs if sum(x == s for x, _ in pairs) == 1 and sum(y == b for _, y in pairs) == 1}
    assert {(r.seller, r.buyer) for r in run(spark, "theta_reachability_match", folder).collect()} == want
    nation = {r[0]: r[1] for r in rows}
    assert {reach[nation[s], nation[b]] for s, b in want} & {2, 3} and (31, 32) not in want


def test_neighbours_score_every_pair_block_by_block(spark, monkeypatch):
    from tarnlake.operators import graph

    monkeypatch.setattr(graph, "VECTOR_BLOCK", 4, raising=False)
    monkeypatch.setattr(graph, "COLUMNS", 2, raising=False)
    rng = random.Random(5)
    rows = {(key, f"f{rng.randrange(9)}"): float(rng.randrange(4)) for key in range(30) for _ in range(rng.randint(1, 5))}
    rows |= {(key + 100, f): w for (key, f), w in rows.items() if key < 12}  # copies tie
    rows |= {(200, "f1"): 0.0, (201, "f2"): None, (202, "f3"): None, (202, "f4"): 3.0, (203, "alone"): 1.0, (204, None): 5.0, (None, "f1"): 2.0}
    frame = spark.createDataFrame([(*k, w) for k, w in rows.items()], "k long, f string, w double").repartition(3)
    found = graph.cosine_neighbours(frame, "k", "f", "w", 5)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.rank): (r.peer, r.score if r.score is None else round(r.score, 9)) for r in found.collect()}
    keys = {k for k, _ in rows if k is not None}
    of = {k: {f: w for (x, f), w in rows.items() if x == k} for k in keys}
    norm = {k: math.sqrt(sum((w or 0) ** 2 for w in v.values())) for k, v in of.items()}
    want = {}
    for k in keys:
        scored = []
        for p in keys - {k}:
            both = [f for f in of[k] if f is not None and f in of[p]]
            terms = [of[k][f] * of[p][f] / norm[k] / norm[p] if norm[k] and norm[p] else math.nan for f in both if of[k][f] is not None and of[p][f] is not None]
            if both:
                scored.append((round(sum(terms), 9) if terms else None, p))
        scored.sort(key=lambda x: (2 if x[0] is None else 0 if math.isnan(x[0]) else 1, -(x[0] or 0.0) if x[0] == x[0] else 0.0, x[1]))
        want |= {(k, i): (p, s) for i, (s, p) in enumerate(scored[:5], 1)}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_alias_detection_counts_every_pair_block_by_block(spark, tmp_path, monkeypatch):
    from tarnlake.operators import graph

    monkeypatch.setattr(graph, "ENTRY_BLOCK", 16, raising=False)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 40, raising=False)
    rng = random.Random(6)
    day = lambda i: None if i is None else datetime.datetime(2024, 1, 1 + i)
    rows = [(rng.randrange(25), rng.choice([0, 0, 0, *range(12), None]), rng.choice(["1-A", "2-B", None])) for _ in range(150)]
    rows += [(None, 1, "1-A"), (50, 5, "2-B"), (50, 5, "2-B"), (51, 5, "2-B"), (51, 5, None), (52, 6, None), (52, 6, None)]
    folder = saved(spark, tmp_path, orders=([(c, day(d), p) for c, d, p in rows], "o_custkey long, o_orderdate timestamp, o_orderpriority string"))
    found = run(spark, "alias_detection", folder)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    n, tops = {}, {}
    for a, d, p in rows:
        if a is not None and d is not None:
            tops[a, d] = max(tops.get((a, d)) or "", p or "") or None
        for b, e, q in rows:
            if None not in (a, b, d, p) and a < b and d == e and p == q:
                n[a, b] = n.get((a, b), 0) + 1
    want = {}
    for (a, b), k in n.items():
        if k >= 2:
            days = [d for x, d in tops if x == a and (b, d) in tops]
            equal = sum(tops[a, d] is not None and tops[a, d] == tops[b, d] for d in days)
            want[a, b] = (k, len(days), round(equal / len(days), 6), sum(x == a and v >= 2 for (x, _), v in n.items()))
    assert {(r.old_code, r.new_code): (r.n, r.shared, r.equal_rate, r.candidates) for r in found.collect()} == want and (50, 51) in want and len(want) > 50
    empty = saved(spark, tmp_path / "none", orders=([], "o_custkey long, o_orderdate timestamp, o_orderpriority string"))
    assert run(spark, "alias_detection", empty).count() == 0


def line_copies(keys, nation, years=(1998,), seed=7):
    """lineitem and supplier in which all keys have the same lines of every year, each in an order of its own."""
    rng = random.Random(seed)
    discounts = [rng.randrange(11) / 100 for _ in range(60)]
    discounts += [round(0.1 - d, 2) for d in discounts]  # 0.05 on the whole
    prices = [round(rng.uniform(900, 90_000), 2) for _ in discounts]
    lines = [(k, d, p, 20.0, 0.02, datetime.datetime(y, 6, 1)) for k in keys for y in years for d, p in rng.sample(list(zip(discounts, prices, strict=True)), len(prices))]
    return {"lineitem": (lines, "l_suppkey long, l_discount double, l_extendedprice double, l_quantity double, l_tax double, l_shipdate timestamp"), "supplier": ([(k, nation) for k in keys], "s_suppkey long, s_nationkey int")}


def test_equal_steadiness_is_ranked_by_key(spark, tmp_path):
    folder = saved(spark, tmp_path, **line_copies(range(1, 31), 0))
    got = {r.c: r.status for r in run(spark, "archetype_check", folder).collect()}
    assert got == {k: "consistent" if k <= 20 else "partial" for k in range(1, 31)}


def test_returns_at_the_threshold_count_in_any_order_of_lines(spark, tmp_path):
    keys = [32 + 65 * i for i in range(12)]  # 0.05 * 100 + 6 - 3 is 8, without a drift
    folder = saved(spark, tmp_path, **line_copies(keys, 4, range(1995, 2000)))
    assert {r.c: (r.width, r.trend_pp) for r in run(spark, "moat_width", folder).collect()} == dict.fromkeys(keys, ("narrow", 0.0))


def test_equal_peers_cast_no_votes(spark, tmp_path):
    folder = saved(spark, tmp_path, **line_copies(range(1, 31), 4))
    rows = run(spark, "pricing_power", folder).collect()
    assert len(rows) == 30 and {r.label for r in rows} == {"insufficient"} and len({r.score for r in rows}) == 1


def test_restated_figures_are_rounded_as_in_the_sql(spark, tmp_path):
    from decimal import ROUND_HALF_UP, Decimal

    def by_multiple(x):
        y = x * 1e4
        return (math.trunc(y) + (abs(y - math.trunc(y)) >= 0.5)) / 1e4

    by_digits = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    prices = [p for p in (i / 100 for i in range(100_001, 400_000)) if by_multiple(0.05 * p * 1.1) != by_digits(0.05 * p * 1.1)][:40]
    rows = [(i, 2 + 6 * i, p, "O", datetime.datetime(1999, 2, 1)) for i, p in enumerate(prices)]  # a restated first quarter
    folder = saved(spark, tmp_path, orders=(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp"))
    got = {r.code: r.np_q for r in run(spark, "company_cycle", folder).collect()}
    assert len(prices) == 40 and got == {2 + 6 * i: by_multiple(0.05 * p * 1.1) for i, p in enumerate(prices)}

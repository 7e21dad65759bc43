"""Operators whose work has no SQL, against plain forms of it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import forecasting, learning, metrics, phase, readiness, regional, visibility


def test_quantile_fit_against_plain_reweighting(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1 + x @ [2.0, -1.0] + rng.gumbel(size=400) * (1 + 0.3 * np.abs(x[:, 0]))
    fold = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(f), float(a), float(b), float(c)) for f, (a, b), c in zip(fold, x, y, strict=True)], "fold long, a double, b double, y double")
    for f, level, beta in forecasting.quantile_fits(df, "fold", ["a", "b"], "y", (0.1, 0.5, 0.9), rounds=30):
        own = fold == f
        z, t, w = np.c_[np.ones(own.sum()), x[own]], y[own], np.ones(own.sum())
        for turn in range(30):
            a = z.T @ (w[:, None] * z)
            plain = np.linalg.solve(a + 1e-6 * np.eye(3) * np.trace(a) / 3, z.T @ (w * t))
            off = t - z @ plain
            w = np.where(off >= 0, level, 1 - level) / np.maximum(np.abs(off), 1e-3)
        assert np.allclose(beta, plain, atol=1e-5)
        assert abs((off < 0).mean() - level) < 0.02


def test_walk_forward_never_learns_from_later_rows(spark):
    rows = [(d, float(d % 7), float(d % 7) * 2) for d in range(60)]
    df = lambda r: spark.createDataFrame(r, "d int, x double, y double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    ask = lambda r: {x.d: (x.fold, [round(q, 3) for q in x.quantiles]) for x in forecasting.quantile_walk_forward(df(r), "day", ["x"], "y", (0.1, 0.9), 20, 10, 3).collect()}
    one = ask(rows)
    assert {d: f for d, (f, _) in one.items()} == {d: (d - 20) // 10 for d in range(20, 50)}
    later = ask([(d, x, y if d < 40 else y + 1000) for d, x, y in rows])
    assert {d: v for d, v in one.items() if d < 40} == {d: v for d, v in later.items() if d < 40}


def test_calibration_is_chosen_on_the_guard_part(spark):
    rng = random.Random(2)
    rows = [(p, int(rng.random() < p**3)) for p in (rng.random() for _ in range(4000))]
    df = spark.createDataFrame(rows, "score double, label int").withColumn("part", F.monotonically_increasing_id() % 2)
    name, found = forecasting.choose_calibration(df.where("part = 0"), df.where("part = 1"), "score", "label")
    assert name == "isotonic" and len(found) == 3
    fair = spark.createDataFrame([(0.5, 1), (0.5, 0)] * 20, "score double, label int")
    assert forecasting.choose_calibration(fair.where("label = 1"), fair, "score", "label")[0] == "raw"


def test_reconciled_levels_add_up(spark):
    rng = np.random.default_rng(3)
    tree = {"a": "x", "b": "x", "c": "y", "d": "y", "x": "top", "y": "top", "top": None}
    past = {n: rng.normal(size=30).tolist() for n in tree}
    base = {n: sorted((rng.random(2) * 10 + (5 if p else 20)).tolist()) for n, p in tree.items()}
    df = spark.createDataFrame([(1, n, p, *base[n], past[n]) for n, p in tree.items()], "g int, node string, parent string, lo double, hi double, errors array<double>")
    got = {r.node: (r.lo_reconciled, r.hi_reconciled) for r in forecasting.reconcile_levels(df, ["g"], "node", "parent", ["lo", "hi"], "errors").collect()}
    names = list(tree)
    s = np.array([[float(leaf == n or tree[leaf] == n or n == "top") for leaf in "abcd"] for n in names])
    w = np.cov(np.array([past[n] for n in names]))
    w = 0.8 * w + 0.2 * np.diag(np.diag(w)) + 1e-6 * np.trace(w) / 7 * np.eye(7)
    p = np.linalg.inv(s.T @ np.linalg.inv(w) @ s) @ s.T @ np.linalg.inv(w)
    low = np.maximum(p @ np.array([base[n] for n in names]), 0)
    want = s @ np.maximum.accumulate(low, axis=1)
    assert np.allclose([got[n] for n in names], want, atol=1e-6)
    assert np.allclose(np.add(got["x"], got["y"]), got["top"]) and all(a <= b for a, b in got.values())


def test_greedy_match_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.random() < 0.3, rng.random() < 0.25) for k in range(12) for i in range(40)] + [(99, 0, False, False)]
    got = {r.k: r for r in readiness.greedy_match(spark.createDataFrame(rows, "k int, i int, a boolean, s boolean"), ["k"], "i", "a", "s").collect()}
    for k in got:
        own, used, leads = [r for r in rows if r[0] == k], set(), []
        for _, i, a, _ in own:
            free = [j for j in range(i, i + 5) if j < len(own) and own[j][3] and j not in used] if a else []
            if free:
                used.add(free[0])
                leads.append(free[0] - i)
        assert (got[k].hits, got[k].false_alarms, got[k].misses) == (len(leads), sum(r[2] for r in own) - len(leads), sum(r[3] for r in own) - len(leads))
        assert got[k].median_lead == (float(np.median(leads)) if leads else None)


def test_softmax_of_large_scores(spark):
    got = {r.s: r.weight for r in regional.softmax_weights(spark.createDataFrame([(1, 1000.0), (1, 999.0), (1, -2000.0)], "g int, s double"), ["g"], "s").collect()}
    assert abs(got[1000.0] - 1 / (1 + math.exp(-1))) < 1e-12 and abs(sum(got.values()) - 1) < 1e-12


def test_ward_merges_against_a_plain_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 3)) + np.repeat(rng.normal(size=(4, 3)) * 3, 6, axis=0)
    got = {r.n: r.cluster for r in learning.clusters(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "n int, a double, b double, c double"), "n", ["a", "b", "c"], 5).collect()}
    z = (x - x.mean(0)) / x.std(0)
    sets = [[i] for i in range(24)]
    spread = lambda s: ((z[s] - z[s].mean(0)) ** 2).sum()
    while len(sets) > 5:
        _, i, j = min((spread(a + b) - spread(a) - spread(b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        sets[i] += sets.pop(j)
    assert {frozenset(i for i in got if got[i] == c) for c in set(got.values())} == {frozenset(s) for s in sets}
    with pytest.raises(ValueError):
        learning.clusters(spark.range(10).withColumn("x", F.lit(1.0)), "id", ["x"], 2, most=5)


def test_backward_join_over_many_stretches(spark):
    rng = random.Random(6)
    left = [(k, i, rng.randrange(10**7)) for k in "ab" for i in range(60)]
    right = [(k, t, rng.choice([None, float(t)])) for k in "ab" for t in rng.sample(range(10**7), 25)]
    lines = spark.createDataFrame(left, "k string, i int, s long").withColumn("at", F.timestamp_seconds("s"))
    seen = spark.createDataFrame(right, "k string, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.k, r.i): r.asof_value for r in visibility.asof_backward(lines, seen, ["k"], "at", "v", ["i"], days=3).collect()}
    for k, i, t in left:
        before = [(s, v) for q, s, v in right if q == k and s <= t and v is not None]
        assert got[k, i] == (max(before)[1] if before else None)


def test_nearest_join_over_raw_rows(spark):
    rng = random.Random(7)
    left = [(rng.choice("ab"), i, rng.randrange(200)) for i in range(150)]
    right = [(rng.choice("ab"), rng.randrange(200), rng.random()) for _ in range(40)]
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    a = spark.createDataFrame(left, "k string, i int, d int").withColumn("day", day("d"))
    b = spark.createDataFrame(right, "k string, d int, v double").withColumn("day", day("d")).drop("d")
    got = {r.i: r.nearest_value for r in visibility.asof_nearest(a, b, ["k"], "day", "v", 6).collect()}
    want = {}
    for k, i, d in left:
        near = [(abs(e - d), e, v) for q, e, v in right if q == k and abs(e - d) <= 6]
        if near:
            want[i] = min(near)[2]
    assert got == want


def test_scores_ranked_in_steps(spark):
    rng = random.Random(8)
    rows = [(rng.choice("pq"), round(rng.random() * 3 - 1, rng.choice([1, 4])), int(rng.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    auc = {r.k: r.auc for r in metrics.roc_auc(df, ["k"], "s", "y").collect()}
    for k in "pq":
        pos, neg = [s for q, s, y in rows if q == k and y], [s for q, s, y in rows if q == k and not y]
        assert abs(auc[k] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12


def test_water_filling_meets_its_bounds(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.random() ** 3) for g in range(6) for i in range(9)]
    got = regional.allocate(spark.createDataFrame(rows, "g int, i int, w double"), ["g"], "i", "w", 0.03, 0.3).collect()
    for g in range(6):
        own = [(r.w, r.share) for r in got if r.g == g]
        assert abs(sum(s for _, s in own) - 1) < 1e-9 and all(0.03 - 1e-9 <= s <= 0.3 + 1e-9 for _, s in own)
        free = [s / w for w, s in own if 0.03 + 1e-9 < s < 0.3 - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_alert_states_by_hand(spark):
    values = [10, 10, 10, 10, 14, 10, 10, 25, 14, 10, 10, 10, 10]
    got = regional.alert_states(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "site string, i int, v double"), ["site"], "i", "v").orderBy("i").collect()
    assert [r.state for r in got] == ["clear"] * 4 + ["watch", "watch", "clear", "alarm", "alarm", "alarm", "watch", "watch", "clear"]


def test_trend_by_hand(spark):
    df = spark.createDataFrame([("a", str(i), float(v)) for i, v in enumerate([1, 2, 4, 7, 11, 16])], "k string, t string, v double")
    got = learning.trend_forecast(df, ["k"], "t", "v", 3).orderBy("step").collect()
    scale = max(float(np.std([1, 2, 3, 4, 5])), 1.0)
    for r in got:
        assert abs(r.forecast - (16 + 3.5 * r.step)) < 1e-9 and abs(r.high - r.forecast - 1.2816 * scale * math.sqrt(r.step)) < 1e-9


def test_small_bins_join_the_nearer_neighbour(spark):
    bins = spark.createDataFrame([(1, 50, 0.1, 0.1), (2, 3, 0.2, 1.0), (3, 40, 0.6, 0.5), (4, 2, 0.9, 1.0)], "bin long, n long, p double, y double")
    got = sorted((r.n, round(r.p, 6), round(r.y, 6)) for r in metrics.merge_small_bins(bins, 10).collect())
    assert got == [(42, round((40 * 0.6 + 2 * 0.9) / 42, 6), round((40 * 0.5 + 2) / 42, 6)), (53, round((50 * 0.1 + 3 * 0.2) / 53, 6), round((5 + 3) / 53, 6))]


def test_bootstrap_of_equal_folds_has_no_width(spark):
    folds = spark.createDataFrame([(i, 2.5) for i in range(5)], "f int, v double")
    r = metrics.bootstrap(folds, "f", "v", 50).first()
    assert (r.low, r.high, r["mean"], r.folds) == (2.5, 2.5, 2.5, 5)
    r = metrics.bootstrap(spark.createDataFrame([(i, float(i)) for i in range(10)], "f int, v double"), "f", "v", 800).first()
    # the deviation of a mean of ten draws of 0..9 is 0.91
    assert abs(r.low - (4.5 - 1.96 * 0.908)) < 0.35 and abs(r.high - (4.5 + 1.96 * 0.908)) < 0.35


def test_folds_by_hash_split_all_rows(spark):
    got = spark.range(2000).select(learning.folds_by_hash(F.col("id"), 4).alias("f")).groupBy("f").count().collect()
    assert {r.f for r in got} == {0, 1, 2, 3} and min(r["count"] for r in got) > 400


def test_snapshots_are_only_ever_added(spark, tmp_path):
    path, rows = str(tmp_path / "snap"), spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sources.append_snapshot(rows, path, F.lit(day))
    held = spark.read.parquet(path)
    assert held.count() == 6 and held.select("batch").distinct().count() == 3 and held.where("as_of = '2024-01-02'").count() == 4


def test_nested_horizons_and_cubes(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"7": {"a": "x", "b": "y"}, "14": {"a": "z"}}'), (2, None)], "k int, body string")
    got = sorted(tuple(r) for r in sources.nested_horizons(df, "body", ("h", "virus"), "v").collect())
    assert got == [(1, "14", "a", "z"), (1, "7", "a", "x"), (1, "7", "b", "y")]
    (tmp_path / "cube.xml").write_text("<cube><row><week>2024-01</week><n>3</n></row><row><week>2024-02</week></row></cube>")
    assert sorted(tuple(r) for r in sources.read_cube(spark, str(tmp_path / "cube.xml"), "row", "week string, n int").collect()) == [("2024-01", 3), ("2024-02", None)]


def test_separators_and_unknown_layouts(spark, tmp_path):
    for k, text in enumerate(("a;b;c\n1,5;2;3\n", "a,b\n1;2,3\n", "lone\n1\n")):
        (tmp_path / f"{k}.csv").write_text(text)
    assert [sources.separator_of(spark, str(tmp_path / f"{k}.csv")) for k in range(3)] == [";", ",", ";"]
    picked = sources.pick_columns(spark.createDataFrame([(1, "x")], "Umsatz int, Ort string"), {"sales": ["revenue", "umsatz"], "place": ["ort"], "brand": ["brand"]})
    assert picked.columns == ["sales", "place", "brand"] and tuple(picked.first()) == (1, "x", None)


def test_truth_score_and_reliability_by_hand(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("double")
    score = lambda *a: one.select(readiness.truth_score(*map(lit, a[:4]), F.lit(a[4])).alias("s")).first().s
    assert score(0.8, 2.0, 0.1, 0.05, True) == round(28 + 12.5 + 12 + 5 + 10, 1) and score(None, None, None, None, False) == 4.0
    rel = one.select(readiness.reliability_score(lit(0.125), lit(0.1), lit(None), lit(0.8), lit(None), lit(20), lit(2), lit(18)).alias("s")).first().s
    assert rel == round((0.5 + 0.5 + 1) / 3 * 0.5, 4)


def test_phase_fit_against_a_grid(spark):
    kernels = [[1.0], [0.2, 0.5, 0.3], [0.0, 0.1, 0.3, 0.4, 0.2]]
    logs = lambda q, c: np.array([math.log(sum(k * math.exp(-a * q + a * (a - 1) / 2 * c) for a, k in enumerate(ks))) for ks in kernels])
    rng, rows = np.random.default_rng(11), []
    for i in range(8):
        z = (5 + logs(rng.uniform(-0.4, 0.4), rng.uniform(-0.1, 0.1)) + rng.normal(0, 0.02, 3)).tolist()
        rows.append((i, z, [0.01, 0.02, 0.04]))
    rows += [(8, [4.0, None, 4.2], [0.01, None, 0.01]), (9, [4.0, None, None], [0.01] * 3), (10, [50.0, 4.0, 3.0], [0.01] * 3)]
    got = {r.k: r for r in phase.phase_fit(spark.createDataFrame(rows, "k int, z array<double>, v array<double>"), ["k"], "z", "v", kernels).collect()}

    def loss(z, v, q, c):
        w = np.array([0.0 if a is None else 1 / (b or 1.0) for a, b in zip(z, v, strict=True)])
        r = np.array([0.0 if a is None else a for a in z]) - logs(q, c)
        return (w * r * r).sum() - (w * r).sum() ** 2 / w.sum() + 1e-4 * q * q + 1e-3 * c * c

    for k, z, v in rows:
        grid = min(loss(z, v, q, c) for q in np.linspace(-1, 1, 81) for c in np.linspace(-0.5, 0.5, 41))
        assert abs(got[k].q) <= 1 and abs(got[k].c) <= 0.5 and loss(z, v, got[k].q, got[k].c) <= grid + 1e-6
    assert "few_sources" in got[9].warnings and got[0].warnings == []


def test_renewal_without_noise_against_a_plain_loop(spark):
    n = {("a", i): v for i, v in enumerate([10.0, 12.0, 15.0, 18.0])} | {("b", i): v for i, v in enumerate([40.0, 30.0, 24.0, 20.0])}
    edges = [("a", "b", 0.5), ("b", "a", 0.25)]
    out = phase.renewal_forecast(spark.createDataFrame([(r, i, v) for (r, i), v in n.items()], "r string, i int, v double"), spark.createDataFrame(edges, "src string, dst string, weight double"), "r", "i", "v", [0.6, 0.4], 3, samples=3, imported=0.1, size=0.0, noise=0.0)
    got = {(x.r, x.ahead): x for x in out.collect()}
    past = {r: [n[r, i] for i in range(4)] for r in "ab"}
    for h in range(1, 4):
        new = {}
        for r in "ab":
            x = [math.log(v + 1) for v in past[r][-3:]]
            q, c = x[2] - x[1], x[2] - 2 * x[1] + x[0]
            rate = min(max(1 / (0.6 * math.exp(-q) + 0.4 * math.exp(-2 * q + c)), 0.2), 5.0)
            come = lambda lag: sum(w * past[s][-lag] for s, d, w in edges if d == r)  # noqa: B023, E731
            new[r] = rate * sum(g * (0.9 * past[r][-lag] + 0.1 * come(lag)) for lag, g in ((1, 0.6), (2, 0.4)))
        for r in "ab":
            assert abs(got[r, h].q50 - new[r]) < 1e-9 and got[r, h].p_up == float(new[r] > n[r, 3])
            past[r].append(new[r])


def test_ridge_shares_against_normal_equations(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 2)) * [1, 50] + [3, -7]
    y = x @ [2.0, 0.1] + rng.normal(size=200)
    got = {r.feature: r for r in learning.ridge_shares(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y").collect()}
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    off = y - y.mean() - z @ beta
    assert np.allclose([got["a"].coefficient, got["b"].coefficient], beta) and abs(got["a"].r2 - (1 - (off**2).mean() / y.var())) < 1e-9 and abs(got["a"].share + got["b"].share - 1) < 1e-12

"""Panels at every issue date, against a plain reading of all revisions per issue."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import issues

START = dt.date(2023, 1, 2)


def day(n):
    return START + dt.timedelta(days=n)


def revisions(seed, regions=4, days=120, late=25):
    rng = random.Random(seed)
    rows = []
    for r in range(regions):
        for d in range(days):
            if rng.random() < 0.6:
                for k in range(rng.choice([1, 1, 2, 3])):
                    rows.append((r, day(d), rng.uniform(1, 9), rng.randint(1, 5), day(d + rng.randint(0, late)) if rng.random() < 0.95 else None, k))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "region int, day date, v double, n long, published date, k int")


def known(rows, cutoff, lookback):
    """{(region, day): value} as it stood at a cutoff."""
    out = {}
    for r, d, v, _, p, k in rows:
        if p is not None and p <= cutoff and cutoff - dt.timedelta(days=lookback) <= d <= cutoff:
            if (r, d) not in out or (p, k) > out[r, d][1]:
                out[r, d] = (v, (p, k))
    return {key: v for key, (v, _) in out.items()}


def test_known_rows_at_weekly_and_irregular_cutoffs(spark):
    rows = revisions(1)
    days = issues.validity(frame(spark, rows), ["region", "day"], "published", ["k"])
    for cutoffs in ([day(6 + 7 * k) for k in range(20)], [day(n) for n in (0, 1, 2, 30, 31, 77, 140, 400)]):
        calendar = spark.createDataFrame([(c,) for c in cutoffs], "cutoff date")
        seen = issues.known_at(days, calendar, "day", 40)
        got = {(r.cutoff, r.region, r.day): r.v for r in seen.collect()}
        want = {(c, *key): v for c in cutoffs for key, v in known(rows, c, 40).items()}
        assert got == want and seen.count() == len(want)


def test_each_region_may_have_its_own_calendar(spark):
    rows = revisions(2)
    days = issues.validity(frame(spark, rows), ["region", "day"], "published", ["k"])
    own = [(r, day(10 * r + 13 * k)) for r in range(4) for k in range(8)]
    got = {(r.cutoff, r.region, r.day): r.v for r in issues.known_at(days, spark.createDataFrame(own, "region int, cutoff date"), "day", 30, ["region"]).collect()}
    assert got == {(c, *key): v for r, c in own for key, v in known(rows, c, 30).items() if key[0] == r}


def panel(spark, rows, weeks, **more):
    edges = spark.createDataFrame([(a, (a + 1) % 4) for a in range(4)], "src int, dst int")
    weekly = spark.createDataFrame(weeks, "region int, week date, v double, published date")
    return {(r.region, r.cutoff): r.asDict() for r in issues.issue_panel(frame(spark, rows), weekly, edges, "region", 7, **more).collect()}


def test_no_later_revision_changes_an_earlier_issue(spark):
    rng = random.Random(3)
    rows = [(*r[:4], r[4] or day(500), 0) for r in revisions(3) if r[5] == 0]
    weeks = [(r, day(7 * w), rng.uniform(0, 20), day(7 * w + lag)) for r in range(4) for w in range(-60, 17) for lag in (7, 30)]
    all_ = panel(spark, rows, weeks)
    cutoff = day(83)
    early = panel(spark, [r for r in rows if r[4] <= cutoff or r[1] == day(119)], [w for w in weeks if w[3] <= cutoff])
    both = {k for k in all_ if k[1] <= cutoff}
    assert len(both) > 20 and both == {k for k in early if k[1] <= cutoff}
    for k in both:
        assert {c: v for c, v in all_[k].items() if c != "next"} == {c: v for c, v in early[k].items() if c != "next"}
    # and what was known is read as it then stood
    for (r, c), row in all_.items():
        mine = {d: v for (q, d), v in known(rows, c, 56).items() if q == r}
        assert row["n_days"] == len(mine) >= 8 and row["level"] == mine[max(mine)]
        late = [v for d, v in mine.items() if d >= c - dt.timedelta(days=7)]
        assert abs(row["mean_7"] - (sum(late) / len(late) if late else 0)) < 1e-9
        old = [d for d in mine if d <= c - dt.timedelta(days=14)]
        assert row["lag_14"] == (mine[max(old)] if old else 0)
    assert any(row["next"] is not None for row in all_.values())


def test_seasonal_values_before_the_target_only(spark):
    weeks = [(0, dt.date(y, 1, 1) + dt.timedelta(days=7 * k - dt.date(y, 1, 1).weekday()), float(y * 100 + k), None) for y in (2020, 2021, 2022) for k in range(1, 52)]
    weeks = [(r, w, v, w + dt.timedelta(days=7)) for r, w, v, _ in weeks]
    valid = issues.validity(spark.createDataFrame(weeks, "region int, week date, v double, published date"), ["region", "week"], "published")
    calendar = spark.createDataFrame([(dt.date(2022, 6, 19), dt.date(2022, 6, 20)), (dt.date(2022, 1, 2), dt.date(2022, 1, 3))], "cutoff date, target date")
    got = {r.cutoff: sorted(r.seasonal) for r in issues.seasonal_at(valid, calendar, ["region"], "week", "v").collect()}
    ring = lambda d: min(d.isocalendar()[1], 52)
    for cutoff, target in ((dt.date(2022, 6, 19), dt.date(2022, 6, 20)), (dt.date(2022, 1, 2), dt.date(2022, 1, 3))):
        near = lambda w: min(abs(ring(w) - ring(target)), 52 - abs(ring(w) - ring(target))) <= 1  # noqa: B023, E731
        assert got[cutoff] == sorted(v for _, w, v, p in weeks if w < target and w <= cutoff and p <= cutoff and near(w))


def test_champion_of_vintages_is_the_one_that_knew(spark):
    rows = [(0, day(7 * w), float(w % 5), day(7 * w + 7)) for w in range(60)]
    history = spark.createDataFrame(rows, "region int, day date, v double, published date")
    truth = history.select("region", F.col("day").alias("target"), F.col("v").alias("actual"))
    made = {"last": F.max_by("v", "day"), "five_back": F.max_by(F.when(F.col("age") >= 26, F.col("v")), F.when(F.col("age") >= 26, F.col("day"))), "none": F.max(F.lit(None).cast("double"))}
    board = {r.candidate: r for r in issues.vintage_benchmark(history, issues.calendar(history, "day", 7), truth, made, ["region"], "day", "v", "published", 120).collect()}
    assert set(board) == {"last", "five_back"} and board["five_back"].champion and not board["last"].champion and board["five_back"].mae < board["last"].mae

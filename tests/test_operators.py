"""Edge cases of the operators on small literal tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.functions import number_from_text, relative_delta, week_from_label
from tidemark.operators import learning, metrics, regional, scores, series, visibility


def d(text):
    return dt.date.fromisoformat(text)


def test_visibility_rules_differ_on_unknown_availability(spark):
    df = spark.createDataFrame([(1, d("2024-01-01"), d("2024-01-05")), (2, d("2024-01-01"), None), (3, d("2024-01-01"), d("2024-01-20"))], "k int, e date, a date")
    cut = F.lit("2024-01-10").cast("date")
    assert {r.k for r in visibility.visible(df, cut, "e", "a").collect()} == {1, 2}
    assert {r.k for r in visibility.visible_known(df, cut, "e", "a").collect()} == {1}
    assert {r.k for r in visibility.visible(df, cut, "e", "a", strict=False).collect()} == {1, 2, 3}


def test_later_data_never_changes_an_as_of_answer(spark):
    rows = [("a", d("2024-01-01"), d("2024-01-02"), 1.0), ("a", d("2024-01-01"), d("2024-01-09"), 2.0)]
    late = [*rows, ("a", d("2024-01-01"), d("2024-02-01"), 99.0)]
    cut = F.lit("2024-01-10").cast("date")
    ask = lambda r: visibility.latest_revision(spark.createDataFrame(r, "k string, e date, p date, v double"), ["k", "e"], cut, "p", ["v"]).collect()
    assert ask(rows) == ask(late)


def test_nearest_prefers_the_earlier_of_two_as_near(spark):
    left = spark.createDataFrame([("x", d("2024-01-10"))], "k string, day date")
    right = spark.createDataFrame([("x", d("2024-01-08"), 8.0), ("x", d("2024-01-12"), 12.0), ("x", d("2024-03-01"), 1.0)], "k string, day date, v double")
    assert [r.nearest_value for r in visibility.asof_nearest(left, right, ["k"], "day", "v", 5).collect()] == [8.0]


def test_backward_join_keeps_unmatched_rows_and_repeats(spark):
    left = spark.createDataFrame([(1, "x", 5), (2, "x", 5), (3, "x", 0)], "i int, k string, t int")
    right = spark.createDataFrame([("x", 5, 7.0), ("x", 9, 8.0)], "k string, t int, v double")
    assert {(r.i, r.asof_value) for r in visibility.asof_backward(left, right, ["k"], "t", "v", ["i"]).collect()} == {(1, 7.0), (2, 7.0), (3, None)}


@pytest.mark.parametrize("text,value", [("1.642,34", 1642.34), ("1,642.34", 1642.34), ("3,5", 3.5), ("12", 12.0), ("x", None), ("", None), ("€ 7", 7.0)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(number_from_text(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("text,day", [("2020-W53", "2020-12-28"), ("2021_01", "2021-01-04"), ("KW 7/2024", "2024-02-12"), ("2024-W60", None), ("?", None)])
def test_week_labels(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(week_from_label(F.col("t"))).first()[0] == (d(day) if day else None)


def test_correlation_of_a_constant_is_null(spark):
    a = spark.createDataFrame([("x", d("2024-01-01") + dt.timedelta(i), 1.0) for i in range(9)], "k string, day date, value double")
    assert {r["corr"] for r in series.lag_correlations(a, a, ["k"], "day", [0, 1]).collect()} == {None}


def test_interpolation_and_segments(spark):
    df = spark.createDataFrame([("x", d("2024-01-01"), 1.0), ("x", d("2024-01-03"), 3.0), ("x", d("2024-01-05"), None)], "k string, day date, v double")
    got = series.interpolate(series.dense(df, ["k"], "day"), ["k"], "day", "v", "u").orderBy("day").collect()
    assert [r.u for r in got] == [1.0, 2.0, 3.0, 3.0, 3.0]
    assert series.segments(df, ["k"], "day", F.col("v") > 2).collect()[0]["length"] == 1


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 1)], "g int, s double, y int")
    assert metrics.roc_auc(df, ["g"], "s", "y").first().auc is None
    assert metrics.average_precision(df, ["g"], "s", "y").first().ap == 0.0


def test_wis_by_hand(spark):
    row = spark.createDataFrame([(10.0,)], "y double").select(metrics.weighted_interval_score(F.col("y"), F.lit(8.0), [(0.2, F.lit(5.0), F.lit(12.0))])).first()[0]
    assert row == pytest.approx((0.5 * 2 + 0.1 * 7) / 1.5)


def test_zero_denominator(spark):
    assert spark.range(1).select(relative_delta(F.lit(3.0), F.lit(0.0))).first()[0] == 3.0


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", None, 1.0, 9), ("b", "x", 2.0, 9)], "k string, g string, v double, seen int")
    new = spark.createDataFrame([("a", None, 5.0, 3), ("b", "x", None, 12), ("c", None, 7.0, 1)], "k string, g string, v double, seen int")
    got = {(r.k, r.g): (r.v, r.seen) for r in sources.upsert(old, new, ["k", "g"], earliest=["seen"]).collect()}
    assert got == {("a", None): (5.0, 3), ("b", "x"): (2.0, 9), ("c", None): (7.0, 1)}


def test_allocation_respects_bounds(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([100.0, 1.0, 1.0, 0.0, None])], "g int, n int, w double")
    got = [r.share for r in regional.allocate(df, ["g"], "n", "w", 0.05, 0.4).orderBy("n").collect()]
    assert sum(got) == pytest.approx(1) and max(got) <= 0.4 + 1e-9 and min(got) >= 0.05 - 1e-9


def test_reconciled_leaves_sum_to_the_parent(spark):
    df = spark.createDataFrame([(1, "a", "r", 10.0, 1.0), (1, "b", "r", 20.0, 3.0), (1, "r", None, 40.0, 2.0)], "g int, n string, p string, v double, s double")
    got = {r.n: r.reconciled for r in regional.reconcile(df, ["g"], "n", "p", "v", "s").collect()}
    assert got["a"] + got["b"] == pytest.approx(got["r"])


def test_ward_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x + 50 * (i % 3)), float(y)) for i, (x, y) in enumerate(rng.normal(size=(30, 2)))]
    got = learning.clusters(spark.createDataFrame(rows, "n int, a double, b double"), "n", ["a"], 3).collect()
    assert len({(r.n % 3, r.cluster) for r in got}) == 3


def test_files(spark, tmp_path):
    (tmp_path / "2024_07.csv").write_text("land;fälle\nA;1.234,5\nB;NA\n")
    got = sources.read_folder(spark, f"{tmp_path}/*.csv").collect()
    assert {(r.file_year, r.file_week) for r in got} == {(2024, 7)}
    (tmp_path / "m.tsv").write_bytes("Land\tFlu\tRSV\r\nA\t1.642,34\t-\r\nB\t2\t3,5\r\n".encode("utf-16"))
    long = sources.read_matrix(spark, str(tmp_path / "m.tsv"), ["Land"], "disease", "n").collect()
    assert {(r.Land, r.disease, r.n) for r in long} == {("A", "Flu", 1642.34), ("B", "Flu", 2.0), ("B", "RSV", 3.5)}
    (tmp_path / "d.tsv").write_text("tag\twert\tflag\n01.02.2024\t3,5\tja\nx\tNA\tnein\n")
    got = sources.read_delimited(spark, str(tmp_path / "d.tsv"), numbers=["wert"], days={"tag": "dd.MM.yyyy"}, flags=["flag"]).collect()
    assert [(r.tag, r.wert, r.flag) for r in got] == [(d("2024-02-01"), 3.5, True), (None, None, False)]


def test_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sources.replace_partitions(df, str(tmp_path / "t"), ["k"])
    sources.replace_partitions(df.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}


def test_densities_of_large_counts(spark):
    # eight long factors of 600 and more pass 64 bits
    df = spark.createDataFrame([(1, 7.0), (300, 7.0), (600, 580.0), (36000, 35000.0), (5_000_000, 4_900_000.0)], "k long, m double")
    got = df.select("k", "m", scores.negative_binomial_log_p(F.col("k"), F.col("m"), F.lit(5.0)).alias("p"), scores.log_gamma(F.col("k")).alias("g")).collect()
    for r in got:
        want = math.lgamma(r.k + 5) - math.lgamma(5) - math.lgamma(r.k + 1) + 5 * math.log(5 / (5 + r.m)) + r.k * math.log(r.m / (5 + r.m))
        assert (r.p, r.g) == (pytest.approx(want, abs=1e-6), pytest.approx(math.lgamma(r.k), rel=1e-12, abs=1e-9))
    t = df.select(scores.student_log_p(F.col("k"), F.col("m"), F.col("m") * 0, 4.0).alias("t")).collect()
    assert [r.t for r in t] == [None] * 5

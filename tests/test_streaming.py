"""Streaming operators give what batch gives."""

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.operators import regional


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def events(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return streaming.stream(spark, str(tmp_path / "in"), e.schema, 10), e


def test_windows(spark, sf_dir, tmp_path):
    s, e = events(spark, sf_dir, tmp_path)
    got = run(streaming.windowed(s, ["user_id"], "ts", "value", "1 day"), "w1", "complete")
    want = e.groupBy("user_id", F.window("ts", "1 day")).count()
    assert got.agg(F.sum("n")).first()[0] == e.count() and got.count() == want.count()


def readings(seed, sites=4, days=60):
    import datetime as dt
    import random

    rng, rows = random.Random(seed), []
    for site in range(sites):
        for d in range(days if site else 20):
            v = 10 * (2.5 if rng.random() < 0.08 else 1.5 if rng.random() < 0.1 else 1) + rng.random()
            rows.append((site, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=site), v))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_states_are_the_batch_states(spark, tmp_path, seed):
    import datetime as dt
    import random

    spark.conf.set(*streaming.TIMERS)
    try:
        rows = readings(3)
        # files of six days, each row up to six days late, so that neighbours come in turned order
        rng = random.Random(seed)
        by = {}
        for r in rows:
            by.setdefault(((r[1] - dt.datetime(2024, 1, 1)).days + rng.randrange(6)) // 6, []).append(r)
        schema = "site int, at timestamp, v double"
        for k in sorted(by):
            rng.shuffle(by[k])
            spark.createDataFrame(by[k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streaming.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 2)
        got = run(streaming.site_alerts(s, "site", "at", "v", late="14 days", silence_days=20), f"timers{seed}").collect()
        batch = regional.alert_states(spark.createDataFrame(rows, schema), ["site"], "at", "v").collect()
        passed = max(r[1] for r in rows) - dt.timedelta(days=14)
        show = lambda r: (r.site, r["at"], round(r.v, 9), r.state, None if r.baseline is None or r.baseline != r.baseline else round(r.baseline, 9))
        want = {show(r) for r in batch if r["at"] <= passed}
        closed = [r for r in got if r.state == "closed"]
        assert {show(r) for r in got if r.state != "closed"} == want and len(want) > 120
        assert {r.state for r in got} == {"clear", "watch", "alarm", "closed"}
        # the site that fell silent is closed once, when its time is up
        assert [(r.site, r["at"]) for r in closed] == [(0, dt.datetime(2024, 1, 20) + dt.timedelta(days=20))]
    finally:
        spark.conf.unset(streaming.TIMERS[0])


def test_sessions_and_repeats(spark, sf_dir, tmp_path):
    s, e = events(spark, sf_dir, tmp_path)
    assert run(streaming.sessions(s, ["user_id"], "ts", "6 hours"), "s1", "complete").agg(F.sum("n")).first()[0] == e.count()
    assert run(streaming.first_seen(s, ["user_id", "ts"], "ts"), "f1").count() == e.dropDuplicates(["user_id", "ts"]).count()

"""Structured Streaming forms of the windowed and stateful operators. Each takes a streaming or a batch table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.regional import AlertRule

#: The setting that timers need.
TIMERS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(df: DataFrame, keys: list[str], at: str, value: str, width: str, slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Count, mean and total per key and time window; rows later than the watermark are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = df.withWatermark(at, late).groupBy(*keys, window).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "total")


def sessions(df: DataFrame, keys: list[str], at: str, gap: str, late: str = "2 days") -> DataFrame:
    """Runs of rows at most a gap apart."""
    out = df.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(df: DataFrame, keys: list[str], at: str, late: str = "2 days") -> DataFrame:
    """Rows without repeats of their key within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


class SiteAlerts(StatefulProcessor):
    """`AlertRule` over a stream. Rows wait until the watermark has passed them and then take their turn in order of time, so
    states don't depend on the order in which rows come. A site that is silent for `silence` is closed and forgotten."""

    def __init__(self, at: str, value: str, silence_ms: int, rule: dict):
        self.at, self.value, self.silence, self.rule = at, value, silence_ms, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, quiet int, last long")
        self.clean = handle.getListState("clean", "v double")
        self.waiting = handle.getListState("waiting", "t long, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame[self.at].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(int(t), float(v)) for t, v in zip(times, frame[self.value], strict=True) if v == v and v is not None])
            for t in sorted(set(times)):
                self.handle.registerTimer(int(t))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, name = timerValues.getCurrentWatermarkInMs(), key[0]
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        state, quiet, last = self.now.get() if self.now.exists() else ("clear", 0, None)
        out = []
        if due:
            rule = AlertRule(**self.rule, state=state, quiet=int(quiet), clean=[r[0] for r in self.clean.get()] if self.clean.exists() else [])
            for t, v in due:
                rule_state, base = rule.step(v)
                out.append((name, pd.Timestamp(t, unit="ms"), v, rule_state, base))
            last = due[-1][0]
            self.now.update((rule.state, rule.quiet, last))
            if rule.clean:
                self.clean.put([(v,) for v in rule.clean])
            left = rows[len(due) :]
            self.waiting.put(left) if left else self.waiting.clear()
            self.handle.registerTimer(last + self.silence)
        elif last is not None and last + self.silence <= passed and not rows:
            out.append((name, pd.Timestamp(int(last) + self.silence, unit="ms"), float("nan"), "closed", float("nan")))
            self.now.clear(), self.clean.clear()
        yield pd.DataFrame(out, columns=[*self.names, self.at, self.value, "state", "baseline"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def site_alerts(df: DataFrame, key: str, at: str, value: str, late: str = "2 days", silence_days: float = 30, history: int = 7, watch: float = 1.3, alarm: float = 2.0, calm: int = 2) -> DataFrame:
    """The states that `alert_states` gives, over a stream whose rows come in any order within the watermark: key, time, value,
    state, baseline, and a row `closed` for a site without rows for so many days. Null values are left out.

    Needs a state store with timers (`TIMERS`, set on the session). What is held of a site: its last clean values, and its
    rows that the watermark hasn't passed.
    """
    kind = df.schema[key].dataType.simpleString()
    processor = SiteAlerts(at, value, int(silence_days * 86_400_000), {"history": history, "watch": watch, "alarm": alarm, "calm": calm})
    processor.names = [key]
    rows = df.where(F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value))
    return rows.withWatermark(at, late).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, `{at}` timestamp, `{value}` double, state string, baseline double", "Append", "EventTime")

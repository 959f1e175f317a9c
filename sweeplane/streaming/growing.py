"""A store that is read while it grows: counts and yield of each family as files arrive, kept as state by key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What a change of a family's totals looks like. A closed row comes when a family has been silent for as long as is allowed.
LIVE_SCHEMA = "family string, arrival long, n long, n_ok long, last_ts timestamp, closed boolean"


class FamilyTotals(StatefulProcessor):
    """n and n_ok of a family over all that has arrived; a timer in event time closes silent families.

    Rows are (family, arrival, ts, ok). A closed family that comes back goes on from where it was. Rows later than the
    watermark are left out by Spark before they come here.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, n_ok long, arrival long, last_ms long, timer_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, n_ok, arrival, last, timer = self.totals.get() if self.totals.exists() else (0, 0, -1, -(1 << 62), -1)
        for pdf in rows:
            n, n_ok = n + len(pdf), n_ok + int(pdf["ok"].sum())
            arrival = max(arrival, int(pdf["arrival"].max()))
            last = max(last, int(pdf["ts"].max().value // 1_000_000))
        if self.idle_ms is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = last + self.idle_ms
            self.handle.registerTimer(timer)
        self.totals.update((n, n_ok, arrival, last, timer))
        yield self._row(key, arrival, n, n_ok, last, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, n_ok, arrival, last, _ = self.totals.get()
        self.totals.update((n, n_ok, arrival, last, -1))
        yield self._row(key, arrival, n, n_ok, last, True)

    def _row(self, key: Any, arrival: int, n: int, n_ok: int, last: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"family": [key[0]], "arrival": [arrival], "n": [n], "n_ok": [n_ok], "last_ts": [pd.Timestamp(last, unit="ms")], "closed": [closed]})

    def close(self) -> None:
        pass


def live_totals(flags: DataFrame, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Totals by family of a stream of (family, arrival, ts, ok): a row for each family of each batch, LIVE_SCHEMA.

    State is two numbers a family, in the state store, so it is bounded by the families and survives a restart. Partial sums
    are made of each Arrow batch; a hot family's rows of a batch meet in one task.
    """
    rows = flags.select("family", "arrival", "ts", "ok").withWatermark("ts", late)
    return rows.groupBy("family").transformWithStateInPandas(FamilyTotals(idle_ms), LIVE_SCHEMA, outputMode="append", timeMode="EventTime")


def follow_store(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of a Parquet store, those at hand and those that files bring later."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drain(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in what has arrived since the checkpoint, append the changes to Parquet files, exactly once, and end."""
    # Keyed state with timers needs this provider.
    conf, key = result.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        started = out.outputMode("append").trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        conf.set(key, before)
    return started

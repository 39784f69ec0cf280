"""Structured Streaming versions of the core tape aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.tape import last_by, with_snapshot, yes_trades


def hourly_last(tape: DataFrame, late: str = "2 hours") -> DataFrame:
    """Last yes price of each market and hour, by the end of the hour; append mode."""
    t = yes_trades(tape).withWatermark("ts", late)
    hour = F.window("ts", "1 hour")
    g = t.groupBy("platform", "platform_id", hour).agg(last_by("px", "ts", "event_id").alias("px"), F.sum("usd").alias("usd"))
    return g.select("platform", "platform_id", F.col("window.end").alias("hour_end"), "px", "usd")


def snapshot_panel(tape: DataFrame, late: str = "2 days") -> DataFrame:
    """Market-day aggregates by snapshot date; the date is a time of its own, so summer time needs no window offset."""
    t = with_snapshot(yes_trades(tape)).withColumn("snap_ts", F.col("snap_date").cast("timestamp")).withWatermark("snap_ts", late)
    return t.groupBy("platform", "platform_id", "snap_ts").agg(
        last_by("px", "ts", "event_id").alias("px_last"), F.max("ts").alias("last_ts"), F.sum("usd").alias("volume_usd"), F.count("*").alias("n_trades")
    )


def dedupe(tape: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops rows that are replayed within the watermark."""
    return tape.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def last_state(tape: DataFrame) -> DataFrame:
    """Latest price and time of every market so far (update or complete mode)."""
    return yes_trades(tape).groupBy("platform", "platform_id").agg(last_by("px", "ts", "event_id").alias("px"), F.max("ts").alias("last_ts"))


def stale_state(tape: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """(platform, platform_id, px, last_ts, stale): a row when a market trades, and a stale one ``hours`` of event time after its last trade.

    Keyed state holds the last price and time of a market; an event-time timer tells when it gets stale.
    """
    t = yes_trades(tape).select("platform", "platform_id", "ts", "event_id", "px").withWatermark("ts", late)
    gap = pd.Timedelta(hours=hours)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        px, at, event = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"platform": [key[0]], "platform_id": [key[1]], "px": [px], "last_ts": [pd.Timestamp(at, unit="us")], "stale": [True]})
            return
        for b in batches:
            for p, ts, e in zip(b["px"], b["ts"], b["event_id"]):
                now = ts.value // 1000
                if at is None or (now, e) > (at, event):
                    px, at, event = float(p), int(now), int(e)
        state.update((px, at, event))
        due = pd.Timestamp(at, unit="us") + gap
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"platform": [key[0]], "platform_id": [key[1]], "px": [px], "last_ts": [pd.Timestamp(at, unit="us")], "stale": [False]})

    return t.groupBy("platform", "platform_id").applyInPandasWithState(
        update,
        "platform string, platform_id string, px double, last_ts timestamp, stale boolean",
        "px double, at long, event long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_counted(stream: DataFrame, mode: str, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """``run_once``, and how many rows came too late for the watermark and were dropped."""
    query = _start(stream, mode, path, checkpoint)
    late = sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(path), late


def run_once(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into Parquet (append: added to; complete: replaced) and read it."""
    _start(stream, mode, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _start(stream: DataFrame, mode: str, path: str, checkpoint: str):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return query

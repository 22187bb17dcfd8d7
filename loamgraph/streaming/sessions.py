"""Sessions of an unbounded stream of events, by timers in keyed state.

The stream's state holds one open session per key. Events in order update it and set its timer to the last event plus the
gap; when the watermark passes the timer, or a later event does, the session is emitted. The batch operator works by the
same rule over whole tables and is the one for hot keys, as a stream keeps each key in one state partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamgraph.session import shared_folder

OUT = "key string, first_id bigint, last_id bigint, started_at timestamp, ended_at timestamp, n_events bigint"
STATE = "first_id bigint, last_id bigint, started_us bigint, ended_us bigint, n_events bigint"


def stream_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Closed sessions of a stream (key string, at timestamp, id bigint).

    Events later than `lateness` behind the newest are dropped; within it a trigger's events are taken in the order of time
    and id, and one that comes before the open session's end widens it. Repeated ids within the lateness count once. Sessions
    that are still open when the stream ends stay in its state.
    """
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1e6)

    def row(key: str, s: tuple) -> pd.DataFrame:
        stamp = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame([(key, s[0], s[1], stamp(s[2]), stamp(s[3]), s[4])], columns=[c.split()[0] for c in OUT.split(", ")])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(key[0], state.get)
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        now = state.get if state.exists else None
        for at, i in zip(rows["at"].astype("datetime64[us]").astype("int64"), rows["id"]):
            at, i = int(at), int(i)
            if now is not None and at - now[3] > gap_us:
                yield row(key[0], now)
                now = None
            if now is None:
                now = (i, i, at, at, 1)
            else:
                now = (i if at < now[2] else now[0], i if at >= now[3] else now[1], min(at, now[2]), max(at, now[3]), now[4] + 1)
        timer = (now[3] + gap_us) // 1000 + 1
        if timer <= state.getCurrentWatermarkMs():
            yield row(key[0], now)
            if state.exists:
                state.remove()
        else:
            state.update(now)
            state.setTimeoutTimestamp(timer)

    rows = events.where("key is not null and at is not null and id is not null").withWatermark("at", lateness).dropDuplicatesWithinWatermark(["key", "id"])
    return rows.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """All sessions of a table (key, at timestamp, id), by running it through the stream until every timer has expired.

    The events are written to the shared folder and read as a stream; one event of a key of its own, far in the future,
    moves the watermark beyond all timers, so that a last trigger without data closes what is open. A trigger holds a key's
    events of its slice in one task, as streams do: for hot keys of whole tables there is `operators.sessions`.
    """
    spark = events.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    rows = events.select("key", "at", "id").where("key is not null and at is not null and id is not null")
    first = rows.agg(F.unix_micros(F.min("at"))).first()[0]
    moved = max(0, 86_400_000_000 - (first or 0))  # a stream's watermark begins in 1970 and drops what is older
    rows.withColumn("at", F.timestamp_micros(F.unix_micros("at") + moved)).write.parquet(f"{home}/in")
    last = spark.range(1).select(F.lit("").alias("key"), F.lit("2250-01-01 00:00:00").cast("timestamp").alias("at"), F.lit(-1).cast("bigint").alias("id"))
    last.write.mode("append").parquet(f"{home}/in")
    source = spark.readStream.schema(last.schema).parquet(f"{home}/in")
    job = stream_sessions(source, gap, lateness).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(availableNow=True).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()
    back = lambda c: F.timestamp_micros(F.unix_micros(c) - moved).alias(c)
    return spark.read.schema(OUT).parquet(f"{home}/out").select("key", "first_id", "last_id", back("started_at"), back("ended_at"), "n_events")


def stream_saves(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """(path, window, saves) of a stream of saves (path, at): counts per tumbling window, late events up to `lateness`."""
    return events.where("path is not null").withWatermark("at", lateness).groupBy("path", F.window("at", window)).agg(F.count("*").alias("saves"))

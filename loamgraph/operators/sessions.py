"""Sessions of a key's events, by keyed inactivity timers over ordered events.

Every event of a key updates the key's open session and resets its timer to the event's own time plus the gap; a session is
emitted when its timer expires, that is when time in the key passes the deadline. Events are range-partitioned by
(key, time, id), so a key that holds a third of all rows is spread over many tasks; a timer that has not expired at a range's
end is handed on: sessions that touch an edge are stitched afterwards (two rows per partition at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import norm_key
from loamgraph.functions.times import utc_micros, utc_text
from loamgraph.session import durable

GAP_US = 1_800_000_000
SCHEMA = "key string, start_us bigint, end_us bigint, first_id bigint, last_id bigint, n_events bigint, types map<string,bigint>, edge boolean"
ARROW = pa.schema(
    [("key", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_events", pa.int64()), ("types", pa.map_(pa.string(), pa.int64())), ("edge", pa.bool_())]
)


class SessionTimers:
    """The keyed timers of one ordered stream of events. State: the open session and the deadline of its timer. `update` takes
    a batch, resets the timer with every event and gives the sessions whose timers expired; `flush` gives the session whose
    timer still runs. As events come in order, all timers of a batch are followed by array operations."""

    def __init__(self, gap_us: int = GAP_US):
        self.gap = gap_us
        self.open: pa.RecordBatch | None = None
        self.deadline: int | None = None
        self.first = True

    def update(self, key: pa.Array, at: np.ndarray, ids: np.ndarray, kinds: pa.Array) -> pa.RecordBatch | None:
        if len(at) == 0:
            return None
        n, start, end, first, last = np.ones(len(at), np.int64), at, at, ids, ids
        kinds = kinds.fill_null("")
        owner = np.arange(len(at))
        amount = n
        if self.open is not None:  # the open session goes on as the first row
            o = self.open
            key = pa.concat_arrays([o["key"], key.cast(pa.string())])
            put = lambda name, own: np.concatenate([o[name].to_numpy(), own])
            start, end, first, last, n = put("start_us", start), put("end_us", end), put("first_id", first), put("last_id", last), put("n_events", n)
            seen = o["types"][0].as_py()
            kinds = pa.concat_arrays([pa.array([k for k, _ in seen], pa.string()), kinds.cast(pa.string())])
            owner = np.concatenate([np.zeros(len(seen), np.int64), owner + 1])
            amount = np.concatenate([np.array([v for _, v in seen], np.int64), amount])
        codes = key.dictionary_encode().indices.to_numpy()
        deadline = end + self.gap  # what every event resets its key's timer to
        expired = np.ones(len(start), bool)  # whether the timer of the row before has run out, or its key is over
        expired[1:] = (codes[1:] != codes[:-1]) | (start[1:] > deadline[:-1])
        head = np.flatnonzero(expired)
        tail = np.append(head[1:], len(start)) - 1
        session = np.cumsum(expired) - 1
        kind = kinds.dictionary_encode()
        width = max(1, len(kind.dictionary))
        cell, inverse = np.unique(session[owner] * width + kind.indices.to_numpy(), return_inverse=True)
        sums = np.zeros(len(cell), np.int64)
        np.add.at(sums, inverse, amount)
        offsets = np.searchsorted(cell // width, np.arange(len(head) + 1))
        types = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), kind.dictionary.take(pa.array(cell % width)).cast(pa.string()), pa.array(sums))
        edge = np.zeros(len(head), bool)
        edge[0] = self.first
        out = pa.RecordBatch.from_arrays(
            [key.take(pa.array(head)).cast(pa.string()), *map(pa.array, (start[head], end[tail], first[head], last[tail], np.add.reduceat(n, head))), types, pa.array(edge)],
            schema=ARROW,
        )
        if len(out) > 1:
            self.first = False
        self.open, self.deadline = out.slice(len(out) - 1), int(deadline[-1])
        return out.slice(0, len(out) - 1) if len(out) > 1 else None

    def flush(self) -> pa.RecordBatch | None:
        if self.open is None:
            return None
        out = self.open.set_column(len(ARROW) - 1, "edge", pa.array([True]))
        self.open = self.deadline = None
        return out


def _timers(gap_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timers = SessionTimers(gap_us)
        for b in batches:
            out = timers.update(b["key"], b["at"].to_numpy(), b["id"].to_numpy(), b["kind"])
            if out is not None:
                yield out
        out = timers.flush()
        if out is not None:
            yield out

    return run


def keyed_events(log: DataFrame) -> DataFrame:
    """Events (key, at, id, kind) of a log: workspaces trimmed and lower-cased; each id once, with its earliest time."""
    rows = log.select(
        norm_key(F.col("workspace")).alias("key"),
        utc_micros(F.col("created_at")).alias("at"),
        F.col("id").cast("bigint").alias("id"),
        F.regexp_replace(F.lower(F.trim(F.col("event_type"))), "-", "_").alias("kind"),
    ).where("key is not null and at is not null and id is not null")
    once = rows.groupBy("id").agg(F.min(F.struct("at", "key", F.coalesce("kind", F.lit("")).alias("kind"))).alias("e"))
    return once.select("e.key", "e.at", "id", "e.kind")


def sessions(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Sessions of `events` (key, at microseconds, id, kind).

    Order within a key: at, then id; a session ends where the next event comes more than `gap_us` later. Result: key,
    start_us, end_us, first_id, last_id, n_events, types (events by kind; null kinds count under ''). Events without key,
    time or id must have been left out (`keyed_events` does). No events give no sessions.
    """
    ordered = events.repartitionByRange("key", "at", "id").sortWithinPartitions("key", "at", "id")
    parts = durable(ordered.select("key", "at", "id", "kind").mapInArrow(_timers(gap_us), SCHEMA))
    by_key = Window.partitionBy("key").orderBy("start_us", "first_id")
    opens = F.coalesce((F.col("start_us") - F.lag("end_us").over(by_key) > gap_us).cast("int"), F.lit(1))
    edges = parts.where("edge").withColumn("opens", opens).withColumn("session", F.sum("opens").over(by_key))
    group = edges.groupBy("key", "session").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.min(F.struct("start_us", "first_id"))["first_id"].alias("first_id"),
        F.max(F.struct("end_us", "last_id"))["last_id"].alias("last_id"),
        F.sum("n_events").alias("n_events"),
    )
    kinds = edges.select("key", "session", F.explode("types").alias("kind", "n")).groupBy("key", "session", "kind").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("key", "session").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("types"))
    stitched = group.join(kinds, ["key", "session"]).select("key", "start_us", "end_us", "first_id", "last_id", "n_events", "types")
    return parts.where("not edge").drop("edge").unionByName(stitched)


def session_report(found: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Readable sessions: workspace, start, end, when the timer expired, duration in seconds, events in all and per type
    (`type=n;...`)."""
    entries = F.array_sort(F.map_entries("types"))
    return found.select(
        F.col("key").alias("workspace"),
        "first_id",
        "last_id",
        utc_text(F.col("start_us")).alias("started_at"),
        utc_text(F.col("end_us")).alias("ended_at"),
        utc_text(F.col("end_us") + gap_us).alias("expired_at"),
        F.round((F.col("end_us") - F.col("start_us")) / 1e6, 6).alias("duration_s"),
        "n_events",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("type_counts"),
    )

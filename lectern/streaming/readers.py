"""Reader events as streams.

Each function takes events as a stream or a table and is the same plan on both, but for the keyed state of ``session_positions``.
Event times are timestamps (not TIMESTAMP_NTZ, which a watermark rejects).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.schemas import READER_EVENTS
from lectern.sources.landing import landing_folder
from lectern.sources.store import asked_chapters

#: The name of the event with which a replay ends.
_END = "end"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(READER_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream in append mode over all files that are there and returns what it has put out."""
    spark = stream.sparkSession
    out = landing_folder(spark, "stream")
    run_available(stream, out, landing_folder(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(out)


def run_available(stream: DataFrame, out: str, state: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> list[dict[str, Any]]:
    """Runs a stream over the files that are there and not done yet, going on from the state of the run before, and returns the progress of its batches.

    In update mode a batch writes the rows that it has changed, to a folder of its own, so that a batch that is run again replaces what it wrote; so it
    does with ``each``, which makes the rows that are written of a batch's rows."""
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append" and not each:
        query = writer.format("parquet").start(out)
    else:
        made = each or (lambda batch: batch)
        query = writer.foreachBatch(lambda batch, batch_id: made(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")).start()
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue() if hasattr(p, "jsonValue") else dict(p) for p in query.recentProgress]


def late_rows(progress: list[dict[str, Any]]) -> int:
    """Rows that came after the watermark had passed their time, and were dropped."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def state_rows(progress: list[dict[str, Any]]) -> list[int]:
    """Rows of state after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


def in_time_order(events: DataFrame, path: str, slices: int) -> Iterator[int]:
    """Lands events as they would have come: one slice of their time after the other, each as files of its own. Yields the number of the slice that is there now."""
    cuts = events.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    bounds = [None, *dict.fromkeys(cuts), None]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows = events if low is None else events.where(F.col("ts") > F.lit(low))
        rows = rows if high is None else rows.where(F.col("ts") <= F.lit(high))
        if high is None and low is None:
            rows = events
        rows.write.mode("append").parquet(path)
        yield k


def close_stream(spark: SparkSession, path: str, after: str, events: DataFrame) -> None:
    """Lands an event without a session so late that the watermark passes all others."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    last.select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("session"), F.lit(_END).alias("event"), F.lit(None).cast("int").alias("k")).where(
        "ts IS NOT NULL"
    ).write.mode("append").parquet(path)


def stream_route(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row per event and subscriber of its name."""
    return events.join(subscribers, "event").select("event_id", "event", "subscriber")


def stream_unrouted(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    return events.join(subscribers.select("event").distinct(), "event", "left_anti").select("event_id", "event")


def stream_chapter_join(events: DataFrame, v: DataFrame) -> DataFrame:
    """Chapter changes with the verses of the chapter."""
    return events.where("event = 'view'").join(v, F.col("k") == F.col("chap")).select("event_id", "engs", "chap", "sec", "txt")


def chapters_of_batch(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``stream_chapter_join`` of one batch of a stream with verses stored by chapter: only the folders of the chapters that the batch asks for are read."""
    views = batch.where("event = 'view'")
    return stream_chapter_join(views, asked_chapters(stored, views.select(F.col("k").alias("chap"))))


def latest_position(events: DataFrame) -> DataFrame:
    """The last chapter of each session of a table, with the event that led to it. ``session_positions`` is the same on a stream."""
    views = events.where("event = 'view'")
    last = F.max_by(F.struct("k", "ts", "event_id"), F.struct("ts", "event_id")).alias("p")
    return views.groupBy("session").agg(last).select("session", F.col("p.k").alias("chap"), "p.ts", "p.event_id")


_POSITION = "session long, chap int, ts timestamp, event_id long"
_HELD = "chap int, ts timestamp, event_id long"


def session_positions(events: DataFrame, late: str = "1 hour", expiry: str = "7 days") -> DataFrame:
    """The chapter of each session whenever it changes, from a stream: update mode, one row per session that has moved in a batch.

    The last position of a session is kept state. It is dropped when the watermark, ``late`` behind the newest event, is ``expiry`` past it, so
    state grows with the sessions of that time and not with all there ever were. Events behind the watermark are dropped and counted; events before the one
    that is held change nothing. A session that comes back later starts anew. Views without a session are one session, as on a table; views without a time are dropped."""
    expiry_ms = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = held
        for rows in batches:
            # the last row by arrays: a sorted frame for each session and batch costs more than all else here
            at = np.lexsort((rows["event_id"].to_numpy(), rows["ts"].to_numpy()))[-1]
            k, ts, event_id = (rows[c].iat[at] for c in ("k", "ts", "event_id"))
            if best is None or (ts, event_id) > (best[1], best[2]):
                best = (None if pd.isna(k) else int(k), ts, int(event_id))
        if best is not held:
            state.update(best)
            yield pd.DataFrame({"session": [key[0]], "chap": pd.array([best[0]], "Int32"), "ts": [best[1]], "event_id": [best[2]]})
        # not before the watermark, which a time-out must not lie behind
        state.setTimeoutTimestamp(max(int(best[1].timestamp() * 1000) + expiry_ms, state.getCurrentWatermarkMs() + 1))

    # all events move the watermark, so the filter looks at the time too and stays above it
    views = events.withWatermark("ts", late).where(F.when(F.col("ts").isNotNull(), F.col("event")) == "view")
    return views.groupBy("session").applyInPandasWithState(update, _POSITION, _HELD, "update", GroupStateTimeout.EventTimeTimeout)


def positions(spark: SparkSession, out: str) -> DataFrame:
    """What ``session_positions`` has put out, the latest position of each session. Rows that a restart wrote twice do no harm."""
    changes = spark.read.schema(f"{_POSITION}, batch long").parquet(out)
    last = F.max_by(F.struct("chap", "ts", "event_id"), F.struct("ts", "event_id")).alias("p")
    return changes.groupBy("session").agg(last).select("session", "p.chap", "p.ts", "p.event_id")


def stream_debounce(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """The last event of each burst of a session, bursts being apart by ``gap``.

    On a stream give ``late``: a burst is put out, in append mode, and its state dropped when the watermark, that far behind the newest event, has
    passed its end; later events of it are dropped and counted. On a table leave it out."""
    events = events.withWatermark("ts", late) if late else events
    burst = events.groupBy("session", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events")).select("session", "event_id", "n_events")


def stream_click_definition(events: DataFrame, x: DataFrame) -> DataFrame:
    """Number clicks with the H entries of the number, null where it has none."""
    entries = x.where("dic_type = 1").select(F.col("num").alias("k"), "sn", "orig")
    return events.where("event = 'click'").join(entries, "k", "left").select("event_id", F.col("k").alias("num"), "sn", "orig")

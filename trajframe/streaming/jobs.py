"""Structured Streaming jobs over frame telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", c("ts").cast("timestamp"))


def windowed_errors(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean absolute value a window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("value")).alias("mae"))


def matched(real: DataFrame, synth: DataFrame, late: str = "2 hours") -> DataFrame:
    """Stream-stream match of frames on (user_id, event_id) within the watermark; unmatched real frames come with nulls."""
    a = real.withWatermark("ts", late).select("user_id", "event_id", c("ts").alias("real_ts"), c("value").alias("real_value"))
    b = synth.withWatermark("ts", late).select(c("user_id").alias("s_user"), c("event_id").alias("s_event"), c("ts").alias("synth_ts"), c("value").alias("synth_value"))
    return a.join(b, (c("user_id") == c("s_user")) & (c("event_id") == c("s_event")) & (c("synth_ts") >= c("real_ts")) & (c("synth_ts") <= c("real_ts") + F.expr("interval 1 hour")), "left_outer").drop("s_user", "s_event")


def matched_to_end(spark: SparkSession, real: DataFrame, synth: DataFrame, name: str, folder: str, late: str = "2 hours") -> DataFrame:
    """:func:`matched` over all that is there, and to its end: every real frame comes out, with nulls where no other met it.

    An outer join gives an unmatched row when the watermark has passed the last moment at which its match could come,
    which it never does for the newest rows of a stream that just stops. Both sides therefore carry a closing row, far
    ahead of all others and of user ``NOBODY``, that comes after everything else. A frame later than ``late`` behind the newest
    of its side is dropped by the engine, matched or not.
    """
    a, b = with_closing(spark, real, f"{folder}/closing-a"), with_closing(spark, synth, f"{folder}/closing-b")
    stream = matched(a, b, late)
    drained(spark, stream, name, folder)
    close(spark, real, f"{folder}/closing-a", ["user_id", "event_id"])
    close(spark, synth, f"{folder}/closing-b", ["user_id", "event_id"])
    return drained(spark, stream, name, folder).where(~c("user_id").eqNullSafe(F.lit(NOBODY)))


#: The time of closing rows, and the key that they have: no user, but not null, as a join filters null keys out before
#: the watermark sees them.
END, NOBODY = "2200-01-01 00:00:00", -(1 << 63)


def with_closing(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """The stream, and beside it whatever files come into a folder that is empty now."""
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def close(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], ts: str = "ts") -> None:
    """One row of ``NOBODY`` at the end of time, null in all else: what waits for the watermark comes out after it."""
    value = {ts: F.lit(END)} | {k: F.lit(NOBODY) for k in keys}
    row = spark.range(1).select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.coalesce(1).write.mode("append").parquet(path)


def drained_to_end(spark: SparkSession, stream: DataFrame, job, name: str, folder: str, key: str = "run") -> DataFrame:
    """Run ``job`` over a stream and a closing row after it, so that all waiting rows come out and all state expires.

    ``key`` is the stream's key, and a column of what the job gives.
    """
    out = job(with_closing(spark, stream, f"{folder}/closing"))
    drained(spark, out, name, folder)
    close(spark, stream, f"{folder}/closing", [key])
    return drained(spark, out, name, folder).where(~c(key).eqNullSafe(F.lit(NOBODY)))


#: What a run keeps: how many frames it has, and its earliest ones in order, as many as its results look at.
EARLIEST_STATE = "frames long, newest long, ts array<long>, ids array<long>, vals array<double>"
TRACK_OUT = "run long, frames long, active long, started long, closest double"


#: How long after its newest event a run's state is kept, and how far behind the newest a row may come.
IDLE_S, LATE = 7 * 86_400, "7 days"


def _earliest(batches: Iterator[pd.DataFrame], state: GroupState, most: int) -> tuple[int, list[float]]:
    """(frames, values of the earliest ``most`` frames): the same however a run is cut into chunks and triggers."""
    frames, newest, *held = state.get if state.exists else (0, 0, [], [], [])
    if state.exists and newest + 1000 * IDLE_S < state.getCurrentWatermarkMs():  # what its timer would have done
        frames, newest, held = 0, 0, [[], [], []]
    ts, ids, values = (np.array(x, t) for x, t in zip(held, ("int64", "int64", "float64"), strict=True))
    for pdf in batches:
        frames += len(pdf)
        newest = max(newest, int(pdf["ms"].max()))
        when = pdf["ts"].astype("int64").where(pdf["ts"].notna(), np.iinfo("int64").max)
        ts, ids, values = (np.concatenate([x, y.to_numpy(x.dtype)]) for x, y in ((ts, when), (ids, pdf["event_id"]), (values, pdf["value"])))
        order = np.lexsort((ids, ts))[:most]
        ts, ids, values = ts[order], ids[order], values[order]
    state.update((frames, newest, ts.tolist(), ids.tolist(), values.tolist()))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1000 * IDLE_S)
    return frames, values.tolist()


def _timed(events: DataFrame) -> DataFrame:
    """Rows with a time; ``ms`` is that time as timers count it."""
    return events.where("ts is not null").select(c("user_id").alias("run"), "ts", F.unix_millis("ts").alias("ms"), "event_id", "value").withWatermark("ts", LATE)


def _track(trigger: int, duration: int, closing: float, least: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        frames, values = _earliest(batches, state, trigger + duration + 1)
        closest = 1e9
        for k, distance in enumerate(values[trigger:]):
            closest = min(closest, max(least, distance - closing * k))
        active = len(values[trigger:])
        yield pd.DataFrame({"run": [key[0]], "frames": [frames], "active": [active], "started": [trigger if active else -1], "closest": [closest]})

    return step


def track_lifecycle(events: DataFrame, trigger: int = 50, duration: int = 100, closing: float = 0.2, least: float = 4.0) -> DataFrame:
    """State by run: a track starts at frame ``trigger``, lasts ``duration`` frames and closes in; one row an update.

    A run's state goes when nothing has come for ``IDLE_S``; a run that returns after that starts anew."""
    return _timed(events).groupBy("run").applyInPandasWithState(_track(trigger, duration, closing, least), TRACK_OUT, EARLIEST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


STOPPED_OUT = "run long, frames long, started long, place double, active long, distance double"


def _stopped(trigger: int, duration: int, ahead: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        frames, values = _earliest(batches, state, trigger + duration + 1)
        seen = values[trigger:]
        place = seen[0] + ahead if seen else 0.0
        distance = abs(place - seen[-1]) if seen else -1.0
        yield pd.DataFrame({"run": [key[0]], "frames": [frames], "started": [trigger if seen else -1], "place": [place], "active": [len(seen)], "distance": [distance]})

    return step


def stopped_track(events: DataFrame, trigger: int = 50, duration: int = 100, ahead: float = 30.0) -> DataFrame:
    """State by run: an object placed ``ahead`` of the ego at frame ``trigger`` stays there; its distance is measured anew each frame.

    State goes as in :func:`track_lifecycle`."""
    return _timed(events).groupBy("run").applyInPandasWithState(_stopped(trigger, duration, ahead), STOPPED_OUT, EARLIEST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote: files for append, batches of updates for update."""
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")

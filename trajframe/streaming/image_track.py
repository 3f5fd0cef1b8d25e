"""An image-space track kept in streaming state: smoothed road centre, trigger, restart after a gap, eased approach.

A recursion needs its frames in order, a stream gives them in any. Rows therefore wait in their run's state until the
watermark has passed them, which is when no earlier row can come any more, and are then taken in order of time and id.
Rows that come later than ``late`` behind the newest are dropped by the engine. An event-time timer wakes a run for its
waiting rows, and another one removes its state once the watermark is ``idle`` past its last row. A row that comes more
than ``idle`` after the one before it starts its run anew at frame 0, whether the state is still there or not. State per
run is a dozen numbers and the rows of at most ``late``. Runs share the state of one of ``LOTS`` lots: a call from the
engine costs milliseconds, so that a state of each run's own would cost far more than the rows of short runs.

Rows without a time cannot be ordered and are left out. A row without a centre is one in which no lane was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajframe.streaming.jobs import NOBODY

c = F.col


@dataclass(frozen=True)
class TrackSettings:
    """When a track starts, how long it lasts, where it goes in the image and how it follows the road."""

    trigger: int = 50
    duration: int = 100
    repeat: bool = True
    gap: int = 30
    width: float = 1280.0
    height: float = 720.0
    centre: float = 0.5
    spawn: float = 0.55
    target: float = 0.88
    smoothing: float = 0.75
    relaxing: float = 0.97
    base_gain: float = 0.12
    confidence_gain: float = 0.35
    least_gain: float = 0.05
    most_gain: float = 0.55


#: Over how many states runs are dealt by their hash; fixed, as a stream's state outlives its program.
LOTS = 1024
#: By run: its number and the track's numbers; by waiting row: its run and its own.
STATE = "runs array<long>, frames array<long>, last array<long>, road array<double>, started array<long>, finished array<long>, age array<long>, start_u array<double>, target_u array<double>, of array<long>, at array<long>, ids array<long>, centres array<double>, confidences array<double>"
OUT = "run long, at long, event_id long, frame long, active boolean, reason string, road double, confidence double, progress double, age long, u double, v double"


class Track:
    """One run's recursion; frames come in order."""

    def __init__(self, s: TrackSettings, held: tuple | None = None):
        self.s = s
        self.frames, self.last, self.road, self.started, self.finished, self.age, self.start_u, self.target_u = held or (0, 0, s.width * s.centre, -1, -1, 0, 0.0, 0.0)

    def held(self) -> tuple:
        return self.frames, self.last, self.road, self.started, self.finished, self.age, self.start_u, self.target_u

    def step(self, centre: float, confidence: float) -> tuple:
        """(frame, active, reason, road, confidence, progress, age, u, v) of the next frame."""
        s, frame = self.s, self.frames
        self.frames += 1
        if math.isnan(centre):  # no lane: back to the default, slowly
            confidence, self.road = 0.0, s.relaxing * self.road + (1.0 - s.relaxing) * (s.width * s.centre)
        else:
            confidence = 0.0 if math.isnan(confidence) else confidence
            self.road = s.smoothing * self.road + (1.0 - s.smoothing) * centre
        if self.started < 0 and frame >= s.trigger and (self.finished < 0 or (s.repeat and frame - self.finished >= s.gap)):
            self.started, self.age, self.start_u, self.target_u = frame, 0, self.road, self.road
        if self.started < 0:
            return frame, False, "waiting_for_trigger", self.road, confidence, None, None, None, None
        if frame - self.started > s.duration:
            self.finished = frame
            self.started = -1 if s.repeat else self.started
            return frame, False, "duration_finished", self.road, confidence, None, None, None, None
        self.age += 1
        progress = min(self.age / max(1, s.duration), 1.0)
        eased = progress * progress
        u = self.target_u if progress >= 1.0 else self.start_u + eased * (self.target_u - self.start_u)
        v = s.height * s.target if progress >= 1.0 else s.height * s.spawn + eased * (s.height * s.target - s.height * s.spawn)
        gain = max(s.least_gain, min(s.base_gain + s.confidence_gain * confidence, s.most_gain))
        u = (1.0 - gain) * u + gain * self.road
        self.target_u = (1.0 - gain) * self.target_u + gain * self.road
        self.start_u = 0.98 * self.start_u + 0.02 * self.road
        return frame, True, None, self.road, confidence, progress, self.age, u, v


def _stepper(settings: TrackSettings, idle_ms: int):
    names = [x.split()[0] for x in OUT.split(", ")]

    kinds = {"run": np.int64, "at": np.int64, "event_id": np.int64, "centre": np.float64, "confidence": np.float64}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, *held = state.get[:9] if state.exists else [[]] * 9
        tracks = {run: Track(settings, numbers) for run, *numbers in zip(runs, *held, strict=True)}
        waiting = [np.array(x, t) for x, t in zip(state.get[9:] if state.exists else [[]] * 5, kinds.values(), strict=True)]
        nameless = key[0] == NAMELESS
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf.assign(run=0) if nameless else pdf
                waiting = [np.concatenate([x, pdf[n].to_numpy(x.dtype, na_value=np.nan) if x.dtype == np.float64 else pdf[n].to_numpy(x.dtype)]) for x, n in zip(waiting, kinds, strict=True)]
        mark_ms = max(0, state.getCurrentWatermarkMs())
        order = np.lexsort((waiting[2], waiting[1], waiting[0]))
        waiting = [x[order] for x in waiting]
        ripe = waiting[1] <= mark_ms * 1000
        out = []
        for run, now, event, centre, confidence in zip(*[x[ripe].tolist() for x in waiting], strict=True):
            track = tracks.get(run)
            if track is None or (track.frames and now - track.last > idle_ms * 1000):
                track = tracks[run] = Track(settings)
            track.last = now
            out.append((None if nameless else run, now, event, *track.step(centre, confidence)))
        waiting = [x[~ripe] for x in waiting]
        # A lot wakes for its first run that has rows to let out or has been silent for long enough to go.
        new, first = np.unique(waiting[0], return_index=True)
        wakes = dict(zip(new.tolist(), (waiting[1][first] // 1000 + 1).tolist(), strict=True))
        tracks = {run: t for run, t in tracks.items() if run in wakes or t.last // 1000 + idle_ms > mark_ms}
        wakes = {run: t.last // 1000 + idle_ms for run, t in tracks.items()} | wakes
        tracks |= {run: Track(settings) for run in wakes if run not in tracks}
        if tracks:
            state.update(([*tracks], *[list(x) for x in zip(*[t.held() for t in tracks.values()], strict=True)], *[x.tolist() for x in waiting]))
            state.setTimeoutTimestamp(max(min(wakes.values()), mark_ms + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names).astype({"run": "Int64", "age": "Int64"})

    return step


#: The lot of rows that name no run; the closing row's is its own number.
NAMELESS = -1


def image_track(frames: DataFrame, settings: TrackSettings = TrackSettings(), late: str = "2 hours", idle_s: int = 7 * 86_400) -> DataFrame:
    """A row a frame of a stream (run, ts, event_id, centre, confidence), in append mode: the track's state and image point.

    Columns as in ``OUT``, ``at`` being microseconds since 1970. Progress, age, u and v are null while no track is active.
    """
    rows = frames.where("ts is not null").select("run", "ts", F.unix_micros("ts").alias("at"), "event_id", c("centre").cast("double").alias("centre"), c("confidence").cast("double").alias("confidence"))
    lot = F.when(c("run").isNull(), F.lit(NAMELESS)).when(c("run") == NOBODY, c("run")).otherwise(F.pmod(F.xxhash64("run"), F.lit(LOTS)))
    return rows.withColumn("lot", lot.cast("long")).withWatermark("ts", late).groupBy("lot").applyInPandasWithState(_stepper(settings, idle_s * 1000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def image_box(u: Column, v: Column, s: TrackSettings = TrackSettings(), horizon: float = 0.45, widths: tuple[float, float] = (70.0, 520.0), heights: tuple[float, float] = (55.0, 430.0), power: float = 1.4) -> dict[str, Column]:
    """The whole-pixel box around an image point, as large as its row says, inside the image; nulls where nothing is left."""
    sky = s.height * horizon
    near = F.least(F.greatest((v - sky) / max(1.0, s.height - sky), F.lit(0.0)), F.lit(1.0))
    scale = F.pow(near, F.lit(power))
    w, h = widths[0] + scale * (widths[1] - widths[0]), heights[0] + scale * (heights[1] - heights[0])
    inside = lambda x, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), x))
    box = {"x1": inside(u - w / 2.0, s.width), "y1": inside(v - h / 2.0, s.height), "x2": inside(u + w / 2.0, s.width), "y2": inside(v + h / 2.0, s.height)}
    ok = (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    return {k: F.when(ok, x.cast("int")) for k, x in box.items()}

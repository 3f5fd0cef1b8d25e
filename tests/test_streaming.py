"""Streaming states against plain sorting, however the rows are cut into chunks and triggers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajframe.streaming import image_track, jobs

MICRO = 1_000_000


@pytest.fixture
def small_chunks(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    yield
    spark.conf.set(key, before)


def events(spark, folder, parts):
    """Parts of (user_id, second, event_id, value), one file and trigger each, as a stream; no time is at or before 1970, where watermarks begin."""
    schema = "user_id long, sec long, event_id long, value double"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    return stream.selectExpr("user_id", "timestamp_seconds(sec + 1000000) as ts", "event_id", "value")


def test_tracks_do_not_depend_on_chunks_and_triggers(spark, tmp_path, small_chunks):
    g = np.random.default_rng(4)
    rows = [(u, int(t), 1000 * u + k, float(v)) for u, n in ((1, 400), (2, 120), (3, 51), (4, 20)) for k, (t, v) in enumerate(zip(g.integers(0, n // 2, n), g.normal(60, 30, n), strict=True))]
    mixed = [rows[k] for k in g.permutation(len(rows))]
    parts = [mixed[:300], mixed[300:]]
    got = {}
    for name, job in (("track", jobs.track_lifecycle), ("stopped", jobs.stopped_track)):
        out = jobs.drained(spark, job(events(spark, f"{tmp_path}/{name}", parts)), f"t_{name}", f"{tmp_path}/{name}", "update")
        for r in out.orderBy("frames").collect():
            got[name, r.run] = r
    for u in (1, 2, 3, 4):
        values = [v for *_, v in sorted((t, e, v) for w, t, e, v in rows if w == u)]
        seen = values[50:151]
        a, b = got["track", u], got["stopped", u]
        assert a.frames == b.frames == len(values) and a.active == b.active == len(seen) and a.started == b.started == (50 if seen else -1)
        assert a.closest == pytest.approx(min((max(4.0, v - 0.2 * k) for k, v in enumerate(seen)), default=1e9))
        assert (b.place, b.distance) == pytest.approx((seen[0] + 30, abs(seen[0] + 30 - seen[-1])) if seen else (0.0, -1.0))


# Outer match, and the image track


def stream_of(spark, folder, parts, schema="user_id long, sec double, event_id long, value double", per_trigger=1):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/part=*")
    return stream.withColumn("ts", F.timestamp_micros(((F.col("sec") + 1e6) * 1e6).cast("long"))).drop("sec")


def test_match_returns_unmatched_frames(spark, tmp_path):
    real = [(1, 60.0 * k, k, float(k)) for k in range(40)]
    synth = [(1, 60.0 * k + 300, k, k + 1.0) for k in range(40) if k % 4] + [(1, 60.0 * 4 + 7200, 4, 0.0), (2, 5.0, 1, 9.0)]
    a, b = stream_of(spark, f"{tmp_path}/a", [real[20:], real[:20]]), stream_of(spark, f"{tmp_path}/b", [synth[:15], synth[15:]])
    out = jobs.matched_to_end(spark, a, b, "match", f"{tmp_path}/run", late="10 hours").collect()
    assert sorted((r.event_id, r.synth_value) for r in out) == [(k, k + 1.0 if k % 4 else None) for k in range(40)]


def test_match_drops_late_frames_only(spark, tmp_path):
    """A file behind the watermark is late: neither it nor a null for it comes out; the rest is whole."""
    now, old = [(1, 1e6 + k, k, 1.0) for k in range(5)], [(1, 1.0 + k, 100 + k, 1.0) for k in range(3)]
    a = stream_of(spark, f"{tmp_path}/a", [now, [(1, 1e6 + 50, 7, 1.0)], old])
    b = stream_of(spark, f"{tmp_path}/b", [[(1, 1e6 + 1, 1, 5.0)], [(1, 1e6 + 60, 60, 5.0)], [(1, 1e6 + 61, 61, 5.0)]])
    out = jobs.matched_to_end(spark, a, b, "late", f"{tmp_path}/run", late="1 hour").collect()
    assert sorted((r.event_id, r.synth_value) for r in out) == [(0, None), (1, 5.0), (2, None), (3, None), (4, None), (7, None)]


SETTINGS = image_track.TrackSettings(trigger=6, duration=9, gap=4)
SEEN = "run long, sec double, event_id long, centre double, confidence double"


def seen_rows(seed=2):
    g = np.random.default_rng(seed)
    return [(r, float(np.round(t, 3)), 1000 * r + k, None if g.random() < 0.25 else float(g.normal(640, 90)), None if g.random() < 0.1 else float(g.random())) for r, n in ((1, 90), (2, 30), (3, 4)) for k, t in enumerate(g.uniform(0, 500, n))]


def track_of(rows):
    """The recursion over whole sorted runs, without any state."""
    out = {}
    for run in {r[0] for r in rows}:
        t = image_track.Track(SETTINGS)
        for _, sec, e, x, conf in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            out[run, e] = t.step(float("nan") if x is None else x, float("nan") if conf is None else conf)
    return out


@pytest.mark.parametrize("cut", [1, 3, 8])
def test_image_track_does_not_depend_on_order_or_cuts(spark, tmp_path, small_chunks, cut):
    rows = seen_rows()
    mixed = [rows[k] for k in np.random.default_rng(cut).permutation(len(rows))]
    parts = [mixed[k::cut] for k in range(cut)]
    out = jobs.drained_to_end(spark, stream_of(spark, f"{tmp_path}/in", parts, SEEN), lambda s: image_track.image_track(s, SETTINGS, late="1 hour"), "image", f"{tmp_path}/run")
    got = {(r.run, r.event_id): (r.frame, r.active, r.reason, r.road, r.confidence, r.progress, r.age, r.u, r.v) for r in out.collect()}
    want = track_of(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:3] == w[:3] and got[k][3:] == pytest.approx(w[3:]), k
    reasons = [w[2] for k, w in sorted(want.items()) if k[0] == 1]
    assert reasons.count("duration_finished") >= 2  # it finishes, waits and starts again


def test_image_track_state_expires(spark, tmp_path):
    """Rows wait for the watermark; a silent run leaves the state and starts anew if it returns."""
    day = 86_400.0
    parts = [[(1, float(k), k, 600.0, 0.5) for k in range(8)], [(2, 20 * day, 50, 600.0, 0.5)], [(1, 21 * day + k, 100 + k, 600.0, 0.5) for k in range(3)], [(3, 22 * day, 51, 1.0, 0.5)]]
    stream = stream_of(spark, f"{tmp_path}/in", parts, SEEN)
    job = lambda s: image_track.image_track(s, SETTINGS, late="1 hour", idle_s=86_400)
    out = jobs.drained_to_end(spark, stream, job, "expiry", f"{tmp_path}/run")
    frames = {r.event_id: r.frame for r in out.collect()}
    assert frames == {**{k: k for k in range(8)}, 50: 0, 100: 0, 101: 1, 102: 2, 51: 0}
    left = spark.read.format("statestore").load(f"{tmp_path}/run/checkpoint").collect()
    assert all(r.key[0] == jobs.NOBODY for r in left)  # only the closing row waits


def test_track_state_expires(spark, tmp_path):
    day = 86_400
    parts = [[(1, k, k, 9.0) for k in range(60)], [(2, 30 * day, 0, 1.0)], [(2, 31 * day, 1, 1.0)]]
    out = jobs.drained(spark, jobs.track_lifecycle(events(spark, f"{tmp_path}/t", parts)), "t_expiry", f"{tmp_path}/t", "update")
    assert {(r.run, r.frames) for r in out.collect()} == {(1, 60), (2, 1), (2, 2)}
    left = spark.read.format("statestore").load(f"{tmp_path}/t/checkpoint").collect()
    assert {r.key[0] for r in left} == {2}


def test_image_boxes(spark):
    b = image_track.image_box(F.col("u"), F.col("v"))
    rows = spark.createDataFrame([(640.0, 720 * 0.88), (640.0, 100.0), (-900.0, 600.0)], "u double, v double").select(*[x.alias(k) for k, x in b.items()]).collect()
    near = ((720 * 0.88 - 324) / (720 - 324)) ** 1.4
    w, h = 70 + near * 450, 55 + near * 375
    assert tuple(rows[0]) == (int(640 - w / 2), int(720 * 0.88 - h / 2), int(640 + w / 2), min(719, int(720 * 0.88 + h / 2)))
    assert rows[1].x2 - rows[1].x1 == 70 and rows[2].x1 is None


def test_image_track_runs_share_states(spark, tmp_path, monkeypatch):
    """Runs share their lot's state and timer and keep apart; before, each had a state and calls of its own."""
    monkeypatch.setattr(image_track, "LOTS", 1)
    rows = seen_rows(5) + [(None, 3.0, 9001, 600.0, 0.5), (None, 4.0, 9002, 610.0, 0.5)]
    stream = stream_of(spark, f"{tmp_path}/in", [rows], SEEN)
    out = jobs.drained(spark, image_track.image_track(stream, SETTINGS, late="1 hour"), "lots", f"{tmp_path}/run")
    assert out.count() == 0  # all wait for the watermark
    assert spark.read.format("statestore").load(f"{tmp_path}/run/checkpoint").count() == 2  # one lot, and the rows without a run

"""Scenario documents, their rules, the resolver and requests: files as they are written by hand, and edge rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trajframe.operators import scenarios
from trajframe.sources import folders
from trajframe.sources import scenarios as documents


def spec(**over):
    doc = {
        "schema_version": "2.0", "scenario_id": "s1", "duration_s": 2.0, "fps": 5, "ego": {"motion": {"mode": "maneuver", "maneuver": "straight", "speed_mps": 5.0}},
        "actors": [
            {"actor_id": "m", "spawn": {"x_m": 10, "y_m": 1, "yaw_deg": 90}, "motion": {"mode": "maneuver", "maneuver": "following", "speed_mps": 2, "start_time_s": 0.4, "duration_s": 1}},
            {"actor_id": "p", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "path", "target_speed_mps": 3, "waypoints": [{"x_m": 4, "y_m": 1}, {"x_m": 4, "y_m": 1}, {"x_m": 8, "y_m": 0}]}},
            {"actor_id": "k", "spawn": {"x_m": 1, "y_m": 1, "yaw_deg": 170}, "lifecycle": {"spawn_time_s": 0.5, "despawn_time_s": 1.5}, "motion": {"mode": "keyframes", "keyframes": [{"t_s": 1.0, "x_m": 3, "y_m": 1, "yaw_deg": -170}, {"t_s": 1.4, "x_m": 3, "y_m": 5, "yaw_deg": -90}]}},
        ],
    }
    return doc | over


@pytest.fixture
def folder(tmp_path):
    def put(*docs):
        for n, d in enumerate(docs):
            (tmp_path / f"{n}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=2))
        return f"file://{tmp_path}"

    return put


def resolved(spark, path):
    raw = documents.read_documents(spark, path)
    frames, outcome = scenarios.resolve_scenarios(documents.scenario_actors(documents.typed_scenarios(raw)))
    return frames, {(r.scenario_id, r.actor_id): (r.frames, r.error) for r in outcome.collect()}, raw


def test_motions_are_one_struct_a_kind(spark, folder):
    got = documents.read_scenarios(spark, folder(spec())).first()
    assert got.ego.actor_id == "ego" and got.ego.spawn.x_m == 0.0 and got.camera.image_width == 1280 and got.seed == 0
    m, p, k = (a.motion for a in got.actors)
    assert m.maneuver.start_time_s == 0.4 and m.path is None and m.keyframes is None
    assert p.path.interpolation == "smooth" and len(p.path.waypoints) == 3 and p.maneuver is None
    assert k.keyframes.interpolation == "linear" and k.path is None
    assert got.actors[0].role == "adversary" and got.actors[2].lifecycle.despawn_time_s == 1.5


def test_unknown_tags_and_broken_files_are_faults(spark, folder):
    odd = spec(scenario_id="s2", actors=[{"actor_id": "x", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "warp"}}, {"actor_id": "y", "spawn": {"x_m": 0, "y_m": 0}}], ego={"motion": {"mode": "drift"}})
    raw = documents.read_documents(spark, folder(spec(), odd, '{"scenario_id": "s3", '))
    faults = {(r.scenario_id, r.actor_id, r.fault) for r in documents.scenario_faults(raw).collect()}
    assert {f[1:] for f in faults if f[0] == "s2"} == {("ego", "unknown motion: drift"), ("x", "unknown motion: warp"), ("y", "unknown motion: none")}
    assert [f[2] for f in faults if f[1] is None] == ["unreadable document"]
    assert {r.scenario_id for r in documents.typed_scenarios(raw).collect()} == {"s1", "s2"}


def test_resolver_covers_all_motions_and_actors(spark, folder):
    bad = spec(scenario_id="s2")
    bad["actors"] += [
        {"actor_id": "cut", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "maneuver", "maneuver": "cut_in"}},
        {"actor_id": "point", "spawn": {"x_m": 4, "y_m": 1}, "motion": {"mode": "path", "target_speed_mps": 3, "waypoints": [{"x_m": 4, "y_m": 1}]}},
        {"actor_id": "late", "spawn": {"x_m": 4, "y_m": 1}, "lifecycle": {"spawn_time_s": 0.05, "despawn_time_s": 0.1}, "motion": {"mode": "maneuver", "maneuver": "static"}},
        {"actor_id": "early", "spawn": {"x_m": 0, "y_m": 0}, "lifecycle": {"spawn_time_s": 1.0}, "motion": {"mode": "keyframes", "keyframes": [{"t_s": 0.5, "x_m": 0, "y_m": 0, "yaw_deg": 0}]}},
        {"actor_id": "twice", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "maneuver", "maneuver": "static"}},
        {"actor_id": "twice", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "maneuver", "maneuver": "static"}},
    ]
    frames, outcome, _ = resolved(spark, folder(spec(), bad))
    assert outcome[("s1", "ego")] == (11, None) and outcome[("s1", "m")] == (11, None) and outcome[("s1", "p")] == (11, None)
    assert outcome[("s1", "k")] == (5, None)  # frames at 0.6 to 1.4
    said = {k[1]: v for k, v in outcome.items() if k[0] == "s2"}
    assert said["cut"] == (0, "unresolved maneuver: cut_in") and said["point"] == (0, "path has less than two points") and said["late"] == (0, "never alive at a frame")
    assert said["early"] == (0, "keyframes: before_spawn") and said["twice"] == (0, "actor_id repeats")
    at = {(r.actor_id, r.frame): r for r in frames.where("scenario_id = 's1'").collect()}
    assert at["ego", 10].x == pytest.approx(10.0) and at["ego", 10].speed_mps == pytest.approx(5.0)
    assert at["m", 2].y == pytest.approx(1.0) and at["m", 5].y == pytest.approx(2.2) and at["m", 10].y == pytest.approx(3.0) and at["m", 10].speed_mps == 0
    # Between the spawn at 0.5 s and the first keyframe at 1 s, then on to the next.
    assert at["k", 4].x == pytest.approx(1 + 2 * 0.6) and at["k", 4].yaw == pytest.approx(-178.0) and at["k", 6].y == pytest.approx(1 + 4 * 0.5) and at["k", 6].yaw == pytest.approx(-130.0)
    assert set(f for a, f in at if a == "k") == {3, 4, 5, 6, 7}


def test_smooth_paths_pass_their_waypoints(spark, folder):
    frames, _, _ = resolved(spark, folder(spec(fps=50, duration_s=4.0, actors=spec()["actors"][1:2])))
    rows = frames.where("actor_id = 'p'").orderBy("frame").collect()
    way = [math.hypot(b.x - a.x, b.y - a.y) for a, b in zip(rows, rows[1:])]
    moving = [d for d in way if d > 1e-9]
    assert max(moving) == pytest.approx(3 / 50, rel=1e-2)  # speed along the path
    assert min(math.hypot(r.x - 4, r.y - 1) for r in rows) < 0.05
    assert (rows[-1].x, rows[-1].y, rows[-1].speed_mps) == pytest.approx((8.0, 0.0, 0.0), abs=1e-9)
    assert len(moving) == pytest.approx(2 * math.hypot(4, 1) / 3 * 50, abs=3)


def test_resolved_documents_round_trip(spark, folder, tmp_path):
    frames, _, raw = resolved(spark, folder(spec()))
    out = f"file://{tmp_path}/resolved"
    documents.write_documents(documents.resolved_documents(documents.typed_scenarios(raw), frames), out)
    docs = documents.read_documents(spark, out, documents.RESOLVED, lines=True)
    key = lambda r: (r.scenario_id, None if r.is_ego else r.actor_id, r.frame, r.t_s, r.x, r.y, r.yaw, r.speed_mps, r.vx, r.vy)
    assert {key(r) for r in documents.resolved_frames(docs).collect()} == {key(r) for r in frames.collect()}
    told = documents.actor_info_of_frames(docs)
    assert told.where("actor_type = 'vehicle'").count() == frames.where("not is_ego").count()


def test_no_scenarios(spark, folder):
    none = documents.typed_scenarios(documents.read_documents(spark, folder(spec()))).where("false")
    frames, outcome = scenarios.resolve_scenarios(documents.scenario_actors(none))
    assert frames.count() == 0 and outcome.count() == 0 and scenarios.scenario_violations(none, ["scenario_id"]).count() == 0


def test_rules_name_their_place(spark, folder):
    bad = spec(fps=0)
    bad["actors"][2]["motion"]["keyframes"] = [{"t_s": 1.8, "x_m": 0, "y_m": 0, "yaw_deg": 0}, {"t_s": 0.2, "x_m": 0, "y_m": 0}]
    bad["actors"][1]["spawn"] = {"y_m": 1}
    got = {(r["at"], r["rule"]) for r in scenarios.scenario_violations(documents.read_scenarios(spark, folder(bad)), ["scenario_id"]).collect()}
    assert got == {
        ("scenario", "fps is not positive"), ("actors[1]", "spawn position is missing"), ("actors[2].motion", "keyframes are not ordered"), ("actors[2].motion.keyframes[0]", "keyframe after lifetime"),
        ("actors[2].motion.keyframes[1]", "keyframe before spawn"), ("actors[2].motion.keyframes[1]", "keyframe field is missing"),
    }
    assert scenarios.scenario_violations(documents.read_scenarios(spark, folder(spec())), ["scenario_id"]).count() == 0


def test_factor_rules(spark):
    rows = spark.createDataFrame([(1, "cut_in", None, [], None), (2, "cut_in", None, ["left"], [1.0]), (3, "static", None, None, [])], "k int, scenario_type string, side string, sides array<string>, speeds array<double>")
    got = {(r.k, r.rule) for r in scenarios.factor_violations(rows, ["k"], ["sides", "speeds"]).collect()}
    assert got == {(1, "factor sides is empty"), (1, "side is required"), (3, "factor speeds is empty")}


def test_requests_have_a_scenario_or_an_error(spark):
    names = list(scenarios.REQUEST_DEFAULTS)
    row = lambda k, t, side=None, sid=None, **own: (k, t, sid, side, *[own.get(n) for n in names])
    asked = [row(1, "cut_in", "left"), row(2, "crossing"), row(3, "oncoming", None, "mine", lane_y_m=-2.0), row(4, "flying"), row(5, "cut_in", "up", cut_start_s=7.0), row(6, None), row(7, "static", start_distance_m=12.5)]
    df = spark.createDataFrame(asked, "k int, scenario_type string, scenario_id string, side string, " + ", ".join(f"{n} double" for n in names))
    good, bad = scenarios.scenarios_of_requests(df, ["k"])
    rows, errors = {r.k: r for r in good.collect()}, {}
    for r in bad.collect():
        errors.setdefault(r.k, set()).add(r.rule)
    assert set(rows) == {1, 3, 7} and errors == {2: {"side is required"}, 4: {"scenario type is unknown"}, 5: {"side is unknown", "cut ends after the scenario"}, 6: {"scenario type is unknown"}}
    assert rows[1].y0 == 3.5 and rows[1].scenario_id == "cut_in_left_d30_v4_v1" and rows[1].cut_s == 3.0 and rows[3].scenario_id == "mine" and rows[3].target_y == -2.0 and rows[7].scenario_id == "static_d12p5_v0_v1"
    assert "start_distance_m" not in rows[7].defaulted and "fps" in rows[7].defaulted
    own, _ = scenarios.scenarios_of_requests(df, ["k"], by_type=True)
    own = {r.k: r for r in own.collect()}
    assert own[2].yaw0 == 270.0 and own[2].y0 == -7.0 and own[2].x0 == 25.0 and "side" in own[2].defaulted and own[3].speed == 8.0 and own[3].x0 == 55.0


def test_frames_are_dealt_by_their_number(spark, folder, monkeypatch):
    """A task holds a bounded number of frames, whatever the session's number of shuffle partitions; before, four held all."""
    monkeypatch.setattr(folders, "TASK_ROWS", 5)
    frames, outcome, _ = resolved(spark, folder(*[spec(scenario_id=f"s{n}") for n in range(12)]))
    assert len(frames.inputFiles()) > 8
    assert frames.count() == sum(n for n, _ in outcome.values()) == 12 * (11 + 11 + 11 + 5)


def test_frames_meet_long_keyframes_and_paths(spark, folder):
    """Each frame lies in one piece of its motion, at pieces shorter than a frame, at their ends and past the last."""
    keys = [{"t_s": n / 7, "x_m": n, "y_m": -n, "yaw_deg": 0} for n in range(8)]
    ways = [{"x_m": n / 3, "y_m": 0} for n in range(1, 10)]
    late = {"spawn_time_s": 0.3}
    moved = [{"actor_id": "k", "spawn": {"x_m": 0, "y_m": 0}, "motion": {"mode": "keyframes", "keyframes": keys}}, {"actor_id": "p", "spawn": {"x_m": 0, "y_m": 0}, "lifecycle": late, "motion": {"mode": "path", "target_speed_mps": 2, "interpolation": "linear", "waypoints": ways}}]
    frames, _, _ = resolved(spark, folder(spec(actors=moved)))
    got = {(r.actor_id, r.frame): r.x for r in frames.where("not is_ego").collect()}
    want = {("k", f): min(7.0, 7 * f / 5) for f in range(11)} | {("p", f): min(3.0, 2 * (f / 5 - 0.3)) for f in range(2, 11)}
    assert got == pytest.approx(want)


def test_documents_are_dealt_by_their_frames(spark, folder, monkeypatch):
    """Documents are made by tasks of a bounded number of frames, and their actors are described without a shuffle."""
    frames, _, raw = resolved(spark, folder(*[spec(scenario_id=f"s{n}") for n in range(3)]))
    asked, deal = [], documents.bounded
    monkeypatch.setattr(documents, "bounded", lambda df, rows, *key: asked.append((rows, key)) or deal(df, rows, *key))
    docs = documents.resolved_documents(documents.typed_scenarios(raw), frames).withColumn("unparsed", F.lit(None).cast("string"))
    assert asked == [(3 * 38, ("scenario_id",))]
    told = documents.actor_info_of_frames(docs.where("scenario_id = 's1'").select("scenario_id", "unparsed", "actor_frames", F.filter("actors", lambda a: a["actor_id"] != "p").alias("actors")))
    assert {(r.actor_id, r.actor_type, r.n) for r in told.groupBy("actor_id", "actor_type").agg(F.count(F.lit(1)).alias("n")).collect()} == {("m", "vehicle", 11), ("p", None, 11), ("k", "vehicle", 5)}
    empty = spark.createDataFrame([], docs.schema)
    assert "Join" not in documents.actor_info_of_frames(empty)._jdf.queryExecution().analyzed().toString()

"""Core queries against their SQL in DuckDB, and edge rows that the given tables lack."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from trajframe import queries as core
from trajframe.functions import angles, boxes, geometry, rules
from trajframe.operators import checks, compare, lookup, maneuvers, motion
from trajframe.plans import datasets, exports, metadata
from trajframe.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = core.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    rows = lambda rs, cols: sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rs), key=repr)
    assert rows(found.fetchall(), names) == rows([tuple(r) for r in df.collect()], df.columns)


def test_yaw_ends(spark):
    df = spark.createDataFrame([(x,) for x in (-540.0, -180.0, 0.0, 180.0, 359.5, 540.0)], "a double")
    got = df.select(angles.wrap180(df.a), angles.wrap180_closed(df.a), angles.wrap360(df.a)).collect()
    assert [r[0] for r in got] == [-180, -180, 0, -180, -0.5, -180]
    assert [r[1] for r in got] == [-180, -180, 0, 180, -0.5, 180]
    assert [r[2] for r in got] == [180, 180, 0, 180, 359.5, 180]


def test_a_last_bit_below_a_turn_is_the_turn(spark):
    """A rounding outside must not give 180 or 360, which are no part of the range."""
    df = spark.createDataFrame([(math.nextafter(180.0, 0.0), math.nextafter(360.0, 0.0))], "a double, b double")
    assert tuple(df.select(angles.wrap180(df.a), angles.wrap360(df.b)).first()) == (-180.0, 0.0)


def test_not_finite_and_empty_boxes(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(angles.finite(df.a)).collect()] == [None, None, 1.0, None]
    z = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    b = {k: z[k] for k in z.columns}
    assert z.select(boxes.iou(b, b)).first()[0] == 0.0


def test_domain_order(spark):
    df = spark.createDataFrame([(9.0, -1.0), (9.0, 101.0), (0.0, 50.0), (-9.0, 50.0)], "x double, z double")
    got = df.select(rules.capability(df.x, df.z), rules.domain_reason(df.x, df.z)).collect()
    assert [tuple(r) for r in got] == [("CULLED", "x_above_max"), ("OOD", "x_above_max+z_above_max"), ("SUPPORTED", ""), ("OOD", "x_below_min")]


def test_single_frames_and_ties(spark):
    one = spark.createDataFrame([(1, 0, 1.0, 2.0)], "run long, frame long, x double, y double")
    assert motion.velocities(one, ["run"]).first().speed_mps == 0.0
    poses = spark.createDataFrame([(1, 0, 10.0), (1, 4, 20.0)], "run long, frame long, x double")
    probes = spark.createDataFrame([(1, 2), (1, 9), (1, 3)], "run long, frame long")
    got = {r.frame: r.pose_frame for r in motion.nearest_pose(probes, poses, "run", ["x"]).collect()}
    assert got == {2: 0, 9: 4, 3: 4}


def test_grid_nodes_give_stored_values(spark):
    axes = {"x": lookup.Axis(0, 1, 3), "z": lookup.Axis(0, 1, 3), "yaw": lookup.Axis(0, 10, 3)}
    nodes = [(x, z, y, float(x + 10 * z + 100 * y)) for x in range(3) for z in range(3) for y in range(3)]
    grid = spark.createDataFrame(nodes, "xi int, zi int, yawi int, w double")
    q = spark.createDataFrame([(float(x), float(z), y * 10.0, w) for x, z, y, w in nodes], "x double, z double, yaw double, k double")
    assert all(r.w == pytest.approx(r.k) for r in lookup.trilinear(q, ["k"], grid, axes, ["w"]).collect())


def test_invariants_see_both_sides(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0)], "case_id long, frame long, x double")
    b = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "case_id long, frame long, x double")
    got = {r.case_id: (r.only_a, r.only_b, r.verdict) for r in checks.invariants(a, b, ["case_id", "frame"], ["x"], ["case_id"]).collect()}
    assert got == {1: (1, 1, "FAIL"), 2: (0, 0, "PASS")}


def test_logs_and_results(spark, tmp_path):
    (tmp_path / "pose.jsonl").write_text('{"recorded_frame_idx": 1, "t_s": 0.1}\n\n{"recorded_frame_idx": 1}\n')
    log = io.read_pose_log(spark, f"file://{tmp_path}/pose.jsonl")
    assert [(r.recorded_frame_idx, r.t_s) for r in log.collect()] == [(1, None)]  # the last line holds
    assert io.repeated_frames(log.unionByName(log)).first().n == 2
    (tmp_path / "r.csv").write_text("Case,MAE_CX\n1, NaN \n2,2.5\n3,n/a\n")
    got = io.read_results_csv(spark, f"file://{tmp_path}/r.csv", {"case_id": ["case"], "mae": ["cx_mae", "mae_cx"], "none": ["zz"]}).collect()
    assert [(r.case_id, r.mae, r.none) for r in got] == [(1, None, None), (2, 2.5, None), (3, None, None)]
    reports = spark.createDataFrame([("a", "x = 1\nx = 2.5\n")], "path string, value string")
    r = io.parse_reports(reports, {"x": r"x = ([0-9.]+)", "y": r"y = ([0-9.]+)"}).first()
    assert (r.x, r.y) == (2.5, None)


def test_corner_box_edges(spark):
    df = spark.createDataFrame([(0.0, -9.0), (0.0, 10.0), (500.0, 10.0), (0.0, 5000.0), (None, 10.0)], "x double, z double")
    b = geometry.points_box(geometry.corner_points(df.x, df.z, df.z * 0.0, 4.0, 2.0, 1.5))
    got = [tuple(r) for r in df.select(*b.values()).collect()]
    nothing = (False, 0.0, 0.0, 0.0, 0.0)  # behind, beside the image, too small, unknown
    assert [got[i] for i in (0, 2, 3, 4)] == [nothing] * 4
    assert got[1] == (True, pytest.approx(560.0), pytest.approx(360 + 640 * 0.1 / 12), pytest.approx(720.0), pytest.approx(360 + 640 * 1.6 / 8))


def test_road_contact_ends_and_null(spark):
    df = spark.createDataFrame([(-1.0,), (15.0,), (17.5,), (45.0,), (99.0,), (None,)], "z double")
    road = [(45.0, 255.0), (15.0, 370.0), (20.0, 330.0)]
    assert [r[0] for r in df.select(geometry.road_contact(df.z, road)).collect()] == [370.0, 370.0, 350.0, 255.0, 255.0, None]


def test_gallery_of_small_keys(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, 1.0)] + [(3, i, float(i)) for i in range(9)], "key long, id long, err double")
    got = {k: [] for k in (1, 2, 3)}
    for r in sorted(datasets.gallery(rows, ["key"], "err", "id", 3).collect(), key=lambda r: (r.key, r.place)):
        got[r.key].append((r.part, r.id))
    assert got == {1: [("best", 1)], 2: [("best", 1), ("middle", 2)], 3: [("best", 0), ("middle", 4), ("worst", 8)]}


def test_violations_and_reasons(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "case_id long, speed double")
    got = checks.violations(rows, ["case_id"], {"slow": rows.speed < 10, "odd": rows.speed < 9}).collect()
    assert sorted(tuple(r) for r in got) == [(1, "odd"), (1, "slow")]
    d = spark.createDataFrame([(1, "CULLED", ""), (2, "OOD", "b"), (2, "OOD", "a"), (2, "OOD", "b"), (2, "SUPPORTED", "")], "actor long, class string, reason string")
    got = {r.actor: (r.active, r.reasons, r.supported_share) for r in compare.reasons_by_actor(d, ["actor"]).collect()}
    assert got == {1: (1, "", 1.0), 2: (4, "a:1,b:2", 0.25)}


def test_turn_without_duration(spark):
    rows = spark.createDataFrame([(1, 0, 3.0, 90.0), (1, 1, 3.0, 90.0)], "k long, frame long, speed double, turn double")
    got = motion.turning_ego(rows, ["k"], 0.0, 0.0).orderBy("frame").collect()
    assert [(r.yaw, r.x) for r in got] == [(0.0, 0.0), (0.0, pytest.approx(0.1))]


def test_keyframe_ends_and_faults(spark):
    keys = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 350.0), (1, 2.0, 10.0, 0.0, 10.0), (2, 0.0, 5.0, 5.0, 0.0), (3, -1.0, 0.0, 0.0, 0.0)], "run long, t_s double, x double, y double, yaw double")
    spawns = spark.createDataFrame([(r, 0.0, 0.0, 0.0, 0.0) for r in (1, 2, 3, 4)], "run long, start_s double, x double, y double, yaw double")
    faults = maneuvers.keyframe_faults(keys, spawns, "run").collect()
    assert sorted(tuple(r) for r in faults) == [(2, "spawn_mismatch"), (3, "before_spawn"), (4, "no_keyframes")]
    times = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.5, 2.0, 9.0)] + [(9, 0.0)], "run long, t_s double")
    whole = maneuvers.with_spawn(keys.where("run = 1"), spawns.where("run = 1"), "run")
    got = {r.t_s: (r.x, r.yaw, r.speed_mps) for r in maneuvers.keyframe_states(times, whole, "run", keys.run == -1).collect()}
    assert got == {-1.0: (0.0, 0.0, 0.0), 0.0: (0.0, 0.0, 0.0), 1.5: (5.0, 0.0, 10.0), 2.0: (10.0, 10.0, 0.0), 9.0: (10.0, 10.0, 0.0)}


def test_unknown_maneuver_and_missing_parameters(spark):
    given = spark.createDataFrame([("spin", 1.0), (None, 1.0), ("cut_in", 9.0)], "maneuver string, t_s double")
    rest = {"x0": 1.0, "y0": 3.0, "yaw0": 0.0, "speed": 2.0, "target_y": None, "target_x": None, "lane_y": None, "direction": None, "cut_start_s": None, "cut_s": None}
    rows = given.selectExpr("*", *[f"cast({'null' if v is None else v} as double) as {k}" for k, v in rest.items()])
    assert [(r.x, r.y, r.yaw) for r in maneuvers.rule_based(rows).collect()] == [(None, None, None), (None, None, None), (19.0, 0.0, 0.0)]


def test_pair_box_reasons(spark):
    df = spark.createDataFrame([(0.0, -9.0), (500.0, 10.0), (0.0, 10.0), (None, 10.0)], "x double, z double")
    b = geometry.pair_box(geometry.corner_points(df.x, df.z, df.z * 0.0, 4.0, 2.0, 1.5, 0.05))
    got = [tuple(r) for r in df.select(b["visible"], b["reason"], b["depth"]).collect()]
    assert got == [(False, "bbox_behind_camera", None), (False, "bbox_outside_image", 10.0), (True, None, 10.0), (False, "bbox_behind_camera", None)]


def test_exports_of_one_frame_and_of_none(spark):
    rows = spark.createDataFrame([(1, "a", 3, 1.0, None, 0.0, 0.0)], "scenario_id long, actor_id string, frame long, x double, y double, yaw double, speed double")
    for write, read in ((exports.execution_plan, exports.plan_frames), (exports.runtime_scenario, exports.runtime_frames)):
        back = read(write(rows)).collect()
        assert [(r.actor_id, r.frame, r.x, r.z) for r in back] == [("a", 3, None, 1.0)]
        assert read(write(rows.limit(0))).count() == 0


def test_far_behind_and_missing_keys(spark):
    rows = spark.createDataFrame([(1, 0, -25.0), (1, 1, -15.0), (2, 0, None)], "run long, frame long, x double")
    assert sorted(r.message for r in checks.far_behind(rows, ["run"]).collect()) == ["moves_far_behind", "starts_far_behind"]
    docs = spark.createDataFrame([(1, "a", (None,)), (2, None, None)], "id long, name string, camera struct<fov:double>")
    got = sorted(tuple(r) for r in checks.missing_keys(docs, ["id"], ["name", "camera.fov"]).collect())
    assert got == [(1, "missing camera.fov"), (2, "missing camera.fov"), (2, "missing name")]


def test_samples_do_not_depend_on_partitions(spark):
    draw = lambda n: sorted(tuple(r) for r in datasets.sampled_scenarios(spark.range(0, 400, 1, n), "id", {"m": (2, 4)}, {"w": ["a", "b"]}).collect())
    got = draw(1)
    assert got == draw(7) and all(2 <= m < 4 for _, m, _ in got) and {w for *_, w in got} == {"a", "b"}


def test_metadata_of_culled_and_unknown(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0), (1, 2, None, 9.0, 0.0), (1, 3, 0.0, 9.0, 0.0), (1, 4, 0.0, 20.0, 0.0)], "scene long, actor long, x double, z double, yaw double")
    got = {r.actor: (r.active, r.rendered, r.order_index) for r in metadata.frame_metadata(rows, ["scene"], ["actor"], 1.8, 1.5, 2.0).collect()}
    assert got == {1: (False, False, None), 2: (True, False, None), 3: (True, True, 1), 4: (True, True, 0)}


def test_entry_has_queries():
    assert set(core.oracle_sql()) <= set(__spark_entry__.queries())


def test_corners_box_is_pair_box_without_arrays(spark):
    """The same boxes from plain expressions; the query's plan calls no function over arrays, which are interpreted."""
    rows = [(0.0, -9.0, 0.0), (500.0, 10.0, 0.0), (0.0, 10.0, 30.0), (None, 10.0, 0.0), (1.0, 1.9, 45.0), (0.0, 0.05, 90.0), (-3.0, 2.0, 180.0), (float("nan"), 9.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, z double, yaw double")
    box = (4.5, 1.8, 1.5, 0.05)
    a, b = geometry.pair_box(geometry.corner_points(df.x, df.z, df.yaw, *box)), geometry.corners_box(geometry.corners(df.x, df.z, df.yaw, *box))
    got = [[tuple(map(plain, r)) for r in df.select(*[v.alias(k) for k, v in s.items()]).collect()] for s in (a, b)]
    assert got[0] == got[1] and len({r[1] for r in got[0]}) == 3
    assert "lambda" not in core.queries()["p19_pair_box"](spark, SF)._jdf.queryExecution().toString()

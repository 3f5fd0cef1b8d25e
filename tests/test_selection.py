"""Medians by histograms, smoothing by blocks, look-up by binary search, ordered logs and vectors against plain Python."""

import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajframe.operators import checks, lookup, motion, reports, resolve, selection
from trajframe.plans import datasets, features, metadata
from trajframe.sources import folders, io


def test_medians_are_exact(spark):
    g = np.random.default_rng(0)
    groups = {
        "normal": g.normal(0, 1, 5001), "even": g.normal(0, 1, 4000), "ties": np.repeat([1.0, 2.0, 3.0], [700, 1, 700]), "one": [7.5], "two": [1.0, 4.0], "same": np.full(3000, -2.5),
        "spread": np.concatenate([10.0 ** g.uniform(-300, 300, 2001), -(10.0 ** g.uniform(-300, 300, 2000))]), "huge": [-1.7e308, 1.7e308, 1.6e308, 0.0, -1.0], "tiny": [5e-324, 0.0, 1e-323, 5e-324, 2e-323], "none": [None, float("nan"), float("inf")],
    }
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0), (None, float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for few in (40, 4096):
        got = {r.k: r.median for r in selection.medians(df, ["k"], "v", bins=256, few=few).collect()}
        want = {k: vs for k, vs in groups.items() if k != "none"}
        assert set(got) == {*want, None} and got[None] == 1.5
        for k, vs in want.items():
            s = sorted(map(float, vs))
            low, high = s[(len(s) - 1) // 2], s[len(s) // 2]
            assert got[k] == low + (high - low) / 2, (k, few)


def test_described_keeps_metrics_without_values(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (4.0, None, 2.0)], "a double, b double, c double")
    got = {r.metric: r for r in checks.described(df, ["a", "b", "c"]).collect()}
    assert (got["a"].n, got["a"].median, got["a"].most) == (2, 2.5, 4.0) and (got["b"].n, got["b"].mean, got["b"].median) == (0, None, None) and (got["c"].n, got["c"].mean) == (1, 2.0)
    assert {(r.metric, r.n) for r in checks.described(df.where("false"), ["a", "b"]).collect()} == {("a", 0), ("b", 0)}


@pytest.mark.parametrize("block", [1, 3, 128])
def test_smoothing_equals_the_recursion(spark, block):
    g = np.random.default_rng(block)
    runs = {r: [(int(f), None if g.random() < 0.3 else float(g.normal(600, 50))) for f in np.cumsum(g.integers(1, 4 if r else 40, n))] for r, n in ((0, 60), (1, 300), (2, 1))}
    df = spark.createDataFrame([(r, f, v, "x") for r, rows in runs.items() for f, v in rows] + [(1, None, 5.0, "x")], "run long, frame long, v double, smooth string").repartition(4)
    got = {(r.run, r.frame): r.smooth for r in motion.smoothed(df, "run", "v", default=640.0, start=640.0, block=block).collect()}
    held = {(r.run, r.frame): r.smooth for r in motion.smoothed(df, "run", "v", block=block).collect()}
    assert len(got) == len(held) == sum(map(len, runs.values()))
    for r, rows in runs.items():
        s, t = 640.0, rows[0][1] if rows[0][1] is not None else 0.0
        for f, v in rows:
            s = 0.97 * s + 0.03 * 640.0 if v is None else 0.85 * s + 0.15 * v
            t = t if v is None else 0.85 * t + 0.15 * v
            assert got[r, f] == pytest.approx(s, abs=1e-9) and held[r, f] == pytest.approx(t, abs=1e-9)


def test_smoothing_needs_no_python(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "run long, frame long, v double")
    assert "Python" not in motion.smoothed(df, "run", "v")._jdf.queryExecution().executedPlan().toString()


def test_axis_bounds(spark):
    values = [-3.0, -1.0, 0.0, 0.5, 7.0]
    axis, ring = lookup.SortedAxis(values), lookup.CircularAxis()
    asked = [-9.0, -3.0, -2.0, -1.0, 0.25, 0.5, 3.75, 7.0, 8.0, None]
    rows = spark.createDataFrame([(v,) for v in asked], "v double").select("v", *[x.alias(n) for n, x in zip("abw", axis.bounds(F.col("v")), strict=True)]).collect()
    assert [(r.a, r.b, r.w) for r in rows] == [(0, 0, 0.0), (0, 0, 0.0), (0, 1, 0.5), (1, 2, 0.0), (2, 3, 0.5), (3, 4, 0.0), (3, 4, 0.5), (4, 4, 0.0), (4, 4, 0.0), (None, None, None)]
    got = spark.createDataFrame([(359.5,), (-0.25,), (360.0,), (12.0,)], "v double").select(*[x.alias(n) for n, x in zip("abw", ring.bounds(F.col("v")), strict=True)]).collect()
    assert [(r.a, r.b, r.w) for r in got] == [(359, 0, 0.5), (359, 0, 0.75), (0, 1, 0.0), (12, 13, 0.0)]
    one = lookup.SortedAxis([2.0])
    assert spark.range(1).select(*[x.alias(n) for n, x in zip("abw", one.bounds(F.lit(5.0)), strict=True)]).first()[:] == (0, 0, 0.0)


def test_gaps_and_zero_weights(spark):
    """A missing corner is NaN even where nothing of it is asked for; beyond the axes there is but one corner."""
    cells = [(z, x, y, 1.0, 100.0 + z, 300.0, 50.0, 40.0) for z in range(2) for x in range(2) for y in range(360) if (z, x, y) != (1, 1, 10)]
    grid = spark.createDataFrame(cells, "zi int, xi int, yawi int, visible double, cx double, bottom double, w double, h double")
    axes = lookup.SortedAxis([0.0, 1.0]), lookup.SortedAxis([5.0, 10.0])
    asked = spark.createDataFrame([(1, 0.0, 5.0, 9.0), (2, 0.5, 7.5, 359.5), (3, 0.0, 5.0, 10.0), (4, 2.0, 11.0, 10.0), (5, -1.0, 5.0, 10.0), (6, 0.0, -1.0, 0.0)], "k int, x double, z double, yaw double")
    got = {r.k: r for r in lookup.placed(asked, ["k"], grid, *axes).collect()}
    assert got[1].visible and got[2].visible and got[2].cx == pytest.approx(100.5) and not got[2].clamped
    assert got[3].visible and got[5].visible and got[5].clamped  # held to an end: one cell, which is there
    assert (got[4].visible, got[4].reason) == (False, "not_visible") and math.isnan(got[4].share)  # the missing cell itself
    assert (got[6].visible, got[6].clamped) == (False, True)  # behind the camera
    inner = lookup.SortedAxis([0.0, 1.0, 2.0]), lookup.SortedAxis([5.0, 10.0, 20.0])
    wide = grid.unionByName(grid.withColumn("zi", F.lit(2)).distinct())
    at_node = spark.createDataFrame([(1, 0.0, 10.0, 10.0)], "k int, x double, z double, yaw double")
    assert lookup.placed(at_node, ["k"], wide, *inner).first().visible


def test_pose_logs_keep_the_last_line(spark, tmp_path):
    for k, lines in {"a": ['{"recorded_frame_idx": 1, "t_s": 1.0}', "", '{"recorded_frame_idx": 2, "t_s": 2.0}', "  ", '{"recorded_frame_idx": 1, "t_s": 3.0}'], "b": ['{"recorded_frame_idx": 1, "t_s": 9.0}']}.items():
        (tmp_path / f"{k}.jsonl").write_text("\n".join(lines) + "\n")
    got = io.read_pose_log(spark, f"file://{tmp_path}").collect()
    assert {(r.path[-7:], r.recorded_frame_idx, r.t_s) for r in got} == {("a.jsonl", 1, 3.0), ("a.jsonl", 2, 2.0), ("b.jsonl", 1, 9.0)}


def test_last_lines_of_a_log_in_many_parts(spark, tmp_path):
    lines = [f'{{"recorded_frame_idx": {k % 700}, "t_s": {k}.0}}' for k in range(5000)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        got = {r.recorded_frame_idx: r.t_s for r in io.read_pose_log(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {k % 700: float(k) for k in range(5000)}


@pytest.mark.parametrize("text", ["", "\n \n"])
def test_empty_logs_are_errors(spark, tmp_path, text):
    (tmp_path / "full.jsonl").write_text('{"recorded_frame_idx": 1}\n')
    (tmp_path / "none.jsonl").write_text(text)
    with pytest.raises(ValueError, match="none.jsonl"):
        io.read_pose_log(spark, f"file://{tmp_path}")


def test_manifests_in_all_forms(spark, tmp_path):
    case = {"case_id": "c1", "case_index": 3, "parameters": {"side": "left", "fps": 30}, "swept_values": {"side": "left"}}
    forms = {"document": {"benchmark_id": "b", "cases": [case]}, "list": [case, case | {"case_id": "c2"}]}
    import json

    for k, v in forms.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(case) + "\n" + json.dumps(case | {"case_id": "c2"}))
    read = lambda k, lines=False: [(r.case_id, r.parameters.side, r.parameters.fps) for r in io.read_cases(spark, f"file://{tmp_path}/{k}.json", lines).collect()]
    assert read("document") == [("c1", "left", 30)] and read("list") == [("c1", "left", 30), ("c2", "left", 30)] and read("lines", True) == [("c1", "left", 30), ("c2", "left", 30)]


def test_velocity_of_brackets(spark):
    keys = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 10, 1.0, 5.0), (1, 20, 1.0, 25.0), (2, 5, 0.0, 3.0)], "run long, frame long, t_s double, x double")
    asked = spark.createDataFrame([(1, f) for f in (-5, 0, 5, 10, 15, 20, 99)] + [(2, 0), (2, 9), (3, 1)], "run long, frame long")
    got = {(r.run, int(r.frame)): r.v_x for r in motion.bracket_velocity(asked, keys, "run", ["x"]).collect()}
    assert got == {(1, -5): 5.0, (1, 0): 5.0, (1, 5): 5.0, (1, 10): 5.0, (1, 15): 2.0, (1, 20): 2.0, (1, 99): 2.0, (2, 0): 0.0, (2, 9): 0.0}


def test_vectors_are_normalised_by_the_training_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0, None]), (2, [3.0, 5.0, 4.0]), (3, [100.0, 5.0, 4.0])], "k int, x array<double>")
    fit = features.vector_stats(rows.where("k < 3"), "x", 3)
    s = fit.first()
    assert (s.n, s["mean"], s["std"]) == (2, [2.0, 5.0, 4.0], [1.0, 1.0, 1.0])
    assert {r.k: r.x for r in features.normalised(rows, "x", fit).collect()} == {1: [-1.0, 0.0, None], 2: [1.0, 0.0, 0.0], 3: [98.0, 0.0, 0.0]}


def test_box_inputs_fall_back(spark):
    names = [n for n, _, _ in features.BOX_INPUTS]
    row = {"adversary_forward_m": 30.0, "distance_to_adversary_m": 12.0, "estimated_distance_from_displacement_m": float("inf")}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], ", ".join(f"{n} double" for n in names))
    assert df.select(features.box_inputs().alias("x")).first().x == [0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.5, 0.2, 0.2, 0.0, 0.0, 0.0]


def test_logs_that_disagree_on_nulls(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, None)], "run long, frame long, x double")
    b = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, None)], "run long, frame long, x double")
    got = {r.run: (r.verdict, r.first_mismatch) for r in reports.pose_sync(a, b, ["run"], ["x"]).collect()}
    assert got == {1: ("FAIL", 0), 2: ("PASS", None)}


def test_asks_of_one_route_stay_apart(spark):
    route = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(10)], "run long, frame long, x double, y double")
    asks = spark.createDataFrame([(1, "a", 0.0, 0.0, 3.0), (1, "b", 7.0, 0.0, 1.0), (1, "c", 7.5, 0.0, 9.0), (1, "d", 0.0, 0.0, 0.0)], "run long, who string, ex double, ey double, ahead double")
    got = {r.who: (r.nearest, r.target) for r in resolve.route_target(route, asks, "run", ["who"]).collect()}
    assert got == {"a": (0, 3), "b": (7, 8), "c": (7, None), "d": (0, 0)}


def test_real_boxes_that_repeat_count_once(spark):
    schema = "k int, cx double, bottom double, w double, h double, visible boolean, nth int"
    pred = spark.createDataFrame([(1, 10.0, 10.0, 4.0, 4.0, True, 0), (2, 0.0, 0.0, 0.0, 1.0, True, 0)], schema)
    real = spark.createDataFrame([(1, 99.0, 9.0, 4.0, 4.0, True, 2), (1, 11.0, 10.0, 4.0, 4.0, True, 1)], schema)
    rows = {r.k: r for r in reports.predicted_boxes(pred, real, ["k"], F.col("nth")).collect()}
    assert len(rows) == 2 and rows[1].dx == -1.0 and not rows[2].valid
    report = {r.metric: r for r in reports.box_report(pred, real, ["k"], F.col("nth")).collect()}
    assert set(report) == set(reports.BOX_METRICS) and (report["dx" if "dx" in report else "abs_dx"].mean, report["iou"].total, report["iou"].valid, report["iou"].invalid_predicted, report["iou"].invalid_real) == (1.0, 2, 1, 1, 1)


def test_cases_without_a_verdict_have_failed(spark):
    df = spark.createDataFrame([("a", None, None), ("a", True, None), ("a", False, None), ("a", True, "x")], "g string, passed boolean, error string")
    r = reports.run_totals(df, ["g"]).first()
    assert (r.selected, r.passed, r.failed, r.errors, r.all_passed) == (4, 1, 2, 1, False)


def test_gates_need_a_planned_policy(spark):
    cases = spark.createDataFrame([(k,) for k in range(4)], "k int")
    status = spark.createDataFrame([(0, "SUPPORTED", "PASS", 2.0, None), (1, "SUPPORTED", "PASS", None, None), (2, "SUPPORTED", "PASS", 2.5, 2.5), (3, "SUPPORTED", "PASS", 2.5, None)], "k int, status string, verdict string, planned_depth double, runtime_depth double")
    assert sorted(r.k for r in reports.gated(cases, status, "k").collect()) == [0, 2]


def test_local_folders_are_refused_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(Session(), "x")


def test_single_actor_logs(spark, tmp_path):
    (tmp_path / "real.jsonl").write_text('{"recorded_frame_idx": 1, "bbox": {"visible": true, "cx": 5, "depth_m": 9}}\n\n{"recorded_frame_idx": 2}\n{"recorded_frame_idx": 1, "bbox": {"visible": true, "cx": 6}}\n')
    got = {r.frame: (r.visible, r.cx, r.depth) for r in io.read_real_v1(spark, f"file://{tmp_path}/real.jsonl").collect()}
    assert got == {1: (True, 6.0, None), 2: (False, None, None)}
    (tmp_path / "synth.json").write_text('{"frames": [\n {"frame_idx": 1, "adversaries": []},\n {"frame_idx": 2, "adversaries": [{"rendered": true, "box": {"visible": true, "z_m": 4}}, {"rendered": false}]},\n {"frame_idx": 3}, {"frame_idx": 1, "adversaries": [{"box": {"visible": true}}]}]}')
    got = {r.frame: (r.visible, r.rendered, r.depth) for r in io.read_synth_v1(spark, f"file://{tmp_path}/synth.json").collect()}
    assert got == {1: (True, False, None), 2: (True, True, 4.0), 3: (False, False, None)}


def test_design_points_hold_their_ends(spark):
    one = spark.range(2).withColumn("stop", F.when(F.col("id") == 0, 0.3).otherwise(-1.0))
    out = datasets.design_points(one, {"x": (F.lit(0.0), F.col("stop"), F.lit(0.1)), "yaw": (F.lit(-180.0), F.lit(180.0), F.lit(180.0))}).collect()
    assert [(r.id, r.x, r.yaw) for r in out] == [(0, x, y) for x in (0.0, 0.1, 0.2, 0.3) for y in (-180.0, 0.0, 180.0)]


def test_crop_samples_say_why_not(spark):
    rows = [("a", 1, 10, 10, 60, 60, True, True, True), ("a", None, 10, 10, 60, 60, True, True, True), ("a", 3, None, None, None, None, False, True, True), ("a", 4, 60, 10, 10, 60, True, True, True), ("a", 5, 10, 10, 60, 60, True, False, True), ("b", 0, 0, 0, 1279, 719, True, True, True)]
    df = spark.createDataFrame(rows, "run string, frame int, x1 int, y1 int, x2 int, y2 int, has_metadata boolean, has_rough boolean, has_target boolean")
    got = {(r.run, r.frame): (r.reason, r.sample_id, r.preview) for r in datasets.crop_samples(df, "run").collect()}
    assert got == {("a", 1): (None, 0, True), ("a", None): ("bad_name", None, None), ("a", 3): ("no_metadata", None, None), ("a", 4): ("invalid_box", None, None), ("a", 5): ("missing_image", None, None), ("b", 0): (None, 1, False)}


def test_previews_keep_the_last_frame(spark):
    df = spark.createDataFrame([(1, f, 0.0, 10.0, 0.0) for f in range(3, 70)] + [(2, 9, 1.0, 1.0, 0.0)], "run long, frame long, x double, z double, yaw double")
    got = sorted((r.run, r.frame, r.sprite) for r in metadata.preview(df, ["run"], 30).collect())
    assert got == [(1, 3, 0), (1, 33, 0), (1, 63, 0), (1, 69, 0), (2, 9, 45)]


def test_logs_that_share_a_file(spark, tmp_path):
    """Each log keeps the last line of its own frames; a frame of another log in the file is no repeat."""
    lines = [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (None, 0, 4.0), (1, 0, 5.0), (2, 0, 6.0)]
    text = "".join(json.dumps({"run": r, "recorded_frame_idx": f, "t_s": t}) + "\n \n" for r, f, t in lines)
    (tmp_path / "many.jsonl").write_text(text)
    got = io.read_pose_log(spark, f"file://{tmp_path}", log="run long").collect()
    assert {(r.run, r.recorded_frame_idx): r.t_s for r in got} == {(1, 0): 5.0, (1, 1): 2.0, (2, 0): 6.0, (None, 0): 4.0} and len(got) == 4


def test_pose_log_query_writes_files_by_tasks(spark):
    """Short logs share files: 1,500 users are not 1,500 files. Before, each run had its own."""
    from trajframe import scenario_queries

    read = []
    of = io.empty_logs
    try:
        io.empty_logs = lambda spark, path, rows: read.append(path) or of(spark, path, rows)
        scenario_queries.queries()["s1_pose_log"](spark, "/root/testdata/sf0.01")
    finally:
        io.empty_logs = of
    assert len(spark.read.text(read[0]).inputFiles()) <= 4

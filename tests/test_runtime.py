"""Edge rows of resolution, look-ups and reports that the given tables lack."""

import pytest
from pyspark.sql import functions as F

from trajframe.functions import runtime
from trajframe.operators import checks, compare, lookup, reports, resolve, sweep
from trajframe.sources import io


def test_later_labels_overwrite_and_gaps_are_filled(spark):
    rows = [(0.0, 5.0, 0.0, True, 1.0, 1), (0.0, 5.0, 0.0, False, 2.0, 2), (1.0, 9.0, 0.0, True, 3.0, 3)]
    out = lookup.dense_grid(spark.createDataFrame(rows, "x double, z double, yaw double, visible boolean, w double, n int"), ["x", "z", "yaw"], ["w"], F.col("n"))
    got = {(r.x, r.z): (r.visible, r.w) for r in out.collect()}
    assert got == {(0.0, 5.0): (False, 2.0), (1.0, 9.0): (True, 3.0), (0.0, 9.0): (False, None), (1.0, 5.0): (False, None)}


def test_grid_files_of_a_built_grid(spark, tmp_path):
    labels = spark.createDataFrame([(0.2, 0.9, 3.0, True, 4.0)], "x double, z double, yaw double, visible boolean, w double")
    axes = {"x": lookup.Axis(0, 1, 3), "z": lookup.Axis(0, 1, 3), "yaw": lookup.Axis(0, 10, 3)}
    io.write_grid(lookup.build_grid(labels, axes, ["w"]), str(tmp_path / "g"))
    r = io.read_grid_metadata(spark, str(tmp_path / "g")).first()
    assert (r.n, r.n_visible, r.n_zi) == (1, 1, 1) and spark.read.parquet(str(tmp_path / "g" / "cells")).count() == 1


def test_a_value_missing_on_one_side_is_a_disagreement(spark):
    schema = "k int, frame int, x double"
    a, b = (spark.createDataFrame(r, schema) for r in ([(1, 0, 1.0), (2, 0, None), (3, 0, 1.0)], [(1, 0, None), (2, 0, None), (3, 0, 1.0)]))
    got = {r.k: r.verdict for r in checks.invariants(a, b, ["k", "frame"], ["x"], ["k"]).collect()}
    assert got == {1: "FAIL", 2: "PASS", 3: "PASS"}


def test_cases_without_counted_frames_are_still_cases(spark):
    schema = "case_id int, actor_id string, frame int, visible boolean, cx double, bottom double, w double, h double, depth double"
    row = lambda case, seen: (case, "a", 0, seen, 1.0, 1.0, 1.0, 1.0, 30.0)
    real = spark.createDataFrame([row(1, True), row(2, False)], schema)
    out = compare.strata(compare.by_threshold(real, real, (15.0,))).first()
    assert (out.n_cases, out.n_with, out.n_frames) == (2, 1, 1)


def test_cut_ins_that_cannot_be_driven_are_named(spark):
    rows = [(1, 20.0, 0.0, 3.5, 8.0, 1.0, 2.0, 5.0), (2, 20.0, 0.0, 3.5, 0.5, 1.0, 0.5, 5.0)]
    cases = spark.createDataFrame(rows, "case_id int, start_m double, lane_y double, target_y double, speed double, cut_start_s double, cut_s double, ego_speed double")
    got = {r.case_id: r.status for r in sweep.capability_of_cases(cases).collect()}
    assert got[2] == "INFEASIBLE" and got[1] in ("SUPPORTED", "OUTSIDE")


def test_maneuvers_wait_stop_and_reject(spark):
    rows = [("straight", 0.5, 1.0, None), ("straight", 3.0, 1.0, 1.5), ("static", 3.0, 0.0, None), ("cut_in", 1.0, 0.0, None), (None, 1.0, 0.0, None)]
    df = spark.createDataFrame([(m, t, s, d, 0.0, 0.0, 90.0, 2.0) for m, t, s, d in rows], "maneuver string, t_s double, start_s double, duration_s double, x0 double, y0 double, yaw0 double, speed double")
    out = resolve.maneuver_states(df).collect()
    assert [(r.y and round(r.y, 9), r.speed_mps) for r in out] == [(0.0, 0.0), (3.0, 0.0), (0.0, 0.0), (None, None), (None, None)]
    assert out[3].error == "unresolved maneuver: cut_in" and out[4].error == "unresolved maneuver: none"


def test_path_ends_hold_and_stop(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0)], "run int, i int, x double, y double")
    times = spark.createDataFrame([(1, 0.0, -1.0, 2.0), (1, 1.0, 2.5, 2.0), (1, 2.0, 9.0, 2.0)], "run int, t_s double, distance double, speed double")
    out = {r.t_s: (round(r.x, 6), round(r.y, 6), r.speed_mps) for r in resolve.path_states(times, points, "run").collect()}
    assert out == {0.0: (0.0, 0.0, 2.0), 1.0: (1.5, 2.0, 2.0), 2.0: (3.0, 4.0, 0.0)}


def test_lifecycle_ends_count(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (1.0, 1.0, 1.0), (1.1, 1.0, 1.0), (9.0, 1.0, None)], "t double, a double, b double")
    assert [r[0] for r in df.select(resolve.alive(df.t, df.a, df.b)).collect()] == [False, True, False, True]


def test_pose_logs_with_missing_frames_and_reports_with_missing_parts(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0)], "run int, frame int, x double")
    b = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.5)], "run int, frame int, x double")
    got = {r.run: (r.verdict, r.only_a, r.first_mismatch) for r in reports.pose_sync(a, b, ["run"], ["x"]).collect()}
    assert got == {1: ("FAIL", 1, None), 2: ("FAIL", 0, 0)}
    cases = spark.createDataFrame([(1,), (2,)], "k int")
    out = {r.k: r.error for r in reports.case_report(cases, {"run": cases.where("k = 1").withColumn("v", F.lit(1))}, "k").collect()}
    assert out == {1: None, 2: "missing_run"}


def test_modes_near_the_grid_and_boxes_at_the_edge(spark):
    df = spark.createDataFrame([(9.0, 3.0, m) for m in ("clamp", "edge", "invisible")], "x double, z double, mode string")
    out = runtime.grid_query(df.x, df.z, (-4.0, 2.0), (4.0, 100.0), df.mode)
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in out.items()]).collect()]
    assert got == [(4.0, 7.0, True, True, "ok"), (4.0, 3.0, True, True, "ok"), (4.0, 3.0, True, False, "below_safe_min_rel_z")]
    one = spark.createDataFrame([(5.0, 700.0, 20.0, 30.0, 0.9, 4.0)], "cx double, b double, w double, h double, p double, z double")
    box = one.select(*[v.alias(k) for k, v in runtime.rect(*[one[k] for k in ("cx", "b", "w", "h", "p", "z")]).items()]).first()
    assert (box.x1, box.clamped, box.visible) == (0.0, True, True)


@pytest.mark.parametrize(("value", "tag"), [(12.5, "12p5"), (-3.0, "m3"), (0.0, "0"), (100.0, "100"), (7.25, "7p25")])
def test_number_tags(spark, value, tag):
    assert spark.range(1).select(runtime.number_tag(F.lit(value))).first()[0] == tag


def test_comparison_grid_cells(spark):
    """Frames of both sides x all actors of the case; repeats are one cell, null keys none, cases of one side none."""
    schema = "case_id long, actor_id string, frame long, visible boolean, cx double, bottom double, w double, h double, depth double"
    row = lambda c, a, f, cx=1.0, seen=True: (c, a, f, seen, cx, 1.0, 1.0, 1.0, 9.0)
    real = spark.createDataFrame([row(1, "a", 0), row(1, "a", 0, 2.0), row(1, "b", 1), row(1, "a", 2), row(2, "a", 0), (1, None, 0, True, 1.0, 1.0, 1.0, 1.0, 9.0)], schema)
    synth = spark.createDataFrame([row(1, "a", 0, 5.0), row(1, "c", 0), row(1, "b", 1, 4.0, None), row(3, "a", 0)], schema)
    got = {(r.case_id, r.actor_id, r.frame): (r.real_present, r.synth_present, r.real_cx, r.synth_cx, r.synth_visible) for r in compare.comparison_grid(real, synth).collect()}
    assert got == {
        (1, "a", 0): (True, True, 2.0, 5.0, True), (1, "b", 0): (False, False, None, None, False), (1, "c", 0): (False, True, None, 1.0, True),
        (1, "a", 1): (False, False, None, None, False), (1, "b", 1): (True, True, 1.0, 4.0, False), (1, "c", 1): (False, False, None, None, False),
    }
    plan = compare.comparison_grid(real, synth)._jdf.queryExecution().executedPlan().toString()
    # One shuffle of the rows, one of the actors by case, and one more only where the actors are too many to broadcast.
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("REPARTITION_BY_COL") == 1

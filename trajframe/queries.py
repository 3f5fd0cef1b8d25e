"""Queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.functions import angles, boxes, geometry, rules
from trajframe.operators import checks, compare, frames, lookup, maneuvers, motion, sweep
from trajframe.operators.frames import c, table
from trajframe.plans import datasets, exports, metadata
from trajframe.sources.folders import shared_folder
from trajframe.streaming import jobs

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(**cols) -> list:
    return [F.round(v, 6).alias(k) for k, v in cols.items()]


POSES = "poses as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value / 10e0 as x, (event_id % 70) / 10e0 - 3.5e0 as y, (event_id % 361 - 180)::double as yaw, (event_id % 40)::double as speed from events)"
REAL = """keyed as (select *, row_number() over (partition by o_custkey % 50, o_orderstatus, o_orderkey % 300 order by o_orderkey) as n from orders),
real_ as (select o_custkey % 50 as case_id, o_orderstatus as actor_id, o_orderkey % 300 as frame, o_orderkey % 10 <> 0 as visible, o_totalprice % 880e0 + 200e0 as cx, o_totalprice % 300e0 + 380e0 as bottom, o_totalprice % 180e0 + 20e0 as w, o_totalprice % 120e0 + 15e0 as h, o_totalprice % 60e0 + 2e0 as depth, o_orderkey as k from keyed where n = 1)"""
SYNTH = REAL + """,
synth as (select case_id, actor_id, frame, k % 13 <> 0 as visible, cx + (k % 11 - 5) as cx, bottom - (k % 11 - 5) as bottom, w + (k % 11 - 5) / 2e0 as w, h - (k % 11 - 5) / 4e0 as h, depth, k from real_ where k % 7 <> 0)"""
GRID = SYNTH + """,
frames_ as (select distinct case_id, frame from real_ intersect select distinct case_id, frame from synth),
actors as (select case_id, actor_id from real_ union select case_id, actor_id from synth),
grid as (select f.case_id, f.frame, a.actor_id, r.k is not null as rp, s.k is not null as sp, coalesce(r.visible, false) as rv, coalesce(s.visible, false) as sv, r.depth, s.cx - r.cx as cx, s.bottom - r.bottom as bottom, s.w - r.w as w, s.h - r.h as h, r.cx as real_cx
 from frames_ f join actors a on f.case_id = a.case_id left join real_ r on r.case_id = f.case_id and r.frame = f.frame and r.actor_id = a.actor_id left join synth s on s.case_id = f.case_id and s.frame = f.frame and s.actor_id = a.actor_id)"""
STATES = "states as (select l_orderkey as k, l_linenumber as line, (l_partkey % 160) / 10e0 - 8e0 as x, l_quantity * 2.5e0 - 5e0 as z, l_suppkey * 3.6e0 as yaw from lineitem)"
mod = lambda a, n="360e0": f"((({a}) % {n} + {n}) % {n})"
wrap = lambda a: f"({mod(f'{a} + 180e0')} - 180e0)"


# Scalar functions


@query(f"with {STATES}, a as (select k, line, yaw - 500e0 as a, yaw * 2 - 900e0 as b from states) select k, line, round({mod('a')}, 6) as full_turn, round({wrap('a')}, 6) as half_turn, round(case when {wrap('a')} = -180e0 and a > 0 then 180e0 else {wrap('a')} end, 6) as closed, round({wrap('b - a')}, 6) as delta, round({wrap(f'a + {wrap('b - a')} * 0.25e0')}, 6) as between_yaw from a")
def p_angles(spark, sf):
    s = frames.states(spark, sf).select("k", "line", (c("yaw") - 500.0).alias("a"), (c("yaw") * 2 - 900.0).alias("b"))
    a, b = c("a"), c("b")
    return s.select("k", "line", *r6(full_turn=angles.wrap360(a), half_turn=angles.wrap180(a), closed=angles.wrap180_closed(a), delta=angles.shortest_delta(a, b), between_yaw=angles.lerp_yaw(a, b, F.lit(0.25))))


@query(f"with {STATES}, u as (select k, line, z / 100e0 as u, least(greatest(z / 100e0, 0e0), 1e0) as v from states) select k, line, round(v * v * (3 - 2 * v), 6) as smooth, round(6 * v * (1 - v), 6) as slope, round(v * v, 6) as ease, round(10e0 + 30e0 * u, 6) as straight from u")
def p_easing(spark, sf):
    u = c("z") / 100.0
    return frames.states(spark, sf).select("k", "line", *r6(smooth=angles.smoothstep(u), slope=angles.smoothstep_slope(u), ease=angles.ease_in(u), straight=angles.lerp(F.lit(10.0), F.lit(40.0), u)))


@query(f"""with {POSES}, st as (select *, first_value(x) over w as ex, first_value(y) over w as ey, first_value(yaw) over w as eyaw from poses window w as (partition by run order by frame)),
world as (select run, frame, x, y, yaw, ex + y * cos(radians(eyaw)) - x * sin(radians(eyaw)) as wx, ey + y * sin(radians(eyaw)) + x * cos(radians(eyaw)) as wy, {wrap('eyaw + yaw')} as wyaw from st)
select run, frame, round(wx, 6) as wx, round(wy, 6) as wy, round(wyaw, 6) as wyaw, round((wy - y) * cos(radians(yaw)) - (wx - x) * sin(radians(yaw)), 6) as cam_x, round((wx - x) * cos(radians(yaw)) + (wy - y) * sin(radians(yaw)), 6) as cam_z, round({wrap('wyaw - yaw')}, 6) as cam_yaw, round(-y, 6) as plan_x, round(x, 6) as plan_z from world""")
def p_coordinates(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("frame")
    p = frames.poses(spark, sf)
    p = p.select("*", *[F.first(k).over(w).alias(f"e_{k}") for k in ("x", "y", "yaw")])
    world = geometry.local_to_world(c("x"), c("y"), c("yaw"), {k: c(f"e_{k}") for k in ("x", "y", "yaw")})
    p = p.select("*", *[v.alias(f"w{k}") for k, v in world.items()])
    cam = geometry.world_to_camera(c("wx"), c("wy"), c("wyaw"), {k: c(k) for k in ("x", "y", "yaw")})
    plan = geometry.scenario_to_local(c("x"), c("y"), c("yaw"))
    return p.select("run", "frame", *r6(wx=c("wx"), wy=c("wy"), wyaw=c("wyaw"), cam_x=cam["x"], cam_z=cam["z"], cam_yaw=cam["yaw"], plan_x=plan["x"], plan_z=plan["z"]))


@query(f"""with {STATES}, f as (select k, line, x, z, 1280 / (2e0 * tan(radians(45e0))) as f from states), b as (select k, line, z, case when z > 0.1e0 then 640e0 + f * x / z end as cx, case when z > 0.1e0 then 360e0 + f * 1.6e0 / z end as bottom, case when z > 0.1e0 then f * 1.8e0 / z end as w, case when z > 0.1e0 then f * 1.5e0 / z end as h from f)
select k, line, round(cx, 6) as cx, round(bottom, 6) as bottom, round(w, 6) as w, round(h, 6) as h, coalesce(z > 0.1e0 and cx + w / 2 > -100 and cx - w / 2 < 1380 and bottom > -100 and bottom - h < 820, false) as visible, round(case when z > 0.1e0 then power(greatest((bottom - 360e0) / 360e0, 0e0), 1.4e0) end, 6) as scale from b""")
def p_projection(spark, sf):
    b = geometry.vehicle_box(c("x"), c("z"), F.lit(1.8), F.lit(1.5))
    s = frames.states(spark, sf).select("k", "line", *[v.alias(k) for k, v in b.items()])
    return s.select("k", "line", *r6(cx=c("cx"), bottom=c("bottom"), w=c("w"), h=c("h")), F.coalesce("visible", F.lit(False)).alias("visible"), *r6(scale=F.when(c("bottom").isNotNull(), geometry.horizon_scale(c("bottom")))))


@query(f"""with {STATES}, v as (select case when sqrt(z * z + x * x) < 0.5 then 'too_close' when sqrt(z * z + x * x) > 120 then 'too_far' when z <= 0 then 'behind' when abs(degrees(atan2(x, z))) > 45 then 'outside_fov' else 'visible' end as why,
 case when z < 10 then 'near' when z < 30 then 'middle' when z < 60 then 'far' else 'beyond' end as band from states) select band, why, count(*) as n from v group by all""")
def p_visibility_bins(spark, sf):
    why = rules.front_visibility(c("z"), c("x"))
    band = rules.binned(c("z"), [10.0, 30.0, 60.0], ["near", "middle", "far", "beyond"])
    return frames.states(spark, sf).select(band.alias("band"), why.alias("why")).groupBy("band", "why").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {STATES}, rig(camera, turn) as (values ('front', 0e0), ('left', 90e0), ('right', -90e0), ('rear', 180e0)), v as (select camera, z * cos(radians(turn)) - x * sin(radians(turn)) as f, x * cos(radians(turn)) + z * sin(radians(turn)) as l, z, x from states, rig)
select camera, count(*) filter (where sqrt(f * f + l * l) between 0.5 and 120 and f > 0 and round(abs(degrees(atan2(l, f))), 6) <= 45) as n_seen, count(*) as n from v group by all""")
def p_rig_visibility(spark, sf):
    rig = F.explode(F.array(*[F.struct(F.lit(n).alias("camera"), F.lit(t).alias("turn")) for n, t in (("front", 0.0), ("left", 90.0), ("right", -90.0), ("rear", 180.0))]))
    s = frames.states(spark, sf).select("x", "z", rig.alias("r")).select("x", "z", "r.*")
    co, si = F.cos(F.radians("turn")), F.sin(F.radians("turn"))
    s = s.select("camera", (c("z") * co - c("x") * si).alias("f"), (c("x") * co + c("z") * si).alias("l"))
    d = F.hypot("f", "l")
    seen = (d >= 0.5) & (d <= 120) & (c("f") > 0) & (F.round(F.abs(F.degrees(F.atan2("l", "f"))), 6) <= 45)
    return s.groupBy("camera").agg(F.count_if(seen).alias("n_seen"), F.count(F.lit(1)).alias("n"))


@query(f"""with {STATES}, v as (select k, line, {mod('degrees(atan2(x, z)) - yaw')} as seen from states), n as (select k, line, seen, round(seen, 6) / 15e0 as turn from v) select k, line, round(seen, 6) as seen_from, ((ceil(turn - 0.5e0)::int % 24) * 15)::int as sprite from n""")
def p_viewpoint(spark, sf):
    v = frames.states(spark, sf).select("k", "line", angles.viewpoint(c("x"), c("z"), c("yaw")).alias("view"))
    return v.select("k", "line", F.round("view", 6).alias("seen_from"), (F.ceil(F.round("view", 6) / 15.0 - 0.5).cast("int") % 24 * 15).alias("sprite"))


_PAIR = """pair as (select r.case_id, r.actor_id, r.frame, r.cx - r.w / 2 as a1, r.bottom - r.h as b1, r.cx + r.w / 2 as a2, r.bottom as b2, s.cx - s.w / 2 as c1, s.bottom - s.h as d1, s.cx + s.w / 2 as c2, s.bottom as d2, r.depth, r.k from real_ r join synth s using (case_id, actor_id, frame)),
i as (select *, greatest(least(a2, c2) - greatest(a1, c1), 0) * greatest(least(b2, d2) - greatest(b1, d1), 0) as both_, greatest(a2 - a1, 0) * greatest(b2 - b1, 0) as ra, greatest(c2 - c1, 0) * greatest(d2 - d1, 0) as sa from pair)"""


def _pairs(spark, sf):
    key = ["case_id", "actor_id", "frame"]
    side = lambda df, s: df.select(*key, "k" if s == "r" else F.lit(0).alias("z"), *[v.alias(f"{s}_{n}") for n, v in boxes.corners(c("cx"), c("bottom"), c("w"), c("h")).items()], *([c("depth")] if s == "r" else []))
    return side(frames.real(spark, sf), "r").join(side(frames.synthetic(spark, sf), "s"), key)


def _box(s):
    return {k: c(f"{s}_{k}") for k in ("x1", "y1", "x2", "y2")}


@query(f"with {SYNTH}, {_PAIR} select case_id, actor_id, frame, round(case when ra + sa - both_ > 0 then both_ / (ra + sa - both_) else 0 end, 6) as iou, round(sa / ra, 6) as area_ratio, round(sqrt(power((c1 + c2 - a1 - a2) / 2, 2) + power((d1 + d2 - b1 - b2) / 2, 2)), 6) as centre from i")
def p_box_overlap(spark, sf):
    a, b = _box("r"), _box("s")
    centre = F.hypot((b["x1"] + b["x2"] - a["x1"] - a["x2"]) / 2.0, (b["y1"] + b["y2"] - a["y1"] - a["y2"]) / 2.0)
    return _pairs(spark, sf).select("case_id", "actor_id", "frame", *r6(iou=boxes.iou(a, b), area_ratio=boxes.area(b) / boxes.area(a), centre=centre))


@query(f"""with {SYNTH}, {_PAIR}, s as (select *, greatest(greatest(a2 - a1, b2 - b1) * 1.5, 64) as side from pair), m as (select *, least(greatest((a1 + a2) / 2 - side / 2, 0), greatest(1280 - side, 0)) as x, least(greatest((b1 + b2) / 2 - side / 2, 0), greatest(720 - side, 0)) as y from s)
select case_id, actor_id, frame, round_even(x, 0)::int as x1, round_even(y, 0)::int as y1, round_even(least(x + side, 1280), 0)::int as x2, round_even(least(y + side, 720), 0)::int as y2 from m""")
def p_square_crop(spark, sf):
    return _pairs(spark, sf).select("case_id", "actor_id", "frame", *[v.alias(k) for k, v in boxes.square_crop(_box("r"), 1280, 720).items()])


# Filters and classes


@query(f"""with {STATES}, d as (select k % 50 as case_id, line, k, z, x, case when z <= 1e-5 then 'CULLED' when x < -4.00001 or x > 4.00001 or z > 100.00001 then 'OOD' else 'SUPPORTED' end as class from states)
select case_id, count(*) as active, count(*) filter (where class = 'SUPPORTED') as supported, count(*) filter (where class = 'CULLED') as culled, count(*) filter (where class = 'OOD') as ood, round(min(x), 6) as min_x, round(max(z), 6) as max_z, min(k) filter (where class = 'OOD') as first_ood from d group by all""")
def f_domain(spark, sf):
    d = frames.states(spark, sf).select((c("k") % 50).alias("case_id"), "k", "x", "z", rules.capability(c("x"), c("z")).alias("class"))
    n = lambda k: F.count_if(c("class") == k)
    return d.groupBy("case_id").agg(F.count(F.lit(1)).alias("active"), n("SUPPORTED").alias("supported"), n("CULLED").alias("culled"), n("OOD").alias("ood"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("z"), 6).alias("max_z"), F.min(F.when(c("class") == "OOD", c("k"))).alias("first_ood"))


@query(f"""with {STATES} select case when x < -4.00001 then 'x_below_min' else '' end || case when x > 4.00001 then 'x_above_max' else '' end || case when z < -1e-5 then (case when abs(x) > 4.00001 then '+' else '' end) || 'z_below_min' else '' end || case when z > 100.00001 then (case when abs(x) > 4.00001 then '+' else '' end) || 'z_above_max' else '' end as reason, count(*) as n from states group by 1""")
def f_domain_reasons(spark, sf):
    return frames.states(spark, sf).groupBy(rules.domain_reason(c("x"), c("z"), below=True).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {REAL}, q as (select case when not visible then 'not_visible' when w < 12 then 'box_too_narrow' when h < 10 then 'box_too_short' when cx - w / 2 < 150 or cx + w / 2 > 1150 then 'bbox_clipped_or_near_edge' when (depth - 30) / 40 <= 0 then 'clean_geometry_only' when (depth - 30) / 40 < 0.35 then 'occluded' else 'clean' end as reason from real_) select reason, count(*) as n from q group by 1""")
def f_quality(spark, sf):
    edge = (c("cx") - c("w") / 2 < 150) | (c("cx") + c("w") / 2 > 1150)
    return frames.real(spark, sf).groupBy(rules.quality(c("visible"), c("w"), c("h"), edge, (c("depth") - 30) / 40).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {REAL}, n as (select case_id, actor_id, frame, lead(frame) over (partition by case_id, actor_id order by frame) as next_frame from real_) select * from n where next_frame <> frame + 1")
def f_contiguity(spark, sf):
    return checks.gaps(frames.real(spark, sf), ["case_id", "actor_id"])


# Joins and aggregates

_AGG = ", ".join(f"round(avg(abs({p})) filter (where counted), 6) as mae_{p}, round(avg({p}) filter (where counted), 6) as mean_{p}" for p in compare.PARTS)


@query(f"""with {GRID}, g as (select *, rv and sv as counted from grid)
select case_id, actor_id, count(*) as n_rows, count(*) filter (where rp and sp) as n_both, count(*) filter (where rp and not sp) as n_real_only, count(*) filter (where sp and not rp) as n_synth_only, count(*) filter (where rv and not sv) as n_real_seen_only, count(*) filter (where sv and not rv) as n_synth_seen_only, count(*) filter (where counted) as n_counted, round(avg((rp = sp)::int), 6) as presence_agreement, round(avg((rv = sv)::int) filter (where rp and sp), 6) as visibility_agreement, {_AGG} from g group by rollup (case_id, actor_id)""")
def a1_compare_summary(spark, sf):
    return compare.summary(compare.comparison_grid(frames.real(spark, sf), frames.synthetic(spark, sf)))


@query(f"""with {GRID}, g as (select *, rv and sv as counted, case when not rp then 'unknown' when (real_cx - 640) / 100 between -4.00001 and 4.00001 and depth - 5 between -1e-5 and 100.00001 then 'in_domain' else 'ood' end as domain from grid), s as (select actor_id, domain, count(*) as n, {", ".join(f"round(avg(abs({p})) filter (where counted), 6) as mae_{p}" for p in compare.PARTS)} from g group by all)
select *, round(n / sum(n) over (partition by actor_id), 6) as fraction from s""")
def a3_domain_split(spark, sf):
    grid = compare.comparison_grid(frames.real(spark, sf), frames.synthetic(spark, sf))
    return compare.domain_split(grid, (c("real_cx") - 640) / 100, c("real_depth") - 5)


_PER_CASE = GRID + ", t(min_depth) as (values (15e0), (20e0), (25e0), (30e0)), pc as (select case_id, min_depth, count(*) filter (where rv and sv and depth >= min_depth) as n_frames, " + ", ".join(f"avg(abs({p})) filter (where rv and sv and depth >= min_depth) as mae_{p}" for p in compare.PARTS) + " from grid, t group by all)"


@query(f"""with {_PER_CASE} select min_depth, count(*) as n_cases, count(*) filter (where n_frames > 0) as n_with, sum(n_frames)::bigint as n_frames, {", ".join(f"round(avg(mae_{p}), 6) as macro_{p}, round(min(mae_{p}), 6) as min_{p}, round(max(mae_{p}), 6) as max_{p}, round(sum(mae_{p} * n_frames) filter (where n_frames > 0) / sum(n_frames) filter (where mae_{p} is not null and n_frames > 0), 6) as weighted_{p}" for p in compare.PARTS)} from pc group by 1""")
def a9_depth_strata(spark, sf):
    return compare.strata(compare.by_threshold(frames.real(spark, sf), frames.synthetic(spark, sf), (15.0, 20.0, 25.0, 30.0)))


@query(f"""with {_PER_CASE}, l as (select case_id, min_depth, metric, round(value, 3) as value from pc unpivot (value for metric in (mae_cx, mae_bottom, mae_w, mae_h)) where n_frames > 0), k as (select *, row_number() over (partition by min_depth, metric order by value desc, case_id) as n from l) select min_depth, metric, case_id, value from k where n = 1""")
def a8_worst_cases(spark, sf):
    return compare.worst_cases(compare.by_threshold(frames.real(spark, sf), frames.synthetic(spark, sf), (15.0, 20.0, 25.0, 30.0)))


@query(f"""with {GRID}, e as (select * from (select case when rv and sv then cx end as err_cx, case when rv and sv then bottom end as err_bottom, case when rv and sv then w end as err_w, case when rv and sv then h end as err_h from grid) unpivot (value for metric in (err_cx, err_bottom, err_w, err_h)))
select metric, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(min(value), 6) as least, round(max(value), 6) as most from e group by 1""")
def a15_described(spark, sf):
    grid = compare.with_errors(compare.comparison_grid(frames.real(spark, sf), frames.synthetic(spark, sf)))
    return checks.described(grid, [f"err_{p}" for p in compare.PARTS])


@query(f"""with {GRID}, g as (select cx as err_cx, w as err_w, case when depth < 10 then '0-10' when depth < 20 then '10-20' when depth < 40 then '20-40' else '40+' end as distance_bin, case when abs(real_cx - 640) / 5 < 15 then 'front' when abs(real_cx - 640) / 5 < 45 then 'slant' when abs(real_cx - 640) / 5 < 90 then 'side' else 'rear' end as yaw_bin from grid where rv and sv)
select distance_bin, yaw_bin, count(*) as n, round(avg(abs(err_cx)), 6) as mae_err_cx, round(avg(abs(err_w)), 6) as mae_err_w from g group by grouping sets ((), (distance_bin), (yaw_bin))""")
def a13_bucket_errors(spark, sf):
    rows = compare.with_errors(compare.comparison_grid(frames.real(spark, sf), frames.synthetic(spark, sf))).where("counted")
    return datasets.bucket_errors(rows, c("real_depth"), (c("real_cx") - 640) / 5, ["err_cx", "err_w"])


@query("""with e as (select * from (select l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem) unpivot (value for feature in (quantity, price, discount, tax))) select feature, round(avg(value), 6) as mean, round(case when stddev_pop(value) < 1e-6 then 1 else stddev_pop(value) end, 6) as std from e group by 1""")
def a18_normaliser(spark, sf):
    rows = table(spark, sf, "lineitem").select(c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"), c("l_tax").alias("tax"))
    return checks.normaliser(rows, ["quantity", "price", "discount", "tax"])


@query(f"""with {REAL}, a as (select case_id, actor_id, count(*) filter (where visible) as n_visible, count(*) filter (where visible and cx > 900) as edge, count(case when visible then w * h end) as n, stddev_pop(case when visible then w * h end) as sd, avg(case when visible then w * h end) as m from real_ group by all)
select case_id, actor_id, n_visible, round(case when n_visible = 0 then -1e9 else 100e0 * n_visible - 20e0 * edge - 40e0 * (case when n < 2 then 1e0 else sd / greatest(m, 1e0) end) end, 4) as score from a""")
def a21_capture_score(spark, sf):
    return checks.capture_score(frames.real(spark, sf).withColumns({"area": c("w") * c("h"), "edge": c("cx") > 900}), ["case_id", "actor_id"])


@query(f"""with {SYNTH}, j as (select coalesce(r.case_id, s.case_id) as case_id, r.k as rk, s.k as sk, abs(r.cx - s.cx) as cx, abs(r.depth - s.depth) as depth from real_ r full join synth s on r.case_id = s.case_id and r.actor_id = s.actor_id and r.frame = s.frame)
select case_id, count(*) filter (where sk is null) as only_a, count(*) filter (where rk is null) as only_b, round(max(cx), 6) as max_cx, round(max(depth), 6) as max_depth, case when count(*) filter (where sk is null or rk is null) = 0 and coalesce(bool_and(greatest(cx, depth) <= 1e-9), true) then 'PASS' else 'FAIL' end as verdict from j group by 1""")
def j9_invariants(spark, sf):
    return checks.invariants(frames.real(spark, sf), frames.synthetic(spark, sf), ["case_id", "actor_id", "frame"], ["cx", "depth"], ["case_id"])


@query(f"""with {POSES}, probe as (select run, frame * 2 + 1 as frame from poses), pose as (select run, frame * 3 as frame, x, yaw from poses), b as (select p.run, p.frame, q.frame as at, q.x, q.yaw from probe p asof join pose q on p.run = q.run and p.frame >= q.frame), a as (select p.run, p.frame, q.frame as at, q.x, q.yaw from probe p asof join pose q on p.run = q.run and p.frame <= q.frame)
select p.run, p.frame, case when b.at is null or a.at - p.frame < p.frame - b.at then a.at else b.at end as pose_frame, case when b.at is null or a.at - p.frame < p.frame - b.at then a.x else b.x end as x from probe p left join a using (run, frame) left join b using (run, frame)""")
def j5_nearest_pose(spark, sf):
    p = frames.poses(spark, sf)
    return motion.nearest_pose(p.select("run", (c("frame") * 2 + 1).alias("frame")), p.withColumn("frame", c("frame") * 3), "run", ["x"])


@query(f"""with {POSES}, key_ as (select run, frame * 5 + 2 as frame, x, lead(frame * 5 + 2) over w as f1, lead(x) over w as x1, first_value(x) over w as x0 from poses window w as (partition by run order by frame)), probe as (select run, frame * 3 as frame from poses)
select p.run, p.frame, round(case when k.frame is null then (select min(z.x0) from key_ z where z.run = p.run) when k.f1 is null then k.x else k.x + (k.x1 - k.x) * (p.frame - k.frame) / (k.f1 - k.frame) end, 6) as x from probe p asof left join key_ k on p.run = k.run and p.frame >= k.frame""")
def j6_bracketed(spark, sf):
    p = frames.poses(spark, sf)
    out = motion.bracketed(p.select("run", (c("frame") * 3).alias("frame")), p.withColumn("frame", c("frame") * 5 + 2), "run", ["x"])
    return out.select("run", "frame", F.round("x", 6).alias("x"))


_AXES = {"x": lookup.Axis(-8.0, 1.0, 17), "z": lookup.Axis(-5.0, 5.0, 28), "yaw": lookup.Axis(0.0, 30.0, 13)}
_pos = lambda v, lo, st, n: f"least(greatest(({v} - {lo}) / {st}, 0e0), {n - 1}e0)"
_near = lambda v, lo, st, n: f"ceil({_pos(v, lo, st, n)} - 0.5e0)::int"
_LGRID = f"""lab as (select k, line, x, z, yaw % 360e0 as yaw, abs(x) < 6 and z > 0 as visible, x * 10 + z as w, z * 2 + yaw / 100 as h from states), cells as (select {_near('x', '-8e0', '1e0', 17)} as xi, {_near('z', '-5e0', '5e0', 28)} as zi, {_near('yaw', '0e0', '30e0', 13)} as yawi, count(*) as n, avg(visible::int) as visible, avg(w) as w, avg(h) as h from lab group by all)"""


def _labels(spark, sf):
    return frames.states(spark, sf).select("k", "line", "x", "z", (c("yaw") % 360.0).alias("yaw"), ((F.abs("x") < 6) & (c("z") > 0)).alias("visible"), (c("x") * 10 + c("z")).alias("w"), (c("z") * 2 + c("yaw") / 100).alias("h"))


@query(f"with {STATES}, {_LGRID} select xi, zi, yawi, n, round(visible, 6) as visible, round(w, 6) as w, round(h, 6) as h from cells")
def d3_grid_build(spark, sf):
    g = lookup.build_grid(_labels(spark, sf), _AXES, ["w", "h"])
    return g.select("xi", "zi", "yawi", "n", *r6(visible=c("visible"), w=c("w"), h=c("h")))


@query(f"with {STATES}, {_LGRID}, p as (select x.range::int as xi, z.range::int as zi, y.range::int as yawi from range(17) x, range(28) z, range(13) y) select * from p anti join cells using (xi, zi, yawi)")
def a25_missing_cells(spark, sf):
    return lookup.missing_cells(lookup.build_grid(_labels(spark, sf), _AXES, ["w"]), _AXES)


@query(f"""with {STATES}, {_LGRID}, q as (select k, line, {_near('x + 0.3e0', '-8e0', '1e0', 17)} as xi, {_near('z', '-5e0', '5e0', 28)} as zi, {_near('yaw % 360e0', '0e0', '30e0', 13)} as yawi from states) select k, line, q.xi, q.zi, q.yawi, round(c.w, 6) as w from q left join cells c using (xi, zi, yawi)""")
def j8_nearest_cell(spark, sf):
    q = frames.states(spark, sf).select("k", "line", (c("x") + 0.3).alias("x"), "z", (c("yaw") % 360.0).alias("yaw"))
    out = lookup.nearest(q, lookup.build_grid(_labels(spark, sf), _AXES, ["w"]), _AXES, ["w"])
    return out.select("k", "line", "xi", "zi", "yawi", F.round("w", 6).alias("w"))


@query(f"""with {STATES}, {_LGRID}, q as (select k, {_pos('avg(x)', '-8e0', '1e0', 17)} as px, {_pos('avg(z)', '-5e0', '5e0', 28)} as pz, {_pos('avg(yaw % 360e0)', '0e0', '30e0', 13)} as pw from states group by k), b as (select k, px, pz, pw, least(floor(px), 15)::int as x0, least(floor(pz), 26)::int as z0, least(floor(pw), 11)::int as w0 from q), d(dx, dz, dw) as (select a.range::int, b.range::int, c.range::int from range(2) a, range(2) b, range(2) c)
select b.k, round(sum((case dx when 1 then px - x0 else 1 - px + x0 end) * (case dz when 1 then pz - z0 else 1 - pz + z0 end) * (case dw when 1 then pw - w0 else 1 - pw + w0 end) * coalesce(c.w, 0)), 5) as w from b cross join d left join cells c on c.xi = x0 + dx and c.zi = z0 + dz and c.yawi = w0 + dw group by b.k""")
def j7_trilinear(spark, sf):
    q = frames.states(spark, sf).groupBy("k").agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.avg(c("yaw") % 360.0).alias("yaw"))
    out = lookup.trilinear(q, ["k"], lookup.build_grid(_labels(spark, sf), _AXES, ["w"]), _AXES, ["w"])
    return out.select("k", F.round("w", 5).alias("w"))


# Windows over frames


@query(f"""with {POSES}, v as (select run, frame, coalesce((lead(x) over w - x) * 30, (x - lag(x) over w) * 30, 0) as vx, coalesce((lead(y) over w - y) * 30, (y - lag(y) over w) * 30, 0) as vy from poses window w as (partition by run order by frame)) select run, frame, round(vx, 6) as vx, round(vy, 6) as vy, round(sqrt(vx * vx + vy * vy), 5) as speed_mps from v""")
def w1_velocity(spark, sf):
    v = motion.velocities(frames.poses(spark, sf), ["run"])
    return v.select("run", "frame", *r6(vx=c("vx"), vy=c("vy")), F.round("speed_mps", 5).alias("speed_mps"))


@query(f"""with {POSES}, s as (select run, frame, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as step from poses window w as (partition by run order by frame)) select run, frame, round(sum(coalesce(step, 0)) over (partition by run order by frame), 5) as arc from s where step is null or step > 1e-9""")
def w2_arc_length(spark, sf):
    return motion.arc_length(frames.poses(spark, sf), ["run"]).select("run", "frame", F.round("arc", 5).alias("arc"))


@query(f"""with {POSES}, a as (select run, frame, x, lead(x) over w - x as d1, x - lag(x) over w as d0 from poses window w as (partition by run order by frame)), b as (select *, lead(d1) over w as d2, lag(d0) over w as db from a window w as (partition by run order by frame)), e as (select *, (3 * d1 - d2) / 2 as s1, (3 * d0 - db) / 2 as s0 from b)
select run, frame, round(case when d0 is null and d1 is null then 0 when d0 is null then (case when d2 is null then d1 when s1 * d1 <= 0 then 0 when d1 * d2 < 0 and abs(s1) > 3 * abs(d1) then 3 * d1 else s1 end) when d1 is null then (case when db is null then d0 when s0 * d0 <= 0 then 0 when d0 * db < 0 and abs(s0) > 3 * abs(d0) then 3 * d0 else s0 end) when d0 * d1 > 0 then 6 / (3 / d0 + 3 / d1) else 0 end, 5) as slope from e""")
def w3_pchip_slopes(spark, sf):
    return motion.pchip_slopes(frames.poses(spark, sf).withColumn("frame", c("frame").cast("double")), ["run"], "frame", "x").select("run", c("frame").cast("long").alias("frame"), F.round("slope", 5).alias("slope"))


@query(f"""with {POSES}, w as (select run, frame, {wrap('lead(yaw, 10) over w - yaw')} as d, lead(yaw, 10) over w as ahead from poses window w as (partition by run order by frame)), r as (select run, frame, round(d, 6) as delta_yaw from w where ahead is not null and frame % 5 = 0) select *, case when delta_yaw > 0 then 'right' else 'left' end as direction from r order by abs(delta_yaw) desc, run, frame limit 50""")
def w9_turn_windows(spark, sf):
    t = motion.turn_windows(frames.poses(spark, sf), ["run"], 10, 5).withColumn("delta_yaw", F.round("delta_yaw", 6))
    return t.orderBy(F.desc(F.abs("delta_yaw")), "run", "frame").limit(50).withColumn("direction", F.when(c("delta_yaw") > 0, "right").otherwise("left"))


@query(f"with {REAL} select case_id, frame, actor_id, row_number() over (partition by case_id, frame order by depth desc, actor_id) - 1 as order_index from real_")
def w10_painter_order(spark, sf):
    return motion.painter_order(frames.real(spark, sf), ["case_id", "frame"], "depth", "actor_id").select("case_id", "frame", "actor_id", "order_index")


@query(f"""with recursive {POSES}, s(run, frame, smooth) as (select run, frame, x from poses where frame = 0 union all select p.run, p.frame, s.smooth * 0.85e0 + p.x * 0.15e0 from s join poses p on p.run = s.run and p.frame = s.frame + 1) select run, frame, round(smooth, 9) as smooth from s""")
def w8_smoothing(spark, sf):
    return motion.smoothed(frames.poses(spark, sf), "run", "x").select("run", "frame", F.round("smooth", 9).alias("smooth"))


# Sweeps and data sets

_SWEEP = """base as (select s_suppkey as base_id, 10e0 + s_suppkey % 20 as start_m, (s_nationkey % 3) * 0.5e0 + 3e0 as lane_y, 0e0 as target_y, 8e0 + s_suppkey % 5 as speed from supplier)"""


def _cases(spark, sf):
    s = table(spark, sf, "supplier")
    base = s.select(c("s_suppkey").alias("base_id"), (F.lit(10.0) + c("s_suppkey") % 20).alias("start_m"), ((c("s_nationkey") % 3) * 0.5 + 3.0).alias("lane_y"), F.lit(0.0).alias("target_y"), (F.lit(8.0) + c("s_suppkey") % 5).alias("speed"))
    cases = sweep.expand(base, {"ego_speed": [5.0, 9.0], "cut_start_s": [1.0, 2.0], "cut_s": [2.0, 3.0]})
    return cases.withColumn("case_id", c("base_id") * 8 + c("case_index") - 1)


@query(f"with {_SWEEP} select base_id, start_m, e as ego_speed, t as cut_start_s, d as cut_s, (ei * 4 + ti * 2 + di + 1)::bigint as case_index from base, (values (0, 5e0), (1, 9e0)) a(ei, e), (values (0, 1e0), (1, 2e0)) b(ti, t), (values (0, 2e0), (1, 3e0)) c(di, d)")
def j1_factor_sweep(spark, sf):
    return _cases(spark, sf).select("base_id", "start_m", "ego_speed", "cut_start_s", "cut_s", "case_index")


@query(f"""with {_SWEEP}, cs as (select base_id * 8 + ei * 4 + ti * 2 + di as case_id, *, from base, (values (0, 5e0), (1, 9e0)) a(ei, ego_speed), (values (0, 1e0), (1, 2e0)) b(ti, cut_start_s), (values (0, 2e0), (1, 3e0)) c(di, cut_s)), p as (select cs.*, i.range::int as i, lane_y + (target_y - lane_y) * (i.range / 20e0) * (i.range / 20e0) * (3 - 2 * (i.range / 20e0)) as y from cs, range(0, 21) i),
d as (select *, power(speed * cut_s / 20, 2) - power(y - lag(y) over (partition by case_id order by i), 2) as dx2 from p), s as (select *, start_m + speed * cut_start_s + sum(coalesce(sqrt(dx2), 0)) over (partition by case_id order by i) as x from d), seg as (select *, lead(x) over w as qx, lead(y) over w as qy, first_value(x) over w as x0 from s window w as (partition by case_id order by i)), f as (select cs.*, r.range as frame, r.range / 30e0 as t_s, (r.range / 30e0 - cut_start_s) / cut_s * 20 as since from cs, range(0, 241) r),
m as (select f.case_id, f.frame, case when f.since <= 0 then f.start_m + f.speed * f.t_s when f.since >= 20 then seg.x + f.speed * (f.t_s - f.cut_start_s - f.cut_s) else seg.x + (seg.qx - seg.x) * (f.since - seg.i) end as x, case when f.since <= 0 then f.lane_y when f.since >= 20 then seg.y else seg.y + (seg.qy - seg.y) * (f.since - seg.i) end as y, f.ego_speed * f.t_s as ego_x from f join seg on seg.case_id = f.case_id and seg.i = floor(least(greatest(f.since, 0), 20))::int),
k as (select case_id, frame, x - ego_x - 1.5 as z, case when x - ego_x - 1.5 <= 1e-5 then 'CULLED' when y < -4.00001 or y > 4.00001 or x - ego_x - 1.5 > 100.00001 then 'OOD' else 'SUPPORTED' end as class from m)
select case_id, count(*) as active, count(*) filter (where class <> 'CULLED') as required, count(*) filter (where class = 'SUPPORTED') as supported, count(*) filter (where class = 'CULLED') as culled, count(*) filter (where class = 'OOD') as ood, round(case when count(*) filter (where class <> 'CULLED') = 0 then 1 else count(*) filter (where class = 'SUPPORTED') / count(*) filter (where class <> 'CULLED') end, 6) as supported_fraction, round(min(z), 6) as min_z, round(max(z), 6) as max_z, min(frame) filter (where class = 'CULLED') as first_culled, min(frame) filter (where class = 'OOD') as first_ood, case when count(*) filter (where class = 'OOD') = 0 then 'SUPPORTED' else 'OUTSIDE' end as status from k group by 1""")
def t7_cut_in_capability(spark, sf):
    return sweep.capability_of_cases(_cases(spark, sf))


@query(f"""with {REAL}, v as (select *, greatest(cx - w / 2, 0) as x1, greatest(bottom - h, 0) as y1, least(cx + w / 2, 1279) as x2, least(bottom, 719) as y2 from real_ where visible and w between 8 and 1200 and h between 8 and 700), c as (select *, least(greatest(x1, 0), 1279) as xa from v where x2 - x1 between 8 and 1200 and y2 - y1 between 8 and 700), d as (select *, max(frame) over p as mf, first_value(depth) over (partition by case_id, actor_id order by frame) as d0 from c window p as (partition by case_id, actor_id))
select case_id, actor_id, frame, round((x1 + x2) / 2 / 1280, 6) as n_cx, round((y1 + y2) / 2 / 720, 6) as n_cy, round((x2 - x1) / 1280, 6) as n_w, round((y2 - y1) / 720, 6) as n_h, round(case when mf = 0 then 0 else frame::double / mf end, 6) as frame_progress, round(least(greatest(1 - depth / d0, 0), 1.5), 6) as distance_progress from d""")
def d1_box_dataset(spark, sf):
    return datasets.box_dataset(frames.real(spark, sf))


@query("""with h as (select o_orderkey, row_number() over (order by md5('s1' || o_orderkey::varchar), o_orderkey) as r, floor(count(*) over () * 0.8) as q from orders) select o_orderkey, case when r <= q then 'train' else 'held' end as part from h""")
def d5_exact_split(spark, sf):
    return datasets.exact_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""with {SYNTH} select case_id, count(*) as n_missing, min(frame) as first_missing, array_to_string(list_slice(list_sort(list(frame)), 1, 10), ',') as sample from (select case_id, frame from (select distinct case_id, frame from real_) except select case_id, frame from synth) group by 1""")
def o4_missing_frames(spark, sf):
    r, s = (f(spark, sf).select("case_id", "frame").distinct() for f in (frames.real, frames.synthetic))
    return r.join(s, ["case_id", "frame"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("frame").alias("first_missing"), F.array_join(F.slice(F.array_sort(F.collect_list("frame")), 1, 10), ",").alias("sample"))


# Corner boxes, road contact, turns, spec rules, reasons, galleries


_ROAD = [(45.0, 255.0), (30.0, 285.0), (20.0, 330.0), (15.0, 370.0)]


@query(f"with {STATES} select k, line, round(case when z <= 15 then 370e0 when z <= 20 then 370e0 - 40e0 * (z - 15) / 5 when z <= 30 then 330e0 - 45e0 * (z - 20) / 10 when z <= 45 then 285e0 - 30e0 * (z - 30) / 15 else 255e0 end, 6) as bottom from states")
def p_road_contact(spark, sf):
    return frames.states(spark, sf).select("k", "line", *r6(bottom=geometry.road_contact(c("z"), _ROAD)))


@query(f"""with {STATES}, n as (select *, row_number() over () as id from states), cr as (select id, k, line, x + f * sin(radians(yaw)) + r * cos(radians(yaw)) as cx, z + f * cos(radians(yaw)) - r * sin(radians(yaw)) as cz, 1.6e0 - up as cy from n, (values (-2.25e0), (2.25e0)) a(f), (values (-0.9e0), (0.9e0)) b(r), (values (0e0), (1.5e0)) d(up)),
pt as (select id, k, line, case when cz > 1e-4 then 640e0 + 1280 / (2e0 * tan(radians(45e0))) * cx / cz end as u, case when cz > 1e-4 then 360e0 + 1280 / (2e0 * tan(radians(45e0))) * cy / cz end as v from cr),
b as (select id, k, line, min(u) as u1, max(u) as u2, min(v) as v1, max(v) as v2 from pt group by id, k, line),
cl as (select k, line, least(greatest(u1, 0), 1279) as x1, least(greatest(v1, 0), 719) as y1, least(greatest(u2, 0), 1279) as x2, least(greatest(v2, 0), 719) as y2, coalesce(u2 >= 0 and u1 < 1280 and v2 >= 0 and v1 < 720, false) as meets from b),
s as (select *, meets and x2 - x1 >= 2 and y2 - y1 >= 2 as visible from cl)
select k, line, visible, round(case when visible then x1 else 0e0 end, 5) as x1, round(case when visible then y1 else 0e0 end, 5) as y1, round(case when visible then x2 else 0e0 end, 5) as x2, round(case when visible then y2 else 0e0 end, 5) as y2 from s""")
def p_corner_box(spark, sf):
    s = frames.states(spark, sf).select("k", "line", geometry.corner_points(c("x"), c("z"), c("yaw"), 4.5, 1.8, 1.5).alias("points"))
    b = geometry.points_box(c("points"))
    return s.select("k", "line", b["visible"].alias("visible"), *[F.round(b[k], 5).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("""with f as (select s_suppkey as k, unnest(range(0, 91)) as frame, 8e0 + s_suppkey % 5 as speed, case when s_suppkey % 2 = 0 then 90e0 else -90e0 end as turn from supplier), y as (select *, least(greatest(frame - 30, 0), 45) * turn / 45e0 as yaw from f)
select k, frame, round(yaw, 6) as yaw, round(sum(case when frame > 0 then speed / 30e0 * cos(radians(yaw)) else 0e0 end) over w, 6) as x, round(sum(case when frame > 0 then speed / 30e0 * sin(radians(yaw)) else 0e0 end) over w, 6) as y from y window w as (partition by k order by frame)""")
def w7_turning_ego(spark, sf):
    s = table(spark, sf, "supplier").select(c("s_suppkey").alias("k"), (c("s_suppkey") % 5 + 8.0).alias("speed"), F.when(c("s_suppkey") % 2 == 0, 90.0).otherwise(-90.0).alias("turn"))
    rows = s.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(90).cast("long"))))
    return motion.turning_ego(rows, ["k"], 1.0, 1.5).select("k", "frame", *r6(yaw=c("yaw"), x=c("x"), y=c("y")))


@query(f"""with {STATES}, d as (select k % 50 as case_id, line, case when z <= 1e-5 then 'CULLED' when x < -4.00001 or x > 4.00001 or z > 100.00001 then 'OOD' else 'SUPPORTED' end as class, concat_ws('+', case when x < -4.00001 then 'x_below_min' end, case when x > 4.00001 then 'x_above_max' end, case when z > 100.00001 then 'z_above_max' end) as reason from states),
e as (select case_id, line, class, reason, count(*) as n from d group by all)
select case_id, line, sum(n)::bigint as active, coalesce(sum(n) filter (where class = 'SUPPORTED'), 0)::bigint as supported, coalesce(sum(n) filter (where class = 'CULLED'), 0)::bigint as culled, coalesce(sum(n) filter (where class = 'OOD'), 0)::bigint as ood, coalesce(string_agg(reason || ':' || n, ',' order by reason || ':' || n) filter (where class = 'OOD'), '') as reasons,
 round(case when coalesce(sum(n) filter (where class <> 'CULLED'), 0) = 0 then 1e0 else coalesce(sum(n) filter (where class = 'SUPPORTED'), 0)::double / sum(n) filter (where class <> 'CULLED') end, 6) as supported_share from e group by case_id, line""")
def a4_reasons_by_actor(spark, sf):
    d = frames.states(spark, sf).select((c("k") % 50).alias("case_id"), "line", rules.capability(c("x"), c("z")).alias("class"), rules.domain_reason(c("x"), c("z")).alias("reason"))
    return compare.reasons_by_actor(d, ["case_id", "line"]).withColumn("supported_share", F.round("supported_share", 6))


@query(f"""with {STATES}, e as (select k % 50 as case_id, k, line, abs(x) + abs(z - 20) as err from states), r as (select *, row_number() over (partition by case_id order by err, k * 10 + line) - 1 as r, count(*) over (partition by case_id) as n from e),
t as (select *, least(12, n) as wanted, greatest(1, least(12, n) // 3) as third, greatest(0, n // 2 - least(12, n) // 6) as mid from r),
p as (select *, 'best' as part, r as place from t where r < third union all select *, 'middle', r - mid + third from t where r >= mid and r < mid + third union all select *, 'worst', r - (n - third) + 2 * third from t where r >= n - third)
select case_id, k, line, round(err, 6) as err, part, place::bigint as place from p where place < wanted""")
def d7_gallery(spark, sf):
    e = frames.states(spark, sf).select((c("k") % 50).alias("case_id"), "k", "line", (F.abs("x") + F.abs(c("z") - 20.0)).alias("err"), (c("k") * 10 + c("line")).alias("id"))
    return datasets.gallery(e, ["case_id"], "err", "id", 12).select("case_id", "k", "line", F.round("err", 6).alias("err"), "part", "place")


@query(f"""with {_SWEEP}, cs as (select *, ei * 4 + ti * 2 + di + 1 as case_index from base, (values (0, 5e0), (1, 9e0)) a(ei, ego_speed), (values (0, 1e0), (1, 2e0)) b(ti, cut_start_s), (values (0, 2e0), (1, 3e0)) d(di, cut_s))
select base_id, case_index::bigint as case_index, 'cut_after_end' as rule from cs where cut_start_s + cut_s > 4.5 union all select base_id, case_index, 'ego_faster_than_actor' from cs where ego_speed >= speed union all select base_id, case_index, 'start_too_near' from cs where start_m < 12""")
def f13_violations(spark, sf):
    broken = {"cut_after_end": c("cut_start_s") + c("cut_s") > 4.5, "ego_faster_than_actor": c("ego_speed") >= c("speed"), "start_too_near": c("start_m") < 12}
    return checks.violations(_cases(spark, sf), ["base_id", "case_index"], broken)


# Maneuvers, scripts, keyframes, exports, samples


_MANEUVER = "case s_suppkey % 5 when 0 then 'static' when 1 then 'oncoming' when 2 then 'cut_in' when 3 then 'following' else 'crossing' end"
_SCRIPT = f"script as (select s_suppkey as k, f.range as frame, f.range / 10e0 as t, {_MANEUVER} as m, 20e0 + s_suppkey % 30 as x0, 3.5e0 - s_nationkey % 2 * 7e0 as y0, 4e0 + s_suppkey % 7 as v, 1e0 + s_suppkey % 3 as start_s, 2e0 + s_suppkey % 2 as span_s from supplier, range(0, 81) f)"


def _script(spark, sf):
    kinds = ["static", "oncoming", "cut_in", "following", "crossing"]
    s = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("k"), F.get(F.array(*map(F.lit, kinds)), (c("s_suppkey") % 5).cast("int")).alias("maneuver"), (c("s_suppkey") % 30 + 20.0).alias("x0"), (F.lit(3.5) - c("s_nationkey") % 2 * 7.0).alias("y0"),
        (c("s_suppkey") % 7 + 4.0).alias("speed"), (c("s_suppkey") % 3 + 1.0).alias("start_s"), (c("s_suppkey") % 2 + 2.0).alias("span_s"),
    )
    return s.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(80).cast("long")))).withColumn("t_s", c("frame") / 10.0)


@query(f"""with {_SCRIPT}, u as (select *, (t - start_s) / span_s as u from script), s as (select *, least(greatest(u, 0), 1) as a from u), d as (select *, -y0 as dy from s),
st as (select k, frame, m, case m when 'static' then x0 when 'oncoming' then x0 - v * t when 'crossing' then x0 else x0 + v * t end as x, case m when 'cut_in' then y0 + dy * a * a * (3 - 2 * a) when 'crossing' then y0 - v * t else y0 end as y, case m when 'oncoming' then -v when 'cut_in' then v when 'following' then v else 0e0 end as vx, case m when 'cut_in' then dy * 6 * a * (1 - a) / span_s when 'crossing' then -v else 0e0 end as vy from d)
select k, frame, round(x, 6) as x, round(y, 6) as y, round(case m when 'static' then 15e0 when 'oncoming' then 180e0 when 'cut_in' then degrees(atan2(vy, vx)) when 'crossing' then -90e0 else 0e0 end, 6) as yaw, round(sqrt(vx * vx + vy * vy), 6) as speed_mps from st""")
def t5_rule_based(spark, sf):
    none = {n: F.lit(None).cast("double") for n in ("target_y", "target_x", "lane_y", "direction")}
    rows = _script(spark, sf).withColumns(none | {"yaw0": F.lit(15.0), "cut_start_s": c("start_s"), "cut_s": c("span_s")})
    return maneuvers.rule_based(rows).select("k", "frame", *r6(x=c("x"), y=c("y"), yaw=c("yaw"), speed_mps=c("speed_mps")))


@query(f"""with {_SCRIPT}, s as (select *, (t - start_s) / span_s as u, -y0 / 2 - y0 as dx from script), a as (select *, least(greatest(u, 0), 1) as a from s)
select k, frame, round(case m when 'cut_in' then y0 + dx * a * a * (3 - 2 * a) when 'crossing' then y0 + dx * a else y0 end, 6) as x, round(case m when 'oncoming' then x0 - v * t when 'following' then x0 + v * t when 'cut_in' then x0 + v * t else x0 end, 6) as z, round(case when m = 'oncoming' then 180e0 when m = 'cut_in' and a > 0 and a < 1 then degrees(atan2(dx, v * span_s)) when m = 'crossing' then 90e0 * sign(dx) else 0e0 end, 6) as yaw from a""")
def t6_recorded_states(spark, sf):
    rows = _script(spark, sf).withColumns({"lane_x": c("y0"), "target_x": -c("y0") / 2, "start_m": c("x0")})
    return maneuvers.recorded(rows).select("k", "frame", *r6(x=c("x"), z=c("z"), yaw=c("yaw")))


_KEYS = POSES + """, keys_ as (select run, frame * 0.5e0 + (run % 3) * 0.25e0 as t, x, y, yaw from poses where frame % 4 = 0),
first_ as (select run, min(t) as t, arg_min(x, t) as x, arg_min(y, t) as y, arg_min(yaw, t) as yaw from keys_ group by run)"""


def _keys(spark, sf):
    p = frames.poses(spark, sf)
    keys = p.where("frame % 4 = 0").select("run", (c("frame") * 0.5 + c("run") % 3 * 0.25).alias("t_s"), "x", "y", "yaw")
    spawns = p.select("run").distinct().withColumns({"start_s": F.lit(0.0), "x": F.lit(-5.0), "y": F.lit(0.0), "yaw": F.lit(170.0)})
    return p, keys, spawns


# Times and keys lie on decimal grids, where exact halves occur; a shift below any digit keeps rounding from tipping either way.
@query(f"""with {_KEYS}, all_ as (select * from keys_ union all select run, 0e0, -5e0, 0e0, 170e0 from first_ where t > 1e-9), k as (select *, lead(t) over w as t1, lead(x) over w as qx, lead(y) over w as qy, lead(yaw) over w as qyaw, row_number() over w as n from all_ window w as (partition by run order by t)), probe as (select run, frame * 0.4e0 - 1 as t from poses),
m as (select p.run, p.t, k.t as t0, k.t1, k.x, k.y, k.yaw, k.qx, k.qy, k.qyaw, k.n from probe p asof join k on p.run = k.run and p.t >= k.t), b as (select p.run, p.t, k.t as t0, null::double as t1, k.x, k.y, k.yaw, k.qx, k.qy, k.qyaw, k.n from probe p join k on p.run = k.run and k.n = 1 and p.t < k.t), j as (select *, (t - t0) / (t1 - t0) as u from (from m union all from b)),
s as (select *, t1 is null or (n = 1 and t <= t0) as still, case when run % 2 = 0 then u * u * (3 - 2 * u) else u end as a, (case when run % 2 = 0 then 6 * u * (1 - u) else 1 end) / (t1 - t0) as r from j)
select run, round(t + 3.7137e-11, 6) as t_s, round(case when still then x else x + (qx - x) * a end + 3.7137e-11, 6) as x, round(case when still then y else y + (qy - y) * a end + 3.7137e-11, 6) as y, round(case when still then {wrap('yaw')} else {wrap(f"yaw + {wrap('qyaw - yaw')} * a")} end + 3.7137e-11, 6) as yaw, round(case when still then 0 else sqrt(power((qx - x) * r, 2) + power((qy - y) * r, 2)) end + 3.7137e-11, 6) as speed_mps from s""")
def t3_keyframe_states(spark, sf):
    p, keys, spawns = _keys(spark, sf)
    out = maneuvers.keyframe_states(p.select("run", (c("frame") * 0.4 - 1.0).alias("t_s")), maneuvers.with_spawn(keys, spawns, "run"), "run", c("run") % 2 == 0)
    return out.select("run", *[F.round(c(k) + 3.7137e-11, 6).alias(k) for k in ("t_s", "x", "y", "yaw", "speed_mps")])


@query(f"with {_KEYS} select run, 'spawn_mismatch' as rule from first_ where t <= 1e-9 and (abs(x + 5) > 1e-6 or abs(y) > 1e-6 or abs({wrap('yaw - 170')}) > 1e-6)")
def t3_keyframe_faults(spark, sf):
    _, keys, spawns = _keys(spark, sf)
    return maneuvers.keyframe_faults(keys, spawns, "run")


@query("""with f as (select event_id % 200 as frame, event_id from events), s as (select event_id, frame, least(greatest((frame - 20) / 120e0, 0), 1) as u from f), h as (select event_id, frame, u * u * (3 - 2 * u) as s from s), w as (select *, round_even(40e0 + 160e0 * s, 0)::int as h, round_even(1280 * (0.5e0 + 0.1e0 * s), 0)::int as cx, round_even(720 * 0.8e0, 0)::int as b from h), x as (select *, greatest(round_even(h * 1.5e0, 0)::int, 1) as w from w)
select event_id, case when frame between 20 and 140 then round_even(cx - w / 2e0, 0)::int end as x1, case when frame between 20 and 140 then b - h end as y1, case when frame between 20 and 140 then round_even(cx - w / 2e0, 0)::int + w end as x2, case when frame between 20 and 140 then b end as y2 from x""")
def p41_sprite_schedule(spark, sf):
    box = maneuvers.sprite_schedule(c("event_id") % 200, 20, 140, (40.0, 200.0), 1.5, (1280, 720), 0.5, 0.8, 0.1)
    return table(spark, sf, "events").select("event_id", *[v.alias(k) for k, v in box.items()])


@query(f"""with {STATES}, n as (select *, row_number() over () as id from states), cr as (select id, k, line, x + f * sin(radians(yaw)) + r * cos(radians(yaw)) as cx, z + f * cos(radians(yaw)) - r * sin(radians(yaw)) as cz, 1.6e0 - up as cy from n, (values (-2.25e0), (2.25e0)) a(f), (values (-0.9e0), (0.9e0)) b(r), (values (0e0), (1.5e0)) d(up)),
pt as (select id, k, line, 640e0 + 640e0 * cx / cz as u, 360e0 + 640e0 * cy / cz as v, cz from cr where cz > 0.05e0), g as (select id, count(*) as n, greatest(min(u), 0) as x1, greatest(min(v), 0) as y1, least(max(u), 1279) as x2, least(max(v), 719) as y2, avg(cz) as depth from pt group by id),
q as (select n.k, n.line, g.*, case when coalesce(g.n, 0) < 2 then 'bbox_behind_camera' when x2 <= 0 or x1 >= 1280 or y2 <= 0 or y1 >= 720 then 'bbox_outside_image' when x2 <= x1 or y2 <= y1 then 'bbox_invalid' end as reason from n left join g using (id))
select k, line, coalesce(reason, '') as reason, round(case when reason is null then x1 end, 4) as x1, round(case when reason is null then y2 end, 4) as y2, round(case when coalesce(reason, '') in ('', 'bbox_outside_image') then depth end, 5) as depth from q""")
def p19_pair_box(spark, sf):
    s = frames.states(spark, sf)
    # Each value is a column before the next is made of it, so that none is computed more than once a row.
    at = [dict(zip((f"u{k}", f"v{k}", f"d{k}"), p, strict=True)) for k, p in enumerate(geometry.corners(c("x"), c("z"), c("yaw"), 4.5, 1.8, 1.5, 0.05))]
    s = s.select("k", "line", *[v.alias(n) for point in at for n, v in point.items()])
    b = geometry.corners_box([tuple(c(n) for n in point) for point in at])
    s = s.select("k", "line", *[b[n].alias(n) for n in ("reason", "x1", "y2", "depth")])
    return s.select("k", "line", F.coalesce("reason", F.lit("")).alias("reason"), F.round("x1", 4).alias("x1"), F.round("y2", 4).alias("y2"), F.round("depth", 5).alias("depth"))


@query("""with p as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value - 40 as x from events) select run, frame, 'warning' as severity, 'starts_far_behind' as message from p where frame = 0 and x < -10 union all select run, frame, 'warning', 'moves_far_behind' from p where x < -20""")
def f14_far_behind(spark, sf):
    return checks.far_behind(frames.poses(spark, sf).select("run", "frame", (c("x") * 10.0 - 40.0).alias("x")), ["run"])


@query("""select c_custkey, 'missing scenario_id' as rule from customer where c_custkey % 7 = 0 union all select c_custkey, 'missing camera.fov' from customer where c_nationkey % 5 = 0 or c_custkey % 11 = 0 union all select c_custkey, 'missing camera' from customer where c_custkey % 11 = 0""")
def f16_missing_keys(spark, sf):
    made = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.when(c("c_custkey") % 7 != 0, c("c_name")).alias("scenario_id"), F.when(c("c_custkey") % 11 != 0, F.struct(F.lit(1280).alias("width"), F.when(c("c_nationkey") % 5 != 0, F.lit(90.0)).alias("fov"))).alias("camera"))).alias("doc"))
    parsed = made.select("c_custkey", F.from_json("doc", "scenario_id string, camera struct<width:int,fov:double>").alias("d")).select("c_custkey", "d.*")
    return checks.missing_keys(parsed, ["c_custkey"], ["scenario_id", "camera", "camera.fov"])


def _plan_rows(spark, sf):
    return frames.poses(spark, sf).select((c("run") % 20).alias("scenario_id"), c("run").cast("string").alias("actor_id"), "frame", "x", "y", "yaw", "speed")


@query(f"with {POSES} select run % 20 as scenario_id, run::varchar as actor_id, frame, round(-y, 6) + 0e0 as x, round(x, 6) as z, round(-yaw, 6) + 0e0 as yaw, round(speed, 6) as speed from poses")
def t10_execution_plan(spark, sf):
    out = exports.plan_frames(exports.execution_plan(_plan_rows(spark, sf)))
    return out.select("scenario_id", "actor_id", "frame", *r6(x=c("x") + 0.0, z=c("z"), yaw=c("yaw") + 0.0, speed=c("speed")))


@query(f"with {POSES} select run % 20 as scenario_id, run::varchar as actor_id, frame, round(-y, 6) + 0e0 as x, round(x, 6) as z, round(-yaw, 6) + 0e0 as yaw from poses")
def t10_runtime_scenario(spark, sf):
    out = exports.runtime_frames(exports.runtime_scenario(_plan_rows(spark, sf)))
    return out.select("scenario_id", "actor_id", "frame", *r6(x=c("x") + 0.0, z=c("z"), yaw=c("yaw") + 0.0))


_DRAW = lambda name: f"(('0x' || substr(md5('7/{name}/' || o_orderkey), 1, 12))::bigint / 281474976710656e0)"


@query(f"select o_orderkey, round(5e0 + {_DRAW('forward_m')} * 55e0, 6) as forward_m, round(-3e0 + {_DRAW('lateral_m')} * 6e0, 6) as lateral_m, (['clear', 'rain', 'dusk'])[floor({_DRAW('weather')} * 3)::int + 1] as weather from orders")
def d4_sampled_scenarios(spark, sf):
    out = datasets.sampled_scenarios(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", {"forward_m": (5, 60), "lateral_m": (-3, 3)}, {"weather": ["clear", "rain", "dusk"]}, 7)
    return out.select("o_orderkey", *r6(forward_m=c("forward_m"), lateral_m=c("lateral_m")), "weather")


@query(f"""with {STATES}, n as (select k % 50 as scene, k, line, x, z, yaw, z > 2 as active from states), b as (select *, case when active then 640e0 + 640e0 * x / z end as cx, case when active then 360e0 + 640e0 * 1.6e0 / z end as bottom, case when active then 640e0 * 1.8e0 / z end as w, case when active then 640e0 * 1.5e0 / z end as h, {mod('degrees(atan2(x, z)) - yaw')} as seen from n),
v as (select *, coalesce(active and cx + w / 2 > -100 and cx - w / 2 < 1380 and bottom > -100 and bottom - h < 820, false) as rendered from b)
select scene, k, line, active, rendered, case when rendered then ((ceil(round(seen, 6) / 15e0 - 0.5e0)::int % 24) * 15)::int end as sprite, round(case when rendered then cx end, 5) as cx, case when rendered then row_number() over (partition by scene, rendered order by z desc, k, line, x, yaw) - 1 end as order_index from v""")
def t11_frame_metadata(spark, sf):
    s = frames.states(spark, sf).withColumn("scene", c("k") % 50)
    return metadata.frame_metadata(s, ["scene"], ["k", "line", "x", "yaw"], 1.8, 1.5, 2.0).select("scene", "k", "line", "active", "rendered", "sprite", F.round("cx", 5).alias("cx"), "order_index")


# Streams, run over what is there


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return shared_folder(spark, "stream")


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(avg(abs(value)), 6) as mae from events group by all")
def st4_windowed_errors(spark, sf):
    out = jobs.drained(spark, jobs.windowed_errors(jobs.read_events(spark, sf)), "st4", _shared(spark), "complete")
    return out.select(c("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("mae", 6).alias("mae"))


@query("""with f as (select user_id as run, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events) select run, count(*) as frames, count(*) filter (where frame between 50 and 150) as active, case when count(*) > 50 then 50 else -1 end as started, round(coalesce(min(greatest(4, value - 0.2 * (frame - 50))) filter (where frame between 50 and 150), 1e9), 6) as closest from f group by 1""")
def st1_track_lifecycle(spark, sf):
    out = jobs.drained(spark, jobs.track_lifecycle(jobs.read_events(spark, sf)), "st1", _shared(spark), "update")
    return out.groupBy("run").agg(*[F.max_by(k, "frames").alias(k) for k in ("active", "started")], F.max("frames").alias("frames"), F.round(F.max_by("closest", "frames"), 6).alias("closest"))


@query("select user_id, event_id, ts as real_ts, value as real_value, case when event_id % 7 <> 0 then ts + interval 5 minute end as synth_ts, case when event_id % 7 <> 0 then value + 1 end as synth_value from events")
def st3_stream_match(spark, sf):
    a = jobs.read_events(spark, sf)
    b = jobs.read_events(spark, sf).where("event_id % 7 <> 0").withColumns({"ts": F.expr("ts + interval 5 minutes"), "value": c("value") + 1})
    out = jobs.matched_to_end(spark, a, b, "st3", _shared(spark))
    return out.withColumns({k: c(k).cast("timestamp_ntz") for k in ("real_ts", "synth_ts")})


@query("""with f as (select user_id as run, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events), p as (select *, max(value) filter (where frame = 50) over (partition by run) + 30 as place from f)
select run, count(*) as frames, case when count(*) > 50 then 50 else -1 end as started, count(*) filter (where frame between 50 and 150) as active, round(coalesce(max(place), 0), 6) as place, round(coalesce(arg_max(abs(place - value), frame) filter (where frame between 50 and 150), -1), 6) as distance from p group by 1""")
def st5_stopped_track(spark, sf):
    out = jobs.drained(spark, jobs.stopped_track(jobs.read_events(spark, sf)), "st5", _shared(spark), "update")
    last = out.groupBy("run").agg(*[F.max_by(k, "frames").alias(k) for k in ("started", "active", "place", "distance")], F.max("frames").alias("frames"))
    return last.withColumns({"place": F.round("place", 6), "distance": F.round("distance", 6)})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from trajframe import runtime_queries, scenario_queries

    return _Q | runtime_queries.queries() | scenario_queries.queries()


def oracle_sql() -> dict[str, str]:
    from trajframe import runtime_queries, scenario_queries

    return _SQL | runtime_queries.oracle_sql() | scenario_queries.oracle_sql()

"""Queries of scenario documents, their rules and resolution, ordered logs, streams and training vectors, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.functions import runtime
from trajframe.operators import frames, lookup, motion, reports, scenarios
from trajframe.operators.frames import c, table
from trajframe.plans import datasets, features, metadata
from trajframe.queries import POSES, REAL, SYNTH, wrap
from trajframe.sources import io
from trajframe.sources import scenarios as documents
from trajframe.sources.folders import shared_folder
from trajframe.streaming import image_track, jobs

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def six(**cols) -> list:
    return [F.round(v, 6).alias(k) for k, v in cols.items()]


def r6(**cols) -> str:
    return ", ".join(f"round({v}, 6) as {k}" for k, v in cols.items())


# Decimal inputs give exact halves at the sixth place, which two engines' last bits tip either way; a shift below any digit keeps both alike.

# Streams


_TRACK = image_track.TrackSettings(trigger=12, duration=15, gap=5)
_SEEN = """seen as (select user_id as run, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, case when event_id % 5 <> 0 then value * 12.8e0 end as centre, (event_id % 11) / 10e0 as conf from events)"""


@query(f"""with recursive {_SEEN}, t(run, event_id, frame, road, conf, started, finished, age, start_u, target_u, progress, u, v, reason) as (
select distinct run, null::bigint, -1::bigint, 640e0, 0e0, -1::bigint, -1::bigint, 0::bigint, 0e0, 0e0, null::double, null::double, null::double, null::varchar from seen union all
select run, event_id, frame, road, conf, case when over then -1 else started end, case when over then frame else finished end, case when live then age + 1 else age end,
  case when live then 0.98e0 * start_u + 0.02e0 * road else start_u end, case when live then (1 - gain) * target_u + gain * road else target_u end, case when live then progress end, case when live then (1 - gain) * way + gain * road end,
  case when live then case when progress >= 1 then 720 * 0.88e0 else 720 * 0.55e0 + progress * progress * (720 * 0.88e0 - 720 * 0.55e0) end end, case when started < 0 then 'waiting_for_trigger' when over then 'duration_finished' end
from (select *, case when progress >= 1 then target_u else start_u + progress * progress * (target_u - start_u) end as way, greatest(0.05e0, least(0.12e0 + 0.35e0 * conf, 0.55e0)) as gain
from (select *, started >= 0 and frame - started > 15 as over, started >= 0 and frame - started <= 15 as live, least((age + 1) / 15e0, 1) as progress
from (select run, event_id, frame, road, conf, case when starts then frame else started end as started, finished, case when starts then 0 else age end as age, case when starts then road else start_u end as start_u, case when starts then road else target_u end as target_u
from (select s.run, s.event_id, s.frame, case when s.centre is null then 0.97e0 * t.road + (1 - 0.97e0) * 640e0 else 0.75e0 * t.road + 0.25e0 * s.centre end as road, case when s.centre is null then 0 else s.conf end as conf, t.started, t.finished, t.age, t.start_u, t.target_u,
  t.started < 0 and s.frame >= 12 and (t.finished < 0 or s.frame - t.finished >= 5) as starts from t join seen s on s.run = t.run and s.frame = t.frame + 1)))))
select run, event_id, frame, reason is null as active, reason, round(road + 3.7137e-11, 6) as road, round(progress + 3.7137e-11, 6) as progress, round(u + 3.7137e-11, 6) as u, round(v + 3.7137e-11, 6) as v from t where frame >= 0""")
def st2_image_track(spark, sf):
    seen = jobs.read_events(spark, sf).select(c("user_id").alias("run"), "ts", "event_id", F.when(c("event_id") % 5 != 0, c("value") * 12.8).alias("centre"), (c("event_id") % 11 / 10.0).alias("confidence"))
    out = jobs.drained_to_end(spark, seen, lambda s: image_track.image_track(s, _TRACK), "st2", shared_folder(spark, "stream"))
    return out.select("run", "event_id", "frame", "active", "reason", *[F.round(c(n) + 3.7137e-11, 6).alias(n) for n in ("road", "progress", "u", "v")])


# Motion


@query(f"""with recursive {POSES}, seen as (select run, frame, case when frame % 4 <> 1 then x end as x from poses), s(run, frame, smooth) as (select distinct run, -1::bigint, 640e0 from seen union all select p.run, p.frame, case when p.x is null then s.smooth * 0.97e0 + 640e0 * 0.03e0 else s.smooth * 0.85e0 + p.x * 0.15e0 end from s join seen p on p.run = s.run and p.frame = s.frame + 1) select run, frame, round(smooth, 9) as smooth from s where frame >= 0""")
def w8_fallback(spark, sf):
    rows = frames.poses(spark, sf).select("run", "frame", F.when(c("frame") % 4 != 1, c("x")).alias("x"))
    return motion.smoothed(rows, "run", "x", default=640.0, start=640.0, block=16).select("run", "frame", F.round("smooth", 9).alias("smooth"))


@query(f"""with {POSES}, k as (select run, frame * 2.5e0 as f, case when frame % 7 = 3 then frame / 12e0 - 0.25e0 / 3 when frame % 7 = 2 then frame / 12e0 else frame / 12e0 end as t, x, y from poses where frame < 20 and (run % 9 <> 0 or frame = 0)), l as (select *, lag(f) over w as pf, lag(t) over w as pt, lag(x) over w as px, lag(y) over w as py, lead(f) over w as qf, lead(t) over w as qt, lead(x) over w as qx, lead(y) over w as qy from k window w as (partition by run order by f, t)),
s as (select run, f, case when pf is null then f else pf end as f0, case when pf is null then qf else f end as f1, case when pf is null then t else pt end as t0, case when pf is null then qt else t end as t1, case when pf is null then x else px end as x0, case when pf is null then qx else x end as x1, case when pf is null then y else py end as y0, case when pf is null then qy else y end as y1 from l),
ask as (select run, frame::double as f from poses), m as (select a.run, a.f as frame, s.* exclude (run, f), row_number() over (partition by a.run, a.f order by case when s.f >= a.f then s.f else 1e9 - s.f end) as n from ask a join s on a.run = s.run)
select run, frame, {r6(v_x='case when x1 is null then 0 else (x1 - x0) / case when abs(t1 - t0) < 1e-6 then f1 - f0 else t1 - t0 end end', v_y='case when y1 is null then 0 else (y1 - y0) / case when abs(t1 - t0) < 1e-6 then f1 - f0 else t1 - t0 end end')} from m where n = 1""")
def w14_keyframe_velocity(spark, sf):
    p = frames.poses(spark, sf)
    # Every seventh keyframe has the time of the one before it.
    t = F.when(c("frame") % 7 == 3, c("frame") / 12.0 - 0.25 / 3).otherwise(c("frame") / 12.0)
    keys = p.where("frame < 20 and (run % 9 <> 0 or frame = 0)").select("run", (c("frame") * 2.5).alias("frame"), t.alias("t_s"), "x", "y")
    out = motion.bracket_velocity(p.select("run", "frame"), keys, "run", ["x", "y"])
    return out.select("run", "frame", *six(v_x=c("v_x"), v_y=c("v_y")))


# Look-up


_AXES = {"z": [5.0, 7.0, 10.0, 15.0, 22.0, 30.0, 45.0, 60.0], "x": [-3.0, -2.0, -0.5, 0.0, 1.0, 2.5, 3.0]}
_CELLS = """cells as (select l_partkey % 8 as zi, l_suppkey % 7 as xi, l_orderkey % 36 * 10 + l_linenumber as yi, avg((l_orderkey % 5 <> 0)::int::double) as visible, avg(l_extendedprice % 1280)::double as cx, avg(l_quantity * 8 + 300)::double as bottom, avg(l_quantity * 4)::double as w, avg(l_quantity * 3)::double as h from lineitem group by all)"""
_NAN = "'nan'::double"
_BOUND = lambda k, v: f"len([a for a in ax_{k} if a <= {v}]) - 1"


@query(f"""with {_CELLS}, axes as (select {_AXES['z']}::double[] as ax_z, {_AXES['x']}::double[] as ax_x), q as (select o_orderkey as k, case when o_orderkey % 6 = 0 then 15e0 else o_totalprice % 70 end as z, case when o_orderkey % 10 = 0 then -0.5e0 else o_totalprice % 8 - 4 end as x, o_orderkey % 720 / 2e0 - 5 as yaw from orders),
h as (select *, greatest(least(z, 60), 5) as hz, greatest(least(x, 3), -3) as hx, ((yaw % 360) + 360) % 360 as y from q, axes), b as (select *, {_BOUND('z', 'hz')} as z0, {_BOUND('x', 'hx')} as x0, floor(y)::int % 360 as y0, y - floor(y) as wy from h),
c as (select *, case when hz <= 5 or hz >= 60 then z0 else z0 + 1 end as z1, case when hx <= -3 or hx >= 3 then x0 else x0 + 1 end as x1, (y0 + 1) % 360 as y1 from b), d as (select *, case when z0 = z1 then 0 else (hz - ax_z[z0 + 1]) / (ax_z[z1 + 1] - ax_z[z0 + 1]) end as wz, case when x0 = x1 then 0 else (hx - ax_x[x0 + 1]) / (ax_x[x1 + 1] - ax_x[x0 + 1]) end as wx from c),
e as (select d.*, {', '.join(f"coalesce(c{i}.{v}, {_NAN}) as {v}{i}" for v in ('visible', 'cx', 'bottom', 'w', 'h') for i in range(8))} from d {' '.join(f"left join cells c{i} on c{i}.zi = d.z{i & 1} and c{i}.xi = d.x{i >> 1 & 1} and c{i}.yi = d.y{i >> 2}" for i in range(8))}),
f as (select k, z, x, abs(hz - z) > 1e-6 or abs(hx - x) > 1e-6 as clamped, {', '.join(f"((({v}0 * (1 - wy) + {v}4 * wy) * (1 - wx) + ({v}2 * (1 - wy) + {v}6 * wy) * wx) * (1 - wz) + (({v}1 * (1 - wy) + {v}5 * wy) * (1 - wx) + ({v}3 * (1 - wy) + {v}7 * wy) * wx) * wz) as {v}" for v in ('visible', 'cx', 'bottom', 'w', 'h'))} from e),
g as (select *, not isnan(visible) and not isnan(w) and not isnan(h) and visible >= 0.5 and w >= 1 and h >= 1 and z >= 0 as ok, greatest(0, least(1279, cx - w / 2)) as bx1, greatest(0, least(719, bottom - h)) as by1, greatest(0, least(1279, cx + w / 2)) as bx2, greatest(0, least(719, bottom)) as by2 from f), i as (select *, case when not ok then 'not_visible' when not (bx2 > bx1 and by2 > by1) then 'outside_image' end as reason from g)
select k, reason is null as visible, reason, clamped, {r6(share=f'case when isnan(visible) then null else visible end', cx='case when reason is null then cx end', x1='case when reason is null then bx1 end', y1='case when reason is null then by1 end', x2='case when reason is null then bx2 end', y2='case when reason is null then by2 end')} from i""")
def j7_placed(spark, sf):
    li = table(spark, sf, "lineitem")
    price = c("l_extendedprice").cast("double")
    cells = li.select((c("l_partkey") % 8).cast("int").alias("zi"), (c("l_suppkey") % 7).cast("int").alias("xi"), (c("l_orderkey") % 36 * 10 + c("l_linenumber")).cast("int").alias("yawi"), (c("l_orderkey") % 5 != 0).cast("double").alias("visible"), (price % 1280).alias("cx"), (c("l_quantity") * 8.0 + 300).alias("bottom"), (c("l_quantity") * 4.0).alias("w"), (c("l_quantity") * 3.0).alias("h"))
    grid = cells.groupBy("zi", "xi", "yawi").agg(*[F.avg(v).alias(v) for v in ("visible", "cx", "bottom", "w", "h")])
    total = c("o_totalprice").cast("double")
    asked = table(spark, sf, "orders").select(c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 6 == 0, 15.0).otherwise(total % 70).alias("z"), F.when(c("o_orderkey") % 10 == 0, -0.5).otherwise(total % 8 - 4).alias("x"), (c("o_orderkey") % 720 / 2.0 - 5).alias("yaw"))
    out = lookup.placed(asked, ["k"], grid, lookup.SortedAxis(_AXES["x"]), lookup.SortedAxis(_AXES["z"]))
    return out.select("k", "visible", "reason", "clamped", *six(share=F.nanvl("share", F.lit(None).cast("double")), cx=c("cx"), **{k: c(k) for k in ("x1", "y1", "x2", "y2")}))


# Reports


_METRICS = {
    "iou": "i / (w * h + rw * rh - i)", "centre_error": "sqrt(power(cx - rcx, 2) + power((bottom - h / 2) - (rb - rh / 2), 2))", "abs_dx": "abs(cx - rcx)", "abs_dy": "abs((bottom - h / 2) - (rb - rh / 2))", "w_error": "abs(w - rw)", "h_error": "abs(h - rh)",
    "rel_w": "abs(w - rw) / rw", "rel_h": "abs(h - rh) / rh", "area_ratio": "w * h / (rw * rh)",
}
_BOXES = SYNTH + """, j as (select s.case_id, s.actor_id, s.frame, s.cx, s.bottom, s.w, s.h, r.cx as rcx, r.bottom as rb, r.w as rw, r.h as rh, coalesce(r.visible and r.w > 0 and r.h > 0, false) as real_ok, coalesce(s.visible and s.w > 0 and s.h > 0, false) as pred_ok from synth s left join (select * from real_ where k % 5 <> 0) r using (case_id, actor_id, frame)),
o as (select *, real_ok and pred_ok as valid, greatest(least(cx + w / 2, rcx + rw / 2) - greatest(cx - w / 2, rcx - rw / 2), 0) * greatest(least(bottom, rb) - greatest(bottom - h, rb - rh), 0) as i from j)"""


@query(f"""with {_BOXES}, m as ({' union all '.join(f"select '{k}' as metric, case when valid then {v} end as value from o" for k, v in _METRICS.items())}), t as (select count(*) as total, count(*) filter (where valid) as valid, count(*) filter (where not pred_ok) as invalid_predicted, count(*) filter (where not real_ok) as invalid_real from o)
select metric, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(min(value), 6) as least, round(max(value), 6) as most, total, valid, invalid_predicted, invalid_real from m, t group by all""")
def a15_box_report(spark, sf):
    return reports.box_report(frames.synthetic(spark, sf), frames.real(spark, sf).where("k % 5 <> 0"), ["case_id", "actor_id", "frame"])


# Ordered logs


@query(f"with {POSES} select run, frame, case when frame % 3 = 1 then speed + 100 else speed end as speed from poses")
def s1_pose_log(spark, sf):
    p = frames.poses(spark, sf).select("run", "frame", "speed")
    again = p.where("frame % 3 = 1").select("run", "frame", F.lit(1).alias("nth"), (c("speed") + 100.0).alias("speed"))
    rows = p.select("run", "frame", F.lit(0).alias("nth"), "speed").unionByName(again)
    line = F.to_json(F.struct("run", c("frame").alias("recorded_frame_idx"), c("speed").alias("ego_speed_mps")))
    # Blank lines between, and repeats long after the first line of a frame. A file holds many runs: their number grows with the users.
    lines = rows.select("run", "nth", "frame", F.explode(F.when(c("frame") % 5 == 0, F.array(line, F.lit("  "))).otherwise(F.array(line))).alias("value"))
    path = shared_folder(spark, "logs")
    lines.repartition("run").sortWithinPartitions("run", "nth", "frame").select("value").write.text(path)
    log = io.read_pose_log(spark, path, log="run long")
    return log.select("run", c("recorded_frame_idx").alias("frame"), c("ego_speed_mps").alias("speed"))


@query(f"""with {SYNTH}, r as (select case_id, frame, arg_max(visible, actor_id) as visible, arg_max(cx, actor_id) as cx, arg_max(depth, actor_id) as depth from real_ group by all), s as (select case_id, frame, count(*) as n, arg_min(visible, actor_id) as visible, arg_min(cx, actor_id) as cx from synth group by all)
select case_id, frame, 'real' as side, visible, null::boolean as rendered, {r6(cx='case when frame % 9 <> 0 then cx end', depth='depth')} from r union all select case_id, frame, 'synthetic', case when frame % 7 = 0 then false else visible end, case when frame % 7 = 0 then false else frame % 3 <> 0 end, round(case when frame % 7 <> 0 then cx end, 6), null from s""")
def s4_single_actor_logs(spark, sf):
    box = lambda *own: F.struct(*own)
    real = frames.real(spark, sf).select("case_id", "actor_id", "frame", F.to_json(F.struct(c("frame").alias("recorded_frame_idx"), box("visible", F.when(c("frame") % 9 != 0, c("cx")).alias("cx"), c("depth").alias("depth_m")).alias("bbox"))).alias("value"))
    path, doc = shared_folder(spark, "real-v1"), shared_folder(spark, "synth-v1")
    # A frame's actors write one line each; the last line is the last actor's.
    real.repartition("case_id").sortWithinPartitions("case_id", "actor_id", "frame").select("case_id", "value").write.partitionBy("case_id").text(path)
    each = frames.synthetic(spark, sf).groupBy("case_id", "frame").agg(F.sort_array(F.collect_list(F.struct(c("actor_id").alias("id"), "visible", "cx"))).alias("a"))
    adversaries = F.when(c("frame") % 7 == 0, F.array().cast("array<struct<id:string,rendered:boolean,box:struct<visible:boolean,cx:double>>>")).otherwise(F.transform("a", lambda a: F.struct(a["id"].alias("id"), (c("frame") % 3 != 0).alias("rendered"), F.struct(a["visible"].alias("visible"), a["cx"].alias("cx")).alias("box"))))
    docs = each.select("case_id", F.struct(c("frame").alias("frame_idx"), adversaries.alias("adversaries")).alias("f")).groupBy("case_id").agg(F.collect_list("f").alias("frames"))
    docs.select("case_id", F.to_json(F.struct("frames"), {"pretty": "true"}).alias("value")).write.partitionBy("case_id").text(doc)
    a = io.read_real_v1(spark, path, ["case_id"]).select("case_id", "frame", F.lit("real").alias("side"), "visible", F.lit(None).cast("boolean").alias("rendered"), *six(cx=c("cx"), depth=c("depth")))
    b = io.read_synth_v1(spark, doc, ["case_id"]).select("case_id", "frame", F.lit("synthetic").alias("side"), "visible", "rendered", *six(cx=c("cx"), depth=c("depth")))
    return a.unionByName(b).withColumn("case_id", c("case_id").cast("long"))


# Displacements, designs, crops, previews


@query(f"with {POSES}, s as (select run, x as x0, y as y0, yaw as yaw0 from poses where frame = 0) select run, frame, {r6(ahead='(x - x0) * cos(radians(yaw0)) + (y - y0) * sin(radians(yaw0)) + 1e-11', flat='sqrt(power(x - x0, 2) + power(y - y0, 2))', full_='sqrt(power(x - x0, 2) + power(y - y0, 2) + power(speed / 10, 2))', norm='sqrt(x * x + y * y + speed * speed)')} from poses join s using (run)")
def p36_displacements(spark, sf):
    p = frames.poses(spark, sf)
    start = p.where("frame = 0").select("run", c("x").alias("x0"), c("y").alias("y0"), c("yaw").alias("yaw0"))
    r = p.join(start, "run")
    flat = runtime.distance([c("x"), c("y")], [c("x0"), c("y0")])
    full = runtime.distance([c("x"), c("y"), c("speed") / 10], [c("x0"), c("y0"), F.lit(0.0)])
    return r.select("run", "frame", *six(ahead=runtime.displacement_ahead(c("x"), c("y"), c("x0"), c("y0"), c("yaw0")) + 1e-11, flat=flat, full_=full, norm=runtime.speed_norm(c("x"), c("y"), c("speed"))))


@query("with s as (select s_suppkey as k, 0.5e0 + s_suppkey % 3 * 0.25e0 as sx from supplier) select k, round(-1 + i.range * sx, 6) as x, round(5 + j.range * 2.5e0, 6) as z, round(n.range * 30e0, 6) as yaw from s, range(9) i, range(20) j, range(4) n where -1 + i.range * sx <= 1 + 1e-6 and 5 + j.range * 2.5e0 <= 5 + k % 20 + 1e-6")
def d2_design_points(spark, sf):
    k = c("s_suppkey")
    axes = {"x": (F.lit(-1.0), F.lit(1.0), k % 3 * 0.25 + 0.5), "z": (F.lit(5.0), k % 20 + 5.0, F.lit(2.5)), "yaw": (F.lit(0.0), F.lit(90.0), F.lit(30.0))}
    return datasets.design_points(table(spark, sf, "supplier").select("s_suppkey"), axes).select(k.alias("k"), "x", "z", "yaw")


@query(f"""with {REAL}, f as (select case_id, actor_id, k, case when k % 31 <> 0 then frame end as frame, k % 13 <> 0 as meta, case when k % 13 <> 0 then trunc(cx - w / 2)::int end as x1, case when k % 13 <> 0 then trunc(bottom - h)::int end as y1, case when k % 13 <> 0 then case when k % 17 = 0 then trunc(cx - w / 2)::int else trunc(cx + w / 2)::int end end as x2, case when k % 13 <> 0 then trunc(bottom)::int end as y2 from real_),
g as (select *, case when frame is null then 'bad_name' when not meta then 'no_metadata' when not (x2 > x1 and y2 > y1) then 'invalid_box' when k % 11 = 0 or k % 19 = 0 then 'missing_image' end as reason, greatest(greatest(x2 - x1, y2 - y1) * 1.5e0, 64) as side from f),
h as (select *, least(greatest((x1 + x2) / 2e0 - side / 2, 0), greatest(1280 - side, 0)) as left_, least(greatest((y1 + y2) / 2e0 - side / 2, 0), greatest(720 - side, 0)) as top_ from g), n as (select k, row_number() over (order by case_id, frame, k) - 1 as sample_id from g where reason is null)
select h.k, reason, case when reason is null then round_even(left_, 0)::int end as crop_x1, case when reason is null then round_even(least(top_ + side, 720), 0)::int end as crop_y2, sample_id, sample_id % 25 = 0 as preview from h left join n on h.k = n.k""")
def d6_crop_samples(spark, sf):
    k, meta = c("k"), c("k") % 13 != 0
    whole = lambda v: F.when(meta, v.cast("int"))
    # Frames of a case's actors are told apart by a number that keeps their order.
    f = frames.real(spark, sf).select("case_id", "k", F.when(k % 31 != 0, F.struct("frame", "k")).alias("frame"), meta.alias("has_metadata"), (k % 11 != 0).alias("has_rough"), (k % 19 != 0).alias("has_target"), whole(c("cx") - c("w") / 2).alias("x1"), whole(c("bottom") - c("h")).alias("y1"), F.when(k % 17 == 0, whole(c("cx") - c("w") / 2)).otherwise(whole(c("cx") + c("w") / 2)).alias("x2"), whole(c("bottom")).alias("y2"))
    return datasets.crop_samples(f, "case_id").select("k", "reason", "crop_x1", "crop_y2", "sample_id", "preview")


@query(f"""with {POSES}, s as (select run, x as x0, speed / 8 + 6 as z0, yaw as yaw0 from poses where frame = 0), e as (select run, max(frame) as ends from poses group by 1), m as (select p.run, p.frame, x0 + 0.4e0 * (p.frame / 30e0) as x, z0 - 1.5e0 * (p.frame / 30e0) as z, yaw0 as yaw from poses p join s using (run) join e using (run) where p.frame % 20 = 0 or p.frame = ends)
select run, frame, {r6(x='x', z='z')}, sprite from (select *, (ceil(round({'((degrees(atan2(x, z)) - yaw) % 360 + 360) % 360'}, 6) / 15e0 - 0.5e0)::int % 24) * 15 as sprite from m)""")
def d11_preview(spark, sf):
    p = frames.poses(spark, sf)
    start = p.where("frame = 0").select("run", c("x").alias("x0"), (c("speed") / 8 + 6).alias("z0"), c("yaw").alias("yaw0"))
    t = c("frame") / 30.0
    rows = p.select("run", "frame").join(start, "run").select("run", "frame", (c("x0") + 0.4 * t).alias("x"), (c("z0") - 1.5 * t).alias("z"), c("yaw0").alias("yaw"))
    return metadata.preview(rows, ["run"], 20).select("run", "frame", *six(x=c("x"), z=c("z")), "sprite")


# Scenario documents


def _spec(spark, sf) -> DataFrame:
    """A scenario document a customer: an ego, an actor of each kind of motion, and for some one that no one knows."""
    k = c("c_custkey")
    pose = lambda x, y, yaw: F.struct(x.cast("double").alias("x_m"), y.cast("double").alias("y_m"), yaw.cast("double").alias("yaw_deg"))
    point = lambda x, y: F.struct(x.cast("double").alias("x_m"), y.cast("double").alias("y_m"))
    key = lambda t, x, y, yaw: F.struct(t.cast("double").alias("t_s"), x.cast("double").alias("x_m"), y.cast("double").alias("y_m"), yaw.cast("double").alias("yaw_deg"))
    lit = F.lit
    null = lambda t: F.lit(None).cast(t)

    def motion_of(mode, **own):
        kinds = {"maneuver": "string", "speed_mps": "double", "start_time_s": "double", "duration_s": "double", "waypoints": f"array<{documents.POINT}>", "target_speed_mps": "double", "interpolation": "string", "keyframes": f"array<{documents.KEY}>"}
        return F.struct(lit(mode).alias("mode"), *[own.get(n, null(t)).cast(t).alias(n) for n, t in kinds.items()]).alias("motion")

    def actor(name, spawn, move, start=None, end=None):
        life = F.struct((start if start is not None else null("double")).cast("double").alias("spawn_time_s"), (end if end is not None else null("double")).cast("double").alias("despawn_time_s"))
        return F.struct(lit(name).alias("actor_id"), lit("traffic").alias("role"), spawn.alias("spawn"), life.alias("lifecycle"), move)

    kinds = F.get(F.array(*map(lit, ("static", "straight", "following", "oncoming", "cut_in"))), (k % 5).cast("int"))
    reach = k % 4 + 6
    ways = F.when(k % 11 == 0, F.array(point(lit(5), lit(0)))).otherwise(F.array(point(reach, lit(0)), point(reach, lit(4))))
    keys = F.array(F.when(k % 13 == 0, key(lit(0), k % 10, lit(2), lit(170))).otherwise(key(lit(1), k % 10, lit(2), lit(170))), key(lit(2), k % 10 + 4, lit(-2), lit(-170)))
    actors = F.array(
        actor("man", pose(k % 9 + 10, k % 3 * 3.5, k % 8 * 45), motion_of("maneuver", maneuver=kinds, speed_mps=k % 6 + 3, start_time_s=k % 3 * 0.7, duration_s=F.when(k % 4 == 0, 1.5)), k % 2 * 0.5, F.when(k % 7 == 0, 2.0)),
        actor("path", pose(lit(5), lit(0), lit(0)), motion_of("path", waypoints=ways, target_speed_mps=k % 3 + 1, interpolation=lit("linear"))),
        actor("keys", pose(lit(0), lit(1), lit(160)), motion_of("keyframes", keyframes=keys, interpolation=F.when(k % 2 == 1, "smooth"))),
        F.when(k % 17 == 0, actor("ghost", pose(lit(1), lit(1), lit(0)), motion_of("teleport"))),
    )
    ego = F.struct(motion_of("maneuver", maneuver=lit("straight"), speed_mps=k % 5 + 2))
    return table(spark, sf, "customer").select(F.format_string("s%d", k).alias("scenario_id"), lit(3.0).alias("duration_s"), lit(4).alias("fps"), ego.alias("ego"), F.filter(actors, lambda a: a.isNotNull()).alias("actors"))


def _read_spec(spark, sf) -> DataFrame:
    path = shared_folder(spark, "scenarios")
    documents.write_documents(_spec(spark, sf), path)
    return documents.read_documents(spark, path, lines=True)


_MAN = "case c_custkey % 5 when 0 then 'static' when 1 then 'straight' when 2 then 'following' when 3 then 'oncoming' else 'cut_in' end"


@query(f"""with a as (select c_custkey as k, 'ego' as actor_id, 'maneuver' as mode, 'straight' as tag, 0e0 as x0, 0e0 as spawn_s, 3e0 as end_s, 1 as parts from customer union all select c_custkey, 'man', 'maneuver', {_MAN}, 10e0 + c_custkey % 9, c_custkey % 2 * 0.5e0, case when c_custkey % 7 = 0 then 2e0 else 3e0 end, 1 from customer
union all select c_custkey, 'path', 'path', 'linear', 5e0, 0e0, 3e0, case when c_custkey % 11 = 0 then 1 else 2 end from customer union all select c_custkey, 'keys', 'keyframes', case when c_custkey % 2 = 1 then 'smooth' else 'linear' end, 0e0, 0e0, 3e0, 2 from customer union all select c_custkey, 'ghost', 'teleport', null, 1e0, 0e0, 3e0, 0 from customer where c_custkey % 17 = 0)
select 's' || k as scenario_id, actor_id, mode, tag, x0, spawn_s, end_s, parts, case when mode = 'teleport' then 'unknown motion: teleport' end as fault from a""")
def s8_scenario_documents(spark, sf):
    raw = _read_spec(spark, sf)
    rows = documents.scenario_actors(documents.typed_scenarios(raw))
    m = c("motion")
    tag = F.coalesce(m["maneuver"]["maneuver"], m["path"]["interpolation"], m["keyframes"]["interpolation"])
    parts = F.coalesce(F.size(m["path"]["waypoints"]), F.size(m["keyframes"]["keyframes"]), F.when(m["maneuver"].isNotNull(), 1), F.lit(0))
    faults = documents.scenario_faults(raw).select("scenario_id", "actor_id", "fault")
    return rows.select("scenario_id", "actor_id", m["mode"].alias("mode"), tag.alias("tag"), "x0", "spawn_s", "end_s", parts.alias("parts")).join(faults, ["scenario_id", "actor_id"], "left")


_RESOLVED = f"""k as (select c_custkey as k from customer), f as (select k, range as frame, range / 4e0 as t from k, range(13)),
man as (select k, frame, t, 10e0 + k % 9 as x0, k % 3 * 3.5e0 as y0, k % 8 * 45e0 as yaw0, k % 5 as kind, case when k % 4 = 0 then 1.5e0 end as dur, k % 6 + 3e0 as speed, greatest(t - k % 3 * 0.7e0, 0) as since from f where k % 5 <> 4 and t >= k % 2 * 0.5e0 - 1e-9 and t <= case when k % 7 = 0 then 2e0 else 3e0 end + 1e-9),
way as (select *, case when kind = 0 then 0 else speed * coalesce(least(since, dur), since) end as way from man),
pat as (select k, frame, t, k % 4 + 1e0 as w, (k % 3 + 1) * t as d from f where k % 11 <> 0),
key0 as (select k, frame, t, k % 10 as m, case when t < 1 then 0 when t < 2 then 1 else 2 end as seg, case when t < 1 then t when t < 2 then t - 1 else 0 end as u from f where k % 13 <> 0), key1 as (select *, case when k % 2 = 1 then u * u * (3 - 2 * u) else u end as a from key0),
st as (select k, 'ego' as actor_id, true as is_ego, frame, t, (k % 5 + 2) * t as x, 0e0 as y, 0e0 as yaw from f
union all select k, 'man', false, frame, t, x0 + way * cos(radians(yaw0)), y0 + way * sin(radians(yaw0)), case when kind = 0 then yaw0 else {wrap('yaw0')} end from way
union all select k, 'path', false, frame, t, case when d < w then 5 + d else 5 + w end, case when d >= w + 4 then 4 when d < w then 0 else d - w end, case when d < w then 0 else 90 end from pat
union all select k, 'keys', false, frame, t, case seg when 0 then m * a when 1 then m + 4 * a else m + 4 end, case seg when 0 then 1 + a when 1 then 2 - 4 * a else -2 end, {wrap('case seg when 0 then 160 + 10 * a when 1 then 170 + 20 * a else -170e0 end')} from key1)"""


@query(f"""with {_RESOLVED}, v as (select *, coalesce((lead(x) over w - x) / (lead(t) over w - t), (x - lag(x) over w) / (t - lag(t) over w), 0) as vx, coalesce((lead(y) over w - y) / (lead(t) over w - t), (y - lag(y) over w) / (t - lag(t) over w), 0) as vy from st window w as (partition by k, actor_id order by frame))
select 's' || k as scenario_id, actor_id, is_ego, frame, {r6(t_s='t', x='x + 1e-11', y='y + 1e-11', yaw='yaw + 1e-11', speed='sqrt(vx * vx + vy * vy) + 1e-11')} from v""")
def t4_scenario_frames(spark, sf):
    out, _ = scenarios.resolve_scenarios(documents.scenario_actors(documents.typed_scenarios(_read_spec(spark, sf))))
    return out.select("scenario_id", "actor_id", "is_ego", "frame", *six(t_s=c("t_s"), x=c("x") + 1e-11, y=c("y") + 1e-11, yaw=c("yaw") + 1e-11, speed=c("speed_mps") + 1e-11))


@query(f"""with {_RESOLVED}, n as (select k, actor_id, count(*) as frames from st group by all), e as (select k, 'ego' as actor_id, null as error from k union all select k, 'man', case when k % 5 = 4 then 'unresolved maneuver: cut_in' end from k union all select k, 'path', case when k % 11 = 0 then 'path has less than two points' end from k union all select k, 'keys', case when k % 13 = 0 then 'keyframes: spawn_mismatch' end from k union all select k, 'ghost', 'unknown motion: teleport' from k where k % 17 = 0)
select 's' || e.k as scenario_id, e.actor_id, coalesce(frames, 0)::bigint as frames, error from e left join n on e.k = n.k and e.actor_id = n.actor_id""")
def t4_outcomes(spark, sf):
    _, outcome = scenarios.resolve_scenarios(documents.scenario_actors(documents.typed_scenarios(_read_spec(spark, sf))))
    return outcome.select("scenario_id", "actor_id", "frames", "error")


@query(f"""with {_RESOLVED}, n as (select k, count(*) filter (where is_ego) as ego_frames, count(*) filter (where not is_ego) as actor_frames, round(sum(x) filter (where not is_ego), 5) as sum_x from st group by k) select 's' || k as scenario_id, ego_frames, actor_frames, sum_x, case when k % 17 = 0 then 4 else 3 end + 0 as actors, actor_frames as described from n""")
def s8_resolved_documents(spark, sf):
    specs = documents.typed_scenarios(_read_spec(spark, sf))
    out, _ = scenarios.resolve_scenarios(documents.scenario_actors(specs))
    path = shared_folder(spark, "resolved")
    documents.write_documents(documents.resolved_documents(specs, out), path)
    docs = documents.read_documents(spark, path, documents.RESOLVED, lines=True)
    counts = documents.resolved_frames(docs).groupBy("scenario_id").agg(F.count_if("is_ego").alias("ego_frames"), F.count_if(~c("is_ego")).alias("actor_frames"), F.round(F.sum(F.when(~c("is_ego"), c("x"))), 5).alias("sum_x"))
    told = documents.actor_info_of_frames(docs).groupBy("scenario_id").agg(F.count_if(c("role") == "traffic").alias("described"))
    return counts.join(told, "scenario_id", "left").withColumn("described", F.coalesce("described", F.lit(0))).join(docs.select("scenario_id", F.size("actors").alias("actors")), "scenario_id")


# Rules


def _faulty(spark, sf) -> DataFrame:
    """Sound scenarios but for one fault each, which the customer's number names."""
    n = c("c_custkey") % 40
    bad = lambda i, wrong, right: F.when(n == i, wrong).otherwise(right)
    lit = F.lit
    null = lambda t: F.lit(None).cast(t)
    man = {"mode": bad(19, lit("fly"), lit("maneuver")), "maneuver": bad(20, lit("drift"), lit("straight")), "speed_mps": bad(21, lit(-1.0), lit(2.0)), "start_time_s": bad(22, lit(-1.0), null("double")), "duration_s": bad(23, lit(0.0), lit(1.0))}
    struct = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])
    xy = F.array(F.struct(lit(9.0).alias("x_m"), lit(1.0).alias("y_m")))
    path = {"mode": lit("path"), "waypoints": bad(24, F.array().cast(f"array<{documents.POINT}>"), xy), "target_speed_mps": bad(25, lit(0.0), lit(3.0)), "interpolation": bad(26, lit("curvy"), null("string"))}
    t0 = F.when(n == 28, 1.5).when(n == 31, -0.5).otherwise(0.5)
    t1 = F.when((n == 28) | (n == 29), 0.5).otherwise(1.5)
    key = lambda t, yaw: F.struct(t.alias("t_s"), lit(1.0).alias("x_m"), lit(2.0).alias("y_m"), yaw.alias("yaw_deg"))
    keys = bad(27, F.array().cast(f"array<{documents.KEY}>"), F.array(key(t0, lit(0.0)), key(t1, bad(32, null("double"), lit(5.0)))))
    keyed = {"mode": lit("keyframes"), "keyframes": keys, "interpolation": bad(30, lit("curvy"), lit("smooth"))}
    spawn = lambda x: F.struct(x.alias("x_m"), lit(0.0).alias("y_m"))
    size = struct({"length_m": bad(10, lit(0.0), lit(4.5)), "width_m": bad(11, lit(-1.0), lit(1.8)), "height_m": bad(12, lit(0.0), lit(1.6))})
    born = F.when(n == 14, -1.0).when(n == 16, 1.0).when(n == 17, 9.0)
    gone = F.when(n == 15, -2.0).when(n == 16, 1.0).when(n == 18, 9.0)
    life = lambda a, b: struct({"spawn_time_s": a, "despawn_time_s": b})
    first = struct({"actor_id": bad(7, lit(""), lit("a")), "actor_type": bad(8, lit("boat"), lit("vehicle")), "role": bad(9, lit("hero"), null("string")), "dimensions_m": size, "spawn": spawn(bad(13, null("double"), lit(1.0))), "lifecycle": life(born, gone), "motion": struct(path)})
    second = struct({"actor_id": bad(3, lit("a"), lit("b")), "spawn": spawn(lit(2.0)), "lifecycle": life(bad(33, lit(1.0), null("double")), bad(34, lit(1.0), null("double"))), "motion": struct(keyed)})
    camera = struct({"image_width": bad(4, lit(0), null("int")), "image_height": bad(5, lit(-1), lit(720)), "fov_deg": bad(6, lit(180.0), lit(90.0))})
    # Two actors of different fields lie in one list only as text.
    doc = F.struct(bad(0, lit(""), lit("x")).alias("scenario_id"), c("c_custkey").cast("string").alias("description"), bad(1, lit(0.0), lit(3.0)).alias("duration_s"), bad(2, lit(0), lit(10)).alias("fps"), F.struct(struct(man).alias("motion")).alias("ego"), camera.alias("camera"), lit("@").alias("actors"))
    actors = F.concat(lit("["), F.to_json(first), lit(","), F.to_json(second), lit("]"))
    return table(spark, sf, "customer").select(F.replace(F.to_json(doc), lit('"@"'), actors).alias("value"))


_EXPECTED = (
    (0, "scenario", "scenario_id is empty"), (1, "scenario", "duration is not positive"), (1, "actors[1].motion.keyframes[0]", "keyframe after lifetime"), (1, "actors[1].motion.keyframes[1]", "keyframe after lifetime"), (2, "scenario", "fps is not positive"), (3, "scenario", "actor ids repeat"),
    (4, "camera", "image width is not positive"), (5, "camera", "image height is not positive"), (6, "camera", "field of view is outside 0 to 180"), (7, "actors[0]", "actor_id is empty"), (8, "actors[0]", "actor type is unknown"), (9, "actors[0]", "role is unknown"),
    (10, "actors[0]", "length is not positive"), (11, "actors[0]", "width is not positive"), (12, "actors[0]", "height is not positive"), (13, "actors[0]", "spawn position is missing"), (14, "actors[0]", "spawn time is negative"), (15, "actors[0]", "despawn time is negative"), (15, "actors[0]", "despawn is not after spawn"),
    (16, "actors[0]", "despawn is not after spawn"), (17, "actors[0]", "spawn exceeds the duration"), (18, "actors[0]", "despawn exceeds the duration"), (19, "ego.motion", "motion mode is unknown"), (20, "ego.motion", "maneuver is unknown"), (21, "ego.motion", "speed is negative"), (22, "ego.motion", "start time is negative"),
    (23, "ego.motion", "motion duration is not positive"), (24, "actors[0].motion", "path has no waypoints"), (25, "actors[0].motion", "target speed is not positive"), (26, "actors[0].motion", "interpolation is unknown"), (27, "actors[1].motion", "there are no keyframes"), (28, "actors[1].motion", "keyframes are not ordered"),
    (29, "actors[1].motion", "keyframe times repeat"), (30, "actors[1].motion", "interpolation is unknown"), (31, "actors[1].motion.keyframes[0]", "keyframe time is negative"), (31, "actors[1].motion.keyframes[0]", "keyframe before spawn"), (32, "actors[1].motion.keyframes[1]", "keyframe field is missing"),
    (33, "actors[1].motion.keyframes[0]", "keyframe before spawn"), (34, "actors[1].motion.keyframes[1]", "keyframe after lifetime"),
)


@query(f"select c_custkey, place as \"at\", rule from customer join (values {', '.join(map(repr, _EXPECTED))}) e(n, place, rule) on c_custkey % 40 = n")
def f13_scenario_rules(spark, sf):
    path = shared_folder(spark, "faulty")
    _faulty(spark, sf).write.text(path)
    specs = documents.read_scenarios(spark, path, lines=True)
    return scenarios.scenario_violations(specs, ["description"]).select(c("description").cast("long").alias("c_custkey"), "at", "rule")


_ASKED = """asked as (select o_orderkey as k, case o_orderkey % 6 when 0 then 'static' when 1 then 'oncoming' when 2 then 'following' when 3 then 'cut_in' when 4 then 'crossing' else 'hover' end as kind, case when o_custkey % 3 = 0 then 'left' when o_custkey % 3 = 1 then 'right' end as side, case when o_orderkey % 4 = 0 then o_totalprice % 50 - 2 end as start_m, case when o_orderkey % 5 = 0 then o_custkey % 9 - 1e0 end as speed, case when o_orderkey % 7 = 0 then o_custkey % 5 - 0.5e0 end as cut_start, case when o_orderkey % 9 = 0 then 4e0 end as duration from orders),
full_ as (select *, coalesce(start_m, 30) as d, coalesce(speed, 4) as v, coalesce(cut_start, 1.5) as cs, coalesce(duration, 8) as dur from asked where kind <> 'hover')"""
_TAG = lambda v: f"translate(regexp_replace(regexp_replace(printf('%.2f', {v}), '0+$', ''), '\\.$', ''), '-.', 'mp')"


def _requests(spark, sf):
    k = c("o_orderkey")
    kinds = F.get(F.array(*map(F.lit, ("static", "oncoming", "following", "cut_in", "crossing", "hover"))), (k % 6).cast("int"))
    null = F.lit(None).cast("double")
    given = {"start_distance_m": F.when(k % 4 == 0, c("o_totalprice").cast("double") % 50 - 2), "actor_speed_mps": F.when(k % 5 == 0, c("o_custkey") % 9 - 1.0), "cut_start_s": F.when(k % 7 == 0, c("o_custkey") % 5 - 0.5), "duration_s": F.when(k % 9 == 0, 4.0)}
    return table(spark, sf, "orders").select(k.alias("k"), kinds.alias("scenario_type"), F.lit(None).cast("string").alias("scenario_id"), F.when(c("o_custkey") % 3 == 0, "left").when(c("o_custkey") % 3 == 1, "right").alias("side"), *[given.get(n, null).alias(n) for n in scenarios.REQUEST_DEFAULTS])


@query(f"""with {_ASKED}, ok as (select * from full_ where d > 0 and v >= 0 and cs >= 0 and (kind not in ('cut_in', 'crossing') or side is not null) and (kind <> 'cut_in' or cs + 3 <= dur)), s as (select *, case when side = 'left' then 3.5e0 else -3.5e0 end as lane, kind in ('cut_in', 'crossing') as turns, case when kind = 'static' then 0 else v end as sv from ok)
select k, kind || case when turns then '_' || side else '' end || '_d' || {_TAG('d')} || '_v' || {_TAG('sv')} || '_v1' as scenario_id, kind as maneuver, dur as duration_s, round(d, 6) as x0, case kind when 'cut_in' then lane when 'crossing' then 2 * lane else 0 end::double as y0, case when kind = 'oncoming' then 180 when kind = 'crossing' and side = 'right' then 270 when kind = 'crossing' then 90 else 0 end::double as yaw0, sv::double as speed,
case when kind in ('cut_in', 'oncoming') then 0e0 end as target_y, round(case when kind = 'crossing' then d end, 6) as target_x, case when kind = 'crossing' then case when side = 'right' then -1e0 else 1e0 end end as direction, case when kind = 'cut_in' then cs end::double as cut_start_s,
concat_ws(',', case when start_m is null then 'start_distance_m' end, 'lane_y_m,target_lane_y_m,lane_width_m', case when speed is null then 'actor_speed_mps' end, 'ego_speed_mps', case when duration is null then 'duration_s' end, 'fps', case when cut_start is null then 'cut_start_s' end, 'cut_duration_s') as defaulted from s""")
def t8_scenarios_of_requests(spark, sf):
    out, _ = scenarios.scenarios_of_requests(_requests(spark, sf), ["k"])
    return out.select("k", "scenario_id", "maneuver", "duration_s", *six(x0=c("x0")), "y0", "yaw0", "speed", "target_y", *six(target_x=c("target_x")), "direction", "cut_start_s", "defaulted")


@query(f"""with {_ASKED} select k, 'scenario type is unknown' as rule from asked where kind = 'hover' union all select k, 'start distance is not positive' from asked where start_m <= 0 union all select k, 'actor speed is negative' from asked where speed < 0 union all select k, 'cut start is negative' from asked where cut_start < 0
union all select k, 'side is required' from full_ where kind in ('cut_in', 'crossing') and side is null union all select k, 'cut ends after the scenario' from full_ where kind = 'cut_in' and cs + 3 > dur""")
def t8_request_errors(spark, sf):
    _, errors = scenarios.scenarios_of_requests(_requests(spark, sf), ["k"])
    return errors


# Training vectors


_INPUTS = """inputs as (select l_orderkey as k, l_linenumber as line, l_orderkey % 5 = 0 as held, [l_discount * 10, l_quantity / 10, 0e0, (l_orderkey % 361 - 180)::double, 640e0, 640e0, 640e0, 360e0, 1280e0, 720e0, 90e0, 1.5e0, 0e0, 1.6e0, (l_partkey % 3)::double, (l_suppkey % 5)::double, 0e0] as x, [(l_extendedprice % 1280) / 1280, (l_quantity * 14) / 720, (l_quantity * 3) / 1280, (l_quantity * 2) / 720]::double[] as y from lineitem)"""


def _labelled(spark, sf):
    lit = lambda v: F.lit(float(v))
    li = table(spark, sf, "lineitem")
    rel = F.struct((c("l_discount") * 10).cast("double").alias("rel_x"), (c("l_quantity") / 10).cast("double").alias("rel_z"), lit(0).alias("rel_y"), (c("l_orderkey") % 361 - 180).cast("double").alias("rel_yaw"))
    cam = F.struct(*[v.cast("double").alias(n) for n, v in {"fx": lit(640), "fy": lit(640), "cx": lit(640), "cy": lit(360), "width": lit(1280), "height": lit(720), "fov": lit(90), "mount_x": lit(1.5), "mount_y": lit(0), "mount_z": lit(1.6), "pitch": c("l_partkey") % 3, "yaw": c("l_suppkey") % 5, "roll": lit(0)}.items()])
    q = c("l_quantity").cast("double")
    target = F.struct((c("l_extendedprice").cast("double") % 1280).alias("center_x"), (q * 14).alias("bottom_y"), (q * 3).alias("box_width"), (q * 2).alias("box_height"))
    rows = li.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("line"), (c("l_orderkey") % 5 == 0).alias("held"), rel.alias("relative_state"), cam.alias("camera"), target.alias("target"))
    return rows.select("k", "line", "held", features.placement_inputs().alias("x"), features.placement_targets().alias("y"))


_STATS = lambda where, part: f"select '{part}' as part, i - 1 as place, count(*) as n, round(avg(v), 6) as mean, round(case when stddev_pop(v) < 1e-6 then 1 else stddev_pop(v) end, 6) as std from (select unnest(x) as v, generate_subscripts(x, 1) as i from inputs where {where}) group by i"


@query(f"with {_INPUTS} {_STATS('true', 'all')} union all {_STATS('not held', 'train')}")
def a18_vector_stats(spark, sf):
    rows = _labelled(spark, sf)
    flat = lambda part, s: s.select(F.lit(part).alias("part"), "n", F.posexplode(F.arrays_zip("mean", "std")).alias("place", "s")).select("part", c("place").cast("long").alias("place"), "n", *six(mean=c("s.mean"), std=c("s.std")))
    size = len(features.PLACEMENT_INPUTS)
    return flat("all", features.vector_stats(rows, "x", size)).unionByName(flat("train", features.vector_stats(rows.where(~c("held")), "x", size)))


@query(f"""with {_INPUTS}, s as (select i, avg(v) as m, case when stddev_pop(v) < 1e-6 then 1 else stddev_pop(v) end as d from (select unnest(x) as v, generate_subscripts(x, 1) as i from inputs where not held) group by i), e as (select id, k, line, held, y, unnest(x) as v, generate_subscripts(x, 1) as i from (select *, row_number() over () as id from inputs))
select k, line, held, round(sum((v - m) / d) filter (where i <= 4), 5) as pose, round(sum((v - m) / d) filter (where i > 4), 5) as rest, count(*) as size, round(any_value(y[1]) + 3.7137e-11, 6) as y_centre, round(any_value(y[4]) + 3.7137e-11, 6) as y_height from e join s using (i) group by id, k, line, held""")
def p30_placement_vectors(spark, sf):
    rows = _labelled(spark, sf)
    train = features.vector_stats(rows.where(~c("held")), "x", len(features.PLACEMENT_INPUTS))
    out = features.normalised(rows, "x", train)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return out.select("k", "line", "held", F.round(total(F.slice("x", 1, 4)), 5).alias("pose"), F.round(total(F.slice("x", 5, 13)), 5).alias("rest"), F.size("x").cast("long").alias("size"), *six(y_centre=F.get("y", 0) + 3.7137e-11, y_height=F.get("y", 3) + 3.7137e-11))


@query("""with v as (select o_orderkey as k, o_orderkey % 100 / 100e0 as p, o_totalprice % 60 as fwd, o_custkey % 3 - 1e0 as lat, case when o_orderkey % 4 <> 0 then o_totalprice % 50 end as first_m, case when o_orderkey % 6 <> 0 then o_totalprice % 40 end as now_m, case when o_orderkey % 10 = 1 then 'nan'::double when o_orderkey % 10 <> 2 then o_totalprice % 30 end as est from orders), w as (select *, coalesce(first_m, fwd) as f1 from v), u as (select *, coalesce(now_m, f1) as n1 from w)
select k, round(p, 6) as progress, round(fwd / 60, 6) as forward, round(lat / 3, 6) as lateral, round(f1 / 60, 6) as initial, round(n1 / 60, 6) as now, round(coalesce(case when not isnan(est) then est end, n1) / 60, 6) as estimated, 12 as size from u""")
def p29_box_vectors(spark, sf):
    k, total = c("o_orderkey"), c("o_totalprice").cast("double")
    null = F.lit(None).cast("double")
    own = {"frame_progress": k % 100 / 100.0, "adversary_forward_m": total % 60, "adversary_lateral_m": c("o_custkey") % 3 - 1.0, "initial_distance_to_adversary_m": F.when(k % 4 != 0, total % 50), "distance_to_adversary_m": F.when(k % 6 != 0, total % 40), "estimated_distance_from_displacement_m": F.when(k % 10 == 1, float("nan")).when(k % 10 != 2, total % 30)}
    rows = table(spark, sf, "orders").select(k.alias("k"), *[own.get(n, null).alias(n) for n, _, _ in features.BOX_INPUTS]).select("k", features.box_inputs().alias("x"))
    return rows.select("k", *six(progress=F.get("x", 0), forward=F.get("x", 1), lateral=F.get("x", 2), initial=F.get("x", 6), now=F.get("x", 7), estimated=F.get("x", 8)), F.size("x").alias("size"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Queries of the frame runtime, scenario resolution and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.functions import angles, runtime
from trajframe.operators import compare, frames, lookup, reports, resolve
from trajframe.operators.frames import c, table
from trajframe.sources import io
from trajframe.sources.folders import shared_folder

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _Q[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def nine(**cols) -> list:
    return [F.round(v, 9).alias(k) for k, v in cols.items()]


def r9(**cols) -> str:
    return ", ".join(f"round({v}, 9) as {k}" for k, v in cols.items())


from trajframe.queries import GRID, POSES, REAL, STATES, SYNTH, wrap  # noqa: E402

IOU = "case when {u} > 0 then {i} / {u} else 0 end"


# Functions


@query(f"with {POSES}, e as (select *, x - x * 0.5e0 as dx, y - y * 0.2e0 as dy, radians(yaw / 2) as a from poses) select run, frame, {r9(ahead='dx * cos(a) + dy * sin(a)', right='dy * cos(a) - dx * sin(a)', rel_yaw=wrap('yaw - yaw / 2'))} from e")
def p12_relative_pose(spark, sf):
    out = runtime.relative_pose(c("x"), c("y"), c("yaw"), c("x") * 0.5, c("y") * 0.2, c("yaw") / 2)
    return frames.poses(spark, sf).select("run", "frame", *nine(**out))


@query(f"""with {STATES}, b as (select k, line, z, 640e0 + 40 * x as u, 360e0 + z as v, 640e0 * 1.8e0 / z as w, 640e0 * 1.5e0 / z as h from states), s as (select k, line, z, least(greatest(u - w / 2, 0), 1279) as x1, least(greatest(v - h / 2, 0), 719) as y1, least(greatest(u + w / 2, 0), 1279) as x2, least(greatest(v + h / 2, 0), 719) as y2 from b)
select k, line, case when ok then trunc(x1)::int end as x1, case when ok then trunc(y1)::int end as y1, case when ok then trunc(x2)::int end as x2, case when ok then trunc(y2)::int end as y2 from (select *, z > 0.1 and x2 > x1 and y2 > y1 as ok from s)""")
def p20_centred_box(spark, sf):
    out = runtime.centred_box(c("x") * 40 + 640.0, c("z") + 360.0, c("z"), 1.8, 1.5)
    return frames.states(spark, sf).where("z <> 0").select("k", "line", *[v.alias(k) for k, v in out.items()]).unionByName(frames.states(spark, sf).where("z = 0").select("k", "line", *[F.lit(None).cast("int").alias(k) for k in out]))


@query(f"with {REAL}, a as (select *, 640 + (cx - 640) * 1.05e0 + 3 as c2, 259.2e0 + (bottom - 259.2e0) * 0.98e0 - 2 as b2, w * 1.1e0 as w2, h * 0.9e0 as h2 from real_) select case_id, actor_id, frame, {r9(cx='c2', bottom='b2', w='w2', h='h2', x='c2 - w2 / 2', y='b2 - h2')} from a")
def p32_corrected_box(spark, sf):
    out = runtime.corrected_box(c("cx"), c("bottom"), c("w"), c("h"), (1.05, 3.0), (0.98, -2.0), (1.1, 0.9))
    return frames.real(spark, sf).select("case_id", "actor_id", "frame", *nine(**out))


@query(f"with {STATES}, a as (select k, line, 20e0 + k % 30 as w, case when z > 1e-6 then 640 + 640e0 * x / z else 500e0 end as cx from states) select k, line, {r9(cx='cx', x1='cx - w / 2', x2='cx + w / 2')} from a")
def p33_centre_override(spark, sf):
    out = runtime.centre_override(c("x"), c("z"), F.lit(500.0), c("k") % 30 + 20.0)
    return frames.states(spark, sf).select("k", "line", *nine(**out))


@query(f"with {POSES} select run, frame, {r9(speed='least(greatest(greatest(x * cos(radians(yaw)) + y * sin(radians(yaw)), 0) + speed, 0), 25)')} from poses")
def p35_closing_speed(spark, sf):
    return frames.poses(spark, sf).select("run", "frame", *nine(speed=runtime.closing_speed(c("x"), c("y"), c("yaw"), c("speed"))))


@query("""select s_suppkey, case s_nationkey % 3 when 0 then 3.5e0 when 1 then -3.5e0 end as lane_y, case when s_nationkey % 3 = 2 then 'unsupported side: middle' end as error,
 'cut_in_' || case s_nationkey % 3 when 0 then 'left' when 1 then 'right' else 'middle' end || '_d' || translate(rtrim(rtrim(printf('%.2f', s_acctbal), '0'), '.'), '-.', 'mp') || '_v' || translate(rtrim(rtrim(printf('%.2f', (s_suppkey % 40) / 4e0), '0'), '.'), '-.', 'mp') || '_v1' as scenario_id from supplier""")
def p37_lanes_and_ids(spark, sf):
    side = F.get(F.array(F.lit("left"), F.lit("right"), F.lit("middle")), (c("s_nationkey") % 3).cast("int"))
    lane, error = runtime.lane_offset(side)
    return table(spark, sf, "supplier").select("s_suppkey", lane.alias("lane_y"), error.alias("error"), runtime.scenario_id(F.lit("cut_in"), side, c("s_acctbal"), c("s_suppkey") % 40 / 4.0).alias("scenario_id"))


@query("""with a as (select p_partkey, case p_partkey % 4 when 0 then 'sedan' when 1 then 'truck' when 2 then 'vehicle.made.' || p_size else 'boat' end as k from part)
select p_partkey, case when p_partkey % 5 > 0 then p_partkey end as frame_id, case when k = 'sedan' then 'vehicle.small' when k = 'truck' then 'vehicle.large' when k like 'vehicle.%' then k end as asset, case when k = 'boat' then 'unknown asset: boat' end as error from a""")
def p39_frames_and_assets(spark, sf):
    p = table(spark, sf, "part").withColumn("key", F.when(c("p_partkey") % 4 == 0, "sedan").when(c("p_partkey") % 4 == 1, "truck").when(c("p_partkey") % 4 == 2, F.concat(F.lit("vehicle.made."), "p_size")).otherwise("boat"))
    path = F.when(c("p_partkey") % 5 > 0, F.format_string("run_7/frame_%06d.png", "p_partkey")).otherwise("run/cover.png")
    name, error = runtime.asset(c("key"), {"sedan": "vehicle.small", "truck": "vehicle.large"})
    return p.select("p_partkey", runtime.frame_id(path).alias("frame_id"), name.alias("asset"), error.alias("error"))


@query(f"with {POSES} select run, frame, {r9(x='x + 3.5e0 * sin(radians(yaw))', y='y - 3.5e0 * cos(radians(yaw))', opposite=wrap('yaw + 180'))} from poses")
def p40_lane_shift(spark, sf):
    return frames.poses(spark, sf).select("run", "frame", *nine(**runtime.lane_shift(c("x"), c("y"), c("yaw"), 3.5)))


@query(f"""with {STATES}, a as (select *, case line % 3 when 0 then 'clamp' when 1 then 'edge' else 'invisible' end as mode from states), b as (select *, z < 7 as near from a)
select k, line, {r9(x_used='least(greatest(x, -4), 4)', z_used="case when near and mode = 'invisible' then z else least(greatest(case when near and mode = 'clamp' then 7e0 else z end, 2), 100) end")}, near as close_range, not (near and mode = 'invisible') as valid, case when near and mode = 'invisible' then 'below_safe_min_rel_z' else 'ok' end as reason from b""")
def d8_grid_queries(spark, sf):
    mode = F.when(c("line") % 3 == 0, "clamp").when(c("line") % 3 == 1, "edge").otherwise("invisible")
    out = runtime.grid_query(c("x"), c("z"), (-4.0, 2.0), (4.0, 100.0), mode)
    return frames.states(spark, sf).select("k", "line", *nine(x_used=out["x_used"], z_used=out["z_used"]), *[out[n].alias(n) for n in ("close_range", "valid", "reason")])


@query(f"""with {REAL}, a as (select case_id, actor_id, frame, cx * 1.5e0 - 200 as cx, bottom * 1.2e0 as b, w, h, (k % 10) / 10e0 as p, depth - 5 as z from real_), r as (select *, coalesce(p >= 0.5e0 and w >= 1 and h >= 1 and z >= 0, false) as seen, cx - w / 2 as a1, b - h as b1, cx + w / 2 as a2 from a), q as (select *, least(greatest(a1, 0), 1279) as x1, least(greatest(b1, 0), 719) as y1, least(greatest(a2, 0), 1279) as x2, least(greatest(b, 0), 719) as y2 from r)
select case_id, actor_id, frame, seen as visible, seen and (a1 <> x1 or b1 <> y1 or a2 <> x2 or b <> y2) as clamped, {r9(**{n: f'case when seen then {n} else 0 end' for n in ('x1', 'y1', 'x2', 'y2')})} from q""")
def d9_rectangles(spark, sf):
    out = runtime.rect(c("cx") * 1.5 - 200.0, c("bottom") * 1.2, c("w"), c("h"), c("k") % 10 / 10.0, c("depth") - 5.0)
    return frames.real(spark, sf).select("case_id", "actor_id", "frame", "k", *[v.alias(n) for n, v in out.items()]).select("case_id", "actor_id", "frame", "visible", "clamped", *nine(**{n: c(n) for n in ("x1", "y1", "x2", "y2")}))


# Predicates


@query("""with s as (select s_suppkey, case when s_suppkey % 4 = 0 then 1920 else 1280 end as width, case when s_suppkey % 3 = 0 then 90.5e0 else 90e0 end as fov, case when s_suppkey % 5 = 0 then 2.5e0 else 1.6e0 end as mount_z from supplier)
select s_suppkey, concat_ws(';', case when width <> 1280 then 'width:' || width || '!=1280' end, case when abs(fov - 90) > 1e-6 then 'fov:' || fov || '!=90.0' end, case when abs(mount_z - 1.6e0) > 1e-6 then 'mount_z:' || mount_z || '!=1.6' end) as reasons from s""")
def f4_camera_support(spark, sf):
    k = c("s_suppkey")
    actual = {"width": F.when(k % 4 == 0, 1920).otherwise(1280), "fov": F.when(k % 3 == 0, 90.5).otherwise(90.0), "mount_z": F.when(k % 5 == 0, 2.5).otherwise(1.6)}
    return table(spark, sf, "supplier").select("s_suppkey", runtime.unlike(actual, {"width": 1280, "fov": 90.0, "mount_z": 1.6}).alias("reasons"))


@query(f"with {REAL}, a as (select case_id, k, cx * 8 - 2000 as cx, bottom - 400 as bottom, w - 30 as w, h * 50 as h, visible from real_) select case_id, k from a where visible and (w <= 0 or h <= 0 or bottom < 0 or cx < -5000 or cx > 6000 or w > 5000 or h > 5000)")
def f6_suspicious_boxes(spark, sf):
    return frames.real(spark, sf).where(c("visible") & runtime.suspicious(c("cx") * 8 - 2000.0, c("bottom") - 400.0, c("w") - 30.0, c("h") * 50.0)).select("case_id", "k")


@query(f"with {REAL}, a as (select *, visible and w - 25 > 1 and cx * 4 - 1500 between -1280 and 2560 and bottom between -720 and 1440 as ok from real_) select case_id, actor_id, frame, case when ok then 'lookup' else 'geometric' end as source, {r9(cx='case when ok then cx * 4 - 1500 else 640 + depth end')} from a")
def f8_fallback(spark, sf):
    ok = runtime.plausible(c("visible"), c("cx") * 4 - 1500.0, c("bottom"), c("w") - 25.0, c("h"))
    return frames.real(spark, sf).select("case_id", "actor_id", "frame", F.when(ok, "lookup").otherwise("geometric").alias("source"), *nine(cx=F.when(ok, c("cx") * 4 - 1500.0).otherwise(c("depth") + 640.0)))


@query(f"with {STATES} select k, line, {r9(z='z')} from states where abs(x) < 1e-6 and abs((k % 4) * 90e0) < 1e-6")
def f12_central_curve(spark, sf):
    return frames.states(spark, sf).where((F.abs("x") < 1e-6) & (F.abs(c("k") % 4 * 90.0) < 1e-6)).orderBy("z").select("k", "line", *nine(z=c("z")))


# Resolution

_KINDS = ["static", "straight", "oncoming", "following", "cut_in"]
_ACTORS = f"actors_ as (select s_suppkey as actor, s_suppkey % 10 as scenario, {'case s_suppkey % 5 ' + ' '.join(f'when {i} then {n!r}' for i, n in enumerate(_KINDS)) + ' end'} as maneuver, 10e0 + s_suppkey % 9 as x0, (s_nationkey % 3) * 3.5e0 as y0, (s_suppkey % 8) * 45e0 as yaw0, (s_suppkey % 3) * 0.7e0 as start_s, case when s_suppkey % 4 = 0 then 1.5e0 end as duration_s, 3e0 + s_suppkey % 6 as speed, (s_suppkey % 2) * 0.5e0 as spawn_s, case when s_suppkey % 7 = 0 then 3e0 end as end_s from supplier)"
_STATES_OF = """st as (select *, greatest(t - start_s, 0) as since, coalesce(greatest(t - start_s, 0) >= duration_s, false) as over, maneuver in ('straight', 'oncoming', 'following') as moves, maneuver <> 'cut_in' as known from f),
m as (select *, case when moves then speed * (case when over then duration_s else since end) when known then 0 end as way, case when moves and t > start_s and not over then speed when known then 0 end as v from st)"""


def _actors(spark, sf):
    k = c("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("actor"), (k % 10).alias("scenario"), F.get(F.array(*map(F.lit, _KINDS)), (k % 5).cast("int")).alias("maneuver"), (k % 9 + 10.0).alias("x0"), (c("s_nationkey") % 3 * 3.5).alias("y0"), (k % 8 * 45.0).alias("yaw0"),
        (k % 3 * 0.7).alias("start_s"), F.when(k % 4 == 0, 1.5).alias("duration_s"), (k % 6 + 3.0).alias("speed"), (k % 2 * 0.5).alias("spawn_s"), F.when(k % 7 == 0, 3.0).alias("end_s"),
    )


@query(f"with {_ACTORS}, f as (select actors_.*, r.range as frame, r.range / 10e0 as t from actors_, range(41) r), {_STATES_OF} select actor, frame, {r9(x='x0 + way * cos(radians(yaw0))', y='y0 + way * sin(radians(yaw0))', yaw='case when known then case when moves then ' + wrap('yaw0') + ' else yaw0 end end', speed='v')}, case when not known then 'unresolved maneuver: cut_in' end as error from m")
def t1_maneuver_states(spark, sf):
    rows = _actors(spark, sf).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long")))).withColumn("t_s", c("frame") / 10.0)
    out = resolve.maneuver_states(rows)
    return out.select("actor", "frame", *nine(x=c("x"), y=c("y"), yaw=c("yaw"), speed=c("speed_mps")), "error")


@query(f"""with {_ACTORS}, f as (select actors_.*, r.range as frame, r.range / 10e0 as t from actors_, range(41) r where r.range / 10e0 >= spawn_s - 1e-9 and coalesce(r.range / 10e0 <= end_s + 1e-9, true)), {_STATES_OF}, p as (select scenario, actor, frame, x0 + way * cos(radians(yaw0)) as x, y0 + way * sin(radians(yaw0)) as y from m where known),
v as (select *, coalesce((lead(x) over w - x) / ((lead(frame) over w - frame) / 10e0), (x - lag(x) over w) / ((frame - lag(frame) over w) / 10e0), 0) as vx, coalesce((lead(y) over w - y) / ((lead(frame) over w - frame) / 10e0), (y - lag(y) over w) / ((frame - lag(frame) over w) / 10e0), 0) as vy from p window w as (partition by scenario, actor order by frame))
select scenario, actor, frame, {r9(x='x', y='y')}, round(sqrt(vx * vx + vy * vy), 6) as speed from v""")
def t4_resolved(spark, sf):
    actors = _actors(spark, sf)
    times = actors.select("scenario").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))))
    out = resolve.resolved(actors, times, ["scenario", "actor"], "scenario", 10.0)
    return out.select("scenario", "actor", "frame", *nine(x=c("x"), y=c("y")), F.round("speed_mps", 6).alias("speed"))


@query(f"with {_ACTORS}, f as (select actors_.*, r.range as frame, r.range / 10e0 as t from actors_, range(41) r) select scenario, count(*) as frames, count(*) filter (where t >= spawn_s - 1e-9 and coalesce(t <= end_s + 1e-9, true)) as alive from f group by 1")
def f1_alive_frames(spark, sf):
    rows = _actors(spark, sf).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(40))))
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("frames"), F.count_if(resolve.alive(c("frame") / 10.0, c("spawn_s"), c("end_s"))).alias("alive"))


_PATH = POSES + """, pts as (select run, frame as i, frame * 1.5e0 as x, (frame % 3) * 2e0 as y from poses where frame < 12), cum as (select *, sum(coalesce(sqrt(power(x - lx, 2) + power(y - ly, 2)), 0)) over (partition by run order by i) as arc from (select *, lag(x) over (partition by run order by i) as lx, lag(y) over (partition by run order by i) as ly from pts)),
seg as (select *, lead(arc) over w as nxt, lead(x) over w as qx, lead(y) over w as qy from cum window w as (partition by run order by i)), ask as (select run, frame, frame * 0.9e0 as t, frame * 0.37e0 as d, 3e0 + run % 4 as v from poses)"""


@query(f"""with {_PATH}, j as (select a.run, a.t, a.d, a.v, s.*, row_number() over (partition by a.run, a.frame order by s.arc desc, s.i desc) as n from ask a join seg s on a.run = s.run and s.arc <= a.d), e as (select *, nxt is null or nxt - arc <= 1e-9 as ended, (d - arc) / (nxt - arc) as u from j where n = 1)
select run, {r9(t_s='t', x='case when ended then x else x + (qx - x) * u end', y='case when ended then y else y + (qy - y) * u end', yaw='case when ended then degrees(atan2(y - ly, x - lx)) else degrees(atan2(qy - y, qx - x)) end', speed='case when ended then 0 else v end')} from e""")
def t2_path_states(spark, sf):
    p = frames.poses(spark, sf)
    points = p.where("frame < 12").select("run", c("frame").alias("i"), (c("frame") * 1.5).alias("x"), (c("frame") % 3 * 2.0).alias("y"))
    times = p.select("run", (c("frame") * 0.9).alias("t_s"), (c("frame") * 0.37).alias("distance"), (c("run") % 4 + 3.0).alias("speed"))
    out = resolve.path_states(times, points, "run")
    return out.select("run", *nine(t_s=c("t_s"), x=c("x"), y=c("y"), yaw=c("yaw"), speed=c("speed_mps")))


@query(f"with {POSES}, u as (select *, least(greatest((frame - 5e0) / (5 + run % 20), 0), 1) as u from poses) select run, frame, {r9(x='x + (2 * y - x) * u', y='y + (10 - y) * u')} from u")
def t9_runtime_states(spark, sf):
    at = lambda a, b: resolve.runtime_state(c("frame"), F.lit(5.0), c("run") % 20 + 10.0, a, b)
    return frames.poses(spark, sf).select("run", "frame", *nine(x=at(c("x"), c("y") * 2), y=at(c("y"), F.lit(10.0))))


@query(f"""with {POSES}, e as (select run, frame, x * 2 as ex from poses where frame % 9 <> 4) select p.run % 20 as scenario, count(e.frame) as joined, count(*) - count(e.frame) as missing, round(sum(p.x - e.ex), 6) as ahead from poses p left join e on p.run = e.run and p.frame = e.frame group by 1""")
def j4_actor_and_ego(spark, sf):
    p = frames.poses(spark, sf).withColumn("scenario", c("run") % 20)
    both, alone = resolve.with_ego(p.select("scenario", "run", "frame", "x"), p.where("frame % 9 <> 4").select("run", "frame", (c("x") * 2).alias("ex")), ["run", "frame"])
    rows = both.select("scenario", F.lit(1).alias("met"), (c("x") - c("ex")).alias("d")).unionByName(alone.select("scenario", F.lit(0).alias("met"), F.lit(None).cast("double").alias("d")))
    return rows.groupBy("scenario").agg(F.sum("met").cast("long").alias("joined"), F.count_if(c("met") == 0).alias("missing"), F.round(F.sum("d"), 6).alias("ahead"))


@query(f"""with {POSES}, r as (select *, sum(coalesce(sqrt(power(x - lx, 2) + power(y - ly, 2)), 0)) over (partition by run order by frame) as arc from (select *, lag(x) over (partition by run order by frame) as lx, lag(y) over (partition by run order by frame) as ly from poses)), n as (select run, ask, arg_min(frame, (sqrt(power(x - run % 7 - 3 * ask, 2) + y * y), frame)) as nearest from r, range(2) k(ask) group by run, ask), a as (select n.run, n.ask, n.nearest, r.arc as place from n join r on r.run = n.run and r.frame = n.nearest)
select a.run, a.ask, a.nearest, min(r.frame) filter (where r.arc >= a.place + 5 + a.run % 40) as target from a join r on r.run = a.run group by all""")
def j15_route_target(spark, sf):
    p = frames.poses(spark, sf)
    asks = p.select("run").distinct().withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    asks = asks.select("run", "ask", (c("run") % 7 + 3.0 * c("ask")).alias("ex"), F.lit(0.0).alias("ey"), (c("run") % 40 + 5.0).alias("ahead"))
    return resolve.route_target(p.select("run", "frame", "x", "y"), asks, "run", ["ask"])


@query(f"""with {POSES}, a as (select run, frame, x, lead(x) over w - x as d1, x - lag(x) over w as d0 from poses window w as (partition by run order by frame)), b as (select *, lead(d1) over w as d2, lag(d0) over w as db from a window w as (partition by run order by frame)), e as (select *, (3 * d1 - d2) / 2 as s1, (3 * d0 - db) / 2 as s0 from b),
k as (select run, frame, x, case when d0 is null and d1 is null then 0 when d0 is null then (case when d2 is null then d1 when s1 * d1 <= 0 then 0 when d1 * d2 < 0 and abs(s1) > 3 * abs(d1) then 3 * d1 else s1 end) when d1 is null then (case when db is null then d0 when s0 * d0 <= 0 then 0 when d0 * db < 0 and abs(s0) > 3 * abs(d0) then 3 * d0 else s0 end) when d0 * d1 > 0 then 6 / (3 / d0 + 3 / d1) else 0 end as s from e),
g as (select *, lead(x) over w as x1, lead(s) over w as s1 from k window w as (partition by run order by frame)), p as (select g.*, r.range / 4e0 as u from g, range(4) r where r.range = 0 or x1 is not null)
select run, {r9(t='frame + u')}, round(coalesce((2*u*u*u - 3*u*u + 1) * x + (u*u*u - 2*u*u + u) * s + (3*u*u - 2*u*u*u) * x1 + (u*u*u - u*u) * s1, x) + 3.7137e-11, 6) as x from p""")
def w5_densified(spark, sf):
    out = resolve.densified(frames.poses(spark, sf).select("run", c("frame").cast("double").alias("t"), "x"), ["run"], "t", "x", 4)
    return out.select("run", *nine(t=c("t")), F.round(c("x") + 3.7137e-11, 6).alias("x"))


# Reports


@query(f"""with {POSES}, b as (select run, frame, x + case when frame % 17 = 3 then 1e-3 else 0 end as x, yaw from poses where (run * 31 + frame) % 97 <> 0), j as (select coalesce(a.run, b.run) as run, coalesce(a.frame, b.frame) as frame, a.run is null as nb, b.run is null as na, abs(a.x - b.x) as dx, abs(a.yaw - b.yaw) as dyaw from poses a full join b on a.run = b.run and a.frame = b.frame), g as (select *, greatest(0, dx, dyaw) as off from j)
select run, count(*) filter (where na) as only_a, count(*) filter (where nb) as only_b, {r9(max_x='max(dx)', max_yaw='max(dyaw)', worst='max(off)')}, min(frame) filter (where off > 1e-6) as first_mismatch, case when count(*) filter (where na or nb) = 0 and max(off) <= 1e-6 then 'PASS' else 'FAIL' end as verdict from g group by 1""")
def j10_pose_sync(spark, sf):
    a = frames.poses(spark, sf).select("run", "frame", "x", "yaw")
    b = a.where("(run * 31 + frame) % 97 <> 0").withColumn("x", c("x") + F.when(c("frame") % 17 == 3, 1e-3).otherwise(0.0))
    out = reports.pose_sync(a, b, ["run"], ["x", "yaw"])
    return out.select("run", "only_a", "only_b", *nine(max_x=c("max_x"), max_yaw=c("max_yaw"), worst=c("worst")), "first_mismatch", "verdict")


def _reported(spark, sf):
    k = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    parts = {
        "capability": k.where("c_custkey % 11 <> 0").select("c_custkey", (c("c_acctbal") > 0).alias("supported")),
        "execution": k.where("c_custkey % 3 <> 0").select("c_custkey", (c("c_custkey") % 7 != 1).alias("passed")),
        "report": k.where("c_custkey % 4 <> 0").select("c_custkey", (c("c_acctbal") / 100.0).alias("mae")),
    }
    return reports.case_report(k.select("c_custkey", "c_nationkey"), parts, "c_custkey")


_REPORTED = "rep as (select c_custkey, c_nationkey, case when c_custkey % 11 <> 0 then c_acctbal > 0 end as supported, case when c_custkey % 3 <> 0 then c_custkey % 7 <> 1 end as passed, case when c_custkey % 4 <> 0 then c_acctbal / 100e0 end as mae, case when c_custkey % 11 = 0 then 'missing_capability' when c_custkey % 3 = 0 then 'missing_execution' when c_custkey % 4 = 0 then 'missing_report' end as error from customer)"


@query(f"with {_REPORTED} select c_custkey, c_nationkey, supported, passed, round(mae, 9) as mae, error from rep")
def j11_case_report(spark, sf):
    return _reported(spark, sf).select("c_custkey", "c_nationkey", "supported", "passed", *nine(mae=c("mae")), "error")


@query(f"with {_REPORTED} select c_nationkey, count(*) as selected, count(*) filter (where error is null and passed) as passed, count(*) filter (where error is null and not passed) as failed, count(*) filter (where error is not null) as errors, bool_and(error is null and coalesce(passed, false)) as all_passed from rep group by 1")
def a24_run_totals(spark, sf):
    return reports.run_totals(_reported(spark, sf), ["c_nationkey"])


@query(f"with {_REPORTED} select c_nationkey, count(*) as n, count(*) filter (where supported) as supported, count(*) filter (where not supported) as outside, count(*) filter (where supported is null) as errors from rep group by 1")
def a6_sweep_summary(spark, sf):
    s = c("supported")
    return _reported(spark, sf).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("supported"), F.count_if(~s).alias("outside"), F.count_if(s.isNull()).alias("errors"))


@query("select c_custkey from customer where c_acctbal > 0 and c_custkey % 6 <> 0 and c_custkey % 2 = 0 and c_custkey % 5 <> 0")
def f9_gated(spark, sf):
    k = table(spark, sf, "customer")
    status = k.select("c_custkey", F.when(c("c_acctbal") > 0, "SUPPORTED").otherwise("OUTSIDE").alias("status"), F.when(c("c_custkey") % 6 == 0, "FAIL").otherwise("PASS").alias("verdict"), F.when(c("c_custkey") % 2 == 0, 2.0).alias("planned_depth"), F.when(c("c_custkey") % 5 == 0, 2.5).alias("runtime_depth"))
    return reports.gated(k.select("c_custkey"), status, "c_custkey")


_PREDICTED = SYNTH + """, j as (select s.case_id, s.actor_id, s.frame, s.cx, s.bottom, s.w, s.h, r.cx as rcx, r.bottom as rb, r.w as rw, r.h as rh, coalesce(s.visible and r.visible and s.w > 0 and s.h > 0, false) as valid from synth s left join (select * from real_ where k % 5 <> 0) r using (case_id, actor_id, frame)),
o as (select *, greatest(least(cx + w / 2, rcx + rw / 2) - greatest(cx - w / 2, rcx - rw / 2), 0) * greatest(least(bottom, rb) - greatest(bottom - h, rb - rh), 0) as i from j)"""


@query(f"""with {_PREDICTED} select case_id, actor_id, frame, valid, case when valid then 'inserted_using_predicted_box' else 'invalid_predicted_box' end as status, {r9(centre_error='case when valid then sqrt(power(cx - rcx, 2) + power((bottom - h / 2) - (rb - rh / 2), 2)) end', w_error='case when valid then abs(w - rw) end', rel_h='case when valid then abs(h - rh) / rh end', area_ratio='case when valid then w * h / (rw * rh) end', iou='case when valid then i / (w * h + rw * rh - i) end')} from o""")
def d10_predicted_boxes(spark, sf):
    out = reports.predicted_boxes(frames.synthetic(spark, sf), frames.real(spark, sf).where("k % 5 <> 0"), ["case_id", "actor_id", "frame"])
    return out.select("case_id", "actor_id", "frame", "valid", "status", *nine(**{k: c(k) for k in ("centre_error", "w_error", "rel_h", "area_ratio", "iou")}))


@query(f"""with {GRID.replace('r.cx as real_cx', 'r.cx as real_cx, r.w as rw, r.h as rh, r.bottom as rb, s.w as sw, s.h as sh, s.cx as scx, s.bottom as sb')}, i as (select *, greatest(least(scx + sw / 2, real_cx + rw / 2) - greatest(scx - sw / 2, real_cx - rw / 2), 0) * greatest(least(sb, rb) - greatest(sb - sh, rb - rh), 0) as o from grid)
select case_id, count(*) as n, round(avg((rv = sv)::int), 6) as visibility_accuracy, round(avg(abs(cx)) filter (where rv), 6) as mae_cx, round(avg((abs(cx) + abs(bottom) + 2.5e0 * abs(w) + 2.5e0 * abs(h)) / 4) filter (where rv), 6) as weighted_l1, round(avg(case when sw is not null then o / (sw * sh + rw * rh - o) else 0 end) filter (where rv), 6) as mean_iou from i group by 1""")
def a14_batch_scores(spark, sf):
    grid = compare.comparison_grid(frames.real(spark, sf), frames.synthetic(spark, sf))
    out = reports.batch_scores(grid, ["case_id"])
    return out.select("case_id", "n", *[F.round(k, 6).alias(k) for k in ("visibility_accuracy", "mae_cx", "weighted_l1", "mean_iou")])


_LABELLED = STATES + ", lab as (select k, line, round(x, 1) as x, z, (k % 12) * 30e0 as yaw, abs(x) < 6 and z > 0 as visible, x * 10 + z as w, z * 2 as h from states)"


def _labelled(spark, sf):
    return frames.states(spark, sf).select("k", "line", F.round("x", 1).alias("x"), "z", (c("k") % 12 * 30.0).alias("yaw"), ((F.abs("x") < 6) & (c("z") > 0)).alias("visible"), (c("x") * 10 + c("z")).alias("w"), (c("z") * 2).alias("h"))


@query(f"with {_LABELLED} select count(*) as n, count(*) filter (where visible) as n_visible, round(count(*) filter (where visible) / count(*), 9) as visible_share, count(distinct x) * count(distinct z) * count(distinct yaw) - count(distinct (x, z, yaw)) as missing, round(min(w), 9) as least_w, round(max(w), 9) as most_w from lab")
def a11_label_set(spark, sf):
    return reports.label_set(_labelled(spark, sf)).select("n", "n_visible", "missing", *nine(visible_share=c("visible_share"), least_w=c("least_w"), most_w=c("most_w")))


@query(f"with {_LABELLED} select case when z < 10 then 'near' when z < 50 then 'middle' else 'far' end as bin, count(*) as n, count(*) filter (where visible) as n_visible, round(avg(visible::int), 6) as share, round(avg(w) filter (where visible), 6) as mean_w, round(avg(h) filter (where visible), 6) as mean_h from lab group by 1")
def a12_depth_bins(spark, sf):
    out = reports.by_bin(_labelled(spark, sf), F.when(c("z") < 10, "near").when(c("z") < 50, "middle").otherwise("far"), ["w", "h"])
    return out.select("bin", "n", "n_visible", *[F.round(k, 6).alias(k) for k in ("share", "mean_w", "mean_h")])


@query(f"""with {_LABELLED}, u as (select *, row_number() over (partition by x, z, yaw order by k * 10 + line desc) as n from lab), ax as (select distinct x from lab), az as (select distinct z from lab), ay as (select distinct yaw from lab)
select {r9(x='ax.x', z='az.z', yaw='ay.yaw')}, coalesce(u.visible, false) as visible, round(u.w, 9) as w from ax cross join az cross join ay left join u on u.x = ax.x and u.z = az.z and u.yaw = ay.yaw and u.n = 1""")
def d3_dense_grid(spark, sf):
    out = lookup.dense_grid(_labelled(spark, sf), ["x", "z", "yaw"], ["w"], c("k") * 10 + c("line"))
    return out.select(*nine(x=c("x"), z=c("z"), yaw=c("yaw")), "visible", *nine(w=c("w")))


@query(f"with {REAL}, a as (select case_id, case when not visible then 'not_visible' when w < 40 then 'too_narrow' else '' end as reason from real_), e as (select case_id, reason, count(*) as n from a group by all) select case_id, coalesce(sum(n) filter (where reason = ''), 0)::bigint as saved, coalesce(sum(n) filter (where reason <> ''), 0)::bigint as skipped, coalesce(string_agg(reason || ':' || n, ',' order by reason) filter (where reason <> ''), '') as reasons from e group by 1")
def a19_run_stats(spark, sf):
    return reports.run_stats(frames.real(spark, sf), ["case_id"], F.when(~c("visible"), "not_visible").when(c("w") < 40, "too_narrow").otherwise(""))


@query(f"with {REAL} select case_id, count(*) as seen, count(*) filter (where visible) as active, count(*) filter (where visible and w > 60) as saved, count(*) filter (where visible) = count(*) as active_only from real_ group by 1")
def a22_run_summary(spark, sf):
    v = c("visible")
    return frames.real(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(v).alias("active"), F.count_if(v & (c("w") > 60)).alias("saved")).withColumn("active_only", c("active") == c("seen"))


@query(f"with {REAL} select case_id, actor_id, count(*) as n, min(frame) as first, max(frame) as last, count(*) = max(frame) - min(frame) + 1 as whole from real_ group by all")
def a23_manifest(spark, sf):
    return reports.manifest(frames.real(spark, sf), ["case_id", "actor_id"])


@query("select o_custkey % 50 as case_id, o_orderstatus as actor_id, o_orderkey % 300 as frame, count(*) as n from orders group by all having count(*) > 1")
def o5_duplicates(spark, sf):
    o = table(spark, sf, "orders").select((c("o_custkey") % 50).alias("case_id"), c("o_orderstatus").alias("actor_id"), (c("o_orderkey") % 300).alias("frame"))
    return reports.duplicated(o, ["case_id", "actor_id", "frame"])


@query(f"with {POSES} select run, frame, row_number() over (order by run, frame) - 1 as sample_id, frame % greatest(count(*) over (partition by run) // 12, 1) = 0 as gallery from poses")
def w13_sample_ids(spark, sf):
    return reports.sample_ids(frames.poses(spark, sf).select("run", "frame"), "run").select("run", "frame", "sample_id", "gallery")


# Files written and read back


def _file(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


@query("select s_suppkey as case_index, 'sweep_case_' || lpad((s_suppkey % 10000)::varchar, 4, '0') as case_id, 'cut_in' as scenario_type, s_acctbal as start_m, f.form from supplier, (values ('document'), ('line'), ('list')) f(form)")
def s7_case_manifest(spark, sf):
    made = table(spark, sf, "supplier").select(c("s_suppkey").alias("case_index"), F.format_string("sweep_case_%04d", c("s_suppkey") % 10000).alias("case_id"), F.lit("cut_in").alias("scenario_type"), F.struct(c("s_acctbal").alias("start_distance_m")).alias("parameters"))
    paths = {form: _file(spark, form) for form in ("line", "list", "document")}
    io.write_json(made, paths["line"])
    # A manifest a hundred cases; one indented, as they are written by hand.
    whole = made.groupBy(F.floor(c("case_index") / 100).alias("g")).agg(F.collect_list(F.struct(*made.columns)).alias("cases"))
    for form, doc in (("list", c("cases")), ("document", F.struct("cases"))):  # a document is a file of its own
        whole.select("g", F.to_json(doc, {"pretty": "true"}).alias("value")).write.partitionBy("g").text(paths[form])
    read = [io.read_cases(spark, p, form == "line").select("case_index", "case_id", "scenario_type", c("parameters.start_distance_m").alias("start_m"), F.lit(form).alias("form")) for form, p in paths.items()]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(f"with {REAL} select case_id, actor_id, frame, {r9(cx='case when w > 30 then cx end', w='w')} from real_")
def s18_box_labels(spark, sf):
    path = _file(spark, "labels")
    io.write_box_labels(frames.real(spark, sf).select("case_id", "actor_id", "frame", F.when(c("w") > 30, c("cx")).otherwise(F.lit(float("nan"))).alias("cx"), "w"), path)
    return io.read_box_labels(spark, path, "case_id long, actor_id string, frame long, cx double, w double").select("case_id", "actor_id", "frame", *nine(cx=c("cx"), w=c("w")))


@query(f"with {_LABELLED} select count(*) as n, count(*) filter (where visible) as n_visible, count(distinct x) as n_x, count(distinct yaw) as n_yaw from lab")
def s15_grid_files(spark, sf):
    path = _file(spark, "grid")
    rows = _labelled(spark, sf)
    io.write_grid(rows, path, ["z", "x", "yaw"])
    return io.read_grid_metadata(spark, path).select("n", "n_visible", "n_x", "n_yaw")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

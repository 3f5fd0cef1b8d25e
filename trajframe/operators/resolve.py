"""Resolving scenarios to states by frame: lifecycles, maneuvers, paths, runtime states, densified curves, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import lerp, wrap180
from trajframe.operators.motion import pchip_slopes, velocities

c = F.col


def alive(t: Column, spawn: Column, end: Column, least: float = 1e-9) -> Column:
    """Whether an actor exists at ``t``; a null end never comes."""
    return (t >= spawn - least) & F.coalesce(t <= end + least, F.lit(True))


def maneuver_states(rows: DataFrame) -> DataFrame:
    """Adds x, y, yaw, speed_mps, vx, vy, error for rows of maneuver, x0, y0, yaw0, t_s, start_s, duration_s, speed.

    static stays; straight, following and oncoming go along the spawn's yaw from start_s on, for duration_s if given;
    others have an error and null states.
    """
    known = F.coalesce(c("maneuver").isin("static", "straight", "following", "oncoming"), F.lit(False))
    moves = known & (c("maneuver") != "static")
    since = F.greatest(c("t_s") - c("start_s"), F.lit(0.0))
    over = F.coalesce(since >= c("duration_s"), F.lit(False))
    way = F.when(moves, c("speed") * F.when(over, c("duration_s")).otherwise(since)).when(known, 0.0)
    speed = F.when(moves & (c("t_s") > c("start_s")) & ~over, c("speed")).when(known, 0.0)
    a = F.radians("yaw0")
    return rows.withColumns({
        "x": c("x0") + way * F.cos(a), "y": c("y0") + way * F.sin(a), "yaw": F.when(known, F.when(moves, wrap180(c("yaw0"))).otherwise(c("yaw0"))), "speed_mps": speed,
        "vx": speed * F.cos(a), "vy": speed * F.sin(a), "error": F.when(~known, F.concat(F.lit("unresolved maneuver: "), F.coalesce("maneuver", F.lit("none")))),
    })


def path_states(times: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, t_s, x, y, yaw, speed_mps): states ``distance`` along each key's points (key, i, x, y), held at its end.

    Distances meet their segment in one union and one sorted window instead of a range join.
    """
    p = path_segments(points, key)
    kind = p.schema["s"].dataType
    both = p.select(key, c("s.arc").alias("distance"), F.lit(0).alias("probe"), F.lit(None).cast("double").alias("t_s"), F.lit(None).cast("double").alias("speed"), "s", "i")
    both = both.unionByName(times.select(key, F.greatest("distance", F.lit(0.0)).alias("distance"), F.lit(1).alias("probe"), c("t_s").cast("double").alias("t_s"), c("speed").cast("double").alias("speed"), F.lit(None).cast(kind).alias("s"), F.lit(None).cast(p.schema["i"].dataType).alias("i")))
    order = Window.partitionBy(key).orderBy("distance", "probe", "i").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("s", F.last("s", True).over(order)).where("probe = 1 and s is not null")
    at = along_segment(c("distance"), c("s"))
    return met.select(key, "t_s", at["x"].alias("x"), at["y"].alias("y"), at["yaw"].alias("yaw"), F.when(at["end"], 0.0).otherwise(c("speed")).alias("speed_mps"))


def path_segments(points: DataFrame, key: str) -> DataFrame:
    """(key, i, s): each point (key, i, x, y) as the beginning of a segment: its arc, the next one's, and both neighbours."""
    w = Window.partitionBy(key).orderBy("i")
    step = F.hypot(c("x") - F.lag("x").over(w), c("y") - F.lag("y").over(w))
    p = points.withColumn("arc", F.sum(F.coalesce(step, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "qx": F.lead("x").over(w), "qy": F.lead("y").over(w), "next": F.lead("arc").over(w)})
    return p.select(key, "i", F.struct("arc", "next", "x", "y", "px", "py", "qx", "qy").alias("s"))


def along_segment(distance: Column, s: Column) -> dict[str, Column]:
    """x, y, yaw at a distance on the segment that it met, and whether it is the path's end."""
    end = s["next"].isNull() | (s["next"] - s["arc"] <= 1e-9)
    u = (distance - s["arc"]) / (s["next"] - s["arc"])
    yaw = F.degrees(F.when(end, F.atan2(s["y"] - s["py"], s["x"] - s["px"])).otherwise(F.atan2(s["qy"] - s["y"], s["qx"] - s["x"])))
    return {"x": F.when(end, s["x"]).otherwise(lerp(s["x"], s["qx"], u)), "y": F.when(end, s["y"]).otherwise(lerp(s["y"], s["qy"], u)), "yaw": wrap180(yaw), "end": end}


def frames_between(start: Column, end: Column, last: Column, fps: Column) -> Column:
    """Array of the frames from 0 to ``last`` that may lie between two times, one to spare on each side; null times are open ends."""
    within = lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), last.cast("double")).cast("long"))
    return F.sequence(F.coalesce(within(F.floor(start * fps) - 1.0), F.lit(0).cast("long")), F.coalesce(within(F.ceil(end * fps) + 1.0), last))


def resolved(actors: DataFrame, frames: DataFrame, key: list[str], scenario: str, fps: float) -> DataFrame:
    """Actors' states at the frames (scenario, frame) at which they are alive, with velocities from positions.

    ``actors`` holds what :func:`maneuver_states` needs, and spawn_s and end_s.
    """
    rows = actors.join(frames, scenario).withColumn("t_s", c("frame") / fps).where(alive(c("t_s"), c("spawn_s"), c("end_s")))
    states = maneuver_states(rows).where("error is null").select(*key, "frame", "t_s", "x", "y", "yaw")
    return velocities(states, key, fps=fps)


def with_ego(actors: DataFrame, ego: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Actor rows beside the ego's of the same key, and the actor rows that lack one."""
    return actors.join(ego, key), actors.join(ego.select(*key), key, "left_anti")


def runtime_state(t: Column, t0: Column, t1: Column, start: Column, end: Column) -> Column:
    """Between start and end by the share of time gone by, held at both; constant where the times coincide."""
    u = F.coalesce(F.least(F.greatest(F.try_divide(t - t0, t1 - t0), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return lerp(start, end, u)


def densified(rows: DataFrame, key: list[str], at: str, value: str, pieces: int = 40) -> DataFrame:
    """(key, at, value): ``pieces`` points an interval on the monotone cubic through the rows, and the last row."""
    w = Window.partitionBy(*key).orderBy(at)
    p = pchip_slopes(rows, key, at, value).withColumns({"t1": F.lead(at).over(w), "v1": F.lead(value).over(w), "s1": F.lead("slope").over(w)})
    n = F.when(c("t1").isNull(), 0).otherwise(pieces - 1)
    p = p.withColumn("piece", F.explode(F.sequence(F.lit(0), n))).withColumn("u", c("piece") / float(pieces))
    u, h = c("u"), c("t1") - c(at)
    curve = (2 * u * u * u - 3 * u * u + 1) * c(value) + (u * u * u - 2 * u * u + u) * h * c("slope") + (3 * u * u - 2 * u * u * u) * c("v1") + (u * u * u - u * u) * h * c("s1")
    return p.select(*key, F.coalesce(c(at) + u * h, c(at)).alias(at), F.coalesce(curve, c(value)).alias(value))


def route_target(route: DataFrame, asks: DataFrame, key: str, ask: list[str]) -> DataFrame:
    """(key, ask, nearest, target): for each ask (key, ask, ex, ey, ahead) its nearest waypoint (the first on a tie) and the first at least ``ahead`` further on, null if none.

    ``ask`` names an ask among those of its route; rows that repeat it are one ask if they are equal. Nearest waypoints
    are a minimum that is taken as waypoints and asks meet; the one further on is met in one sorted pass a route.
    """
    w = Window.partitionBy(key).orderBy("frame")
    step = F.hypot(c("x") - F.lag("x").over(w), c("y") - F.lag("y").over(w))
    arcs = route.withColumn("arc", F.sum(F.coalesce(step, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = arcs.select(key, "frame", "arc", "x", "y").join(asks.select(key, *ask, "ex", "ey", "ahead").distinct(), key)
    near = rows.groupBy(key, *ask, "ahead").agg(F.min(F.struct(F.hypot(c("x") - c("ex"), c("y") - c("ey")).alias("off"), "frame", "arc")).alias("near"))
    none = {n: F.lit(None).cast(near.schema[n].dataType) for n in ask}
    probe = near.select(key, *ask, c("near.frame").alias("nearest"), (c("near.arc") + c("ahead")).alias("arc"), F.lit(None).cast(arcs.schema["frame"].dataType).alias("frame"), F.lit(0).alias("way"))
    ways = arcs.select(key, *[v.alias(n) for n, v in none.items()], F.lit(None).cast(arcs.schema["frame"].dataType).alias("nearest"), "arc", "frame", F.lit(1).alias("way"))
    # Of equal distances the probe comes first, and the earliest waypoint after it.
    order = Window.partitionBy(key).orderBy("arc", "way", "frame").rowsBetween(0, Window.unboundedFollowing)
    return probe.unionByName(ways).withColumn("target", F.first("frame", True).over(order)).where("way = 0").select(key, *ask, "nearest", "target")

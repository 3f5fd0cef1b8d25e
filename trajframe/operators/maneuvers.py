"""Actor states by maneuver, by script and by keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import lerp, lerp_yaw, shortest_delta, smoothstep, smoothstep_slope, wrap180

c = F.col


def _by_maneuver(values: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in values.items():
        out = out.when(c("maneuver") == name, value)
    return out


def rule_based(rows: DataFrame) -> DataFrame:
    """Adds x, y, yaw, vx, vy, speed_mps in the scenario frame for rows (maneuver, t_s, x0, y0, yaw0, speed, ...).

    target_y, target_x, lane_y, direction, cut_start_s and cut_s may be null and then have defaults. Other maneuvers give nulls.
    """
    t, v = c("t_s"), c("speed")
    span = F.greatest(F.coalesce("cut_s", F.lit(3.0)), F.lit(1e-6))
    u = (t - F.coalesce("cut_start_s", F.lit(1.5))) / span
    aside = F.coalesce("target_y", F.lit(0.0)) - c("y0")
    across = F.coalesce("direction", F.lit(-1.0)) * v
    x = {"static": c("x0"), "oncoming": c("x0") - v * t, "cut_in": c("x0") + v * t, "following": c("x0") + v * t, "crossing": F.coalesce("target_x", "x0")}
    y = {"static": c("y0"), "oncoming": F.coalesce("lane_y", "y0"), "cut_in": c("y0") + aside * smoothstep(u), "following": c("y0"), "crossing": c("y0") + across * t}
    vx = {"static": F.lit(0.0), "oncoming": -v, "cut_in": v, "following": v, "crossing": F.lit(0.0)}
    vy = {"static": F.lit(0.0), "oncoming": F.lit(0.0), "cut_in": aside * smoothstep_slope(u) / span, "following": F.lit(0.0), "crossing": across}
    rows = rows.withColumns({"x": _by_maneuver(x), "y": _by_maneuver(y), "vx": _by_maneuver(vx), "vy": _by_maneuver(vy)})
    yaw = {"static": c("yaw0"), "oncoming": F.lit(180.0), "cut_in": F.degrees(F.atan2("vy", "vx")), "following": F.lit(0.0), "crossing": 90.0 * F.signum("vy")}
    return rows.withColumns({"yaw": _by_maneuver(yaw), "speed_mps": F.hypot("vx", "vy")})


def recorded(rows: DataFrame) -> DataFrame:
    """Adds x, z, yaw in the local frame for rows (maneuver, t_s, lane_x, target_x, start_m, speed, start_s, span_s)."""
    span = F.greatest(c("span_s"), F.lit(0.01))
    u = F.least(F.greatest((c("t_s") - c("start_s")) / span, F.lit(0.0)), F.lit(1.0))
    aside, ahead, inside = c("target_x") - c("lane_x"), c("speed") * c("t_s"), (u > 0) & (u < 1)
    x = {"static": c("lane_x"), "oncoming": c("lane_x"), "following": c("lane_x"), "cut_in": c("lane_x") + aside * smoothstep(u), "crossing": c("lane_x") + aside * u}
    z = {"static": c("start_m"), "oncoming": c("start_m") - ahead, "following": c("start_m") + ahead, "cut_in": c("start_m") + ahead, "crossing": c("start_m")}
    slant = F.degrees(F.atan2(aside, F.greatest(c("speed") * span, F.lit(0.01))))
    yaw = {"static": F.lit(0.0), "oncoming": F.lit(180.0), "following": F.lit(0.0), "cut_in": F.when(inside, slant).otherwise(0.0), "crossing": 90.0 * F.signum(aside)}
    return rows.withColumns({"x": _by_maneuver(x), "z": _by_maneuver(z), "yaw": _by_maneuver(yaw)})


def _first_keys(keyframes: DataFrame, spawns: DataFrame, key: str) -> DataFrame:
    first = keyframes.groupBy(key).agg(F.min_by(F.struct("t_s", "x", "y", "yaw"), "t_s").alias("first"))
    return spawns.select(key, "start_s", *[c(k).alias(f"s_{k}") for k in ("x", "y", "yaw")]).join(first, key, "left")


def with_spawn(keyframes: DataFrame, spawns: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """Keyframes (key, t_s, x, y, yaw), and the spawn pose before them where the first comes later than the spawn."""
    later = _first_keys(keyframes, spawns, key).where(c("first.t_s") > c("start_s") + least)
    return keyframes.select(key, "t_s", "x", "y", "yaw").unionByName(later.select(key, c("start_s").alias("t_s"), c("s_x").alias("x"), c("s_y").alias("y"), c("s_yaw").alias("yaw")))


def first_key_rule(first: Column, start: Column, x: Column, y: Column, yaw: Column, least: float = 1e-9) -> Column:
    """What the first keyframe (t_s, x, y, yaw; null if there is none) of an actor breaks that starts at ``start`` in a pose; null if nothing."""
    off = F.greatest(F.abs(first["x"] - x), F.abs(first["y"] - y), F.abs(shortest_delta(yaw, first["yaw"])))
    gap = first["t_s"] - start
    return F.when(first.isNull(), "no_keyframes").when(gap < -least, "before_spawn").when((F.abs(gap) <= least) & (off > 1e-6), "spawn_mismatch")


def keyframe_faults(keyframes: DataFrame, spawns: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """(key, rule): actors without keyframes, with one before the spawn, or whose first one is at the spawn in another pose."""
    rule = first_key_rule(c("first"), c("start_s"), c("s_x"), c("s_y"), c("s_yaw"), least)
    return _first_keys(keyframes, spawns, key).select(key, rule.alias("rule")).where("rule is not null")


def keyframe_states(times: DataFrame, keyframes: DataFrame, key: str, smooth: Column) -> DataFrame:
    """(key, t_s, x, y, yaw, vx, vy, speed_mps): states at ``times`` between keyframes, still at and beyond both ends.

    ``smooth`` eases in and out of each keyframe. Times meet the keyframe before them in one sorted pass.
    """
    w = Window.partitionBy(key).orderBy("t_s")
    ends = {f"{k}1": F.lead(k).over(w) for k in ("t_s", "x", "y", "yaw")}
    k = keyframes.select(key, "t_s", F.lit(0).alias("probe"), F.struct("t_s", "x", "y", "yaw", F.lag("t_s").over(w).isNull().alias("opens"), *[v.alias(n) for n, v in ends.items()]).alias("p"))
    both = k.unionByName(times.select(key, "t_s", F.lit(1).alias("probe"), F.lit(None).cast(k.schema["p"].dataType).alias("p")))
    order = Window.partitionBy(key).orderBy("t_s", "probe")
    met = both.withColumn("p", F.coalesce(F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("p", True).over(order.rowsBetween(0, Window.unboundedFollowing)))).where("probe = 1 and p is not null")
    at = between_keys(c("t_s"), c("p"), smooth)
    return met.select(key, "t_s", *[at[n].alias(n) for n in ("x", "y", "yaw", "vx", "vy")]).withColumn("speed_mps", F.hypot("vx", "vy"))


def between_keys(t: Column, p: Column, smooth: Column) -> dict[str, Column]:
    """x, y, yaw, vx, vy at ``t`` from the keyframe that it met: ``p`` holds t_s, x, y, yaw, the next one's with a 1
    behind (null at the last), and whether it ``opens`` its key's."""
    still = (t < p["t_s"]) | p["t_s1"].isNull() | (p["opens"] & (t <= p["t_s"]))
    dt = p["t_s1"] - p["t_s"]
    u = F.try_divide(t - p["t_s"], dt)
    at = F.when(smooth, smoothstep(u)).otherwise(u)
    rate = F.try_divide(F.when(smooth, smoothstep_slope(u)).otherwise(1.0), dt)
    pos = lambda n: F.when(still, p[n]).otherwise(lerp(p[n], p[f"{n}1"], at))
    vel = lambda n: F.when(still, 0.0).otherwise((p[f"{n}1"] - p[n]) * rate)
    yaw = F.when(still, wrap180(p["yaw"])).otherwise(lerp_yaw(p["yaw"], p["yaw1"], at))
    return {"x": pos("x"), "y": pos("y"), "yaw": yaw, "vx": vel("x"), "vy": vel("y")}


def sprite_schedule(frame: Column, start: int, end: int, heights: tuple[float, float], aspect: float, image: tuple[int, int], centre: float, bottom: float, drift: float) -> dict[str, Column]:
    """Whole-pixel box of a sprite that grows between two frames and drifts sideways; nulls outside them."""
    s = smoothstep((frame - start) / float(max(1, end - start)))
    whole = lambda v: F.bround(v).cast("int")
    h = whole(lerp(F.lit(heights[0]), F.lit(heights[1]), s))
    w = F.greatest(whole(h * aspect), F.lit(1))
    cx, by = whole(image[0] * (centre + drift * s)), whole(F.lit(image[1] * bottom))
    x1 = whole(cx - w / 2.0)
    box = {"x1": x1, "y1": by - h, "x2": x1 + w, "y2": by}
    return {k: F.when((frame >= start) & (frame <= end), v) for k, v in box.items()}

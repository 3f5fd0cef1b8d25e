"""Trajectories as windows over frames, and joins of frames with nearest poses and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import lerp, shortest_delta

c = F.col


def velocities(rows: DataFrame, key: list[str], frame: str = "frame", fps: float = 30.0) -> DataFrame:
    """Adds vx, vy, speed_mps: forward difference, backward on the last frame, 0 on a single one."""
    w = Window.partitionBy(*key).orderBy(frame)
    dt = lambda a, b: (b - a) / fps

    def rate(x: str) -> Column:
        ahead = F.try_divide(F.lead(x).over(w) - c(x), dt(c(frame), F.lead(frame).over(w)))
        back = F.try_divide(c(x) - F.lag(x).over(w), dt(F.lag(frame).over(w), c(frame)))
        return F.coalesce(ahead, back, F.lit(0.0))

    return rows.withColumns({"vx": rate("x"), "vy": rate("y")}).withColumn("speed_mps", F.hypot("vx", "vy"))


def arc_length(rows: DataFrame, key: list[str], frame: str = "frame", least: float = 1e-9) -> DataFrame:
    """Adds the distance along the path; points within ``least`` of the one before are dropped."""
    w = Window.partitionBy(*key).orderBy(frame)
    step = F.hypot(c("x") - F.lag("x").over(w), c("y") - F.lag("y").over(w))
    kept = rows.withColumn("step", step).where(c("step").isNull() | (c("step") > least))
    return kept.withColumn("arc", F.sum(F.coalesce("step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def pchip_slopes(rows: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Adds slope: monotone cubic (harmonic mean inside, 0 at a change of sign, one-sided and limited at the ends)."""
    w = Window.partitionBy(*key).orderBy(at)
    h1, h0 = F.lead(at).over(w) - c(at), c(at) - F.lag(at).over(w)
    rows = rows.withColumns({"h1": h1, "h0": h0}).withColumns({"d1": (F.lead(value).over(w) - c(value)) / c("h1"), "d0": (c(value) - F.lag(value).over(w)) / c("h0")})
    rows = rows.withColumns({"h2": F.lead("h1").over(w), "d2": F.lead("d1").over(w), "hb": F.lag("h0").over(w), "db": F.lag("d0").over(w)})
    w1, w2 = 2 * c("h1") + c("h0"), c("h1") + 2 * c("h0")
    inner = F.when((F.abs("d0") > 1e-9) & (F.abs("d1") > 1e-9) & (c("d0") * c("d1") > 0), (w1 + w2) / (F.try_divide(w1, c("d0")) + F.try_divide(w2, c("d1")))).otherwise(0.0)

    def end(h: str, d: str, hn: str, dn: str) -> Column:
        s = F.try_divide((2 * c(h) + c(hn)) * c(d) - c(h) * c(dn), c(h) + c(hn))
        return F.when(c(dn).isNull(), c(d)).when(s * c(d) <= 0, 0.0).when((c(d) * c(dn) < 0) & (F.abs(s) > 3 * F.abs(d)), 3 * c(d)).otherwise(s)

    slope = F.when(c("d0").isNull() & c("d1").isNull(), 0.0).when(c("d0").isNull(), end("h1", "d1", "h2", "d2")).when(c("d1").isNull(), end("h0", "d0", "hb", "db")).otherwise(inner)
    return rows.withColumn("slope", slope).drop("h0", "h1", "h2", "hb", "d0", "d1", "d2", "db")


def turn_windows(rows: DataFrame, key: list[str], window: int, every: int) -> DataFrame:
    """(key, frame, delta_yaw): change of yaw over ``window`` rows, from every ``every``-th row."""
    w = Window.partitionBy(*key).orderBy("frame")
    out = rows.withColumns({"ahead": F.lead("yaw", window).over(w), "n": F.row_number().over(w) - 1})
    return out.where(c("ahead").isNotNull() & (c("n") % every == 0)).select(*key, "frame", shortest_delta(c("yaw"), c("ahead")).alias("delta_yaw"))


def painter_order(rows: DataFrame, scene: list[str], depth: str, ordinal: str) -> DataFrame:
    """Adds order_index from 0: the farthest first, ties by ``ordinal``."""
    return rows.withColumn("order_index", (F.row_number().over(Window.partitionBy(*scene).orderBy(F.desc(depth), ordinal)) - 1).cast("long"))


def nearest_pose(probes: DataFrame, poses: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each probe (key, frame) with the nearest pose of its key: the ends hold, a tie goes to the lower frame.

    One union and one sort within a key instead of a range join.
    """
    pose = F.struct(c("frame").alias("at"), *columns)
    both = probes.select(key, "frame", F.lit(1).alias("probe"), F.lit(None).cast(poses.select(pose.alias("p")).schema["p"].dataType).alias("p")).unionByName(poses.select(key, "frame", F.lit(0).alias("probe"), pose.alias("p")))
    w = Window.partitionBy(key).orderBy("frame", "probe")
    met = both.withColumns({"before": F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("probe = 1")
    near = F.when(c("before").isNull(), c("after")).when(c("after").isNull(), c("before")).when(c("after.at") - c("frame") < c("frame") - c("before.at"), c("after")).otherwise(c("before"))
    return met.select(key, "frame", near.alias("n")).select(key, "frame", c("n.at").alias("pose_frame"), *[c(f"n.{x}").alias(x) for x in columns])


def bracketed(probes: DataFrame, keyframes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each probe (key, frame) interpolated between the keyframes around it; held before the first and after the last.

    Keyframes carry their successor; probes meet the last keyframe at or before them in one sorted pass.
    """
    w = Window.partitionBy(key).orderBy("frame")
    first = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = keyframes.select(key, "frame", F.lit(0).alias("probe"), F.struct(c("frame").alias("f0"), F.lead("frame").over(w).alias("f1"), *[F.struct(c(x).alias("a"), F.lead(x).over(w).alias("b"), F.first(x).over(first).alias("start")).alias(x) for x in columns]).alias("p"))
    both = k.unionByName(probes.select(key, "frame", F.lit(1).alias("probe"), F.lit(None).cast(k.schema["p"].dataType).alias("p")))
    order = Window.partitionBy(key).orderBy("frame", "probe")
    met = both.withColumns({"p": F.coalesce(F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("p", True).over(order.rowsBetween(0, Window.unboundedFollowing)))}).where("probe = 1 and p is not null")
    u = F.try_divide((c("frame") - c("p.f0")).cast("double"), (c("p.f1") - c("p.f0")).cast("double"))
    value = lambda x: F.when(c("frame") < c("p.f0"), c(f"p.{x}.start")).when(c("p.f1").isNull(), c(f"p.{x}.a")).otherwise(lerp(c(f"p.{x}.a"), c(f"p.{x}.b"), u))
    return met.select(key, "frame", *[value(x).alias(x) for x in columns])


def bracket_velocity(probes: DataFrame, keyframes: DataFrame, key: str, columns: list[str], least: float = 1e-6) -> DataFrame:
    """(key, frame, v_{column}): a keyed motion's velocity at each probe (key, frame), the slope of the keyframes around it.

    Keyframes are (key, frame, t_s, columns). At a keyframe the slope before it holds, at and before the first one the
    first slope, beyond the last one the last. Where the two times coincide the slope is by frame instead of by second.
    A single keyframe has no velocity. One union and one sorted window a key.
    """
    w = Window.partitionBy(key).orderBy("frame", "t_s")
    own = F.struct("frame", "t_s", *columns)
    k = keyframes.select(key, c("frame").cast("double").alias("frame"), "t_s", *columns).withColumns({"here": own, "before": F.lag(own).over(w), "after": F.lead(own).over(w)})
    first = c("before").isNull()
    k = k.select(key, "frame", F.lit(0).alias("probe"), F.struct(F.when(first, c("here")).otherwise(c("before")).alias("a"), F.when(first, c("after")).otherwise(c("here")).alias("b")).alias("s"))
    both = k.unionByName(probes.select(key, c("frame").cast("double").alias("frame"), F.lit(1).alias("probe"), F.lit(None).cast(k.schema["s"].dataType).alias("s")))
    # A probe meets the first keyframe at or after it, which is sorted behind it where the frames are equal.
    order = Window.partitionBy(key).orderBy("frame", F.desc("probe"))
    met = both.withColumn("s", F.coalesce(F.first("s", True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.last("s", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))).where("probe = 1 and s is not null")
    dt, df = c("s.b.t_s") - c("s.a.t_s"), F.greatest(c("s.b.frame") - c("s.a.frame"), F.lit(least))
    span = F.when(F.abs(dt) < least, df).otherwise(dt)
    return met.select(key, "frame", *[F.when(c("s.b").isNull(), 0.0).otherwise((c(f"s.b.{x}") - c(f"s.a.{x}")) / span).alias(f"v_{x}") for x in columns])


#: Frames in a block of :func:`smoothed`.
SMOOTHING_BLOCK = 128


def smoothed(rows: DataFrame, key: str, value: str, keep: float = 0.85, relax: float = 0.97, default: float | None = None, start: float | None = None, block: int = SMOOTHING_BLOCK) -> DataFrame:
    """(key, frame, smooth): exponential smoothing along each run, s <- keep s + (1 - keep) x.

    A frame without a value relaxes towards ``default``, s <- relax s + (1 - relax) default, or leaves s as it is if
    there is none. s begins at ``start``, else at the run's first frame's value, else at ``default``, else at 0.

    Each frame is an affine map of s, and so is a block of frames: blocks are composed apart, the maps of a run's blocks
    (a row for ``block`` frames) are chained by windows that double their reach, and each block then starts from the s
    that comes out of those before it. No run meets in one group; a window sees a run's blocks only. Frames that repeat
    are taken in order of their values; rows without a frame are left out.
    """
    x, lost = c("x"), (F.lit(default) if default is not None else F.lit(None)).cast("double")
    map_a = F.when(x.isNotNull(), F.lit(keep)).when(lost.isNotNull(), F.lit(relax)).otherwise(1.0)
    map_b = F.when(x.isNotNull(), x * round(1 - keep, 12)).when(lost.isNotNull(), lost * round(1 - relax, 12)).otherwise(0.0)
    each = rows.where("frame is not null").select(key, c("frame").cast("long").alias("frame"), c(value).cast("double").alias("x"))
    each = each.select(key, F.floor(c("frame") / block).cast("long").alias("block"), F.struct("frame", "x", map_a.alias("a"), map_b.alias("b")).alias("m"))
    blocks = each.groupBy(key, "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    whole = F.aggregate("ms", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, m: F.struct((m["a"] * s["a"]).alias("a"), (m["a"] * s["b"] + m["b"]).alias("b")))
    blocks = blocks.withColumn("w", whole)
    run = Window.partitionBy(key).orderBy("block")
    spans = each.agg(F.max("block") - F.min("block")).first()[0] or 0  # one number: how many doublings reach over all blocks
    first = F.first(F.get("ms", 0)["x"]).over(run.rowsBetween(Window.unboundedPreceding, 0))
    chain = blocks.select(key, "block", "ms", F.coalesce(F.lit(start).cast("double"), first, lost, F.lit(0.0)).alias("s0"), F.lag("w").over(run).alias("w"))
    reach = 1
    while reach <= spans:
        before = F.lag("w", reach).over(run)
        joined = F.struct((c("w.a") * before["a"]).alias("a"), (c("w.a") * before["b"] + c("w.b")).alias("b"))
        chain = chain.withColumn("w", F.when(before.isNotNull(), joined).otherwise(c("w")))
        reach *= 2
    carried = chain.withColumn("s0", F.coalesce(c("w.a") * c("s0") + c("w.b"), c("s0")))
    steps = F.aggregate("ms", F.array().cast("array<double>"), lambda done, m: F.concat(done, F.array(m["a"] * F.coalesce(F.try_element_at(done, F.lit(-1)), c("s0")) + m["b"])))
    out = carried.select(key, F.explode(F.arrays_zip(F.transform("ms", lambda m: m["frame"]).alias("frame"), steps.alias("smooth"))).alias("o"))
    return out.select(key, c("o.frame").alias("frame"), c("o.smooth").alias("smooth"))


def turning_ego(rows: DataFrame, key: list[str], turn_start_s: float, turn_s: float, fps: float = 30.0) -> DataFrame:
    """Adds yaw, x, y of an ego that turns by ``turn`` degrees over ``turn_s`` seconds; rows hold key, frame, speed, turn.

    The heading advances before the position. Its sum has a closed form, so that only the position needs a window.
    """
    first, last = F.bround(F.lit(turn_start_s * fps)), F.bround(F.lit((turn_start_s + turn_s) * fps))
    turned = F.least(F.greatest(c("frame") - first, F.lit(0.0)), last - first)
    rows = rows.withColumn("yaw", turned * c("turn") / (turn_s * fps) if turn_s > 0 else F.lit(0.0))
    w = Window.partitionBy(*key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    step = lambda part: F.sum(F.when(c("frame") > 0, c("speed") / fps * part(F.radians("yaw"))).otherwise(0.0)).over(w)
    return rows.withColumns({"x": step(F.cos), "y": step(F.sin)})

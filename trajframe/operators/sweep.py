"""Factor sweeps: cases, their time axis and paths, and what the domain says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import lerp, smoothstep
from trajframe.functions.geometry import MOUNT_FORWARD
from trajframe.functions.rules import capability

c = F.col


def expand(base: DataFrame, factors: dict[str, list[float]]) -> DataFrame:
    """Every combination of factor values for each base row, the last factor varying fastest; case_index from 1.

    The index is mixed-radix arithmetic on positions: nothing is sorted.
    """
    out, index = base, F.lit(0)
    for name, values in factors.items():
        out = out.drop(name).select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"at_{name}", name))
        index = index * len(values) + c(f"at_{name}")
    return out.withColumn("case_index", (index + 1).cast("long")).drop(*[f"at_{n}" for n in factors])


def time_axis(cases: DataFrame, duration: Column, fps: int = 30) -> DataFrame:
    """Adds a row a frame from 0 to round-half-even(duration x fps), and t_s."""
    frames = F.sequence(F.lit(0), F.bround(duration * fps).cast("int"))
    return cases.withColumn("frame", F.explode(frames)).withColumn("frame", c("frame").cast("long")).withColumn("t_s", c("frame") / float(fps))


def cut_in_waypoints(cases: DataFrame, pieces: int = 20) -> DataFrame:
    """Waypoints of a lane change at constant path speed: ``pieces`` equal arcs, each with dx = sqrt(arc^2 - dy^2).

    Needs start_m, lane_y, target_y, speed, cut_start_s and cut_s. Cases in which some arc is shorter than its lateral
    step are infeasible and give no waypoints.
    """
    seg = c("speed") * c("cut_s") / pieces
    lateral = lambda k: lerp(c("lane_y"), c("target_y"), smoothstep(k / float(pieces)))
    at = cases.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(pieces)))).withColumn("y", lateral(c("i")))
    dy = lateral(c("i")) - lateral(c("i") - 1)
    steps = at.withColumn("dx2", seg * seg - dy * dy)
    w = Window.partitionBy("case_id").orderBy("i")
    whole = Window.partitionBy("case_id")
    ok = steps.withColumn("worst", F.min("dx2").over(whole)).where("worst >= 0")
    return ok.withColumn("x", c("start_m") + c("speed") * c("cut_start_s") + F.sum(F.sqrt("dx2")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("dx2", "worst")


def cut_in_frames(cases: DataFrame, duration_s: float = 8.0, fps: int = 30) -> DataFrame:
    """(case_id, frame, t_s, x, y, ego_x): actor and ego in the scenario frame at constant speeds along their paths.

    A case carries its path's twenty points as an array, and a frame finds its segment in it by number, worked out from
    the equal arcs: cases meet their points once, and frames nothing.
    """
    pts = cut_in_waypoints(cases).groupBy(c("case_id").alias("p_case")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("ways"))
    t = time_axis(cases.join(pts, c("case_id") == c("p_case")), F.lit(duration_s), fps)
    since = (c("t_s") - c("cut_start_s")) / c("cut_s") * 20.0
    rows = t.withColumns({"since": since, "i0": F.floor(F.least(F.greatest(since, F.lit(0.0)), F.lit(20.0))).cast("int")})
    at = lambda i, k: F.get("ways", i)[k]
    i, first, end = c("i0"), F.lit(0), F.lit(19)
    x0, y0 = c("start_m") + c("speed") * c("cut_start_s"), c("lane_y")
    u = c("since") - i
    x = F.when(c("since") <= 0, c("start_m") + c("speed") * c("t_s")).when(i == 0, lerp(x0, at(first, "x"), u)).when(i >= 20, at(end, "x") + c("speed") * (c("t_s") - c("cut_start_s") - c("cut_s"))).otherwise(lerp(at(i - 1, "x"), at(i, "x"), u))
    y = F.when(c("since") <= 0, y0).when(i == 0, lerp(y0, at(first, "y"), u)).when(i >= 20, at(end, "y")).otherwise(lerp(at(i - 1, "y"), at(i, "y"), u))
    return rows.select("case_id", "frame", "t_s", x.alias("x"), y.alias("y"), (c("ego_speed") * c("t_s")).alias("ego_x"))


def capability_report(frames: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """Per case: frames by class, fraction supported of those required (1 if none), first culled and first outside."""
    z, x = c("x") - c("ego_x") - MOUNT_FORWARD, -c("y")
    f = frames.select("case_id", "frame", z.alias("z"), x.alias("lateral"), capability(x, z, min_depth).alias("class"))
    n = lambda k: F.count_if(c("class") == k)
    first = lambda k: F.min(F.when(c("class") == k, c("frame")))
    required = n("SUPPORTED") + n("OOD")
    return f.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("active"), required.alias("required"), n("SUPPORTED").alias("supported"), n("CULLED").alias("culled"), n("OOD").alias("ood"),
        F.round(F.when(required == 0, 1.0).otherwise(F.try_divide(n("SUPPORTED").cast("double"), required.cast("double"))), 6).alias("supported_fraction"),
        F.round(F.min("z"), 6).alias("min_z"), F.round(F.max("z"), 6).alias("max_z"), first("CULLED").alias("first_culled"), first("OOD").alias("first_ood"),
        F.when(n("OOD") == 0, "SUPPORTED").otherwise("OUTSIDE").alias("status"),
    )


def capability_of_cases(cases: DataFrame, duration_s: float = 8.0, fps: int = 30) -> DataFrame:
    """The report of every case; cut-ins that no arc length allows have the status INFEASIBLE and no frames."""
    report = capability_report(cut_in_frames(cases, duration_s, fps))
    out = cases.select("case_id").join(report, "case_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("INFEASIBLE")))

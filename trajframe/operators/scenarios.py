"""Scenarios as rows: their rules, and the resolver of all motions to states by frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions.runtime import number_tag
from trajframe.operators import maneuvers, motion, resolve
from trajframe.sources.folders import bounded, kept

c = F.col
#: What the tags of documents may be.
MANEUVERS = ("static", "straight", "following", "oncoming", "cut_in", "crossing", "left_turn", "right_turn")
ACTOR_TYPES = ("vehicle", "pedestrian", "cyclist", "unknown")
ROLES = ("adversary", "traffic", "background")
INTERPOLATIONS = ("linear", "smooth")
_ROW = "array<struct<at:string,rule:string>>"


def _rules(at: Column, rules: dict[str, Column]) -> Column:
    """Array of (at, rule) of the rules whose condition is true; null counts as kept."""
    return F.filter(F.array(*[F.when(bad, F.struct(at.alias("at"), F.lit(rule).alias("rule"))) for rule, bad in rules.items()]), lambda r: r.isNotNull())


def _among(value: Column, known: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(*known), F.lit(False))


def _motion_rules(m: Column, at: Column) -> Column:
    """Rules of one motion, whatever its kind."""
    man, path, keys = m["maneuver"], m["path"], m["keyframes"]
    missing = lambda v: v.isNull()
    of = lambda tag, rules: F.when(m["mode"] == tag, _rules(at, rules)).otherwise(F.array().cast(_ROW))
    times = F.transform(keys["keyframes"], lambda k: k["t_s"])
    ordered = F.zip_with(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a <= b)
    each = F.transform(keys["keyframes"], lambda k, i: _rules(F.concat(at, F.lit(".keyframes["), i.cast("string"), F.lit("]")), {"keyframe time is negative": k["t_s"] < 0, "keyframe field is missing": k["t_s"].isNull() | k["x_m"].isNull() | k["y_m"].isNull() | k["yaw_deg"].isNull()}))
    return F.concat(
        _rules(at, {"motion mode is unknown": _among(m["mode"], ("maneuver", "path", "keyframes"))}),
        of("maneuver", {"maneuver is unknown": _among(man["maneuver"], MANEUVERS), "speed is negative": man["speed_mps"] < 0, "start time is negative": man["start_time_s"] < 0, "motion duration is not positive": man["duration_s"] <= 0}),
        of("path", {"path has no waypoints": F.coalesce(F.size(path["waypoints"]), F.lit(0)) < 1, "target speed is not positive": missing(path["target_speed_mps"]) | (path["target_speed_mps"] <= 0), "interpolation is unknown": _among(path["interpolation"], INTERPOLATIONS)}),
        of("keyframes", {"there are no keyframes": F.coalesce(F.size(keys["keyframes"]), F.lit(0)) < 1, "keyframes are not ordered": F.exists(ordered, lambda ok: ~ok), "keyframe times repeat": F.size(F.array_distinct(times)) < F.size(times), "interpolation is unknown": _among(keys["interpolation"], INTERPOLATIONS)}),
        F.coalesce(F.flatten(each), F.array().cast(_ROW)),
    )


def _actor_rules(a: Column, at: Column, duration: Column) -> Column:
    life, size = a["lifecycle"], a["dimensions_m"]
    spawn, end = life["spawn_time_s"], life["despawn_time_s"]
    positive = lambda k: size.isNotNull() & (size[k].isNull() | (size[k] <= 0))
    own = _rules(at, {
        "actor_id is empty": F.coalesce(F.length(a["actor_id"]), F.lit(0)) < 1, "actor type is unknown": _among(a["actor_type"], ACTOR_TYPES), "role is unknown": _among(a["role"], ROLES),
        "length is not positive": positive("length_m"), "width is not positive": positive("width_m"), "height is not positive": positive("height_m"), "spawn position is missing": a["spawn"]["x_m"].isNull() | a["spawn"]["y_m"].isNull(),
        "spawn time is negative": spawn < 0, "despawn time is negative": end < 0, "despawn is not after spawn": end <= spawn, "spawn exceeds the duration": spawn > duration, "despawn exceeds the duration": end > duration,
    })
    keys = F.transform(F.coalesce(a["motion"]["keyframes"]["keyframes"], F.array().cast("array<struct<t_s:double,x_m:double,y_m:double,yaw_deg:double>>")), lambda k, i: _rules(F.concat(at, F.lit(".motion.keyframes["), i.cast("string"), F.lit("]")), {"keyframe before spawn": k["t_s"] < spawn, "keyframe after lifetime": k["t_s"] > F.coalesce(end, duration)}))
    return F.concat(own, _motion_rules(a["motion"], F.concat(at, F.lit(".motion"))), F.flatten(keys))


def scenario_violations(scenarios: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, rule): everything that a typed scenario breaks, with the path of where; a sound one has no row."""
    ids = F.concat(F.array("ego.actor_id"), F.transform("actors", lambda a: a["actor_id"]))
    top = _rules(F.lit("scenario"), {
        "scenario_id is empty": F.coalesce(F.length("scenario_id"), F.lit(0)) < 1, "duration is not positive": c("duration_s").isNull() | (c("duration_s") <= 0), "fps is not positive": c("fps").isNull() | (c("fps") <= 0),
        "actor ids repeat": F.size(F.array_distinct(ids)) < F.size(ids),
    })
    camera = _rules(F.lit("camera"), {"image width is not positive": c("camera.image_width") <= 0, "image height is not positive": c("camera.image_height") <= 0, "field of view is outside 0 to 180": (c("camera.fov_deg") <= 0) | (c("camera.fov_deg") >= 180)})
    actors = F.transform("actors", lambda a, i: _actor_rules(a, F.concat(F.lit("actors["), i.cast("string"), F.lit("]")), c("duration_s")))
    found = F.concat(top, camera, _motion_rules(c("ego.motion"), F.lit("ego.motion")), F.flatten(actors))
    return scenarios.select(*key, F.explode(found).alias("v")).select(*key, "v.at", "v.rule")


def case_rules() -> dict[str, Column]:
    """Rules of a benchmark case's parameters (columns of the same names): the condition is true where one is broken."""
    turns = c("scenario_type").isin("cut_in", "crossing")
    return {
        "start distance is negative": c("start_distance_m") < 0, "lane width is not positive": c("lane_width_m") <= 0, "actor speed is negative": c("actor_speed_mps") < 0, "ego speed is negative": c("ego_speed_mps") < 0,
        "duration is not positive": c("duration_s") <= 0, "fps is not positive": c("fps") <= 0, "cut start is negative": c("cut_start_s") < 0, "cut duration is not positive": c("cut_duration_s") <= 0,
        "side is required": turns & c("side").isNull(), "side is unknown": c("side").isNotNull() & ~c("side").isin("left", "right"),
        "cut ends after the scenario": (c("scenario_type") == "cut_in") & (c("cut_start_s") + c("cut_duration_s") > c("duration_s")),
    }


def factor_violations(specs: DataFrame, key: list[str], factors: list[str]) -> DataFrame:
    """(key, rule): factors of a sweep (array columns) that are given but empty, and types that need a side and have none."""
    rules = {f"factor {f} is empty": F.size(f) == 0 for f in factors}
    has_side = c("side").isNotNull() | (F.coalesce(F.size("sides"), F.lit(0)) > 0) if "sides" in factors else c("side").isNotNull()
    rules["side is required"] = c("scenario_type").isin("cut_in", "crossing") & ~has_side
    broken = F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()])
    return specs.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def path_points(actors: DataFrame, key: str, pieces: int = 40, least: float = 1e-9) -> DataFrame:
    """(key, i, x, y): the spawn and the waypoints without repeats, as they are or on the monotone cubic over their arc length."""
    rows = actors.select(key, "interpolation", F.posexplode(F.concat(F.array(F.struct(c("x0").alias("x_m"), c("y0").alias("y_m"))), "waypoints")).alias("i", "p"))
    rows = motion.arc_length(rows.select(key, "interpolation", c("i").cast("double").alias("i"), c("p.x_m").alias("x"), c("p.y_m").alias("y")), [key], "i", least)
    smooth = rows.where("interpolation = 'smooth'")
    along = [resolve.densified(smooth.select(key, c("arc").alias("at"), v), [key], "at", v, pieces) for v in ("x", "y")]
    n = Window.partitionBy(key).orderBy("at")
    x, y = (d.withColumn("i", (F.row_number().over(n) - 1).cast("double")) for d in along)
    curved = x.select(key, "i", "x").join(y.select(key, "i", "y"), [key, "i"])
    return rows.where("interpolation <> 'smooth'").select(key, "i", "x", "y").unionByName(curved)


def resolve_scenarios(actors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, outcome) of actors as :func:`trajframe.sources.scenarios.scenario_actors` gives them.

    frames: (scenario_id, actor_id, is_ego, frame, t_s, x, y, yaw, speed_mps, vx, vy) for every frame at which an actor is
    alive, velocities from positions. outcome: a row an actor with its number of frames and the error for which it has
    none (null if it has been resolved), so that no actor disappears. Repeated actors of a scenario are one error.
    """
    who = F.struct("scenario_id", "actor_id")
    rows = actors.select(who.alias("who"), "*")
    known = F.coalesce(c("motion.mode").isin("maneuver", "path", "keyframes"), F.lit(False))
    sound = c("fps").isNotNull() & (c("fps") > 0) & c("duration_s").isNotNull() & (c("duration_s") > 0)
    man = c("motion.maneuver.maneuver")
    early = F.when(~F.coalesce(sound, F.lit(False)), "no frames: duration or fps").when(c("x0").isNull() | c("y0").isNull(), "no spawn").when(~known, F.concat(F.lit("unknown motion: "), F.coalesce("motion.mode", F.lit("none"))))
    early = early.when((c("motion.mode") == "maneuver") & ~F.coalesce(man.isin("static", "straight", "following", "oncoming"), F.lit(False)), F.concat(F.lit("unresolved maneuver: "), F.coalesce(man, F.lit("none"))))
    early = early.when((c("motion.mode") == "path") & (c("motion.path.target_speed_mps").isNull() | (c("motion.path.target_speed_mps") <= 0)), "no target speed")
    rows = kept(rows.withColumn("early", early), "scenario-actors")
    # Only ids that repeat come back to the rows, and there are few if any: no actor's motion is shuffled.
    repeats = kept(rows.groupBy(c("who").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "scenario-repeats")
    keys, spawn = _keys(c("motion.keyframes.keyframes")), F.struct(c("spawn_s").alias("t_s"), F.lit(-1).alias("n"), c("x0").alias("x"), c("y0").alias("y"), c("yaw0").alias("yaw"))
    fault = F.when(c("motion.mode") == "keyframes", F.concat(F.lit("keyframes: "), maneuvers.first_key_rule(F.get(keys, F.lit(0)), c("spawn_s"), c("x0"), c("y0"), c("yaw0"))))
    fault = fault.when((c("motion.mode") == "path") & ~_moves(c("x0"), c("y0"), c("motion.path.waypoints")), "path has less than two points")
    rows = rows.join(repeats, c("who") == c("of"), "left").withColumn("error", F.when(c("n").isNotNull(), "actor_id repeats").otherwise(F.coalesce("early", fault))).drop("of", "n", "early")

    last = F.bround(c("duration_s") * c("fps")).cast("long")
    sound_rows = rows.where("error is null").withColumn("last", last)
    by_mode = lambda m: sound_rows.where(c("motion.mode") == m)
    # Each piece of a motion gives its own frames, so that times meet no table: their number is all that grows.
    timed = lambda pieces, frames: pieces.withColumn("frame", F.explode(frames)).withColumn("t_s", c("frame") / c("fps")).where(resolve.alive(c("t_s"), c("spawn_s"), c("end_s")))
    state = ["who", "is_ego", "fps", "frame", "t_s", "x", "y", "yaw"]
    m = "motion.maneuver"
    scripted = timed(by_mode("maneuver"), F.sequence(F.lit(0).cast("long"), c("last")))
    scripted = resolve.maneuver_states(scripted.select("who", "is_ego", "fps", "frame", "t_s", "x0", "y0", "yaw0", c(f"{m}.maneuver").alias("maneuver"), c(f"{m}.start_time_s").alias("start_s"), c(f"{m}.duration_s").alias("duration_s"), c(f"{m}.speed_mps").alias("speed"))).select(*state)

    full = F.when(F.get(keys, F.lit(0))["t_s"] > c("spawn_s") + 1e-9, F.concat(F.array(spawn), keys)).otherwise(keys)
    keyed = by_mode("keyframes").select("who", "is_ego", "fps", "last", "spawn_s", "end_s", (c("motion.keyframes.interpolation") == "smooth").alias("smooth"), full.alias("keys"))
    ahead = lambda i: F.get("keys", i + 1)
    piece = lambda k, i: F.struct(*[k[n].alias(n) for n in ("t_s", "x", "y", "yaw")], (i == 0).alias("opens"), *[ahead(i)[n].alias(f"{n}1") for n in ("t_s", "x", "y", "yaw")])
    keyed = keyed.withColumn("p", F.explode(F.transform("keys", piece))).drop("keys")
    p, t = c("p"), c("t_s")
    keyed = timed(keyed, resolve.frames_between(F.when(~p["opens"], p["t_s"]), p["t_s1"], c("last"), c("fps"))).where((p["opens"] | (t >= p["t_s"])) & (p["t_s1"].isNull() | (t < p["t_s1"])))
    between = maneuvers.between_keys(t, p, c("smooth"))
    keyed = keyed.select("who", "is_ego", "fps", "frame", "t_s", *[between[n].alias(n) for n in ("x", "y", "yaw")])

    # The key carries what a path's frames need, so that its pieces meet no table either.
    ask = F.struct("who", "is_ego", "fps", "last", "spawn_s", "end_s", c("motion.path.target_speed_mps").alias("speed"))
    pathed = by_mode("path").select(ask.alias("ask"), "x0", "y0", "motion.path.waypoints", "motion.path.interpolation")
    pathed = resolve.path_segments(path_points(pathed, "ask"), "ask").select("ask.*", "s")
    s, since = c("s"), lambda arc: c("spawn_s") + arc / c("speed")
    pathed = timed(pathed, resolve.frames_between(since(s["arc"]), since(s["next"]), c("last"), c("fps"))).withColumn("distance", c("speed") * F.greatest(t - c("spawn_s"), F.lit(0.0)))
    along = resolve.along_segment(c("distance"), s)
    pathed = pathed.where((c("distance") >= s["arc"]) & (s["next"].isNull() | (c("distance") < s["next"]))).select("who", "is_ego", "fps", "frame", "t_s", *[along[n].alias(n) for n in ("x", "y", "yaw")])

    most = sound_rows.agg(F.sum(c("last") + 1)).first()[0] or 0  # one number
    states = bounded(scripted.unionByName(keyed).unionByName(pathed), most, "who")
    states = kept(motion.velocities(states, ["who"], fps=c("fps")), "scenario-states")
    frames = states.select("who.scenario_id", "who.actor_id", "is_ego", "frame", "t_s", "x", "y", "yaw", "speed_mps", "vx", "vy")
    counted = states.groupBy(c("who").alias("of")).agg(F.count(F.lit(1)).alias("frames"))
    outcome = rows.join(counted, c("who") == c("of"), "left").select("scenario_id", "actor_id", "is_ego", F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), F.coalesce("error", F.when(c("frames").isNull(), F.lit("never alive at a frame"))).alias("error"))
    return frames, outcome


def _keys(keys: Column) -> Column:
    """Array of (t_s, n, x, y, yaw) of keyframes with a time, in order of time and place."""
    named = F.transform(keys, lambda k, i: F.struct(k["t_s"].alias("t_s"), i.alias("n"), k["x_m"].alias("x"), k["y_m"].alias("y"), k["yaw_deg"].alias("yaw")))
    return F.array_sort(F.filter(named, lambda k: k["t_s"].isNotNull()))


def _moves(x: Column, y: Column, waypoints: Column, least: float = 1e-9) -> Column:
    """Whether a path has a second point, as :func:`path_points` drops repeats."""
    points = F.concat(F.array(F.struct(x.alias("x_m"), y.alias("y_m"))), waypoints)
    steps = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(F.hypot(b["x_m"] - a["x_m"], b["y_m"] - a["y_m"]).alias("step")))
    far = F.exists(F.slice(steps, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda s: s["step"].isNull() | (s["step"] > least))
    return F.coalesce(far, F.lit(False))


# From requests

#: What a request leaves out, for every type, and for the types whose own constructors differ.
REQUEST_DEFAULTS = {"start_distance_m": 30.0, "lane_y_m": 0.0, "target_lane_y_m": 0.0, "lane_width_m": 3.5, "actor_speed_mps": 4.0, "ego_speed_mps": 5.0, "duration_s": 8.0, "fps": 30.0, "cut_start_s": 1.5, "cut_duration_s": 3.0}
TYPE_DEFAULTS = {
    "static": {},
    "oncoming": {"start_distance_m": 55.0, "lane_y_m": -3.5, "actor_speed_mps": 8.0},
    "following": {"start_distance_m": 25.0},
    "cut_in": {"start_distance_m": 28.0, "side": "right"},
    "crossing": {"start_distance_m": 25.0, "actor_speed_mps": 3.0, "side": "right"},
}


def default_table(requests: DataFrame, by_type: bool) -> DataFrame:
    """(of_type, d_side, d_...): the defaults of each scenario type, five rows."""
    names = list(REQUEST_DEFAULTS)
    rows = [(t, own.get("side") if by_type else None, *[float(own.get(n, v) if by_type else v) for n, v in REQUEST_DEFAULTS.items()]) for t, own in TYPE_DEFAULTS.items()]
    return requests.sparkSession.createDataFrame(rows, "of_type string, d_side string, " + ", ".join(f"d_{n} double" for n in names))


def scenarios_of_requests(requests: DataFrame, key: list[str], by_type: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenarios, errors) of requests (key, scenario_type, scenario_id, side, and the names of REQUEST_DEFAULTS; all may be null).

    What a request leaves out comes from a joined table of defaults, the request's own or, ``by_type``, those of the
    type's constructor; ``defaulted`` names what did. A request that breaks a rule is a row of errors for each rule, and
    no scenario: no request is in neither.
    """
    names = list(REQUEST_DEFAULTS)
    met = requests.join(F.broadcast(default_table(requests, by_type)), c("scenario_type") == c("of_type"), "left")  # five rows
    left_out = F.array(*[F.when(c(n).isNull(), F.lit(n)) for n in names], F.when(c("side").isNull() & c("d_side").isNotNull(), F.lit("side")))
    # A type without a row of defaults keeps what it gave; its type is the error.
    rows = met.select(*key, "scenario_type", "scenario_id", F.coalesce("side", "d_side").alias("side"), *[F.coalesce(c(n).cast("double"), c(f"d_{n}")).alias(n) for n in names], F.array_join(F.filter(left_out, lambda n: n.isNotNull()), ",").alias("defaulted"), c("of_type").isNotNull().alias("known"))
    rules = {"scenario type is unknown": ~c("known"), "start distance is not positive": c("start_distance_m") <= 0} | {k: v for k, v in case_rules().items() if k != "start distance is negative"}
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]), lambda r: r.isNotNull())
    rows = rows.withColumn("broken", broken)
    errors = rows.select(*key, F.explode("broken").alias("rule"))
    kind, side, turns = c("scenario_type"), c("side"), c("scenario_type").isin("cut_in", "crossing")
    still = F.when(kind == "static", F.lit(0.0)).otherwise(c("actor_speed_mps"))
    to_side = F.when(side == "left", c("lane_width_m")).otherwise(-c("lane_width_m"))
    name = F.concat_ws("_", kind, F.when(turns, side), F.concat(F.lit("d"), number_tag(c("start_distance_m"))), F.concat(F.lit("v"), number_tag(still)), F.lit("v1"))
    only = lambda when, value: F.when(when, value)
    out = rows.where(F.size("broken") == 0).select(
        *key, F.coalesce("scenario_id", name).alias("scenario_id"), kind.alias("maneuver"), only(turns, side).alias("side"), "duration_s", c("fps").cast("int").alias("fps"), "ego_speed_mps",
        c("start_distance_m").alias("x0"), F.when(kind == "cut_in", to_side).when(kind == "crossing", 2.0 * to_side).otherwise(c("lane_y_m")).alias("y0"),
        F.when(kind == "oncoming", 180.0).when((kind == "crossing") & (side == "right"), 270.0).when(kind == "crossing", 90.0).otherwise(0.0).alias("yaw0"), still.alias("speed"),
        F.when(kind == "cut_in", c("target_lane_y_m")).when(kind == "oncoming", c("lane_y_m")).alias("target_y"), only(kind == "crossing", c("start_distance_m")).alias("target_x"),
        only(kind == "crossing", F.when(side == "right", -1.0).otherwise(1.0)).alias("direction"), only(kind == "cut_in", c("cut_start_s")).alias("cut_start_s"), only(kind == "cut_in", c("cut_duration_s")).alias("cut_s"), "defaulted",
    )
    return out, errors

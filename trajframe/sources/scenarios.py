"""Scenario documents: read by explicit schema into typed columns, written, and resolved documents beside them.

A motion is a tagged union. The reader takes all fields any kind of motion may have, and gives a struct for each kind,
of which the one that the tag names is set and the others are null. A document that cannot be parsed, or a motion with
an unknown tag, is a row of :func:`scenario_faults` and never vanishes silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajframe.sources.folders import bounded

c = F.col
POINT = "struct<x_m:double,y_m:double>"
POSE2 = "struct<x_m:double,y_m:double,yaw_deg:double>"
KEY = "struct<t_s:double,x_m:double,y_m:double,yaw_deg:double>"
MOTION = f"struct<mode:string,maneuver:string,speed_mps:double,target_y_m:double,start_time_s:double,duration_s:double,waypoints:array<{POINT}>,target_speed_mps:double,interpolation:string,keyframes:array<{KEY}>>"
ACTOR = f"struct<actor_id:string,actor_type:string,role:string,asset_key:string,dimensions_m:struct<length_m:double,width_m:double,height_m:double>,spawn:{POSE2},lifecycle:struct<spawn_time_s:double,despawn_time_s:double>,motion:{MOTION}>"
CAMERA = "struct<image_width:int,image_height:int,fov_deg:double,x_m:double,y_m:double,z_m:double,pitch_deg:double,yaw_deg:double,roll_deg:double>"
SCENARIO = f"schema_version string, scenario_id string, description string, duration_s double, fps int, seed long, ego struct<actor_id:string,spawn:{POSE2},motion:{MOTION}>, actors array<{ACTOR}>, camera {CAMERA}"
EGO_FRAME = "struct<frame_idx:long,t_s:double,x_m:double,y_m:double,yaw_deg:double,speed_mps:double,vx_mps:double,vy_mps:double>"
ACTOR_FRAME = EGO_FRAME.replace("t_s:double", "t_s:double,actor_id:string")
ACTOR_INFO = "struct<actor_id:string,actor_type:string,role:string,asset_key:string,dimensions_m:struct<length_m:double,width_m:double,height_m:double>,spawn_time_s:double,despawn_time_s:double>"
RESOLVED = f"scenario_id string, source_description string, duration_s double, fps int, seed long, camera {CAMERA}, actors array<{ACTOR_INFO}>, ego_frames array<{EGO_FRAME}>, actor_frames array<{ACTOR_FRAME}>"
MODES = ("maneuver", "path", "keyframes")
#: A camera's fields where a document leaves them out.
CAMERA_DEFAULTS = {"image_width": 1280, "image_height": 720, "fov_deg": 90.0, "x_m": 1.5, "y_m": 0.0, "z_m": 1.6, "pitch_deg": 0.0, "yaw_deg": 0.0, "roll_deg": 0.0}


def read_documents(spark: SparkSession, path: str, schema: str = SCENARIO, lines: bool = False) -> DataFrame:
    """Documents as they are, with ``path`` and the text of those that cannot be parsed: a file each, or a line each."""
    raw = spark.read.schema(f"{schema}, unparsed string").option("columnNameOfCorruptRecord", "unparsed").option("multiLine", not lines).json(path)
    return raw.select(c("_metadata.file_path").alias("path"), "*")


def _motion(m: Column) -> Column:
    mode = m["mode"]
    maneuver = F.struct(m["maneuver"].alias("maneuver"), F.coalesce(m["speed_mps"], F.lit(0.0)).alias("speed_mps"), m["target_y_m"].alias("target_y_m"), F.coalesce(m["start_time_s"], F.lit(0.0)).alias("start_time_s"), m["duration_s"].alias("duration_s"))
    path = F.struct(m["waypoints"].alias("waypoints"), m["target_speed_mps"].alias("target_speed_mps"), F.coalesce(m["interpolation"], F.lit("smooth")).alias("interpolation"))
    keys = F.struct(m["keyframes"].alias("keyframes"), F.coalesce(m["interpolation"], F.lit("linear")).alias("interpolation"))
    return F.struct(mode.alias("mode"), F.when(mode == "maneuver", maneuver).alias("maneuver"), F.when(mode == "path", path).alias("path"), F.when(mode == "keyframes", keys).alias("keyframes"))


def _spawn(s: Column, default: float | None = None) -> Column:
    at = lambda k: F.coalesce(s[k], F.lit(default)) if default is not None else s[k]
    return F.struct(at("x_m").alias("x_m"), at("y_m").alias("y_m"), F.coalesce(s["yaw_deg"], F.lit(0.0)).alias("yaw_deg"))


def typed_scenarios(raw: DataFrame) -> DataFrame:
    """Parsed documents with defaults filled in: (path, scenario_id, description, duration_s, fps, seed, camera, ego, actors)."""
    ego = c("ego")
    camera = F.struct(*[F.coalesce(c("camera")[k], F.lit(v)).alias(k) for k, v in CAMERA_DEFAULTS.items()])
    actor = lambda a: F.struct(
        a["actor_id"].alias("actor_id"), F.coalesce(a["actor_type"], F.lit("vehicle")).alias("actor_type"), F.coalesce(a["role"], F.lit("adversary")).alias("role"), a["asset_key"].alias("asset_key"), a["dimensions_m"].alias("dimensions_m"),
        _spawn(a["spawn"]).alias("spawn"), F.struct(F.coalesce(a["lifecycle"]["spawn_time_s"], F.lit(0.0)).alias("spawn_time_s"), a["lifecycle"]["despawn_time_s"].alias("despawn_time_s")).alias("lifecycle"), _motion(a["motion"]).alias("motion"),
    )
    return raw.where("unparsed is null").select(
        "path", "scenario_id", "description", "duration_s", "fps", F.coalesce("seed", F.lit(0)).alias("seed"), camera.alias("camera"),
        F.struct(F.coalesce(ego["actor_id"], F.lit("ego")).alias("actor_id"), _spawn(ego["spawn"], 0.0).alias("spawn"), _motion(ego["motion"]).alias("motion")).alias("ego"),
        F.transform(F.coalesce("actors", F.array().cast(f"array<{ACTOR}>")), actor).alias("actors"),
    )


def read_scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return typed_scenarios(read_documents(spark, path, SCENARIO, lines))


def scenario_faults(raw: DataFrame) -> DataFrame:
    """(path, scenario_id, actor_id, fault): documents that cannot be parsed, and motions without or with an unknown tag."""
    known = lambda m: F.coalesce(m["mode"].isin(*MODES), F.lit(False))
    tag = lambda m: F.concat(F.lit("unknown motion: "), F.coalesce(m["mode"], F.lit("none")))
    row = lambda who, fault: F.struct(who.alias("actor_id"), fault.alias("fault"))
    broken = F.when(c("unparsed").isNotNull(), F.array(row(F.lit(None).cast("string"), F.lit("unreadable document"))))
    ego = F.when(known(c("ego.motion")), F.array().cast("array<struct<actor_id:string,fault:string>>")).otherwise(F.array(row(F.coalesce("ego.actor_id", F.lit("ego")), tag(c("ego.motion")))))
    others = F.transform(F.filter(F.coalesce("actors", F.array().cast(f"array<{ACTOR}>")), lambda a: ~known(a["motion"])), lambda a: row(a["actor_id"], tag(a["motion"])))
    return raw.select("path", "scenario_id", F.explode(F.coalesce(broken, F.concat(ego, others))).alias("f")).select("path", "scenario_id", "f.actor_id", "f.fault")


def scenario_actors(scenarios: DataFrame) -> DataFrame:
    """One row an actor, the ego included: (scenario_id, actor_id, is_ego, fps, duration_s, x0, y0, yaw0, spawn_s, end_s, motion, info)."""
    info = "actor_type:string,role:string,asset_key:string,dimensions_m:struct<length_m:double,width_m:double,height_m:double>"
    ego = F.struct(c("ego.actor_id").alias("actor_id"), F.lit(True).alias("is_ego"), c("ego.spawn").alias("spawn"), F.lit(0.0).alias("spawn_s"), F.lit(None).cast("double").alias("end_s"), c("ego.motion").alias("motion"), F.lit(None).cast(f"struct<{info}>").alias("info"))
    other = lambda a: F.struct(a["actor_id"].alias("actor_id"), F.lit(False).alias("is_ego"), a["spawn"].alias("spawn"), a["lifecycle"]["spawn_time_s"].alias("spawn_s"), a["lifecycle"]["despawn_time_s"].alias("end_s"), a["motion"].alias("motion"), F.struct(*[a[k].alias(k) for k in ("actor_type", "role", "asset_key", "dimensions_m")]).alias("info"))
    rows = scenarios.select("scenario_id", "fps", "duration_s", F.explode(F.concat(F.array(ego), F.transform("actors", other))).alias("a"))
    return rows.select("scenario_id", "a.actor_id", "a.is_ego", "fps", "duration_s", c("a.spawn.x_m").alias("x0"), c("a.spawn.y_m").alias("y0"), c("a.spawn.yaw_deg").alias("yaw0"), "a.spawn_s", F.coalesce("a.end_s", "duration_s").alias("end_s"), "a.motion", "a.info")


def write_documents(rows: DataFrame, path: str) -> None:
    """A document a line; null fields are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def resolved_documents(scenarios: DataFrame, frames: DataFrame) -> DataFrame:
    """Resolved documents from scenarios and their frames (scenario_id, actor_id, is_ego, frame, t_s, x, y, yaw, speed_mps, vx, vy).

    A document holds its scenario's frames in order, so its size is bounded by the scenario's length; a task makes the
    documents of a bounded number of frames.
    """
    named = lambda *first: F.struct(c("frame").alias("frame_idx"), "t_s", *first, c("x").alias("x_m"), c("y").alias("y_m"), c("yaw").alias("yaw_deg"), "speed_mps", c("vx").alias("vx_mps"), c("vy").alias("vy_mps"))
    docs = bounded(frames, frames.count(), "scenario_id").groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.when(c("is_ego"), named()))).alias("ego_frames"), F.array_sort(F.collect_list(F.when(~c("is_ego"), named("actor_id")))).alias("actor_frames"))
    info = F.transform("actors", lambda a: F.struct(a["actor_id"].alias("actor_id"), a["actor_type"].alias("actor_type"), a["role"].alias("role"), a["asset_key"].alias("asset_key"), a["dimensions_m"].alias("dimensions_m"), a["lifecycle"]["spawn_time_s"].alias("spawn_time_s"), a["lifecycle"]["despawn_time_s"].alias("despawn_time_s")))
    none = lambda k: F.array().cast(f"array<{k}>")
    return scenarios.select("scenario_id", c("description").alias("source_description"), "duration_s", "fps", "seed", "camera", info.alias("actors")).join(docs, "scenario_id", "left").select(
        "scenario_id", "source_description", "duration_s", "fps", "seed", "camera", "actors", F.coalesce("ego_frames", none(EGO_FRAME)).alias("ego_frames"), F.coalesce("actor_frames", none(ACTOR_FRAME)).alias("actor_frames"))


def resolved_frames(documents: DataFrame) -> DataFrame:
    """(scenario_id, actor_id, is_ego, frame, t_s, x, y, yaw, speed_mps, vx, vy) of read resolved documents; the ego has no actor_id."""
    plain = lambda f, who, ego: F.struct(who.alias("actor_id"), F.lit(ego).alias("is_ego"), f["frame_idx"].alias("frame"), f["t_s"].alias("t_s"), f["x_m"].alias("x"), f["y_m"].alias("y"), f["yaw_deg"].alias("yaw"), f["speed_mps"].alias("speed_mps"), f["vx_mps"].alias("vx"), f["vy_mps"].alias("vy"))
    both = F.concat(F.transform("ego_frames", lambda f: plain(f, F.lit(None).cast("string"), True)), F.transform("actor_frames", lambda f: plain(f, f["actor_id"], False)))
    return documents.where("unparsed is null").select("scenario_id", F.explode(both).alias("f")).select("scenario_id", "f.*")


def actor_info_of_frames(documents: DataFrame) -> DataFrame:
    """Each actor frame of read resolved documents beside its actor's description; null where the document has none.

    A document holds both, so that no frame is shuffled.
    """
    both = documents.where("unparsed is null").select("scenario_id", "actors", F.explode("actor_frames").alias("d"))
    described = F.filter(F.coalesce("actors", F.array().cast(f"array<{ACTOR_INFO}>")), lambda a: a["actor_id"] == c("d.actor_id"))
    rows = both.select("scenario_id", "d", F.explode_outer(described).alias("i"))
    frame = {"actor_id": "actor_id", "is_ego": None, "frame": "frame_idx", "t_s": "t_s", "x": "x_m", "y": "y_m", "yaw": "yaw_deg", "speed_mps": "speed_mps", "vx": "vx_mps", "vy": "vy_mps"}
    info = ("actor_type", "role", "asset_key", "dimensions_m", "spawn_time_s", "despawn_time_s")
    return rows.select("scenario_id", *[(c("d")[v] if v else F.lit(False)).alias(k) for k, v in frame.items()], *[c("i")[k].alias(k) for k in info])

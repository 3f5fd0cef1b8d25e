"""Readers and writers of frame logs, labels, results and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajframe.functions.angles import finite, wrap360

c = F.col
TRANSFORM = "struct<x:double,y:double,z:double,pitch:double,yaw:double,roll:double>"
POSE = f"recorded_frame_idx long, t_s double, ego_transform {TRANSFORM}, camera_transform {TRANSFORM}, ego_speed_mps double"
BOX = "struct<visible:boolean,reason:string,x1:double,y1:double,x2:double,y2:double,cx:double,bottom_y:double,box_width:double,box_height:double,depth_m:double,z_m:double>"
STATE = "struct<x_m:double,y_m:double,z_m:double,yaw_deg:double>"
REAL = f"recorded_frame_idx long, t_s double, actors array<struct<actor_id:string,planned_state:{STATE},bbox:{BOX}>>"
SYNTH = f"scenario_id string, frames array<struct<frame_idx:long,adversaries:array<struct<id:string,rendered:boolean,state:{STATE},box:{BOX}>>>>"
RELATIVE = "struct<rel_x:double,rel_z:double,rel_y:double,rel_yaw:double>"
TARGET = "struct<visible:boolean,center_x:double,bottom_y:double,box_width:double,box_height:double>"
LABEL = f"sample_id long, requested_camera_relative_state {RELATIVE}, requested_ego_relative_state {RELATIVE}, relative_state {RELATIVE}, target {TARGET}"
#: How result files write a missing number.
NULL_WORDS = ("", "none", "null", "nan", "n/a", "na")


def last_of_lines(spark: SparkSession, path: str, schema: str, of: str, key: list[str] | None = None, log: list[str] | None = None) -> DataFrame:
    """(key, path, row): of the JSON lines of each file that repeat the field ``of`` the last one holds.

    A line's place is its file, where its part of the file begins, and its order in that part; parts are read from
    front to back, so that the place orders a file's lines however it is cut. Blank lines and lines without the field
    are skipped. A file with nothing else is an error. ``key`` names partition columns of the folder to keep, ``log``
    fields of the lines that tell apart the logs that share a file.
    """
    lines = spark.read.text(path).select(*(key or []), c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth"), "value")
    rows = lines.where(F.trim("value") != "").select(*(key or []), "path", F.struct("part", "nth").alias("place"), F.from_json("value", schema).alias("row")).where(c(f"row.{of}").isNotNull())
    empty = empty_logs(spark, path, rows.select("path").distinct()).limit(5).collect()
    if empty:
        raise ValueError("logs without frames: " + ", ".join(r.path for r in empty))
    own = [c(f"row.{n}").alias(f"of_{n}") for n in (*(log or []), of)]
    return rows.groupBy(*(key or []), "path", *own).agg(F.max_by("row", "place").alias("row")).select(*(key or []), "path", "row")


def read_pose_log(spark: SparkSession, path: str, key: list[str] | None = None, log: str | None = None) -> DataFrame:
    """One row a frame of each file, as :func:`last_of_lines` settles repeats.

    ``log`` declares fields, as in a schema, by which lines name their log where a file holds many. Files without
    number cost more than their lines: short logs are better kept together.
    """
    names = [f.split()[0] for f in (log or "").split(",") if f.strip()]
    return last_of_lines(spark, path, f"{log}, {POSE}" if log else POSE, "recorded_frame_idx", key, names).select(*(key or []), "path", "row.*")


#: A line of a version 1 log: one actor, whose box lies beside the frame's number.
REAL_V1 = f"recorded_frame_idx long, bbox {BOX}"


def read_real_v1(spark: SparkSession, path: str, key: list[str] | None = None) -> DataFrame:
    """(key, frame, visible, cx, bottom, w, h, depth) of single-actor logs; a number that is missing is null."""
    rows = last_of_lines(spark, path, REAL_V1, "recorded_frame_idx", key)
    box = c("row.bbox")
    return rows.select(*(key or []), c("row.recorded_frame_idx").alias("frame"), F.coalesce(box["visible"], F.lit(False)).alias("visible"), *[finite(box[n]).alias(k) for k, n in (("cx", "cx"), ("bottom", "bottom_y"), ("w", "box_width"), ("h", "box_height"), ("depth", "depth_m"))])


def read_synth_v1(spark: SparkSession, path: str, key: list[str] | None = None) -> DataFrame:
    """(key, frame, visible, rendered, cx, bottom, w, h, depth) of a metadata document's first actor a frame; a frame without one is not visible.

    Of frames that repeat in a document the last one holds.
    """
    docs = spark.read.schema(SYNTH).option("multiLine", True).json(path)
    rows = docs.select(*(key or []), c("_metadata.file_path").alias("path"), F.posexplode("frames").alias("nth", "f")).where("f.frame_idx is not null")
    last = rows.groupBy(*(key or []), "path", c("f.frame_idx").alias("frame")).agg(F.max_by("f", "nth").alias("f"))
    first = F.get("f.adversaries", F.lit(0))
    box = first["box"]
    flag = lambda v: F.coalesce(v, F.lit(False))
    return last.select(*(key or []), "frame", flag(box["visible"]).alias("visible"), flag(first["rendered"]).alias("rendered"), *[finite(box[n]).alias(k) for k, n in (("cx", "cx"), ("bottom", "bottom_y"), ("w", "box_width"), ("h", "box_height"), ("depth", "z_m"))])


def empty_logs(spark: SparkSession, path: str, with_rows: DataFrame) -> DataFrame:
    """(path): files under ``path`` that ``with_rows`` does not name. The names are those of the read's own file index,
    which holds files without a byte too; scans pass these over."""
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "path string")
    same = lambda p: F.regexp_replace(p, "^[a-z]+:/+", "/")  # noqa: E731  file:/a and file:///a are one
    return files.join(with_rows.select(same(c("path")).alias("found")), same(c("path")) == c("found"), "left_anti")


def repeated_frames(log: DataFrame, key: str = "recorded_frame_idx") -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_real(spark: SparkSession, path: str) -> DataFrame:
    """(frame, actor_id, box..., depth, depth_source): one row an actor and frame; absence is no row."""
    rows = spark.read.schema(REAL).json(path).select(c("recorded_frame_idx").alias("frame"), F.explode("actors").alias("a"))
    measured = finite(c("a.bbox.depth_m"))
    return rows.select("frame", c("a.actor_id").alias("actor_id"), F.coalesce("a.bbox.visible", F.lit(False)).alias("visible"), c("a.bbox.cx").alias("cx"), c("a.bbox.bottom_y").alias("bottom"), c("a.bbox.box_width").alias("w"), c("a.bbox.box_height").alias("h"), F.coalesce(measured, finite(c("a.planned_state.z_m"))).alias("depth"), F.when(measured.isNotNull(), "bbox").otherwise("planned").alias("depth_source"))


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a metadata document; visible only what was also rendered."""
    rows = spark.read.schema(SYNTH).option("multiLine", True).json(path).select(F.explode("frames").alias("f")).select(c("f.frame_idx").alias("frame"), F.explode("f.adversaries").alias("a"))
    seen = F.coalesce(c("a.box.visible"), F.lit(False)) & F.coalesce(c("a.rendered"), F.lit(False))
    return rows.select("frame", c("a.id").alias("actor_id"), seen.alias("visible"), c("a.box.cx").alias("cx"), c("a.box.bottom_y").alias("bottom"), c("a.box.box_width").alias("w"), c("a.box.box_height").alias("h"), c("a.box.z_m").alias("depth"))


def read_labels_grid(spark: SparkSession, path: str) -> DataFrame:
    """Labels for grid building: the requested state where there is one, to six places, yaw in [0, 360)."""
    s = F.coalesce("requested_camera_relative_state", "requested_ego_relative_state", "relative_state")
    rows = spark.read.schema(LABEL).json(path).withColumn("s", s)
    return rows.select(F.round("s.rel_x", 6).alias("x"), F.round("s.rel_z", 6).alias("z"), wrap360(F.round("s.rel_yaw", 6)).alias("yaw"), F.coalesce("target.visible", F.lit(False)).alias("visible"), c("target.center_x").alias("cx"), c("target.bottom_y").alias("bottom"), c("target.box_width").alias("w"), c("target.box_height").alias("h"))


def read_labels_flat(spark: SparkSession, path: str) -> DataFrame:
    """Labels for validation: the measured state, sample_id -1 and invisible where they say nothing."""
    rows = spark.read.schema(LABEL).json(path)
    return rows.select(F.coalesce("sample_id", F.lit(-1)).alias("sample_id"), *[c(f"relative_state.rel_{k}").alias(f"rel_{k}") for k in ("x", "z", "yaw")], F.coalesce("target.visible", F.lit(False)).alias("visible"), *[c(f"target.{k}").alias(k) for k in ("center_x", "bottom_y", "box_width", "box_height")])


def number(text: Column) -> Column:
    """A result cell as a finite number; null words and what is no number are null."""
    return F.when(~F.lower(F.trim(text)).isin(*NULL_WORDS), finite(text.try_cast("double")))


def read_results_csv(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> DataFrame:
    """Numbers from a result file with a header: each column under the first alias there, whatever its case."""
    raw = spark.read.option("header", True).csv(path)
    have = {x.lower(): x for x in raw.columns}
    found = lambda names: F.coalesce(*[number(F.col(f"`{have[n.lower()]}`")) for n in names if n.lower() in have], F.lit(None).cast("double"))
    return raw.select(*[found(names).alias(k) for k, names in columns.items()])


def parse_reports(reports: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, metrics) from report texts (path, value): the last match of each pattern's first group, null if none."""
    last = lambda p: F.element_at(F.regexp_extract_all("value", F.lit(p), 1), -1).try_cast("double")
    return reports.select("path", *[F.when(F.regexp_count("value", F.lit(p)) > 0, last(p)).alias(k) for k, p in patterns.items()])


def read_newest(spark: SparkSession, glob: str, most: int) -> DataFrame:
    """(path, modified) of the newest files under a pattern, as run folders are listed."""
    files = spark.read.format("binaryFile").load(glob).select("path", c("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), "path").limit(most)


def file_manifest(spark: SparkSession, expected: DataFrame, glob: str) -> DataFrame:
    """(path, exists, sha256) for each expected path."""
    found = spark.read.format("binaryFile").load(glob).select(c("path").alias("found"), F.sha2("content", 256).alias("sha256"))
    return expected.join(found, c("path") == c("found"), "left").select("path", c("found").isNotNull().alias("exists"), "sha256")


def write_results_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns; numbers that are not finite stay empty."""
    kinds = dict(rows.dtypes)
    rows.select(*[finite(c(x)).alias(x) if kinds[x] in ("double", "float") else c(x) for x in columns]).write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(*[finite(c(k)).alias(k) if t in ("double", "float") else c(k) for k, t in rows.dtypes]).write.option("ignoreNullFields", False).json(path)


def write_grid(grid: DataFrame, path: str, axes: list[str] | None = None) -> None:
    """Cells in the order of their axes, and one row that describes them beside them."""
    axes = axes or ["zi", "xi", "yawi"]
    grid.repartitionByRange(*axes).sortWithinPartitions(*axes).write.parquet(f"{path}/cells")
    seen = F.count_if(c("visible") > 0) if dict(grid.dtypes)["visible"] != "boolean" else F.count_if("visible")
    grid.agg(F.count(F.lit(1)).alias("n"), seen.alias("n_visible"), *[F.count_distinct(a).alias(f"n_{a}") for a in axes]).write.parquet(f"{path}/metadata")


def read_grid_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/metadata")


#: A case of a manifest: its parameters by name, and which of them are swept.
CASE = "benchmark_id string, case_index long, case_id string, scenario_type string, parameters struct<side:string,start_distance_m:double,lane_y_m:double,target_lane_y_m:double,lane_width_m:double,actor_speed_mps:double,ego_speed_mps:double,duration_s:double,fps:int,cut_start_s:double,cut_duration_s:double>, swept_values map<string,string>"


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cases of manifests, one row each: documents that are a list of cases or have it under ``cases``, or a case a line.

    The schema is given, never inferred. A document that cannot be parsed, or has no case, gives no row.
    """
    names = spark.createDataFrame([], CASE).columns
    if lines:
        return spark.read.schema(CASE).json(path).where("case_id is not null")
    listed = f"array<struct<{spark.createDataFrame([], CASE).schema.simpleString()[7:-1]}>>"
    found = spark.read.schema(f"cases {listed}, {CASE}").option("multiLine", True).json(path)
    return found.select(F.explode(F.coalesce("cases", F.array(F.struct(*names)))).alias("x")).select("x.*").where("case_id is not null")


def write_box_labels(rows: DataFrame, path: str) -> None:
    """Training labels as CSV with a header; what is not finite is left empty."""
    rows.select(*[finite(c(k)).alias(k) if t in ("double", "float") else c(k) for k, t in rows.dtypes]).write.option("header", True).csv(path)


def read_box_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_by_case(rows: DataFrame, path: str) -> None:
    rows.repartition("case_id").write.partitionBy("case_id").parquet(path)


def keyframes_from_log(log: DataFrame, key: str = "run") -> DataFrame:
    """Adds t_s (frame / 30 where missing) and fps from the first two rows of each log, 30 where they coincide."""
    w = Window.partitionBy(key).orderBy("frame")
    rows = log.withColumn("t_s", F.coalesce("t_s", c("frame") / 30.0)).withColumn("n", F.row_number().over(w))
    whole = Window.partitionBy(key)
    dt = F.max(F.when(c("n") == 2, c("t_s"))).over(whole) - F.max(F.when(c("n") == 1, c("t_s"))).over(whole)
    return rows.withColumn("fps", F.when(dt > 1e-9, 1.0 / dt).otherwise(30.0)).drop("n")

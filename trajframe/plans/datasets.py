"""Training tables and evaluations put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.functions import boxes, rules
from trajframe.operators.frames import c

WIDTH, HEIGHT = 1280, 720


def box_dataset(real: DataFrame) -> DataFrame:
    """Normalised training boxes: valid before and after clipping, with frame progress and distance progress."""
    raw = boxes.corners(c("cx"), c("bottom"), c("w"), c("h"))
    cut = boxes.clipped(raw, WIDTH, HEIGHT)
    rows = real.where(c("visible") & boxes.valid(c("w"), c("h"))).select("*", *[v.alias(k) for k, v in cut.items()])
    rows = rows.where(boxes.valid(c("x2") - c("x1"), c("y2") - c("y1")))
    run = Window.partitionBy("case_id", "actor_id")
    first = F.min_by("depth", "frame").over(run)
    progress = F.least(F.greatest(1.0 - F.try_divide(c("depth"), first), F.lit(0.0)), F.lit(1.5))
    norm = boxes.normalised({k: c(k) for k in cut}, WIDTH, HEIGHT)
    share = F.coalesce(F.try_divide(c("frame").cast("double"), F.max("frame").over(run).cast("double")), F.lit(0.0))
    return rows.select("case_id", "actor_id", "frame", *[F.round(v, 6).alias(f"n_{k}") for k, v in norm.items()], F.round(share, 6).alias("frame_progress"), F.round(F.coalesce(progress, share), 6).alias("distance_progress"))


def exact_split(rows: DataFrame, id_col: str, share: float = 0.8, seed: str = "s1") -> DataFrame:
    """Adds part: exactly int(share x n) rows train, by the hash of seed and id.

    Ranks need no single sorted task: rows are counted by the hash's first byte, and ordered within it.
    """
    h = F.md5(F.concat(F.lit(seed), c(id_col).cast("string")).cast("binary"))
    rows = rows.withColumn("h", h).withColumn("bin", F.substring("h", 1, 2))
    bins = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    before = bins.select("bin", (F.sum("n").over(Window.orderBy("bin")) - c("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * share).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h", id_col))
    ranked = rows.withColumn("rank", rank).join(F.broadcast(before), "bin")  # at most 256 bins
    return ranked.withColumn("part", F.when(c("before") + c("rank") <= c("quota"), "train").otherwise("held")).drop("h", "bin", "rank", "before", "quota")


def bucket_errors(pairs: DataFrame, distance: Column, yaw: Column, errors: list[str]) -> DataFrame:
    """Errors over all, by distance bucket and by yaw bucket in one pass of grouping sets."""
    near = rules.binned(distance, [10.0, 20.0, 40.0], ["0-10", "10-20", "20-40", "40+"])
    turn = rules.binned(F.abs(yaw), [15.0, 45.0, 90.0], ["front", "slant", "side", "rear"])
    rows = pairs.withColumns({"distance_bin": near, "yaw_bin": turn})
    out = rows.groupingSets([[], [c("distance_bin")], [c("yaw_bin")]], c("distance_bin"), c("yaw_bin"))
    return out.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.abs(e)), 6).alias(f"mae_{e}") for e in errors])


def gallery(rows: DataFrame, key: list[str], error: str, ordinal: str, pick: int) -> DataFrame:
    """Up to ``pick`` rows a key to look at: a third each of the best, middle and worst by ``error``, with part and place.

    A row of a small key may be picked more than once.
    """
    col = F.col
    w = Window.partitionBy(*key)
    ranked = rows.withColumns({"r": F.row_number().over(w.orderBy(error, ordinal)) - 1, "n": F.count(F.lit(1)).over(w).cast("int")})
    ranked = ranked.withColumn("wanted", F.least(F.lit(pick), "n"))
    ranked = ranked.withColumn("third", F.greatest(F.lit(1), F.floor(col("wanted") / 3))).withColumn("mid", F.greatest(F.lit(0), F.floor(col("n") / 2) - F.floor(col("wanted") / 6)))
    starts = (("best", F.lit(0), 0), ("middle", col("mid"), 1), ("worst", col("n") - col("third"), 2))
    parts = F.array(*[F.when((col("r") >= at) & (col("r") < at + col("third")), F.struct(F.lit(name).alias("part"), (col("r") - at + k * col("third")).cast("long").alias("place"))) for name, at, k in starts])
    picked = ranked.withColumn("p", F.explode(F.filter(parts, lambda p: p.isNotNull())))
    return picked.where("p.place < wanted").select(*rows.columns, "p.part", "p.place")


def sampled_scenarios(ids: DataFrame, key: str, ranges: dict[str, tuple[float, float]], choices: dict[str, list[str]], seed: int = 1) -> DataFrame:
    """Adds uniform values and choices that depend on the seed, the column's name and the id only, not on partitions."""
    part = lambda name: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(name), c(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = {n: F.lit(float(lo)) + part(n) * float(hi - lo) for n, (lo, hi) in ranges.items()}
    picked = {n: F.get(F.array(*map(F.lit, of)), F.floor(part(n) * len(of)).cast("int")) for n, of in choices.items()}
    return ids.withColumns(drawn | picked)


def design_points(rows: DataFrame, axes: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """``rows`` with every point of the product of their axes (start, stop, step), ends included, to six places.

    A row's points are numbered and each number is taken apart into the axes' places, so that no product is joined.
    """
    sizes = {k: F.greatest(F.floor((stop - start + 1e-6) / step) + 1, F.lit(0)).cast("long") for k, (start, stop, step) in axes.items()}
    out = rows.withColumns({f"size_{k}": n for k, n in sizes.items()})
    total = F.lit(1).cast("long")
    for k in axes:
        total = total * c(f"size_{k}")
    out = out.withColumn("point", F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(F.array().cast("array<long>"))))
    place, points = c("point"), {}
    for k, (start, _, step) in reversed(axes.items()):  # the last axis runs fastest
        points[k] = F.round(start + F.pmod(place, c(f"size_{k}")) * step, 6)
        place = F.floor(place / c(f"size_{k}"))
    return out.withColumns({k: points[k] for k in axes}).drop("point", *[f"size_{k}" for k in axes])


def crop_samples(frames: DataFrame, run: str, preview_every: int = 25, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """What becomes of each frame of a run as a training crop: the reason it is skipped (null if saved), its crop and sample number.

    ``frames`` has the run, frame (null where a file's name holds none), x1, y1, x2, y2 (null without metadata), and
    has_metadata, has_rough, has_target. Samples are numbered in order of run and frame over all runs; every
    ``preview_every``-th has a preview.
    """
    from trajframe.operators.reports import sample_ids

    box = {k: c(k).cast("double") for k in ("x1", "y1", "x2", "y2")}
    crop = boxes.square_crop(box, width, height)
    whole = F.coalesce((c("x2") > c("x1")) & (c("y2") > c("y1")), F.lit(False))
    some = F.coalesce((crop["x2"] > crop["x1"]) & (crop["y2"] > crop["y1"]), F.lit(False))
    reason = F.when(c("frame").isNull(), "bad_name").when(~c("has_metadata"), "no_metadata").when(~whole, "invalid_box").when(~(c("has_rough") & c("has_target")), "missing_image").when(~some, "no_crop")
    rows = frames.withColumn("reason", reason).withColumns({f"crop_{k}": F.when(c("reason").isNull(), v) for k, v in crop.items()})
    saved = sample_ids(rows.where("reason is null"), run).drop("gallery").withColumn("preview", c("sample_id") % preview_every == 0)
    return saved.unionByName(rows.where("reason is not null"), allowMissingColumns=True)

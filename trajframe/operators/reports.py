"""Reports that join cases with what was run of them: synchrony, coverage, predicted boxes, label sets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajframe.functions.boxes import iou
from trajframe.operators.checks import described
from trajframe.sources.folders import kept

c = F.col


def pose_sync(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key: frames of one log only, worst difference a field and over all, first frame that disagrees, verdict.

    A field that one log alone lacks at a frame disagrees; one that both lack does not.
    """
    side = lambda df, s: df.select(*key, "frame", *[c(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(f"in_{s}"))
    both = side(a, "a").join(side(b, "b"), [*key, "frame"], "full_outer")
    off = {f: F.abs(c(f"a_{f}") - c(f"b_{f}")) for f in fields}
    worst = F.greatest(F.lit(0.0), *off.values())
    near = F.lit(True)
    for f, v in off.items():
        near = near & F.coalesce(v <= tolerance, c(f"a_{f}").isNull() & c(f"b_{f}").isNull())
    apart = c("in_a") & c("in_b") & ~near
    out = both.groupBy(*key).agg(F.count_if(c("in_b").isNull()).alias("only_a"), F.count_if(c("in_a").isNull()).alias("only_b"), *[F.max(v).alias(f"max_{f}") for f, v in off.items()], F.max(worst).alias("worst"), F.min(F.when(apart, c("frame"))).alias("first_mismatch"))
    return out.withColumn("verdict", F.when((c("only_a") == 0) & (c("only_b") == 0) & c("first_mismatch").isNull(), "PASS").otherwise("FAIL"))


def case_report(cases: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Each case beside its parts, with an ``error`` naming the first part it lacks; cases are never dropped."""
    out = cases
    for name, df in parts.items():
        out = out.join(df.withColumn(f"has_{name}", F.lit(True)), key, "left")
    error = F.coalesce(*[F.when(c(f"has_{n}").isNull(), F.lit(f"missing_{n}")) for n in parts])
    return out.withColumn("error", error).drop(*[f"has_{n}" for n in parts])


def run_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Selected, passed, failed and faulty cases of rows with ``passed`` and ``error``, and whether all passed.

    A case without an error whose ``passed`` is null has failed: every selected case is passed, failed or faulty.
    """
    ok, passed = c("error").isNull(), F.coalesce(c("passed"), F.lit(False))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("selected"), F.count_if(ok & passed).alias("passed"), F.count_if(ok & ~passed).alias("failed"), F.count_if(~ok).alias("errors"), F.bool_and(ok & passed).alias("all_passed"))


def gated(cases: DataFrame, statuses: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """The cases that are supported, whose invariants pass and whose two visibility policies agree.

    A runtime that says nothing uses 2.0; a plan has to say what it was made for.
    """
    agree = F.coalesce(F.abs(c("planned_depth") - F.coalesce("runtime_depth", F.lit(2.0))) <= tolerance, F.lit(False))
    return cases.join(statuses.where((c("status") == "SUPPORTED") & (c("verdict") == "PASS") & agree), key, "left_semi")


def predicted_boxes(predicted: DataFrame, real: DataFrame, key: list[str], ordinal: Column | None = None) -> DataFrame:
    """Each predicted box (cx, bottom, w, h, visible) with the real one's errors; without a real one or empty it is invalid.

    Of real rows that repeat a key the first by ``ordinal`` counts (by their own values, where none is given), so that a
    predicted box is one row. ``predicted_ok`` and ``real_ok`` tell which side is at fault.
    """
    parts = ("cx", "bottom", "w", "h", "visible")
    own = F.struct(*[c(x).alias(f"r_{x}") for x in parts])
    r = real.select(*key, own.alias("r"), (ordinal if ordinal is not None else own).alias("nth")).groupBy(*key).agg(F.min_by("r", "nth").alias("r")).select(*key, "r.*")
    rows = predicted.join(r, key, "left")
    whole = lambda p: F.coalesce(c(f"{p}visible") & (c(f"{p}w") > 0) & (c(f"{p}h") > 0), F.lit(False))
    ok = whole("") & whole("r_")
    corners = lambda p: {"x1": c(f"{p}cx") - c(f"{p}w") / 2.0, "y1": c(f"{p}bottom") - c(f"{p}h"), "x2": c(f"{p}cx") + c(f"{p}w") / 2.0, "y2": c(f"{p}bottom")}
    dx, dy = c("cx") - c("r_cx"), (c("bottom") - c("h") / 2.0) - (c("r_bottom") - c("r_h") / 2.0)
    least = lambda v: F.greatest(v, F.lit(1e-6))
    metrics = {
        "centre_error": F.hypot(dx, dy), "dx": dx, "dy": dy, "abs_dx": F.abs(dx), "abs_dy": F.abs(dy), "w_error": F.abs(c("w") - c("r_w")), "h_error": F.abs(c("h") - c("r_h")),
        "rel_w": F.abs(c("w") - c("r_w")) / least(c("r_w")), "rel_h": F.abs(c("h") - c("r_h")) / least(c("r_h")), "area_ratio": c("w") * c("h") / least(c("r_w") * c("r_h")),
        "iou": iou(corners(""), corners("r_")),
    }
    status = F.when(ok, "inserted_using_predicted_box").otherwise("invalid_predicted_box")
    return rows.select(*key, ok.alias("valid"), whole("").alias("predicted_ok"), whole("r_").alias("real_ok"), status.alias("status"), *[F.when(ok, v).alias(k) for k, v in metrics.items()])


#: The nine metrics of a box report.
BOX_METRICS = ("iou", "centre_error", "abs_dx", "abs_dy", "w_error", "h_error", "rel_w", "rel_h", "area_ratio")


def box_report(predicted: DataFrame, real: DataFrame, key: list[str], ordinal: Column | None = None) -> DataFrame:
    """A row a metric: count, mean, exact median, least and most over valid boxes, and beside them the totals.

    A frame may be invalid on both sides and counts on each. A metric without values has a row of nulls.
    """
    rows = kept(predicted_boxes(predicted, real, key, ordinal), "box-report")
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~c("predicted_ok")).alias("invalid_predicted"), F.count_if(~c("real_ok")).alias("invalid_real"))
    return described(rows, list(BOX_METRICS)).join(F.broadcast(totals), F.lit(True), "left")  # one row


def batch_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Visibility accuracy over all rows; errors, L1 weighted 1, 1, 2.5, 2.5 and overlap over rows that are really visible."""
    seen = c("real_visible")
    err = {p: F.abs(c(f"synth_{p}") - c(f"real_{p}")) for p in ("cx", "bottom", "w", "h")}
    corners = lambda s: {"x1": c(f"{s}_cx") - c(f"{s}_w") / 2.0, "y1": c(f"{s}_bottom") - c(f"{s}_h"), "x2": c(f"{s}_cx") + c(f"{s}_w") / 2.0, "y2": c(f"{s}_bottom")}
    weighted = (err["cx"] + err["bottom"] + 2.5 * err["w"] + 2.5 * err["h"]) / 4.0
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((seen == c("synth_visible")).cast("double")).alias("visibility_accuracy"), *[F.avg(F.when(seen, e)).alias(f"mae_{p}") for p, e in err.items()], F.avg(F.when(seen, weighted)).alias("weighted_l1"), F.avg(F.when(seen, iou(corners("real"), corners("synth")))).alias("mean_iou"))


def label_set(rows: DataFrame) -> DataFrame:
    """One row on a label set: sizes, visible share, axes, how many cells of their product are missing, ranges."""
    spans = [f(v).alias(f"{n}_{v}") for v in ("x", "z", "yaw", "w", "h") for n, f in (("least", F.min), ("most", F.max))]
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("n_visible"), *[F.count_distinct(v).alias(f"n_{v}") for v in ("x", "z", "yaw")], F.count_distinct("x", "z", "yaw").alias("cells"), *spans)
    return out.withColumns({"visible_share": F.try_divide(c("n_visible").cast("double"), c("n").cast("double")), "missing": c("n_x") * c("n_z") * c("n_yaw") - c("cells")})


def by_bin(rows: DataFrame, bin_: Column, values: list[str]) -> DataFrame:
    """Rows, visible ones, their share, and means of ``values`` over visible rows, by bin."""
    seen = c("visible")
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("n_visible"), F.avg(seen.cast("double")).alias("share"), *[F.avg(F.when(seen, c(v))).alias(f"mean_{v}") for v in values])


def run_stats(rows: DataFrame, by: list[str], reason: Column) -> DataFrame:
    """Saved and skipped rows and the reasons of skips with their counts."""
    each = rows.groupBy(*by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.coalesce(F.sum(F.when(c("reason") == "", c("n"))), F.lit(0)).alias("saved"), F.coalesce(F.sum(F.when(c("reason") != "", c("n"))), F.lit(0)).alias("skipped"), F.array_join(F.array_sort(F.collect_list(F.when(c("reason") != "", F.format_string("%s:%d", "reason", "n")))), ",").alias("reasons"))


def manifest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Frames of each actor, its first and last one, and whether all between are there."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")).withColumn("whole", c("n") == c("last") - c("first") + 1)


def duplicated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sample_ids(rows: DataFrame, run: str) -> DataFrame:
    """Adds sample_id from 0 in order of run and frame: runs are numbered apart and shifted by what is before them."""
    from pyspark.sql import Window

    sizes = rows.groupBy(run).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    shifts = sizes.select(run, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), "size")
    own = F.row_number().over(Window.partitionBy(run).orderBy("frame")) - 1
    return rows.withColumn("own", own).join(shifts, run).withColumn("sample_id", c("own") + c("shift")).withColumn("gallery", c("own") % F.greatest(F.floor(c("size") / 12), F.lit(1)) == 0).drop("own", "shift", "size")

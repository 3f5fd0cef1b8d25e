"""The placement grid: building it from labels, nearest and trilinear look-ups, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


class Axis:
    """A uniform axis: values low + step x (0 .. n-1). A position is found by arithmetic, never by a range join."""

    def __init__(self, low: float, step: float, n: int):
        self.low, self.step, self.n = low, step, n

    def position(self, v: Column) -> Column:
        """Fractional position, held at both ends."""
        return F.least(F.greatest((v - self.low) / self.step, F.lit(0.0)), F.lit(self.n - 1.0))

    def floor(self, v: Column) -> Column:
        return F.least(F.floor(self.position(v)), F.lit(max(self.n - 2, 0))).cast("int")

    def share(self, v: Column) -> Column:
        return self.position(v) - self.floor(v)

    def nearest(self, v: Column) -> Column:
        """The closer value's index; halfway, the lower one."""
        return F.ceil(self.position(v) - 0.5).cast("int")


def build_grid(labels: DataFrame, axes: dict[str, Axis], values: list[str]) -> DataFrame:
    """Labels folded to cells (zi, xi, yi): means of ``values``, how many labels, and share visible."""
    cell = {f"{k}i": a.nearest(c(k)) for k, a in axes.items()}
    return labels.select(*[v.alias(k) for k, v in cell.items()], "visible", *values).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(c("visible").cast("double")).alias("visible"), *[F.avg(v).alias(v) for v in values])


def dense_grid(labels: DataFrame, axes: list[str], values: list[str], ordinal: Column) -> DataFrame:
    """Every cell of the product of the labels' own axis values: the label of the highest ordinal, or not visible and null."""
    last = labels.groupBy(*axes).agg(F.max_by(F.struct("visible", *values), ordinal).alias("at"))
    # An axis has as many values as the grid has cells along it.
    product = reduce(lambda a, b: a.crossJoin(b), [labels.select(a).distinct() for a in axes])
    return product.join(last, axes, "left").select(*axes, F.coalesce("at.visible", F.lit(False)).alias("visible"), *[c(f"at.{v}").alias(v) for v in values])


def missing_cells(grid: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """Cells of the full product that no label reached."""
    spark = grid.sparkSession
    product = reduce(lambda a, b: a.crossJoin(b), [spark.range(a.n).select(c("id").cast("int").alias(f"{k}i")) for k, a in axes.items()])
    return product.join(grid, [f"{k}i" for k in axes], "left_anti")


def nearest(queries: DataFrame, grid: DataFrame, axes: dict[str, Axis], values: list[str]) -> DataFrame:
    """Each query with its nearest cell's values; null where the cell is missing."""
    cell = {f"{k}i": a.nearest(c(k)) for k, a in axes.items()}
    return queries.withColumns(cell).join(grid.select(*cell, *values), list(cell), "left")


def trilinear(queries: DataFrame, key: list[str], grid: DataFrame, axes: dict[str, Axis], values: list[str]) -> DataFrame:
    """(key, values): the weighted sum of eight corners, met by equality on their indices.

    A missing corner counts as zero, as stored grids fill their gaps.
    """
    corner = F.explode(F.array(*[F.struct(*[F.lit(n >> b & 1).alias(k) for b, k in enumerate(axes)]) for n in range(8)])).alias("d")
    q = queries.select(*key, *[a.floor(c(k)).alias(f"{k}0") for k, a in axes.items()], *[a.share(c(k)).alias(f"{k}u") for k, a in axes.items()], corner)
    weight = reduce(lambda a, b: a * b, [F.when(c(f"d.{k}") == 1, c(f"{k}u")).otherwise(1.0 - c(f"{k}u")) for k in axes])
    q = q.select(*key, *[(c(f"{k}0") + c(f"d.{k}")).alias(f"{k}i") for k in axes], weight.alias("weight"))
    met = q.join(grid.select(*[f"{k}i" for k in axes], *values), [f"{k}i" for k in axes], "left")
    return met.groupBy(*key).agg(*[F.sum(c("weight") * F.coalesce(v, F.lit(0.0))).alias(v) for v in values])


class SortedAxis:
    """An axis of any spacing: an interval is found by binary search in its values, a few hundred numbers in the plan."""

    def __init__(self, values: list[float]):
        self.values = sorted(values)
        if not self.values or len(self.values) > 100_000:
            raise ValueError("an axis has 1 to 100,000 values")

    @classmethod
    def of(cls, grid: DataFrame, column: str) -> SortedAxis:
        """The distinct values of a grid's column."""
        return cls([r[0] for r in grid.select(column).where(c(column).isNotNull()).distinct().limit(100_001).collect()])

    def bounds(self, v: Column) -> tuple[Column, Column, Column]:
        """(lower index, upper index, weight of the upper): both are one end beyond it, where the weight is 0."""
        values, last = F.array(*map(F.lit, self.values)), len(self.values) - 1
        jumps = [1 << b for b in reversed(range(last.bit_length()))]
        found = F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), lambda at, jump: F.when(F.get(values, at + jump) <= v, at + jump).otherwise(at)) if jumps else F.lit(0)
        low, high = v <= self.values[0], v >= self.values[-1]
        i0 = F.when(low, 0).when(high, last).when(v.isNotNull(), found)
        i1 = F.when(low, 0).when(high, last).when(v.isNotNull(), found + 1)
        v0, v1 = F.get(values, i0), F.get(values, i1)
        return i0, i1, F.when(F.abs(v1 - v0) < 1e-9, 0.0).otherwise((v - v0) / (v1 - v0))

    def held(self, v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(self.values[0])), F.lit(self.values[-1]))


class CircularAxis:
    """Whole degrees 0 to n - 1 that close to a circle: after the last value comes the first."""

    def __init__(self, n: int = 360):
        self.n = n

    def bounds(self, v: Column) -> tuple[Column, Column, Column]:
        turned = F.pmod(v, F.lit(float(self.n)))
        i0 = F.pmod(F.floor(turned), F.lit(self.n)).cast("int")
        return i0, F.pmod(i0 + 1, F.lit(self.n)).cast("int"), turned - F.floor(turned)


def interpolated(queries: DataFrame, key: list[str], grid: DataFrame, axes: dict[str, SortedAxis | CircularAxis], values: list[str]) -> DataFrame:
    """(key, values): three axes interpolated one in the other, from eight corners met by equality on their indices.

    ``grid`` holds an index column ``{axis}i`` an axis. A cell that is missing, null or NaN makes the result NaN, also
    where its weight is zero, as in the arrays that such grids are stored in. ``key`` identifies a query.
    """
    names = list(axes)
    q = queries.select(*key, *[x.alias(n) for k, a in axes.items() for n, x in zip((f"{k}0", f"{k}1", f"{k}u"), a.bounds(c(k)), strict=True)])
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("corner"), *[c(f"{k}{n >> b & 1}").alias(f"{k}i") for b, k in enumerate(names)]) for n in range(8)]))
    at = q.select(*key, *[f"{k}u" for k in names], corner.alias("d")).select(*key, *[f"{k}u" for k in names], "d.*")
    met = at.join(grid.select(*[f"{k}i" for k in names], *values), [f"{k}i" for k in names], "left")
    nan = F.lit(float("nan"))
    corners = [F.max(F.when(c("corner") == n, F.coalesce(c(v).cast("double"), nan))).alias(f"{v}_{n}") for v in values for n in range(8)]
    wide = met.groupBy(*key, *[f"{k}u" for k in names]).agg(*corners)

    def along(v: str) -> Column:
        now = [c(f"{v}_{n}") for n in range(8)]
        for b in (2, 1, 0):  # the last axis first; corners that differ in bit b are merged
            u = c(f"{names[b]}u")
            now = [now[n] * (1.0 - u) + now[n | 1 << b] * u for n in range(1 << b)]
        return now[0]

    return wide.select(*key, *[along(v).alias(v) for v in values])


def placed(queries: DataFrame, key: list[str], grid: DataFrame, x_axis: SortedAxis, z_axis: SortedAxis, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """Boxes looked up for (key, x, z, yaw) in a grid (zi, xi, yawi, visible, cx, bottom, w, h) with a yaw axis of 0..359.

    Places beyond the axes are held to them and marked. A box shows from a visibility of one half on, at least a pixel
    wide and high and not behind; what the image leaves of it may still be nothing. Else there is a reason, and no box.
    """
    held = queries.select(*key, "x", "z", "yaw", x_axis.held(c("x")).alias("held_x"), z_axis.held(c("z")).alias("held_z"))
    asked = held.select(*key, c("held_z").alias("z"), c("held_x").alias("x"), "yaw")
    found = interpolated(asked, key, grid, {"z": z_axis, "x": x_axis, "yaw": CircularAxis()}, ["visible", "cx", "bottom", "w", "h"])
    both = found.withColumnRenamed("visible", "share").join(held, key)
    number = lambda *vs: reduce(lambda a, b: a & b, [~F.isnan(v) for v in vs])  # noqa: E731  a comparison with NaN is false
    seen = number("share", "w", "h") & (c("share") >= 0.5) & (c("w") >= 1.0) & (c("h") >= 1.0) & (c("z") >= 0.0)
    cut = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), v))
    box = {"x1": cut(c("cx") - c("w") / 2.0, width), "y1": cut(c("bottom") - c("h"), height), "x2": cut(c("cx") + c("w") / 2.0, width), "y2": cut(c("bottom"), height)}
    left = (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    reason = F.when(~seen, "not_visible").when(~left, "outside_image")
    clamped = (F.abs(c("held_x") - c("x")) > 1e-6) | (F.abs(c("held_z") - c("z")) > 1e-6)
    out = both.withColumns({"reason": reason, "clamped": clamped})
    ok = c("reason").isNull()
    return out.select(*key, ok.alias("visible"), "reason", "share", "clamped", *[F.when(ok, c(v)).alias(v) for v in ("cx", "bottom")], *[F.when(ok, v).alias(k) for k, v in box.items()])

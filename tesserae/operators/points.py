"""Point sets of objects: percentile boxes, robust filters, voxels and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def keys(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def fit_box(points: DataFrame, by: str | list[str] = "node", least: int = 50) -> DataFrame:
    """Box between the 2nd and 98th percentile (inverted distribution function); plain bounds under ``least`` points."""
    exact = []
    for k in AXES:
        for e, q, plain in (("l", 0.02, F.min), ("h", 0.98, F.max)):
            disc = F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {k})")
            exact.append(F.when(F.count("*") < least, plain(k)).otherwise(disc).alias(e + k))
    return points.groupBy(*keys(by)).agg(F.count("*").alias("n"), *exact)


def linear_box(points: DataFrame, by: str = "node", trim: float = 0.005) -> DataFrame:
    """Box between two linear percentiles."""
    cuts = F.array(F.lit(trim), F.lit(1 - trim))
    both = points.groupBy(by).agg(*[F.percentile(k, cuts).alias(k) for k in AXES])
    return both.select(by, *[F.col(k)[i].alias(e + k) for k in AXES for i, e in enumerate("lh")])


def robust_filter(points: DataFrame, by: str = "node", scale: float = 3.0, least: int = 10) -> DataFrame:
    """Points within ``scale`` robust deviations of the median on every axis; groups under ``least`` stay whole."""
    middle = points.groupBy(by).agg(F.count("*").alias("_n"), *[F.median(k).alias(f"_m{k}") for k in AXES])
    near = points.join(middle, by)
    spread = near.groupBy(by).agg(*[F.median(F.abs(F.col(k) - F.col(f"_m{k}"))).alias(f"_d{k}") for k in AXES])
    ok = F.col("_n") < least
    inside = F.lit(True)
    for k in AXES:
        inside = inside & (F.abs(F.col(k) - F.col(f"_m{k}")) <= scale * (1.4826 * F.col(f"_d{k}") + 1e-3))
    return near.join(spread, by).where(ok | inside).select(by, *AXES)


def voxels(points: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    return points.select("*", *[F.floor(F.col(k) / s).alias(f"v{k}") for k, s in zip(AXES, size, strict=True)])


def thin(points: DataFrame, size: tuple[float, float, float], order: list[str]) -> DataFrame:
    """The first point of every voxel; as a minimum, so voxels combine before the shuffle and none is sorted."""
    first = F.min(F.struct(*order)).alias("_first")
    cells = voxels(points, size).groupBy("vx", "vy", "vz").agg(first)
    return cells.select("vx", "vy", "vz", "_first.*")


def dense_voxels(points: DataFrame, size: tuple[float, float, float], by: str = "node", share: float = 0.1) -> DataFrame:
    """Voxels of each object with at least max(2, share * points in the average point's voxel)."""
    counts = voxels(points, size).groupBy(by, "vx", "vy", "vz").agg(F.count("*").alias("n"))
    typical = counts.groupBy(by).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("typical"))
    return counts.join(typical, by).where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("typical"))).drop("typical")


def spread_sample(points: DataFrame, k: int, order: list[str], by: str = "node") -> DataFrame:
    """At most k rows of each group, evenly spaced over its order: places int(i * (n - 1) / (k - 1)), ends included."""
    w = Window.partitionBy(by)
    placed = points.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row p is the i-th place if floor(i * step) = p for the i next to p / step; the last row is the last place.
    m = F.least(F.col("_n"), F.lit(k))
    step = (F.col("_n") - 1).cast("double") / F.greatest(m - 1, F.lit(1))
    near = F.floor(F.col("_at") / F.when(step > 0, step).otherwise(1.0))
    is_place = lambda i: (i >= 0) & (i < m - 1) & (F.floor(i * step) == F.col("_at"))
    ends = (F.col("_at") == F.col("_n") - 1) & (m > 1) | (F.col("_at") == 0)
    wanted = ends | is_place(near) | is_place(near + 1)
    return placed.where(wanted).drop("_n").withColumnRenamed("_at", "place")


def strided(frames: DataFrame, column: str, step: int) -> DataFrame:
    return frames.where(F.pmod(F.col(column), F.lit(step)) == 0)


def reliable(masks: DataFrame, confidence: float = 2.5):
    """Condition: points, and no confidence under the limit; an unknown confidence passes."""
    return (masks["n_points"] > 0) & (masks["conf"].isNull() | (masks["conf"] >= confidence))


SIDES = tuple(e + k for e in "lh" for k in AXES)


def most_confident(masks: DataFrame, by: str | list[str] = "node") -> DataFrame:
    """The mask with points and the highest confidence of each group; unknown counts least, ties to the first mask."""
    key = F.struct(F.coalesce("conf", F.lit(float("-inf"))).alias("c"), (-F.col("mask")).alias("m"))
    best = F.max_by(F.struct("mask", *[c for c in SIDES if c in masks.columns]), key).alias("b")
    return masks.where(F.col("n_points") > 0).groupBy(*keys(by)).agg(best).select(*keys(by), "b.*")


def corners(masks: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, z: the two corners of each mask's box."""
    corner = lambda e: F.struct(*[F.col(e + k).alias(k) for k in AXES])
    return masks.select(*by, F.explode(F.array(corner("l"), corner("h"))).alias("p")).select(*by, "p.*")


def node_box(masks: DataFrame, by: str | list[str] = "node", points: DataFrame | None = None) -> DataFrame:
    """by and bounds: the trimmed box of the points of reliable masks; without any, the most confident mask's box.

    masks: by, mask, n_points, conf and bounds. points: run, mask, x, y, z; None: the masks' corners.
    """
    by = keys(by)
    good = masks.where(reliable(masks))
    cloud = corners(good, by) if points is None else good.select(*by, "mask").join(points, ["run", "mask"])
    pooled = fit_box(cloud, by).drop("n")
    best = most_confident(masks, by).drop("mask")
    fallback = best.select(*by, *[F.col(c).alias(f"_{c}") for c in SIDES])
    own = F.col("lx").isNotNull()
    return pooled.join(fallback, by, "full_outer").select(*by, *[F.when(own, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in SIDES])

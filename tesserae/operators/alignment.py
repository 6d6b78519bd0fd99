"""Crops of masks, alignment of a reconstruction with gravity, walls and metres, and scoring of point clouds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pad_box(x0: Column, y0: Column, x1: Column, y1: Column, height: int, width: int, share: float = 0.1) -> list[Column]:
    """A pixel box with a share of its size added on each side, cut off to whole pixels and to the image."""
    px, py = (x1 - x0) * share, (y1 - y0) * share
    return [
        F.greatest((x0 - px).cast("int"), F.lit(0)),
        F.greatest((y0 - py).cast("int"), F.lit(0)),
        F.least((x1 + px).cast("int"), F.lit(width)),
        F.least((y1 + py).cast("int"), F.lit(height)),
    ]


def square_box(x0: Column, y0: Column, x1: Column, y1: Column, height: int, width: int) -> list[Column]:
    """The box grown to a square of its longer side, as far as the image allows, and moved inside."""
    side = F.least(F.greatest(x1 - x0, y1 - y0), F.lit(width), F.lit(height)).cast("int")
    left = F.greatest(F.least(F.floor((x0 + x1 - side) / 2), F.lit(width) - side), F.lit(0))
    top = F.greatest(F.least(F.floor((y0 + y1 - side) / 2), F.lit(height) - side), F.lit(0))
    return [left, top, left + side, top + side]


def bounds_of_runs(runs: DataFrame, by: list[str], height: int) -> DataFrame:
    """by, x0, y0, x1, y1 (exclusive ends) of column-major runs. A run over a column's end covers all rows."""
    first, last = F.col("s"), F.col("e") - 1
    crosses = F.floor(first / height) != F.floor(last / height)
    return runs.where("e > s").groupBy(*by).agg(
        F.min(F.floor(first / height)).alias("x0"),
        F.min(F.when(crosses, 0).otherwise(first % height)).alias("y0"),
        (F.max(F.floor(last / height)) + 1).alias("x1"),
        (F.max(F.when(crosses, height - 1).otherwise(last % height)) + 1).alias("y1"),
    )


def suppress(boxes: DataFrame, by: list[str], least: float) -> DataFrame:
    """Boxes that stay when those that overlap a better one too much go, best first (greedy, an image each)."""

    def one(b):
        b = b.sort_values(["score", "box"], ascending=[False, True])
        kept, xy = [], b[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (xy[:, 2] - xy[:, 0]) * (xy[:, 3] - xy[:, 1])
        for i in range(len(b)):
            k = np.asarray(kept, dtype=int)
            side = np.maximum(np.minimum(xy[k, 2:], xy[i, 2:]) - np.maximum(xy[k, :2], xy[i, :2]), 0)
            shared = side.prod(axis=1)
            if not (shared / np.maximum(area[k] + area[i] - shared, 1e-9) >= least).any():
                kept.append(i)
        return b.iloc[kept]

    return boxes.groupBy(*by).applyInPandas(one, boxes.schema)


def gravity_up(rights: np.ndarray, downs: np.ndarray, turn: float = 0.2) -> np.ndarray:
    """The unit up direction in a model's world, from the cameras' right and down axes there (n, 3 each).

    A camera held level has its right axis at right angles to up, so up is the direction in which the right axes spread
    least, on the side that the cameras' tops point to. If the cameras hardly turn (the second spread is under ``turn``
    of the first), that direction is not determined, and up is the mean of the cameras' own.
    """
    mean = -downs.mean(axis=0)
    _, spread, directions = np.linalg.svd(rights)
    up = mean if len(spread) < 2 or spread[1] < turn * spread[0] else directions[2] * np.sign(directions[2] @ mean)
    return up / np.linalg.norm(up)


def frame_of(up: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Rotation whose rows are x (heading, made level), y and z (up)."""
    x = heading - (heading @ up) * up
    x = x / np.linalg.norm(x)
    return np.stack([x, np.cross(up, x), up])


def metric_scale(pixels: DataFrame) -> DataFrame:
    """run, scale: median over frames of the median ratio of metric to relative depth. pixels: run, frame, metric, relative."""
    ratio = pixels.where("relative > 0 and metric > 0").groupBy("run", "frame").agg(F.median(F.col("metric") / F.col("relative")).alias("r"))
    return ratio.groupBy("run").agg(F.median("r").alias("scale"))


def world_from_camera(cam_from_world: np.ndarray, sim3: np.ndarray) -> np.ndarray:
    """Camera-to-world of a 3x4 pose under a similarity (scaled rotation and translation)."""
    scale = np.linalg.norm(sim3[:3, 0])
    turn = sim3[:3, :3] / scale
    back = cam_from_world[:, :3].T
    out = np.eye(4)
    out[:3, :3] = turn @ back
    out[:3, 3] = scale * turn @ (-back @ cam_from_world[:, 3]) + sim3[:3, 3]
    return out


def truth_boxes(points: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """by, n_points and bounds of points within four robust deviations. points: by, x, y, z; few outliers go first."""
    from tesserae.operators.points import robust_filter

    keyed = points.withColumn("_by", F.struct(*by))
    kept = robust_filter(keyed, "_by", 4.0)
    bounds = kept.groupBy("_by").agg(F.count("*").alias("n_points"), *[f(k).alias(e + k) for k in "xyz" for e, f in (("l", F.min), ("h", F.max))])
    return bounds.where(F.col("n_points") >= least).select("_by.*", "n_points", *[e + k for k in "xyz" for e in "lh"])


def nearest_within(points: DataFrame, cloud: DataFrame, by: list[str], reach: float) -> DataFrame:
    """by, point, obj: the object of the nearest cloud point within reach; null without one.

    points: by, point, x, y, z. cloud: by, obj, x, y, z. Both go to grid cells of that size; each cloud point is copied
    to the 27 cells around it.
    """
    cell = lambda k: F.floor(F.col(k) / reach)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = cloud.select(*by, "obj", *[F.col(k).alias(f"_{k}") for k in "xyz"], *[cell(k).alias(f"b{k}") for k in "xyz"])
    for k in "xyz":
        around = around.select("*", F.explode(steps).alias("_d")).withColumn(f"c{k}", F.col(f"b{k}") + F.col("_d")).drop("_d")
    asked = points.select("*", *[cell(k).alias(f"c{k}") for k in "xyz"])
    away = sum(((F.col(k) - F.col(f"_{k}")) * (F.col(k) - F.col(f"_{k}")) for k in "xyz"), F.lit(0.0))
    met = asked.join(around, [*by, "cx", "cy", "cz"]).withColumn("_a", away).where(F.col("_a") <= reach * reach)
    best = met.groupBy(*by, "point").agg(F.min(F.struct("_a", "obj"))["obj"].alias("obj"))
    return points.select(*by, "point").join(best, [*by, "point"], "left")


#: What a predicted label can be to a true object, best first.
CATEGORIES = ("synonym", "depiction", "vis_sim", "clutter", "incorrect", "missing")


def segmentation(nearest: DataFrame, ranked: DataFrame, truth: DataFrame, categories: DataFrame, top: int) -> DataFrame:
    """scene and the share of points in each category: of the best category among the nearest object's top labels.

    nearest: scene, point, obj. ranked: scene, obj, label, rank. truth: scene, point, object. categories: scene, object,
    label, category. Shares are a mean over objects.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    known = categories.select("scene", "object", "label", order.alias("place"))
    guesses = truth.join(nearest, ["scene", "point"]).join(ranked.where(F.col("rank") <= top), ["scene", "obj"], "left")
    best = guesses.join(known, ["scene", "object", "label"], "left").groupBy("scene", "object", "point").agg(
        F.min("place").alias("place"), F.max(F.col("obj").isNotNull()).alias("there")
    )
    place = F.when(~F.col("there"), len(CATEGORIES)).otherwise(F.coalesce("place", F.lit(len(CATEGORIES) - 1)))
    shares = best.withColumn("place", place).groupBy("scene", "object").agg(
        *[F.avg((F.col("place") == i + 1).cast("int")).alias(c) for i, c in enumerate(CATEGORIES)]
    )
    return shares.groupBy("scene").agg(*[F.avg(c).alias(c) for c in CATEGORIES])


def set_ious(predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, p, t, iou of sets of vertices that meet. predicted: by, p, vertex. truth: by, t, vertex."""
    p, t = predicted.distinct(), truth.distinct()
    shared = p.join(t, [*by, "vertex"]).groupBy(*by, "p", "t").agg(F.count("*").alias("n"))
    np_, nt = p.groupBy(*by, "p").agg(F.count("*").alias("a")), t.groupBy(*by, "t").agg(F.count("*").alias("b"))
    both = shared.join(np_, [*by, "p"]).join(nt, [*by, "t"])
    return both.select(*by, "p", "t", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("iou"))


def precision_at(ious: DataFrame, ranked: DataFrame, targets: DataFrame, thresholds: tuple[float, ...], top: int = 10) -> DataFrame:
    """query, ap: mean over thresholds of average precision, a target counting once. ranked: query, p, rank; targets: query, t."""
    n = targets.groupBy("query").agg(F.count("*").alias("targets"))
    found = ranked.where(F.col("rank") <= top).join(ious, "p").join(targets, ["query", "t"])
    each = found.select("*", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("least")).where(F.col("iou") >= F.col("least"))
    first = each.groupBy("query", "least", "t").agg(F.min("rank").alias("rank"))
    k = F.row_number().over(Window.partitionBy("query", "least").orderBy("rank", "t"))
    sums = first.withColumn("k", k).groupBy("query").agg(F.sum(F.col("k") / F.col("rank")).alias("s"))
    return n.join(sums, "query", "left").select("query", (F.coalesce("s", F.lit(0.0)) / F.col("targets") / len(thresholds)).alias("ap"))

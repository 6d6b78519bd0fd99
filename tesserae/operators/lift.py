"""From masks and depth to points: boxes of masks, points that views agree on, coverage and sightings.

A frame is one row: its camera, its depth and its masks (column-major runs). Points meet the frames they are asked
about by (run, frame); each frame is decoded once for all its points.

frames:  run, frame, height, width, h, w, depth (h * w floats, bytes), conf (the same, or null), k, c2w (9 and 16 numbers),
         masks array<struct<mask, node, prompt, runs array<struct<s, e>>>>
points:  run, node, source (the frame it is from), ord, x, y, z
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import geometry
from tesserae.operators.points import spread_sample

# Fixed values of lifting and voting.
COVER, LEAST, SUPPORT, TRIM, MOST = 0.5, 50, 0.5, 0.005, 8192
VISIBLE, CONTAINED, SEEN_LEAST, SIGHTED = 0.5, 0.8, 20, 512

MASKS = "array<struct<mask:bigint,node:bigint,prompt:bigint,runs:array<struct<s:bigint,e:bigint>>>>"


def frame_rows(cameras: DataFrame, runs: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with their masks. cameras: run, frame and the rest. runs: run, mask, s, e. masks: run, frame, mask, node, prompt."""
    packed = runs.groupBy("run", "mask").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    held = masks.join(packed, ["run", "mask"]).groupBy("run", "frame").agg(
        F.array_sort(F.collect_list(F.struct("mask", "node", "prompt", "runs"))).alias("masks")
    )
    return cameras.join(held, ["run", "frame"], "left")


class Frame:
    """A decoded frame row."""

    def __init__(self, row):
        self.size, self.small = (int(row.height), int(row.width)), (int(row.h), int(row.w))
        self.depth = np.frombuffer(row.depth, dtype="<f4").reshape(self.small).astype(np.float64)
        self.conf = None if row.conf is None else np.frombuffer(row.conf, dtype="<f4").reshape(self.small)
        self.k, self.c2w = np.asarray(row.k, float).reshape(3, 3), np.asarray(row.c2w, float).reshape(4, 4)
        self.masks = [] if row.masks is None else list(row.masks)

    def whole(self, runs) -> np.ndarray:
        flat = np.zeros(self.size[0] * self.size[1], dtype=bool)
        for r in runs:
            flat[r["s"] : r["e"]] = True
        return flat.reshape(self.size[1], self.size[0]).T

    def of(self, masks, cover: float = 0.25) -> np.ndarray:
        """The union of masks at the depth's size."""
        joined = np.zeros(self.size, dtype=bool)
        for m in masks:
            joined |= self.whole(m["runs"])
        return joined if self.size == self.small else geometry.shrink(joined, self.small, cover)


def mask_boxes(frames: DataFrame) -> DataFrame:
    """run, frame, mask, n_points, conf and box (null without enough depth) of every mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                f = Frame(row)
                for m in f.masks:
                    got = geometry.mask_to_box(f.depth, f.k, f.c2w, f.of([m], COVER), f.conf)
                    box = [None] * 6 if got is None else got[0].ravel().tolist()
                    n, sure = (0, None) if got is None else (len(got[1]), None if np.isnan(got[2]) else got[2])
                    out.append((row.run, row.frame, m["mask"], n, sure, *box))
            yield pd.DataFrame(out, columns=["run", "frame", "mask", "n_points", "conf", "lx", "ly", "lz", "hx", "hy", "hz"])

    kinds = "run bigint, frame bigint, mask bigint, n_points bigint, conf double, lx double, ly double, lz double, hx double, hy double, hz double"
    return frames.mapInPandas(run, kinds)


def lifted_points(frames: DataFrame) -> DataFrame:
    """points: the robust depth points of every mask of an object (node >= 0), in order of mask and pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                f = Frame(row)
                for m in f.masks:
                    if m["node"] is None or m["node"] < 0:
                        continue
                    p = geometry.backproject(f.depth, f.k, f.c2w, f.of([m], COVER))[0]
                    p = p[geometry.robust(p)] if len(p) else p
                    if len(p) >= LEAST:
                        yield pd.DataFrame({"run": row.run, "node": m["node"], "source": row.frame, "ord": m["mask"] * 10_000_000 + np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return frames.mapInPandas(run, "run bigint, node bigint, source bigint, ord bigint, x double, y double, z double")


def views(points: DataFrame, frames: DataFrame, everywhere: bool) -> DataFrame:
    """run, frame, node, source, ord, seen, inside, hidden, held: how each frame sees each point.

    Asked are the frames that hold a mask of the point's node, or all frames of the run. ``inside`` is by the node's
    own masks there; ``hidden`` is behind the depth; ``held`` has the masks that hold the point.
    """
    of_node = frames.select("run", "frame", F.explode("masks").alias("m")).select("run", "frame", F.col("m.node").alias("node")).distinct()
    asked = points.join(frames.select("run", "frame"), "run") if everywhere else points.join(of_node, ["run", "node"])
    columns = ["run", "frame", "node", "source", "ord", "seen", "inside", "hidden", "held"]

    def one(p: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(rows):
            return pd.DataFrame(columns=columns)
        f = Frame(next(rows.itertuples(index=False)))
        xyz = p[["x", "y", "z"]].to_numpy(float)
        back = np.linalg.inv(f.c2w)
        z = xyz @ back[2, :3] + back[2, 3]
        open_ = np.full(f.small, np.inf)  # without walls: what is in the image
        u, v, seen = geometry.project(xyz, open_, f.k, f.c2w)
        there = f.depth[v, u]
        hidden = seen & (z > there + np.maximum(geometry.HIDDEN[0], geometry.HIDDEN[1] * there))
        inside = np.zeros(len(p), dtype=bool)
        for n in p["node"].unique():
            mine = (p["node"] == n).to_numpy()
            inside[mine] = f.of([m for m in f.masks if m["node"] == n])[v[mine], u[mine]]
        held: list[list[int]] = [[] for _ in range(len(p))]
        for m in f.masks if everywhere else ():
            for i in np.flatnonzero(seen & f.of([m])[v, u]):
                held[i].append(int(m["mask"]))
        return p[["run", "frame", "node", "source", "ord"]].assign(seen=seen, inside=seen & inside, hidden=hidden, held=held)

    kinds = "run bigint, frame bigint, node bigint, source bigint, ord bigint, seen boolean, inside boolean, hidden boolean, held array<bigint>"
    other = frames.select(F.col("run").alias("_run"), F.col("frame").alias("_frame"), *[c for c in frames.columns if c not in ("run", "frame")])
    return asked.groupBy("run", "frame").cogroup(other.groupBy("_run", "_frame")).applyInPandas(one, kinds)


def agreed_points(points: DataFrame, frames: DataFrame, most: int = MOST) -> DataFrame:
    """points that other views of the object support; of objects with fewer than ten such points, all."""
    keyed = points.withColumn("_key", F.struct("run", "node"))
    sample = spread_sample(keyed, most, ["source", "ord"], "_key").drop("_key", "place")
    seen = views(sample, frames, everywhere=False).where(F.col("seen") & (F.col("source") != F.col("frame")))
    votes = seen.groupBy("run", "node", "source", "ord").agg(
        F.sum(F.col("inside").cast("int")).alias("agree"),
        F.sum((~F.col("inside") & ~F.col("hidden")).cast("int")).alias("against"),
    )
    both = sample.join(votes, ["run", "node", "source", "ord"], "left").na.fill(0, ["agree", "against"])
    ok = F.col("agree") >= SUPPORT * (F.col("agree") + F.col("against"))
    n = F.sum(ok.cast("int")).over(Window.partitionBy("run", "node"))
    return both.withColumn("_ok", ok).withColumn("_n", n).where(F.col("_ok") | (F.col("_n") < 10)).select(*sample.columns)


def object_boxes(agreed: DataFrame) -> DataFrame:
    """run, node and the box between the outer percentiles of its agreed points."""
    cuts = F.array(F.lit(TRIM), F.lit(1 - TRIM))
    both = agreed.groupBy("run", "node").agg(*[F.percentile(k, cuts).alias(k) for k in "xyz"])
    return both.select("run", "node", *[F.col(k)[i].alias(e + k) for k in "xyz" for i, e in enumerate("lh")])


def coverage(points: DataFrame, frames: DataFrame) -> DataFrame:
    """run, node, coverage: mean share of an object's unhidden points inside its own mask, over frames with enough."""
    keyed = points.withColumn("_key", F.struct("run", "node"))
    sample = spread_sample(keyed, SIGHTED, ["source", "ord"], "_key").drop("_key", "place")
    seen = views(sample, frames, everywhere=False).where(F.col("seen") & ~F.col("hidden"))
    share = seen.groupBy("run", "node", "frame").agg(F.count("*").alias("n"), F.avg(F.col("inside").cast("int")).alias("share"))
    return share.where(F.col("n") >= SEEN_LEAST).groupBy("run", "node").agg(F.avg("share").alias("coverage"))


def sightings(points: DataFrame, frames: DataFrame) -> DataFrame:
    """run, frame, node, masks: frames that see enough of an object, and the masks that hold enough of what they see."""
    total = points.groupBy("run", "node").agg(F.count("*").alias("total"))
    seen = views(points, frames, everywhere=True).where(F.col("seen") & ~F.col("hidden"))
    n = seen.groupBy("run", "frame", "node").agg(F.count("*").alias("n")).join(total, ["run", "node"])
    n = n.where(F.col("n") >= F.greatest(VISIBLE * F.col("total"), F.lit(1.0)))
    by_mask = seen.select("run", "frame", "node", F.explode("held").alias("mask")).groupBy("run", "frame", "node", "mask").agg(F.count("*").alias("k"))
    holding = by_mask.join(n, ["run", "frame", "node"]).where(F.col("k") >= CONTAINED * F.col("n"))
    masks = holding.groupBy("run", "frame", "node").agg(F.array_sort(F.collect_set("mask")).alias("masks"))
    return n.join(masks, ["run", "frame", "node"], "left").select("run", "frame", "node", F.coalesce("masks", F.array().cast("array<bigint>")).alias("masks"))

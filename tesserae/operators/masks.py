"""Run-length masks as intervals: union, area, overlap, containment and lookups.

A mask is a set of half-open pixel intervals (s, e) of a frame. Interval overlap is joined on blocks of pixels, so it
is an equality join with a residual condition; a pair of intervals is counted in the block where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.plan import dealt, parts

BLOCK = 256


def _islands(runs: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint intervals of each mask with its ``area``. Windows are in the order of one sort, and equal rows count alike."""
    runs = dealt(runs, parts(runs, runs.count()), *by)
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_before", before)
    fresh = F.col("_before").isNull() | (F.col("s") > F.col("_before"))
    marked = marked.withColumn("_new", F.when(fresh, 1).otherwise(0))
    marked = marked.withColumn("_more", F.when(fresh, F.col("e") - F.col("s")).otherwise(F.greatest(F.col("e") - F.col("_before"), F.lit(0))))
    island = marked.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = island.withColumn("area", F.sum("_more").over(Window.partitionBy(*by)))
    whole = sized.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("area").alias("area"))
    return whole.drop("_island")


def union(runs: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint intervals of each mask: touching and overlapping ones become one."""
    return _islands(runs, by).drop("area")


def area(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("area"))


def _blocks(runs: DataFrame) -> DataFrame:
    b = F.sequence(F.floor(F.col("s") / BLOCK), F.floor((F.col("e") - 1) / BLOCK))
    return runs.where(F.col("e") > F.col("s")).withColumn("_block", F.explode(b))


def overlaps(left: DataFrame, right: DataFrame, frame: list[str], a: str, b: str, apart: bool, n: int | None = None) -> DataFrame:
    """frame, a, b, shared: pixels that masks of a frame share. ``apart``: both sides are one table, and a < b.

    Areas that both sides hold go along as area_a, area_b. ``n``: the parts that both are dealt to, if they are large.
    """
    sizes = "area" in left.columns and "area" in right.columns
    size = lambda out: [F.col("area").alias(out)] if sizes else []
    x = _blocks(left).select(*frame, F.col(a).alias("a"), F.col("s").alias("as"), F.col("e").alias("ae"), "_block", *size("area_a"))
    y = _blocks(right).select(*frame, F.col(b).alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"), "_block", *size("area_b"))
    if n is not None:
        x, y = dealt(x, n, *frame, "_block"), dealt(y, n, *frame, "_block").hint("merge")
    start = F.greatest("as", "bs")
    met = x.join(y, [*frame, "_block"]).where(
        (F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae")) & (F.col("_block") == F.floor(start / BLOCK))
    )
    met = met.where(F.col("a") < F.col("b")) if apart else met
    shared = dealt(met.select(*frame, "a", "b", *(["area_a", "area_b"] if sizes else []), (F.least("ae", "be") - start).alias("_px")), n, *frame)
    more = [F.first(c).alias(c) for c in ("area_a", "area_b") if sizes]
    return shared.groupBy(*frame, "a", "b").agg(F.sum("_px").alias("shared"), *more)


def with_areas(shared: DataFrame, left: DataFrame, right: DataFrame, frame: list[str]) -> DataFrame:
    """Adds area_a, area_b, iou and contain (shared over the smaller area). left, right: frame, mask, area."""
    x = left.select(*frame, F.col("mask").alias("a"), F.col("area").alias("area_a"))
    y = right.select(*frame, F.col("mask").alias("b"), F.col("area").alias("area_b"))
    return measures(shared.join(x, [*frame, "a"]).join(y, [*frame, "b"]))


def measures(both: DataFrame) -> DataFrame:
    """Adds iou and contain to shared, area_a and area_b."""
    return both.withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared"))).withColumn(
        "contain", F.col("shared") / F.greatest(F.least("area_a", "area_b"), F.lit(1))
    )


def pairs(runs: DataFrame, frame: list[str]) -> DataFrame:
    """Overlapping pairs of union masks of each frame with their measures. runs: frame columns, mask, s, e."""
    whole = _islands(runs, [*frame, "mask"])
    return measures(overlaps(whole, whole, frame, "mask", "mask", True, parts(runs, runs.count())))


def points_in_masks(runs: DataFrame, pixels: DataFrame, frame: list[str]) -> DataFrame:
    """frame, pixel, mask: union masks that hold each pixel of their frame."""
    whole = _blocks(union(runs, [*frame, "mask"]))
    asked = pixels.withColumn("_block", F.floor(F.col("pixel") / BLOCK))
    met = whole.join(asked, [*frame, "_block"])
    return met.where((F.col("s") <= F.col("pixel")) & (F.col("pixel") < F.col("e"))).select(*frame, "pixel", "mask")


def duplicate_pairs(found: DataFrame, by: list[str], duplicate: float, shared: int) -> DataFrame:
    """by, a, b, share, frames: pairs whose median containment over the frames they share is high enough."""
    rates = found.groupBy(*by, "a", "b").agg(F.median("contain").alias("share"), F.count("*").alias("frames"))
    return rates.where((F.col("frames") >= shared) & (F.col("share") >= duplicate))

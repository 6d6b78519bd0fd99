"""Visibility of objects over time: runs, hiding and revisits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible_runs(pixels: DataFrame, min_pixels: int, min_run: int, min_gap: int, step: int = 1) -> DataFrame:
    """obj, start, end: runs of visible frames; short ones are dropped first, then those with short gaps are joined.

    min_run and min_gap are in raw frames, of which a sample is every ``step``-th; start and end are frame numbers.
    """
    least, apart = math.ceil(min_run / step), math.ceil(min_gap / step)
    w = Window.partitionBy("obj").orderBy("f")
    seen = pixels.where(F.col("px") >= min_pixels).withColumn("_island", F.col("f") / step - F.row_number().over(w))
    runs = (
        seen.groupBy("obj", "_island")
        .agg(F.min("f").alias("start"), F.max("f").alias("end"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
    by_start = Window.partitionBy("obj").orderBy("start")
    hole = (F.col("start") - F.lag("end").over(by_start)) / step - 1
    marked = runs.withColumn("_new", F.when(hole.isNull() | (hole >= apart), 1).otherwise(0))
    session = marked.withColumn("_session", F.sum("_new").over(by_start))
    return session.groupBy("obj", "_session").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_session")


def hide_revisit(runs: DataFrame) -> DataFrame:
    """obj, frame, kind (0 hidden, 1 revisited), gap: each pair of neighbouring runs gives both events."""
    after = F.lead("start").over(Window.partitionBy("obj").orderBy("start"))
    gaps = runs.withColumn("back", after).where(F.col("back").isNotNull()).withColumn("gap", F.col("back") - F.col("end"))
    hidden = gaps.select("obj", F.col("end").alias("frame"), F.lit(0).alias("kind"), "gap")
    return hidden.union(gaps.select("obj", F.col("back").alias("frame"), F.lit(1).alias("kind"), "gap"))


def pair_events(events: DataFrame) -> DataFrame:
    """obj, left, back: each hidden event with the object's next event."""
    w = Window.partitionBy("obj").orderBy("frame", "kind")
    return (
        events.withColumn("back", F.lead("frame").over(w))
        .where((F.col("kind") == 0) & F.col("back").isNotNull())
        .select("obj", F.col("frame").alias("left"), "back")
    )


def revisit_outcomes(gaps: DataFrame, matches: DataFrame, window: int) -> DataFrame:
    """obj, left, back, outcome: kept if the last id before hiding is the first after return; else switched or missed.

    gaps: obj, left, back. matches: obj, frame, id. Ids are looked for within ``window`` frames; the range join is on
    blocks of that many frames.
    """
    block = lambda c: F.floor(c / window)
    near = matches.withColumn("_block", block(F.col("frame")))
    before = gaps.withColumn("_block", F.explode(F.sequence(block(F.col("left")) - 1, block(F.col("left")))))
    before = before.join(near, ["obj", "_block"]).where((F.col("frame") <= F.col("left")) & (F.col("frame") > F.col("left") - window))
    after = gaps.withColumn("_block", F.explode(F.sequence(block(F.col("back")), block(F.col("back")) + 1)))
    after = after.join(near, ["obj", "_block"]).where((F.col("frame") >= F.col("back")) & (F.col("frame") < F.col("back") + window))
    key = ["obj", "left", "back"]
    last = before.groupBy(*key).agg(F.max(F.struct("frame", "id"))["id"].alias("old"))
    first = after.groupBy(*key).agg(F.min(F.struct("frame", "id"))["id"].alias("new"))
    both = gaps.join(last, key, "left").join(first, key, "left")
    missed = F.col("old").isNull() | F.col("new").isNull()
    return both.select(
        *key, F.when(missed, "missed").when(F.col("old") == F.col("new"), "kept").otherwise("switched").alias("outcome")
    )

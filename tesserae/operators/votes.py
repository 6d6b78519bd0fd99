"""Label votes, modes and numbering of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.plan import global_index


def label_vote(votes: DataFrame) -> DataFrame:
    """node, prompt, total: the prompt with the highest summed score, ties to the smaller prompt."""
    sums = votes.groupBy("node", "prompt").agg(F.sum("score").alias("total"))
    best = sums.groupBy("node").agg(F.max(F.struct("total", (-F.col("prompt")).alias("less"))).alias("b"))
    return best.select("node", (-F.col("b.less")).alias("prompt"), F.col("b.total").alias("total"))


def weighted_label(votes: DataFrame, cosine: DataFrame, scale: float) -> DataFrame:
    """node, prompt: votes times exp(scale * (cosine - best cosine of the node)). cosine: node, prompt, cosine."""
    sums = votes.groupBy("node", "prompt").agg(F.sum("score").alias("total"))
    top = cosine.groupBy("node").agg(F.max("cosine").alias("_top"))
    weighed = sums.join(cosine, ["node", "prompt"]).join(top, "node")
    weight = F.col("total") * F.exp(scale * (F.col("cosine") - F.col("_top")))
    best = weighed.groupBy("node").agg(F.max(F.struct(F.round(weight, 9).alias("w"), (-F.col("prompt")).alias("less"))).alias("b"))
    return best.select("node", (-F.col("b.less")).alias("prompt"))


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n: the commonest value of each group, ties to the smallest."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.max(F.struct("n", (-F.col(value)).alias("less"))).alias("b"))
    return best.select(by, (-F.col("b.less")).alias(value), F.col("b.n").alias("n"))


def renumber(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Ids numbered 0, 1, ... in order."""
    return rows.join(global_index(rows, column, out), column)


def offset_clips(tracks: DataFrame) -> DataFrame:
    """clip, sam_id, track: ids of later clips follow those of earlier ones."""
    spans = tracks.groupBy("clip").agg((F.max("sam_id") + 1).alias("_n"))
    w = Window.orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return tracks.join(starts, "clip").select("clip", "sam_id", (F.col("sam_id") + F.col("_start")).alias("track"))


def multi_clip(rows: DataFrame) -> DataFrame:
    """node, clips: objects seen in more than one clip."""
    return rows.groupBy("node").agg(F.countDistinct("clip").alias("clips")).where(F.col("clips") > 1)


def unaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one of two row-aligned tables holds."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return only.union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))

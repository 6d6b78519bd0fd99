"""Relations between object boxes: on, near, nearest, position and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import box
from tesserae.functions.plan import grid_pairs, prefixed, small_side

CELL = 1.0


def close_pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """a_*, b_* with a < b of one run whose boxes lie within ``reach`` on each axis."""
    pairs = grid_pairs(prefixed(nodes, "a_", ["run"]), prefixed(nodes, "b_", ["run"]), CELL, reach, ["run"])
    return pairs.where(F.col("a_node") < F.col("b_node"))


def gap_pairs(nodes: DataFrame, most: float) -> DataFrame:
    return (
        close_pairs(nodes, most)
        .withColumn("gap", box.gap("a_", "b_"))
        .where(F.col("gap") <= most)
        .select("run", F.col("a_node").alias("a"), F.col("b_node").alias("b"), "gap")
    )


def edges(nodes: DataFrame) -> DataFrame:
    """run, a, b, relation, gap. A resting pair is ``on`` with a on b; other pairs within NEAR are ``near``, a < b."""
    able = nodes.where(box.takes_part("", F.col("label")))
    reach = max(box.NEAR, box.SINK)
    pairs = close_pairs(able.drop("label"), reach).withColumn("gap", box.gap("a_", "b_"))
    up, down = box.rests_on("a_", "b_"), box.rests_on("b_", "a_")
    relation = F.when(up | down, "on").when(F.col("gap") <= box.NEAR, "near")
    return pairs.select(
        "run",
        F.when(~up & down, F.col("b_node")).otherwise(F.col("a_node")).alias("a"),
        F.when(~up & down, F.col("a_node")).otherwise(F.col("b_node")).alias("b"),
        relation.alias("relation"),
        "gap",
    ).where(F.col("relation").isNotNull())


def listing(found: DataFrame) -> DataFrame:
    """run, place and the edge: resting pairs first, then by ends."""
    order = Window.partitionBy("run").orderBy(F.col("relation") != "on", "a", "b")
    return found.withColumn("place", F.row_number().over(order))


def edge_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("relation").agg(F.count("*").alias("n"))


def neighbours(found: DataFrame) -> DataFrame:
    """run, node, relation (on, under, near), other: each edge from both ends."""
    back = F.when(F.col("relation") == "on", "under").otherwise(F.col("relation"))
    return found.select("run", F.col("a").alias("node"), "relation", F.col("b").alias("other")).union(
        found.select("run", F.col("b").alias("node"), back.alias("relation"), F.col("a").alias("other"))
    )


def related(found: DataFrame, anchors: DataFrame, relation: str) -> DataFrame:
    """run, node, anchor, gap: for each node its best edge to an anchor; ``near`` takes every kind of edge.

    For ``on`` the anchor is what is rested on. Ties go to the earlier edge (on first, then ends), a-side first.
    """
    forth = found.select("run", F.col("a").alias("node"), F.col("b").alias("anchor"), "relation", "gap", F.lit(0).alias("side"))
    back = found.select("run", F.col("b").alias("node"), F.col("a").alias("anchor"), "relation", "gap", F.lit(1).alias("side"))
    both = forth.where(F.col("relation") == "on") if relation == "on" else forth.union(back)
    mine = both.join(anchors.select("run", F.col("node").alias("anchor")).distinct(), ["run", "anchor"], "left_semi")
    order = Window.partitionBy("run", "node").orderBy("gap", F.col("relation").desc(), "anchor", "side")
    return mine.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("run", "node", "anchor", "gap")


def nearest(nodes: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """run, anchor, node, rank: the k boxes nearest to each run's anchor by (gap in hundredths, centre, id)."""
    a = prefixed(anchors, "a_", ["run"])
    met = prefixed(nodes.where(box.finite("")), "b_", ["run"]).join(small_side(a, 10_000), "run")  # an anchor for each run
    order = Window.partitionBy("run").orderBy("g", "c", "b_node")
    return (
        met.where(F.col("a_node") != F.col("b_node"))
        .select(
            "run",
            "a_node",
            "b_node",
            F.round(box.gap("a_", "b_") * 100, 3).alias("hundredths"),
            box.centre_distance("a_", "b_").alias("c"),
        )
        .withColumn("g", F.rint("hundredths"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("run", F.col("a_node").alias("anchor"), F.col("b_node").alias("node"), "rank")
    )


def at_position(nodes: DataFrame, point: tuple[float, float, float], k: int) -> DataFrame:
    """run, node, distance, rank: the k boxes of each run nearest to a point."""
    order = Window.partitionBy("run").orderBy("distance", "node")
    return (
        nodes.where(box.finite(""))
        .select("run", "node", box.point_distance("", point).alias("distance"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def containment_pairs(nodes: DataFrame, least: float) -> DataFrame:
    return (
        close_pairs(nodes, 0.0)
        .withColumn("share", box.containment("a_", "b_"))
        .where(F.col("share") >= least)
        .select("run", F.col("a_node").alias("a"), F.col("b_node").alias("b"), "share")
    )

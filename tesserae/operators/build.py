"""From masks to a saved graph: observations, the refinement chain, and renumbering.

Tables: masks (run, mask, frame, track, prompt, score, node, reliable), points (run, mask, x, y, z), looks (run, mask,
dino), runs (run, frame, mask, s, e). Between the greedy steps, which run a recording each, candidates are made by joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.plan import cut
from tesserae.functions.vec import norm, vector_sum
from tesserae.operators import masks as mask_ops
from tesserae.operators import refine


def observations(masks: DataFrame, groups: DataFrame, looks: DataFrame, points: DataFrame) -> DataFrame:
    """run, frame, group, tracks, prompt, dino, reliable, n_points and box: one row for each group of a frame's masks.

    groups: run, frame, mask, group. The look and the box are of the reliable masks if there is one, else of all; the
    prompt has the most score, ties to the smaller.
    """
    key = ["run", "frame", "group"]
    rows = masks.join(groups, ["run", "frame", "mask"])
    trusted = rows.groupBy(*key).agg(F.max(F.col("reliable").cast("int")).alias("_any"))
    base = rows.join(trusted, key).withColumn("_use", (F.col("_any") == 0) | F.col("reliable"))
    used = base.where("_use").select(*key, "run", "mask").select(*key, "mask")
    sums = vector_sum(used.join(looks, ["run", "mask"]), key, "dino")
    look = sums.select(*key, F.transform("total", lambda x: x / F.greatest(norm(F.col("total")), F.lit(1e-9))).alias("dino"))
    box = used.join(points, ["run", "mask"]).groupBy(*key).agg(
        F.count("*").alias("n_points"),
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {k})").alias(e + k) for k in "xyz" for e, q in (("l", 0.02), ("h", 0.98))],
    )
    votes = rows.groupBy(*key, "prompt").agg(F.sum("score").alias("s"))
    best = votes.groupBy(*key).agg((-F.max(F.struct("s", (-F.col("prompt")).alias("less")))["less"]).alias("prompt"))
    tracks = base.groupBy(*key).agg(F.array_sort(F.collect_set("track")).alias("tracks"), (F.max("_any") > 0).alias("reliable"))
    return reduce(lambda a, b: a.join(b, key, "left"), (tracks, best, look, box))


def split(masks: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """masks with their nodes after the split, and run, node, family (the object that was split)."""
    good = masks.where(F.col("reliable") & (F.col("node") >= 0))
    enough = good.groupBy("run", "node").agg(F.count("*").alias("n")).where("n >= 2").select("run", "node")
    cloud = points.join(good.join(enough, ["run", "node"], "left_semi").select("run", "node", "mask"), ["run", "mask"])
    parts = cut(refine.split_clusters(cloud.select("run", "node", "mask", "x", "y", "z"), ["run", "node"]))
    several = parts.groupBy("run", "node").agg(F.countDistinct("part").alias("n")).where("n > 1").select("run", "node")
    asked = masks.join(several, ["run", "node"], "left_semi")
    whole = refine.place_rest(parts.join(several, ["run", "node"], "left_semi"), asked.select("run", "node", "mask", "frame", "track"), ["run", "node"])
    sizes = whole.groupBy("run", "node", "part").agg(F.count("*").alias("n"))
    by_size = Window.partitionBy("run", "node").orderBy(F.col("n").desc(), "part")
    ranked = sizes.withColumn("k", F.row_number().over(by_size) - 1)
    top = masks.groupBy("run").agg((F.max("node") + 1).alias("next"))
    fresh = ranked.where("k > 0").withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("node", "k")) - 1)
    named = ranked.where("k = 0").select("run", "node", "part", F.col("node").alias("new")).unionByName(
        fresh.join(top, "run").select("run", "node", "part", (F.col("next") + F.col("i")).alias("new"))
    )
    moved = whole.join(named, ["run", "node", "part"]).select("run", "mask", F.col("new"))
    out = masks.join(moved, ["run", "mask"], "left").withColumn("node", F.coalesce("new", "node")).drop("new")
    return cut(out), cut(named.select("run", F.col("new").alias("node"), F.col("node").alias("family")))


def object_facts(masks: DataFrame, points: DataFrame, looks: DataFrame) -> DataFrame:
    """run, node, label, masks, frames, dino (summed), cloud and box of each object."""
    live = masks.where(F.col("node") >= 0)
    key = ["run", "node"]
    facts = live.groupBy(*key).agg(F.count("*").alias("masks"), F.array_sort(F.collect_set("frame")).alias("frames"))
    sums = live.groupBy(*key, "prompt").agg(F.sum("score").alias("s"))
    label = sums.groupBy(*key).agg((-F.max(F.struct("s", (-F.col("prompt")).alias("less")))["less"]).alias("label"))
    dino = vector_sum(live.select(*key, "mask").join(looks, ["run", "mask"]), key, "dino", "dino")
    good = live.where("reliable").select(*key, "mask").join(points, ["run", "mask"])
    cuts = F.array(F.lit(0.005), F.lit(0.995))
    cloud = good.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias("cloud"), *[F.percentile(k, cuts).alias(f"b{k}") for k in "xyz"]
    )
    return reduce(lambda a, b: a.join(b, key, "left"), (facts, label, dino, cloud))


def _greedy(facts: DataFrame, rates: DataFrame | None, families: DataFrame, step) -> DataFrame:
    """run, node, kept from ``step(facts of a run, rates of it, apart groups)``."""
    kind = facts.schema["run"].dataType.simpleString()
    rates = facts.sparkSession.createDataFrame([], f"run {kind}, rate double, a bigint, b bigint") if rates is None else rates
    held = facts.join(families, ["run", "node"], "left")
    other = rates.select(F.col("run").alias("_run"), "rate", "a", "b")

    def one(things: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(things):
            return pd.DataFrame(columns=["run", "node", "kept"])
        apart = [set(g["node"]) for _, g in things.dropna(subset="family").groupby("family")]
        final = step(things.set_index("node"), list(zip(pairs["rate"], pairs["a"], pairs["b"], strict=True)), apart)
        return pd.DataFrame({"run": things["run"].iloc[0], "node": list(final), "kept": list(final.values())})

    return held.groupBy("run").cogroup(other.groupBy("_run")).applyInPandas(one, f"run {kind}, node bigint, kept bigint")


def _box(t) -> np.ndarray:
    return np.array([[np.nan if t[f"b{k}"] is None else t[f"b{k}"][i] for k in "xyz"] for i in (0, 1)], dtype=float)


def apply_merges(masks: DataFrame, merged: DataFrame) -> DataFrame:
    kept = merged.select("run", "node", "kept")
    return cut(masks.join(kept, ["run", "node"], "left").withColumn("node", F.coalesce("kept", "node")).drop("kept"))


def refine_runs(masks: DataFrame, points: DataFrame, looks: DataFrame, runs: DataFrame, sightings=None, trust: DataFrame | None = None) -> DataFrame:
    """masks with final nodes (-1: dropped) and label, by split, duplicates, parts, consensus and trust.

    ``sightings(masks)`` gives run, frame, node, masks (that hold it) for the consensus; ``trust`` has run, node,
    coverage, views, arc and tiny of the objects for the last step. Both steps are left out where they are not given.
    """
    masks, families = split(masks, points)
    facts = cut(object_facts(masks, points, looks))
    label = facts.select("run", "node", "label")

    node_runs = runs.join(masks.where("node >= 0").select("run", "mask", "node"), ["run", "mask"])
    shares = mask_ops.pairs(node_runs.select("run", "frame", F.col("node").alias("mask"), "s", "e"), ["run", "frame"])
    same = shares.join(label.select("run", F.col("node").alias("a"), F.col("label").alias("la")), ["run", "a"]).join(
        label.select("run", F.col("node").alias("b"), F.col("label").alias("lb")), ["run", "b"]
    )
    rates = mask_ops.duplicate_pairs(same.where("la = lb"), ["run"], refine.DUPLICATE, refine.SHARED)

    def duplicates(t, pairs, apart):
        boxes = {n: _box(r) for n, r in t.iterrows()}
        return refine.duplicate_merge(pairs, t["masks"].to_dict(), apart, boxes)[0]

    masks = apply_merges(masks, _greedy(facts, rates.select("run", F.col("share").alias("rate"), "a", "b"), families, duplicates))

    def wholes(t, _pairs, apart):
        things = {}
        for n, r in t.iterrows():
            cloud = np.array(list(r["cloud"]), dtype=float) if r["cloud"] is not None else np.full((1, 3), np.inf)
            things[n] = {"label": r["label"], "box": _box(r), "frames": set(r["frames"]), "masks": r["masks"], "dino": np.asarray(r["dino"], float), "points": cloud}
        return refine.merge_parts(things, apart)[0]

    live = object_facts(masks, points, looks).drop("label", "bx", "by", "bz")
    live = live.join(facts.select("run", "node", "label", "bx", "by", "bz"), ["run", "node"])
    masks = apply_merges(masks, _greedy(live, None, families, wholes))

    if sightings is not None:
        live = object_facts(masks, points, looks).drop("label").join(label, ["run", "node"])
        seen = sightings(masks).join(label, ["run", "node"])
        of_label = masks.select("run", F.col("mask").alias("_m"), F.col("prompt").alias("_p"))
        held = seen.select("*", F.explode_outer("masks").alias("_m")).join(of_label, ["run", "_m"], "left")
        held = held.groupBy("run", "frame", "node", "label").agg(F.collect_set(F.when(F.col("_p") == F.col("label"), F.col("_m"))).alias("masks"))
        agreed = refine.consensus_pairs(held, ["run"])

        def consensus(t, pairs, apart):
            return refine.consensus_merge(pairs, t["masks"].to_dict(), {n: set(f) for n, f in t["frames"].items()}, apart)[0]

        masks = apply_merges(masks, _greedy(live, agreed.select("run", "rate", "a", "b"), families, consensus))

    if trust is not None:
        n = masks.where("node >= 0").groupBy("run", "node").agg(F.count("*").alias("masks"))
        facts_ = n.join(trust, ["run", "node"], "left")
        reasons = refine.drop_reasons(F.col("masks"), F.coalesce("tiny", F.lit(False)), F.col("coverage"), F.coalesce("views", F.lit(0)), F.coalesce("arc", F.lit(0.0)))
        gone = facts_.select("run", "node", reasons.alias("reasons")).where(F.size("reasons") > 0).select("run", "node", F.lit(True).alias("_gone"))
        masks = masks.join(gone, ["run", "node"], "left").withColumn("node", F.when(F.col("_gone"), -1).otherwise(F.col("node"))).drop("_gone")
    return masks.join(label, ["run", "node"], "left")


def renumber_runs(masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """masks with nodes numbered 0, 1, ... in each run (-1 stays), and run, old, node."""
    ids = masks.where("node >= 0").select("run", F.col("node").alias("old")).distinct()
    numbers = ids.withColumn("node", (F.row_number().over(Window.partitionBy("run").orderBy("old")) - 1).cast("bigint"))
    out = masks.withColumnRenamed("node", "old").join(numbers, ["run", "old"], "left")
    return out.withColumn("node", F.coalesce("node", F.lit(-1).cast("bigint"))).drop("old"), numbers


def saved_node(before: DataFrame, after: DataFrame) -> DataFrame:
    """run, old, node: the saved object that holds most of a memory object's masks, ties to the smaller. Both: run, mask, node."""
    both = before.select("run", "mask", F.col("node").alias("old")).join(after.where("node >= 0").select("run", "mask", "node"), ["run", "mask"])
    n = both.groupBy("run", "old", "node").agg(F.count("*").alias("n"))
    return n.groupBy("run", "old").agg((-F.max(F.struct("n", (-F.col("node")).alias("less")))["less"]).alias("node"))

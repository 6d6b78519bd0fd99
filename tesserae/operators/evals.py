"""Scoring against ground truth: identity, owners, retrieval and nearest objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import box
from tesserae.functions.plan import prefixed

BOX = ("lx", "ly", "lz", "hx", "hy", "hz")


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Row, column pairs of a one-to-one assignment with the largest total weight (shortest augmenting paths)."""
    w = np.asarray(weight, dtype=float)
    turned = w.shape[0] > w.shape[1]
    cost = -(w.T if turned else w)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    of_column = np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        i, j, shift = row, -1, 0.0
        while True:
            reach = shift + cost[i] - u[i] - v
            better = ~done & (reach < least)
            least[better], back[better] = reach[better], j
            j = int(np.where(done, np.inf, least).argmin())
            shift = least[j]
            done[j] = True
            if of_column[j] < 0:
                break
            i = of_column[j]
        u[row] += shift
        for c in np.flatnonzero(done):
            if of_column[c] >= 0 and c != j:
                u[of_column[c]] += shift - least[c]
            v[c] -= shift - least[c]
        while j >= 0:
            of_column[j] = of_column[back[j]] if back[j] >= 0 else row
            j = back[j]
    pairs = [(int(r), c) for c, r in enumerate(of_column.tolist()) if r >= 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def identity(pairs: DataFrame, predicted: DataFrame, truth: DataFrame, by: str = "run") -> DataFrame:
    """by, idtp, predicted, truth, idf1, idp, idr: best one-to-one assignment of ids over matched frames.

    pairs: by, id, obj, n (frames in which they match). predicted, truth: by, n (masks counted). Scenes go in parallel.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="id", columns="obj", values="n", aggfunc="sum", fill_value=0)
        w = table.to_numpy(float)
        return pd.DataFrame({by: [rows[by].iloc[0]], "idtp": [int(sum(w[r, c] for r, c in assign(w)))]})

    kind = pairs.schema[by].dataType.simpleString()
    best = pairs.groupBy(by).applyInPandas(one, f"{by} {kind}, idtp bigint")
    counts = predicted.select(by, F.col("n").alias("np")).join(truth.select(by, F.col("n").alias("ng")), by, "full_outer")
    both = counts.join(best, by, "left").na.fill(0, ["idtp", "np", "ng"])
    share = lambda n: F.col("idtp") / F.greatest(n, F.lit(1))
    return both.select(
        by, "idtp", "np", "ng", (2 * share(F.col("np") + F.col("ng"))).alias("idf1"), share(F.col("np")).alias("idp"),
        share(F.col("ng")).alias("idr"),
    )


def owners(pairs: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, a, owner: each prediction's commonest best-overlapping object, the first seen on ties.

    pairs: by, frame, a (prediction), b (object), iou.
    """
    best = pairs.where(F.col("iou") >= least).groupBy(*by, "frame", "a").agg(
        F.max(F.struct("iou", (-F.col("b")).alias("less"))).alias("x")
    )
    votes = best.select(*by, "frame", "a", (-F.col("x.less")).alias("b"))
    counts = votes.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    key = F.struct("n", (-F.col("first")).alias("f"), (-F.col("b")).alias("less"))
    return counts.groupBy(*by, "a").agg(F.max(key).alias("x")).select(*by, "a", (-F.col("x.less")).alias("owner"))


def average_precision(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """query, ap, top1: precision at each target's first hit, over all targets; later hits of it are misses.

    ranked: query, rank, obj (null: none). targets: query, obj.
    """
    asked = targets.select("query", "obj").distinct()
    hits = ranked.join(asked, ["query", "obj"]).groupBy("query", "obj").agg(F.min("rank").alias("rank"))
    found = hits.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("rank", "obj")))
    score = found.groupBy("query").agg(F.sum(F.col("k") / F.col("rank")).alias("s"), F.min("rank").alias("best"))
    n = asked.groupBy("query").agg(F.count("*").alias("n"))
    both = n.join(score, "query", "left")
    ap = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n")
    return both.select("query", ap.alias("ap"), F.coalesce(F.col("best") == 1, F.lit(False)).alias("top1"))


def nearest_hits(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """anchor, hit: whether the nearest predicted object of a class is the nearest true one. Both: anchor, obj."""
    both = truth.select("anchor", F.col("obj").alias("true")).join(answers, "anchor", "left")
    return both.select("anchor", F.coalesce(F.col("obj") == F.col("true"), F.lit(False)).alias("hit"))


def report(results: DataFrame) -> DataFrame:
    """method, runs, mean of every score over runs, unknown ones left out."""
    scores = [c for c in results.columns if c not in ("method", "run")]
    return results.groupBy("method").agg(F.count("*").alias("runs"), *[F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in scores])


def _first(pairs: DataFrame, by: list[str], out: str) -> DataFrame:
    """by and the id of the nearest candidate: hundredths of the gap, then centre distance, then id."""
    best = F.min(F.struct(F.rint(F.round(F.col("gap") * 100, 3)).alias("g"), F.col("away").alias("c"), F.col("id").alias("id")))
    return pairs.groupBy(*by).agg(best["id"].alias(out))


def nearest_objects(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """run, labels, oracle, anchor, reach, queries: how often the map finds the nearest object of a class.

    truth: run, object, class, lx ... hz of the objects seen. nodes: run, node, label, frames, owner (the object it
    stands for, or null), owner_class, lx ... hz. Every object asks for the nearest of each class that has at least two
    others; the anchor is its node with the most frames. Candidates are the nodes with that label, or (oracle) those
    that stand for an object of that class, never those that stand for the asking object.
    """
    a = prefixed(truth, "a_", ["run"])
    b = prefixed(truth, "b_", ["run"]).where(box.finite("b_"))
    met = a.join(b, "run").where(F.col("a_object") != F.col("b_object"))
    pairs = met.select("run", F.col("a_object").alias("object"), F.col("b_class").alias("class"), F.col("b_object").alias("id"), box.gap("a_", "b_").alias("gap"), box.centre_distance("a_", "b_").alias("away"))
    enough = pairs.groupBy("run", "object", "class").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    asked = _first(pairs, ["run", "object", "class"], "answer").join(enough, ["run", "object", "class"], "left_semi")

    owned = nodes.where(F.col("owner").isNotNull())
    best = F.max(F.struct("frames", (-F.col("node")).alias("less")))
    anchors = owned.groupBy("run", "owner").agg((-best["less"]).alias("anchor"))
    asked = asked.join(anchors.withColumnRenamed("owner", "object"), ["run", "object"], "left")
    there = owned.select("run", F.col("owner").alias("answer"), F.lit(True).alias("there")).distinct()
    asked = asked.join(there, ["run", "answer"], "left")

    left = prefixed(nodes.select("run", "node", *BOX), "a_", ["run"]).withColumnRenamed("a_node", "anchor")
    right = prefixed(nodes.where(box.finite("")).select("run", "node", "label", "owner", "owner_class", *BOX), "b_", ["run"])
    hits = {}
    for name, kind in (("labels", "b_label"), ("oracle", "b_owner_class")):
        near = asked.where("anchor is not null").join(left, ["run", "anchor"]).join(right, "run")
        near = near.where((F.col(kind) == F.col("class")) & ~F.col("b_owner").eqNullSafe(F.col("object")) & (F.col("b_node") != F.col("anchor")))
        near = near.select("run", "object", "class", F.col("b_node").alias("id"), box.gap("a_", "b_").alias("gap"), box.centre_distance("a_", "b_").alias("away"))
        got = _first(near, ["run", "object", "class"], "node").join(nodes.select("run", "node", "owner"), ["run", "node"])
        hits[name] = got.select("run", "object", "class", F.col("owner").alias(name))
    both = asked.join(hits["labels"], ["run", "object", "class"], "left").join(hits["oracle"], ["run", "object", "class"], "left")
    right_ = lambda c: F.avg(F.coalesce(F.col(c) == F.col("answer"), F.lit(False)).cast("int"))
    known = F.col("anchor").isNotNull()
    return both.groupBy("run").agg(
        right_("labels").alias("labels"), right_("oracle").alias("oracle"), F.avg(known.cast("int")).alias("anchor"),
        F.avg((known & F.coalesce("there", F.lit(False))).cast("int")).alias("reach"), F.count("*").alias("queries"),
    )

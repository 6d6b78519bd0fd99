"""From saved stages to a saved graph: nodes, observations, replay through the object memory, finishing, rebuilding.

Tables carry a column ``run``. masks: run, mask, frame, track, prompt, score. boxes: run, mask, n_points, conf and bounds.
points: run, mask, x, y, z (or none: then a mask's points are its box's corners). looks: run, mask, dino. texts: run, mask,
siglip. vocab: prompt, label.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.plan import cut
from tesserae.functions.vec import norm, vector_sum
from tesserae.operators import build, masks as mask_ops, points as point_ops, refine, votes
from tesserae.operators.memory import ObjectMemory, Observation
from tesserae.sources import stages

BOX = ("lx", "ly", "lz", "hx", "hy", "hz")
NODE = ["run", "node"]
#: Masks of a frame that overlap this much are one observation.
SAME = 0.6


def mask_points(boxes: DataFrame, points: DataFrame | None) -> DataFrame:
    """run, mask, x, y, z: the stored points, or the two corners of the box."""
    if points is not None:
        return points.select("run", "mask", "x", "y", "z")
    corner = lambda e: F.struct(*[F.col(e + k).cast("double").alias(k) for k in "xyz"])
    both = boxes.where("n_points > 0").select("run", "mask", F.explode(F.array(corner("l"), corner("h"))).alias("p"))
    return both.select("run", "mask", "p.*")


def node_boxes(assigned: DataFrame, boxes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """run, node and bounds: the trimmed box of the pooled points of reliable masks; else the most confident mask's box.

    assigned: run, mask, node. Nodes without any box have null bounds.
    """
    live = assigned.where(F.col("node") >= 0).select("run", "mask", "node")
    held = live.join(boxes, ["run", "mask"])
    return point_ops.node_box(held, NODE, mask_points(boxes, points)).join(live.select(*NODE).distinct(), NODE, "right")


def build_nodes(masks: DataFrame, assigned: DataFrame, boxes: DataFrame, vocab: DataFrame, points: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """run, node, label, bounds, masks, frames, tracks (sorted arrays) of every node; masks with node -1 are left out.

    saved: run, node, prompt and bounds of a finished graph, which go before what the masks say.
    """
    live = masks.join(assigned.where(F.col("node") >= 0).select("run", "mask", "node"), ["run", "mask"])
    lists = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("mask", "masks"), ("frame", "frames"), ("track", "tracks"))]
    held = live.groupBy(*NODE).agg(*lists)
    if saved is None:
        scored = live.groupBy(*NODE, "prompt").agg(F.sum("score").alias("s"))
        prompt = scored.groupBy(*NODE).agg((-F.max(F.struct("s", (-F.col("prompt")).alias("less")))["less"]).alias("prompt"))
        saved = prompt.join(node_boxes(assigned, boxes, points), NODE)
    named = saved.join(F.broadcast(vocab.select("prompt", "label")), "prompt", "left")  # a vocabulary is a few hundred rows
    return held.join(named, NODE, "left").select(*NODE, "label", *BOX, "masks", "frames", "tracks")


def mask_vocab(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """prompt, label: the prompts that the run's masks were made with, from the stage's parameters."""
    entry = stages.log(spark, root).where((F.col("run_id") == run_id) & (F.col("stage") == "masks"))
    words = F.from_json("params", "vocab array<string>")["vocab"]
    return entry.select(F.posexplode(words).alias("prompt", "label"))


def _stage_tables(spark: SparkSession, root: str, run_id: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Saved stages in the shape of this module."""
    key = [F.col("run_id").alias("run"), F.col("mask_id").alias("mask")]
    shapes = {
        "masks": [*key, "frame", F.col("sam_id").alias("track"), "prompt", "score", "counts"],
        "boxes": [*key, "n_points", "conf", *[F.col(e)[i].cast("double").alias(e[0] + k) for e in ("lo", "hi") for i, k in enumerate("xyz")]],
        "features": [*key, "dino"],
        "siglip": [*key, "siglip"],
        "graph": [*key, "node"],
    }
    return {n: stages.load(spark, root, n, run_id).select(*shapes[n]) for n in names}


def load_nodes(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The nodes of a run's saved graph, the table that every search begins with."""
    t = _stage_tables(spark, root, run_id, ("masks", "boxes", "graph"))
    return build_nodes(t["masks"], t["graph"], t["boxes"], mask_vocab(spark, root, run_id))


INPUTS = ("masks", "boxes", "features", "siglip")


def cached_observations(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The stages that a graph is made of, and the vocabulary; an error if one is missing, older than masks, or unaligned."""
    entries = {r["stage"]: r["saved_at"] for r in stages.log(spark, root).where(F.col("run_id") == run_id).collect()}
    missing = [n for n in INPUTS if n not in entries]
    if missing:
        raise FileNotFoundError(f"stages of {run_id} are missing: {', '.join(missing)}")
    older = [n for n in INPUTS if entries[n] < entries["masks"]]
    if older:
        raise ValueError(f"stages of {run_id} are older than masks: {', '.join(older)}")
    tables = _stage_tables(spark, root, run_id, INPUTS)
    tables["vocab"] = mask_vocab(spark, root, run_id)
    check_inputs(tables["masks"], [tables[n] for n in INPUTS[1:]], tables["vocab"])
    return tables


def check_inputs(masks: DataFrame, others: list[DataFrame], vocab: DataFrame) -> None:
    """Every stage has exactly the masks' rows, and every prompt is in the vocabulary."""
    for other in others:
        if not votes.unaligned(masks, other, "mask").isEmpty():
            raise ValueError("all observation stages must be row-aligned")
    if not masks.join(vocab, "prompt", "left_anti").isEmpty():
        raise ValueError("mask prompt outside the vocabulary")


def observation_groups(masks: DataFrame, runs: DataFrame, same: float = SAME) -> DataFrame:
    """run, frame, mask, group: masks of a frame that all overlap each other by ``same`` are one observation.

    runs: run, frame, mask, s, e.
    """
    pairs = mask_ops.pairs(runs, ["run", "frame"])
    return refine.complete_link_groups(masks, pairs, ["run", "frame"], same)


def observations(masks: DataFrame, groups: DataFrame, boxes: DataFrame, looks: DataFrame, texts: DataFrame, vocab: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row for each group: tracks, label, dino, siglip, reliable, n_points, conf, bounds and points.

    Look, box and points are of the group's reliable masks; without one the look is of all, and the box that of the mask
    with the most confident depth. siglip is the mean of all masks.
    """
    key = ["run", "frame", "group"]
    judged = masks.join(boxes.withColumn("reliable", point_ops.reliable(boxes)), ["run", "mask"], "left")
    judged = judged.withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    cloud = mask_points(boxes, points)
    base = build.observations(judged.select("run", "mask", "frame", "track", "prompt", "score", "reliable"), groups, looks, cloud)
    rows = judged.join(groups, ["run", "frame", "mask"])
    total = vector_sum(rows.select(*key, "mask", "run").select(*key, "mask").join(texts, ["run", "mask"]), key, "siglip", "total")
    text = total.select(*key, F.transform("total", lambda x: x / F.greatest(norm(F.col("total")), F.lit(1e-9))).alias("siglip"))
    sure = F.struct(F.coalesce("conf", F.lit(float("-inf"))).alias("c"), (-F.col("mask")).alias("m"))
    best = rows.where("n_points > 0").groupBy(*key).agg(F.max_by(F.struct("conf", "n_points", *BOX), sure).alias("best"))
    good = rows.where("reliable").select(*key, "mask").join(cloud, ["run", "mask"])
    pooled = good.groupBy(*key).agg(F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias("points"))
    both = reduce(lambda a, b: a.join(b, key, "left"), (base, text, best, pooled)).join(F.broadcast(vocab), "prompt", "left")
    own = F.col("reliable")
    bounds = [F.when(own, F.col(c)).otherwise(F.col(f"best.{c}")).alias(c) for c in BOX]
    n = F.when(own, F.col("n_points")).otherwise(F.coalesce(F.col("best.n_points"), F.lit(0))).cast("bigint").alias("n_points")
    return both.select(*key, "tracks", "label", "dino", "siglip", "reliable", n, F.col("best.conf").alias("conf"), *bounds, "points")


TRACE = (
    "run {run}, kind string, frame bigint, row bigint, node bigint, candidate bigint, via string, cut string, held boolean, "
    "reliable boolean, score double, n bigint"
)


def replay(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """The trace of a memory over each run's frames, also those without observations.

    rows: as ``observations`` gives them. frames: run, frame. A row's kind is ``match`` (an observation and the node it
    went to, as of the end), ``history`` (a frame: nodes, and n observations) or ``merge`` (node kept, candidate merged
    into it). Runs are independent; a run is replayed in one task because each frame depends on the one before.
    """
    kind = rows.schema["run"].dataType.simpleString()

    def seen(r) -> Observation:
        corners = np.asarray([getattr(r, c) for c in BOX], dtype=float).reshape(2, 3)
        held = None if r.points is None else np.stack([np.asarray(p, dtype=np.float32) for p in r.points])
        return Observation(
            r.dino, None if np.isnan(corners).any() else corners, int(r.n_points), r.label, tuple(int(t) for t in r.tracks),
            r.siglip, bool(r.reliable), held, float("nan") if pd.isna(r.conf) else float(r.conf),
        )

    def one(key, seen_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        memory, out = ObjectMemory(), []
        by_frame = dict(iter(seen_rows.sort_values(["frame", "group"]).groupby("frame"))) if len(seen_rows) else {}
        for frame in sorted({*by_frame, *asked["_frame"].tolist()}):
            held = by_frame.get(frame)
            here = [] if held is None else [seen(r) for r in held.itertuples(index=False)]
            memory.step(int(frame), here)
            for group, t in zip([] if held is None else held["group"], memory.trace, strict=True):
                out.append(("match", frame, group, t["object"], t["candidate"], t["via"], t["cut"], t["held"], t["reliable"], t["score"], None))
            out.append(("history", frame, None, len(memory.things), None, None, None, None, None, None, len(here)))
            out += [("merge", frame, None, m["kept"], m["merged"], None, None, None, None, m["score"], None) for m in memory.merges]
        names = ["kind", "frame", "row", "node", "candidate", "via", "cut", "held", "reliable", "score", "n"]
        table = pd.DataFrame(out, columns=names)
        for c in ("row", "node", "candidate", "n"):
            table[c] = table[c].astype("Int64")
        match = table["kind"] == "match"
        for c in ("node", "candidate"):
            table[c] = table[c].where(~match, table[c].map(lambda i: i if pd.isna(i) else memory.find(int(i)))).astype("Int64")
        table.insert(0, "run", key[0])
        return table

    plan = frames.select(F.col("run").alias("_run"), F.col("frame").cast("bigint").alias("_frame")).distinct()
    return rows.groupBy("run").cogroup(plan.groupBy("_run")).applyInPandas(one, TRACE.format(run=kind))


def memory_nodes(trace: DataFrame, groups: DataFrame) -> DataFrame:
    """run, mask, node: the memory's node of every mask, numbered without gaps in order of appearance."""
    placed = trace.where("kind = 'match'").select("run", "frame", F.col("row").alias("group"), F.col("node").alias("old"))
    return build.renumber_runs(groups.join(placed, ["run", "frame", "group"]).select("run", "mask", F.col("old").alias("node")))[0]


def finish(masks: DataFrame, assigned: DataFrame, boxes: DataFrame, looks: DataFrame, runs: DataFrame, points: DataFrame | None = None, sightings=None, trust: DataFrame | None = None):
    """(assigned, saved, moved): refined nodes numbered from 0 (-1: dropped) of every mask, the nodes' prompts and boxes,
    and run, old, node: the saved node that holds most of a memory node's masks."""
    cloud = mask_points(boxes, points)
    judged = masks.join(boxes.withColumn("reliable", point_ops.reliable(boxes)).select("run", "mask", "reliable"), ["run", "mask"], "left")
    held = judged.withColumn("reliable", F.coalesce("reliable", F.lit(False))).join(assigned, ["run", "mask"])
    held = held.select("run", "mask", "frame", "track", "prompt", "score", F.col("node").cast("bigint").alias("node"), "reliable")
    refined = cut(build.refine_runs(held, cloud, looks, runs, sightings, trust))
    numbered = cut(build.renumber_runs(refined.select("run", "mask", "node", "label"))[0])
    prompt = numbered.where("node >= 0").groupBy(*NODE).agg(F.max("label").alias("prompt"))
    final = numbered.select("run", "mask", "node")
    return final, prompt.join(node_boxes(final, boxes, points), NODE), build.saved_node(assigned, final)


def save_result(root: str, run_id: str, final: DataFrame, trace: DataFrame, moved: DataFrame, params: dict | None = None) -> None:
    """Write the run's traces, with the saved nodes beside the memory's, and then the graph stage and its log row.

    The log row comes last, so a graph counts as saved only with all that belongs to it.
    """
    keyed = moved.select("run", F.col("old").alias("node"), F.col("node").alias("saved"))
    for kind in ("match", "history", "merge"):
        rows = trace.where(F.col("kind") == kind)
        rows = rows if kind == "history" else rows.join(keyed, NODE, "left")
        rows.drop("kind").write.mode("overwrite").parquet(f"{root}/graph_{kind}/run_id={run_id}")
    out = final.select(F.col("run").cast("string").alias("run_id"), F.col("mask").alias("mask_id"), F.col("node").cast("int").alias("node"))
    stages.save(out, root, "graph", run_id, params)


def decoded_runs(masks: DataFrame) -> DataFrame:
    """run, frame, mask, s, e of masks with compressed ``counts``."""
    from tesserae.operators.geometry import decode_runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [decode_runs(c) for c in b["counts"]]
            n = [len(x) for x in each]
            flat = np.asarray([p for x in each for p in x], dtype=np.int64).reshape(-1, 2)
            yield b.drop(columns="counts").loc[b.index.repeat(n)].assign(s=flat[:, 0], e=flat[:, 1])

    keys = T.StructType([masks.schema[c] for c in ("run", "frame", "mask")])
    return masks.select("run", "frame", "mask", "counts").mapInPandas(run, keys.add("s", T.LongType()).add("e", T.LongType()))


def rebuild(spark: SparkSession, root: str, run_id: str, frames: DataFrame | None = None, save: bool = True, params: dict | None = None) -> dict[str, DataFrame]:
    """Replay a run's cached stages, refine, and save the graph: the one way from saved masks to a searchable map."""
    t = cached_observations(spark, root, run_id)
    masks, boxes, looks = t["masks"].withColumn("frame", F.col("frame").cast("bigint")), t["boxes"], t["features"]
    runs = cut(decoded_runs(masks))
    groups = cut(observation_groups(masks, runs))
    seen = observations(masks, groups, boxes, looks, t["siglip"], t["vocab"])
    trace = cut(replay(seen, masks.select("run", "frame") if frames is None else frames))
    in_memory = cut(memory_nodes(trace, groups))
    final, saved, moved = finish(masks, in_memory, boxes, looks, runs)
    if save:
        save_result(root, run_id, final, trace, moved, params or {"same": SAME})
    return {"graph": final, "nodes": build_nodes(masks, final, boxes, t["vocab"], saved=saved), "trace": trace, "moved": moved}


def vocab_params(labels: list[str]) -> dict:
    """Parameters with which the masks stage is saved, so that its prompts can be read back."""
    return {"vocab": json.loads(json.dumps(labels))}

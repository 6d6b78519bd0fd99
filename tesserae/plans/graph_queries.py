"""Queries over refinement, geometry, scoring, the object memory and its stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.operators import evals, geometry, masks, refine, truth
from tesserae.plans.mask_queries import FRAME, PAIRS
from tesserae.plans.registry import Registry
from tesserae.plans.scene_queries import EMB, _emb
from tesserae.sources import scene
from tesserae.streaming import object_memory as stream

register = Registry()

HELD = """held AS (SELECT run, frame, mask AS node, mask % 3 AS label, list_sort(list(DISTINCT s % 7)) AS masks FROM raw_runs GROUP BY ALL)"""


def _held(spark, sf_dir):
    rows = scene.mask_runs(spark, sf_dir)
    key = [*FRAME, F.col("mask").alias("node"), (F.col("mask") % 3).alias("label")]
    return rows.groupBy(*key).agg(F.collect_set(F.col("s") % 7).alias("masks"))


@register(f"""WITH {scene.RUNS}, {HELD},
c AS (SELECT a.run, a.node AS a, b.node AS b, count(*) AS observers, count(*) FILTER (WHERE list_has_any(a.masks, b.masks)) AS support
  FROM held a JOIN held b ON a.run = b.run AND a.frame = b.frame AND a.label = b.label AND a.node < b.node GROUP BY ALL)
SELECT run, a, b, observers, round(support / observers, 6) AS rate FROM c WHERE observers >= 3 AND support / observers >= 0.3""")
def consensus_pairs(spark, sf_dir):
    found = refine.consensus_pairs(_held(spark, sf_dir), ["run"], 3, 0.3)
    return found.withColumn("rate", F.round("rate", 6))


@register(f"""WITH {scene.RUNS}, f AS (SELECT DISTINCT run, frame, mask FROM raw_runs)
SELECT a.run, a.mask AS a, b.mask AS b, count(*) AS frames FROM f a JOIN f b ON a.run = b.run AND a.frame = b.frame AND a.mask < b.mask GROUP BY ALL""")
def frame_pair_support(spark, sf_dir):
    rows = scene.mask_runs(spark, sf_dir).select(*FRAME, F.col("mask").alias("node"))
    found = refine.apart_pairs(rows, ["run"], 0.0)
    return found.withColumnRenamed("shared", "frames")


@register(f"""WITH {scene.RUNS}, f AS (SELECT DISTINCT run, frame, mask FROM raw_runs), n AS (SELECT run, mask, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT a.run, a.mask AS a, b.mask AS b, count(*) AS shared FROM f a JOIN f b ON a.run = b.run AND a.frame = b.frame AND a.mask < b.mask GROUP BY ALL)
SELECT p.run, a, b, shared FROM p JOIN n x ON x.run = p.run AND x.mask = a JOIN n y ON y.run = p.run AND y.mask = b WHERE shared > 0.8 * least(x.n, y.n)""")
def seen_apart(spark, sf_dir):
    rows = scene.mask_runs(spark, sf_dir).select(*FRAME, F.col("mask").alias("node"))
    return refine.apart_pairs(rows, ["run"], 0.8)


@register("""WITH n AS (SELECT o_custkey AS node, count(*) AS masks, bool_and(o_totalprice < 100000) AS tiny,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey % 20) / 20 END AS coverage, count(*) FILTER (WHERE o_orderstatus = 'F') AS views,
  (o_custkey % 40)::DOUBLE AS arc FROM orders GROUP BY o_custkey),
r AS (SELECT node, unnest([CASE WHEN masks < 3 THEN 'few masks' END, CASE WHEN tiny THEN 'small and far' END,
  CASE WHEN coverage IS NULL OR coverage < 0.7 THEN 'inconsistent' END, CASE WHEN views < 10 THEN 'few views' END,
  CASE WHEN arc < 15 THEN 'narrow views' END]) AS reason FROM n)
SELECT node, reason FROM r WHERE reason IS NOT NULL""")
def drop_reasons(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders")
    nodes = rows.groupBy(F.col("o_custkey").alias("node")).agg(
        F.count("*").alias("masks"),
        F.bool_and(F.col("o_totalprice") < 100000).alias("tiny"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("views"),
    )
    coverage = F.when(F.col("node") % 9 != 0, (F.col("node") % 20) / 20)
    arc = (F.col("node") % 40).cast("double")
    reasons = refine.drop_reasons(F.col("masks"), F.col("tiny"), coverage, F.col("views"), arc)
    return nodes.select("node", F.explode(reasons).alias("reason"))


@register("""WITH a AS (SELECT DISTINCT o_custkey % 97 AS node, (o_orderkey * 37 % 360)::DOUBLE - 180 AS az FROM orders),
g AS (SELECT node, coalesce(lead(az) OVER w, first_value(az) OVER w + 360) - az AS gap FROM a WINDOW w AS (PARTITION BY node ORDER BY az))
SELECT node, round(CASE WHEN count(*) >= 2 THEN 360 - max(gap) ELSE 0 END, 6) AS arc FROM g GROUP BY node""")
def circular_arc(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders")
    azimuth = (F.col("o_orderkey") * 37 % 360).cast("double") - 180
    rays = rows.select((F.col("o_custkey") % 97).alias("node"), azimuth.alias("az")).distinct()
    return geometry.widest_gap_arc(rays, "node", "az").withColumn("arc", F.round("arc", 6))


@register("""WITH n AS (SELECT l_suppkey % 25 AS view, l_quantity - 25.5 AS x, l_discount * 100 - 5.5 AS y FROM lineitem),
s AS (SELECT view, sum(cos(4 * atan2(y, x))) AS c, sum(sin(4 * atan2(y, x))) AS s, count(*) AS n FROM n GROUP BY view)
SELECT view, round(atan2(s, c) / 4, 5) AS angle, round(sqrt(c * c + s * s) / n, 5) AS strength FROM s""")
def wall_direction(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "lineitem")
    normals = rows.select((F.col("l_suppkey") % 25).alias("view"), (F.col("l_quantity") - 25.5).alias("x"), (F.col("l_discount") * 100 - 5.5).alias("y"))
    found = geometry.wall_direction(normals, "view", "x", "y")
    return found.select("view", F.round("angle", 5).alias("angle"), F.round("strength", 5).alias("strength"))


@register("""WITH p AS (SELECT l_suppkey AS seq, pow(l_quantity - l_linenumber, 2) + pow(l_discount, 2) + pow(l_tax, 2) AS e FROM lineitem)
SELECT seq, round(sqrt(avg(e)), 6) AS rms FROM p GROUP BY seq""")
def camera_path_rms(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "lineitem")
    path = rows.select(F.col("l_suppkey").alias("seq"), "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("t"), F.lit(0.0).alias("zero"))
    found = truth.path_rms(path, ["seq"], ["l_quantity", "l_discount", "l_tax"], ["t", "zero", "zero"])
    return found.withColumn("rms", F.round("rms", 6))


@register("""SELECT l_suppkey AS seq, l_linenumber AS v, count(*) AS n,
  round(sum((l_quantity - 25) * l_discount * 10 / 600 + 1), 4) AS x, round(sum(-(l_linenumber - 4) * l_discount * 10 / 600 + 2), 4) AS y, round(sum(l_discount * 10 - 3), 4) AS z
FROM lineitem WHERE l_discount > 0 GROUP BY ALL""")
def backproject_sums(spark, sf_dir):
    """Pixels with depth to world points with column expressions: the camera looks along z, turned over in y."""
    rows = scene.read(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0)
    c2w = (1.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 2.0, 0.0, 0.0, 1.0, -3.0)
    u, v, z = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount") * 10
    x, y, w = geometry.backproject_columns(u, v, z, (600.0, 600.0, 25.0, 4.0), c2w)
    grouped = rows.groupBy(F.col("l_suppkey").alias("seq"), F.col("l_linenumber").alias("v"))
    sums = [F.round(F.sum(c), 4).alias(n) for c, n in ((x, "x"), (y, "y"), (w, "z"))]
    return grouped.agg(F.count("*").alias("n"), *sums)


@register("""SELECT node, count(*) AS rows FROM (SELECT c_custkey % 50 AS node FROM customer UNION ALL SELECT s_suppkey % 50 FROM supplier) GROUP BY node""")
def stage_union(spark, sf_dir):
    a = scene.read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("node"))
    b = scene.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("node"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("node").agg(F.count("*").alias("rows"))


@register(f"""WITH {PAIRS},
best AS (SELECT run, frame, a, b FROM pairs WHERE iou >= 0.02 QUALIFY row_number() OVER (PARTITION BY run, frame, a ORDER BY iou DESC, b) = 1),
n AS (SELECT run, a, b, count(*) AS n, min(frame) AS first FROM best GROUP BY ALL)
SELECT run, a, b AS owner FROM n QUALIFY row_number() OVER (PARTITION BY run, a ORDER BY n DESC, first, b) = 1""")
def owners(spark, sf_dir):
    return evals.owners(masks.pairs(scene.mask_runs(spark, sf_dir), FRAME), ["run"], 0.02)


@register(f"""WITH {EMB}, t AS (SELECT DISTINCT vec_id % 5 AS query, label AS obj FROM embeddings WHERE label % 3 = vec_id % 3),
h AS (SELECT t.query, t.obj, min(rank) AS rank FROM t JOIN ranked ON ranked.query = t.query AND ranked.id // 2 * 2 = t.obj GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, obj) AS k FROM h),
n AS (SELECT query, count(*) AS n FROM t GROUP BY query)
SELECT n.query, round(coalesce(sum(k / rank), 0) / any_value(n), 6) AS ap, coalesce(min(rank) = 1, false) AS top1 FROM n LEFT JOIN k USING (query) GROUP BY n.query""")
def ap_per_query(spark, sf_dir):
    ranked, rows = _emb(spark, sf_dir)
    mapped = ranked.select("query", "rank", (F.floor(F.col("id") / 2) * 2).cast("int").alias("obj"))
    targets = rows.where(F.col("label") % 3 == F.col("vec_id") % 3).select((F.col("vec_id") % 5).alias("query"), F.col("label").alias("obj"))
    return evals.average_precision(mapped, targets).withColumn("ap", F.round("ap", 6))


@register("""WITH t AS (SELECT p_brand AS anchor, min(p_partkey) AS obj FROM part GROUP BY 1), a AS (SELECT p_brand AS anchor, min(p_partkey) AS obj FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT t.anchor, coalesce(a.obj = t.obj, false) AS hit FROM t LEFT JOIN a USING (anchor)""")
def nearest_hit(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "part").select(F.col("p_brand").alias("anchor"), F.col("p_partkey").alias("obj"), "p_size")
    first = lambda df: df.groupBy("anchor").agg(F.min("obj").alias("obj"))
    return evals.nearest_hits(first(rows.where(F.col("p_size") % 2 == 0)), first(rows))


@register(f"WITH {EMB} SELECT id, count(*) AS n FROM ranked WHERE rank <= 3 GROUP BY id")
def top_match_counts(spark, sf_dir):
    ranked, _ = _emb(spark, sf_dir)
    return ranked.where(F.col("rank") <= 3).groupBy("id").agg(F.count("*").alias("n"))


@register("""SELECT o_orderpriority AS method, count(*) AS runs, round(avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END), 4) AS score FROM orders GROUP BY 1""")
def method_report(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders")
    score = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).otherwise(float("nan"))
    found = evals.report(rows.select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("run"), score.alias("score")))
    return found.withColumn("score", F.round("score", 4))


@register()
def complete_link_groups(spark, sf_dir):
    rows = scene.mask_runs(spark, sf_dir)
    score = rows.groupBy(*FRAME, "mask").agg((F.sum(F.col("e") - F.col("s")) / 1000.0).alias("score"))
    return refine.complete_link_groups(score, masks.pairs(rows, FRAME), FRAME, 0.05)


@register()
def split_clusters(spark, sf_dir):
    rows = scene.points(spark, sf_dir)
    cloud = rows.select("node", F.floor(F.col("y") / 8192).alias("mask"), (F.col("x") / 25).alias("x"), (F.col("y") / 50000).alias("y"), (F.col("z") * 5).alias("z"))
    return refine.split_clusters(cloud, ["node"])


def _things(rows: pd.DataFrame) -> dict[int, dict]:
    """A thing for each node of a frame of node, label, frame, box and embedding."""
    things = {}
    for n, g in rows.groupby("node"):
        low, high = g[["lx", "ly", "lz"]].min().to_numpy(float), g[["hx", "hy", "hz"]].max().to_numpy(float)
        points = np.concatenate([g[["lx", "ly", "lz"]].to_numpy(float), g[["hx", "hy", "hz"]].to_numpy(float)])
        dino = np.sum([np.asarray(v, dtype=np.float32) for v in g["dino"]], axis=0)
        things[int(n)] = {"label": g["label"].iloc[0], "box": np.stack([low, high]), "frames": set(g["frame"]), "masks": len(g), "dino": dino, "points": points}
    return things


def _observations(spark, sf_dir):
    """Observations from the embeddings: 250 vectors to a run, five to a frame; the label is the track and the place."""
    key = F.col("vec_id")
    lx, ly = F.col("label") * 0.75 + (key % 3) * 0.125, (key % 4) * 0.125
    return scene.read(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 250").alias("run"),
        F.expr("vec_id % 250 div 5").alias("frame"),
        key.alias("mask"),
        (F.col("label") + F.when(key % 11 == 0, 100).otherwise(0)).cast("bigint").alias("track"),
        F.col("embedding").alias("dino"),
        lx.cast("double").alias("lx"),
        ly.cast("double").alias("ly"),
        F.lit(0.0).alias("lz"),
        (lx + 0.5).cast("double").alias("hx"),
        (ly + 0.5).cast("double").alias("hy"),
        F.lit(0.75).alias("hz"),
        (key % 9).alias("n_points"),
        (key % 7 != 0).alias("reliable"),
        (F.col("label") % 2).alias("label"),
    )


@register()
def merge_parts(spark, sf_dir):
    """run, node, kept: objects of the memory's tracks, merged where parts lie inside wholes."""
    rows = _observations(spark, sf_dir).withColumn("node", F.col("track"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        final, _ = refine.merge_parts(_things(part))
        return pd.DataFrame({"run": part["run"].iloc[0], "node": list(final), "kept": list(final.values())})

    return rows.groupBy("run").applyInPandas(one, "run bigint, node bigint, kept bigint")


@register()
def object_memory(spark, sf_dir):
    return stream.in_batch(_observations(spark, sf_dir).drop("label"))


@register()
def memory_stream(spark, sf_dir):
    """The same observations as a stream of files, run over what is there."""
    rows = _observations(spark, sf_dir).drop("label")
    folder = f"{stream.shared_folder(spark)}/observations-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    rows.repartition("run").write.mode("overwrite").parquet(folder)
    source = spark.readStream.schema(stream.INPUT).parquet(folder)
    return stream.run_once(stream.in_stream(source))


@register()
def idf1_assignment(spark, sf_dir):
    found = masks.pairs(scene.mask_runs(spark, sf_dir), FRAME)
    pairs = found.where("iou >= 0.02").groupBy("run", F.col("a").alias("id"), F.col("b").alias("obj")).agg(F.count("*").alias("n"))
    rows = scene.mask_runs(spark, sf_dir).select(*FRAME, "mask").distinct().groupBy("run").agg(F.count("*").alias("n"))
    return evals.identity(pairs, rows, rows)


@register()
def umeyama_fit(spark, sf_dir):
    """scale, rms and translation of the similarity between two point tables, from sums alone."""
    rows = scene.read(spark, sf_dir, "lineitem")
    x, y, z = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    pairs = rows.select(x.alias("sx"), y.alias("sy"), z.alias("sz"), (1 - 2 * y).alias("dx"), (2 * x + 3).alias("dy"), (2 * z).alias("dz"))
    scale, _, t, rms = geometry.umeyama_from_sums(pairs)
    values = [(round(scale, 6), round(rms, 6), *(round(float(v), 6) for v in t))]
    return spark.createDataFrame(values, "scale double, rms double, tx double, ty double, tz double")


@register()
def mask_codec(spark, sf_dir):
    """run, frame, mask, counts, pixels: union masks as compressed strings, and the area read back from them."""
    rows = masks.union(scene.mask_runs(spark, sf_dir), [*FRAME, "mask"])
    packed = rows.groupBy(*FRAME, "mask").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))

    def code(batches):
        for b in batches:
            texts = []
            for runs in b["runs"]:
                flat = np.zeros(4000, dtype=bool)
                for r in runs:
                    flat[r["s"] : r["e"]] = True
                texts.append(geometry.encode_runs(flat.reshape(50, 80).T))
            area = [sum(e - s for s, e in geometry.decode_runs(t)) for t in texts]
            yield b.drop(columns="runs").assign(counts=texts, pixels=area)

    return packed.mapInPandas(code, "run bigint, frame bigint, mask bigint, counts string, pixels bigint")


QUERIES, ORACLES = register.queries, register.oracles

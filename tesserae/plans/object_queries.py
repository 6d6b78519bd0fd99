"""Queries over nodes, ground truth, frames of reference, scores and views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions.colour import channels
from tesserae.operators import events, graph, points, spatial, truth, views
from tesserae.operators import masks as mask_ops
from tesserae.plans.mask_queries import EVENTS, FRAME, PAIRS, UNION
from tesserae.plans.registry import Registry
from tesserae.plans.scene_queries import EDGES, EMB, _emb
from tesserae.sources import scene

register = Registry()
SIDES = ("lx", "ly", "lz", "hx", "hy", "hz")


@register("""WITH m AS (SELECT l_suppkey AS seq, [1, 0, -1, 0][l_linenumber % 4 + 1] AS c, [0, 1, 0, -1][l_linenumber % 4 + 1] AS s,
  l_quantity AS tx, l_discount * 100 AS ty, l_tax * 100 AS tz FROM lineitem)
SELECT seq, round(sum(-(c * tx + s * ty)), 4) AS x, round(sum(-(-s * tx + c * ty)), 4) AS y, round(sum(-tz), 4) AS z FROM m GROUP BY seq""")
def camera_centres(spark, sf_dir):
    """Cameras turned by quarters about z: world positions from camera-from-world matrices."""
    rows = scene.read(spark, sf_dir, "lineitem")
    turn = F.col("l_linenumber") % 4
    c = F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0)
    s = F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [c, -s, zero, F.col("l_quantity"), s, c, zero, F.col("l_discount") * 100, zero, zero, one, F.col("l_tax") * 100]
    found = [F.round(F.sum(x), 4).alias(n) for x, n in zip(truth.camera_centres(m), "xyz", strict=True)]
    return rows.groupBy(F.col("l_suppkey").alias("seq")).agg(*found)


@register(f"""WITH {EDGES} SELECT run, a, b, relation, round(gap, 6) AS gap,
  CAST(row_number() OVER (PARTITION BY run ORDER BY relation <> 'on', a, b) AS INTEGER) AS place FROM edges""")
def edge_listing(spark, sf_dir):
    return spatial.listing(spatial.edges(scene.nodes(spark, sf_dir))).withColumn("gap", F.round("gap", 6))


@register(f"""WITH {scene.VIS}, f AS (SELECT DISTINCT f FROM vis), o AS (SELECT DISTINCT obj FROM vis)
SELECT f.f AS frame, o.obj, coalesce(vis.px, 0) AS px FROM f CROSS JOIN o LEFT JOIN vis ON vis.f = f.f AND vis.obj = o.obj""")
def visibility_matrix(spark, sf_dir):
    rows = scene.visibility(spark, sf_dir).select(F.lit(0).alias("run"), F.col("f").alias("frame"), "obj", "px")
    return truth.visibility_pixels(rows, rows, rows).drop("run")


def _trimmed(k, e):
    return f"CASE WHEN count(*) < 50 THEN {'min' if e == 'l' else 'max'}({k}) ELSE quantile_disc({k}, {0.02 if e == 'l' else 0.98}) END AS {e}{k}"


@register(f"""WITH {scene.POINTS}, b AS (SELECT node, {", ".join(_trimmed(k, e) for k in "xyz" for e in "lh")} FROM points GROUP BY node)
SELECT p.node, count(*) AS n, round(sum(x), 2) AS sx FROM points p JOIN b USING (node)
WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY p.node""")
def points_in_boxes(spark, sf_dir):
    """Points inside the saved box of their object."""
    rows = scene.points(spark, sf_dir)
    kept = truth.inside_boxes(rows, points.fit_box(rows).drop("n"))
    return kept.groupBy("node").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sx"))


MAD = " AND ".join(f"abs({k} - m{k}) <= 4 * (1.4826 * d{k} + 1e-3)" for k in "xyz")


@register(f"""WITH p AS (SELECT l_suppkey % 50 AS node, l_linenumber AS frame, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem),
s AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY node, frame) >= 20 AND row_number() OVER (PARTITION BY node, frame ORDER BY x, y, z) <= 100),
m AS (SELECT node, count(*) AS n, median(x) AS mx, median(y) AS my, median(z) AS mz FROM s GROUP BY node),
d AS (SELECT node, median(abs(x - mx)) AS dx, median(abs(y - my)) AS dy, median(abs(z - mz)) AS dz FROM s JOIN m USING (node) GROUP BY node)
SELECT node, count(*) AS n_points, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz
FROM s JOIN m USING (node) JOIN d USING (node) WHERE n < 10 OR ({MAD}) GROUP BY node HAVING count(*) >= 50""")
def truth_boxes(spark, sf_dir):
    """Boxes of the ground truth: a bounded sample of each object in each frame, pooled, without outliers."""
    rows = scene.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("node"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"),
    )
    return truth.object_truth_boxes(rows, ["node"], 100, 20, ["x", "y", "z"])


@register(f"""WITH {scene.NODES} SELECT node AS object, label AS class, ((ly + hy) / 2 - 5) / 2 AS cx, -((lx + hx) / 2 - 3) / 2 + 0.0 AS cy, ((lz + hz) / 2 - 1) / 2 AS cz,
  (hx - lx) / 4 AS sx, (hy - ly) / 4 AS sy, (hz - lz) / 4 AS sz FROM nodes WHERE label <> 'wall'""")
def boxes_in_run(spark, sf_dir):
    """True boxes under the inverse of a similarity that doubles, turns by a quarter and moves; walls are left out."""
    rows = scene.nodes(spark, sf_dir)
    sim3 = np.array([[0.0, -2, 0, 3], [2, 0, 0, 5], [0, 0, 2, 1], [0, 0, 0, 1]])
    classes = rows.select(F.col("node").alias("object"), F.col("label").alias("class"))
    return truth.boxes_in_run(rows.withColumnRenamed("node", "object").drop("label", "run"), classes, ("wall",), sim3)


HITS = f"""{PAIRS}, t AS (SELECT run, frame, mask AS o, area, mask <> 9 AND area >= 30 AS counted FROM areas WHERE mask >= 5),
i AS (SELECT run, frame, a AS p, b AS o, iou FROM pairs WHERE a < 5 AND b >= 5 AND iou >= 0.02),
h AS (SELECT i.*, counted FROM i JOIN t USING (run, frame, o)),
pr AS (SELECT DISTINCT run, frame, mask AS p FROM areas WHERE mask < 5)"""


def _evaluated(spark, sf_dir):
    """Masks 0 to 4 of a frame play the predictions, 5 to 9 the truth, of which 9 is ignored."""
    whole = mask_ops.union(scene.mask_runs(spark, sf_dir), [*FRAME, "mask"])
    area = mask_ops.area(whole, [*FRAME, "mask"])
    left, right = area.where("mask < 5"), area.where("mask >= 5")
    shared = mask_ops.overlaps(whole.where("mask < 5"), whole.where("mask >= 5"), FRAME, "mask", "mask", False)
    ious = mask_ops.with_areas(shared, left, right, FRAME).select(*FRAME, F.col("a").alias("p"), F.col("b").alias("o"), "iou")
    true = right.select(*FRAME, F.col("mask").alias("o"), "area")
    marked = truth.counted(true, true.where("o = 9").select("run", "o").distinct(), ["run"], 30)
    return truth.evaluate(left.select(*FRAME, F.col("mask").alias("p")), marked, ious, "run", 0.02)


@register(f"""WITH {HITS}, m AS (SELECT run, p, o, count(*) AS n FROM h WHERE counted GROUP BY ALL),
np AS (SELECT run, count(*) AS np FROM pr WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.run = pr.run AND h.frame = pr.frame AND h.p = pr.p AND NOT counted) GROUP BY run),
ng AS (SELECT run, count(*) AS ng FROM t WHERE counted GROUP BY run), ids AS (SELECT run, count(DISTINCT p) AS ids FROM pr GROUP BY run),
io AS (SELECT run, avg(n) AS v FROM (SELECT run, o, count(*) AS n FROM m GROUP BY ALL) GROUP BY run),
oi AS (SELECT run, avg(n) AS v FROM (SELECT run, p, count(*) AS n FROM m GROUP BY ALL) GROUP BY run)
SELECT run, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(ids, 0) AS ids, round(coalesce(io.v, 0), 6) AS ids_per_object, round(coalesce(oi.v, 0), 6) AS objects_per_id
FROM np FULL JOIN ng USING (run) LEFT JOIN ids USING (run) LEFT JOIN io USING (run) LEFT JOIN oi USING (run)""")
def evaluate_counts(spark, sf_dir):
    scores, _ = _evaluated(spark, sf_dir)
    rounded = [F.round(c, 6).alias(c) for c in ("ids_per_object", "objects_per_id")]
    return scores.select("run", "np", "ng", "ids", *rounded)


@register(f"""WITH {HITS} SELECT run, frame, o, p FROM h WHERE counted QUALIFY row_number() OVER (PARTITION BY run, frame, o ORDER BY iou DESC, p) = 1""")
def best_matches(spark, sf_dir):
    return _evaluated(spark, sf_dir)[1]


@register(f"""WITH {EVENTS}, m AS (SELECT obj, f AS frame, px % 3 AS id FROM vis WHERE px % 5 <> 0),
g AS (SELECT obj, l, b FROM gaps WHERE b IS NOT NULL),
r AS (SELECT obj, (SELECT id FROM m WHERE m.obj = g.obj AND frame <= l AND frame > l - 5 ORDER BY frame DESC LIMIT 1) AS o,
  (SELECT id FROM m WHERE m.obj = g.obj AND frame >= b AND frame < b + 5 ORDER BY frame LIMIT 1) AS n FROM g)
SELECT obj, count(*) AS revisits, count(*) FILTER (WHERE o = n) AS kept, count(*) FILTER (WHERE o <> n) AS switched,
  count(*) FILTER (WHERE o IS NULL OR n IS NULL) AS missed,
  round(CASE WHEN count(*) FILTER (WHERE o IS NOT NULL AND n IS NOT NULL) > 0 THEN count(*) FILTER (WHERE o = n) / count(*) FILTER (WHERE o IS NOT NULL AND n IS NOT NULL) END, 6) AS kept_rate
FROM r GROUP BY obj""")
def kept_rate(spark, sf_dir):
    pixels = scene.visibility(spark, sf_dir)
    matches = pixels.where(F.col("px") % 5 != 0).select("obj", F.col("f").alias("frame"), (F.col("px") % 3).alias("id"))
    gaps = events.pair_events(events.hide_revisit(events.visible_runs(pixels, 100, 2, 6)))
    found = truth.kept_rates(events.revisit_outcomes(gaps, matches, 5), ["obj"])
    return found.withColumn("kept_rate", F.round("kept_rate", 6))


@register(f"""WITH {EMB}, tt AS (SELECT DISTINCT vec_id % 5 AS query, label AS obj FROM embeddings WHERE label % 3 = vec_id % 3 AND label <> 7),
ow AS (SELECT id, id // 2 * 2 AS obj FROM (SELECT DISTINCT id FROM ranked) WHERE id <> 4),
h AS (SELECT tt.query, tt.obj, min(rank) AS rank FROM tt JOIN ow USING (obj) JOIN ranked ON ranked.query = tt.query AND ranked.id = ow.id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, obj) AS k FROM h)
SELECT tt.query, round(coalesce(sum(k / rank), 0) / count(*), 6) AS ap, coalesce(min(rank) = 1, false) AS top1,
  round(avg(CASE WHEN tt.obj IN (SELECT obj FROM ow) THEN 1 ELSE 0 END), 6) AS reachable FROM tt LEFT JOIN k ON k.query = tt.query AND k.obj = tt.obj GROUP BY tt.query""")
def text_retrieval(spark, sf_dir):
    """Queries against objects that stand for others: precision, first hit, and the share of targets within reach."""
    ranked, rows = _emb(spark, sf_dir)
    targets = rows.where(F.col("label") % 3 == F.col("vec_id") % 3).select((F.col("vec_id") % 5).alias("query"), F.col("label").alias("obj"))
    seen = rows.where("label <> 7").select(F.col("label").alias("obj"))
    owners = ranked.select("id").distinct().where("id <> 4").select("id", (F.floor(F.col("id") / 2) * 2).cast("int").alias("obj"))
    found = truth.retrieval(ranked, targets, owners, seen)
    return found.select("query", F.round("ap", 6).alias("ap"), "top1", F.round("reachable", 6).alias("reachable"))


@register("""WITH old AS (SELECT o_orderpriority AS method, o_orderstatus AS task, o_custkey % 8 AS scene, round(avg(o_totalprice), 4) AS score FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
fresh AS (SELECT o_orderpriority AS method, o_orderstatus AS task, o_custkey % 8 AS scene, round(avg(o_totalprice), 4) AS score FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F' GROUP BY ALL),
u AS (SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE (method, task) NOT IN (SELECT (method, task) FROM fresh)
  UNION ALL SELECT c_mktsegment || ' (paper)', 'F', 0, 1.5 FROM customer GROUP BY c_mktsegment)
SELECT method, task, round(avg(score), 3) AS mean, count(*) AS scenes FROM u GROUP BY method, task""")
def results_table(spark, sf_dir):
    """Scores with those of redone tasks replaced, beside literal rows."""
    rows = scene.read(spark, sf_dir, "orders")
    each = lambda df: df.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("task"), (F.col("o_custkey") % 8).alias("scene")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))  # noqa: E731, E501
    held = truth.upserted(each(rows.where("o_orderkey % 2 = 0")), each(rows.where("o_orderkey % 2 = 1 AND o_orderstatus = 'F'")), ["method", "task"])
    literal = scene.read(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" (paper)")).alias("method")).distinct()
    found = truth.results_table(held, literal.select("method", F.lit("F").alias("task"), F.lit(0).cast("bigint").alias("scene"), F.lit(1.5).alias("score")))
    return found.withColumn("mean", F.round("mean", 3))


@register("""SELECT DISTINCT 'ours-' || concat_ws('_', nullif(o_orderstatus, 'F'), CASE WHEN o_orderkey % 3 = 0 THEN 'indoor' END, 'gt') || '-stride' || (o_custkey % 4 * 10) || '-graph' AS method FROM orders""")
def method_names(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    vocab = F.when(F.col("o_orderkey") % 3 == 0, "indoor")
    name = truth.method_name(source, vocab, F.lit("gt"), F.col("o_custkey") % 4 * 10, F.lit("graph"))
    return rows.select(name.alias("method")).distinct()


@register(f"""WITH {UNION}, px AS (SELECT run, frame, mask, unnest(range(s, e)) AS p FROM whole),
c AS (SELECT run, frame, mask, p // 80 AS x, p % 80 AS y FROM px), s AS (SELECT run, frame, mask, count(*) AS area, sum(x) AS sx, sum(y) AS sy FROM c GROUP BY ALL),
b AS (SELECT c.*, area FROM c JOIN s USING (run, frame, mask)
  QUALIFY row_number() OVER (PARTITION BY run, frame, mask ORDER BY (area * x - sx) * (area * x - sx) + (area * y - sy) * (area * y - sy), y, x) = 1)
SELECT run, frame, mask, CAST(row_number() OVER (PARTITION BY run, frame ORDER BY area DESC, mask) AS INTEGER) AS place, area, x, y FROM b""")
def panel_layout(spark, sf_dir):
    return views.panel_layout(scene.mask_runs(spark, sf_dir), 80, FRAME)


def _channel(m):
    key = "(node + 1)"
    return f"CAST(({key} * {m} + CAST(floor({key} * {m} / 256) AS BIGINT)) % 166 + 90 AS INTEGER)"


@register(f"""WITH {scene.NODES} SELECT run, node, label, lx AS x, ly AS y, hx - lx AS width, hy - ly AS depth, CASE WHEN node IN (3, 7) THEN 1.0 ELSE 0.25 END::DOUBLE AS alpha,
  {_channel(40503)} AS red, {_channel(30011)} AS green, {_channel(52711)} AS blue FROM nodes""")
def top_down(spark, sf_dir):
    return views.top_down(scene.nodes(spark, sf_dir), [3, 7])


@register("""SELECT DISTINCT o_custkey % 13 AS track, CAST(((o_custkey % 13 + 7920) * 40503 + CAST(floor((o_custkey % 13 + 7920) * 40503 / 256) AS BIGINT)) % 166 + 90 AS INTEGER) AS red FROM orders""")
def palette(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 13).alias("track")).distinct()
    return rows.select("track", channels(F.col("track"), 1)[0].alias("red"))


NODE_LISTS = """live AS (SELECT o_orderkey // 1000 AS run, o_custkey % 40 AS node, o_orderkey AS mask, o_orderkey % 90 AS frame, o_orderkey % 13 AS track,
  o_orderkey % 6 AS prompt, CAST(o_orderkey % 10 AS BIGINT) AS score, o_orderkey % 11 AS n_points, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 41) * 0.125::DOUBLE END AS conf,
  (o_orderkey % 64) * 0.125::DOUBLE AS lx, (o_orderkey % 64) * 0.125::DOUBLE + (1 + o_orderkey % 3) * 0.25::DOUBLE AS hx FROM orders WHERE o_orderkey % 17 <> 0)"""


@register(f"""WITH {NODE_LISTS}, v AS (SELECT run, node, prompt FROM live GROUP BY run, node, prompt QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY sum(score) DESC, prompt) = 1),
p AS (SELECT run, node, unnest([lx, hx]) AS x FROM live WHERE n_points > 0 AND (conf IS NULL OR conf >= 2.5)),
b AS (SELECT run, node, {_trimmed("x", "l")}, {_trimmed("x", "h")} FROM p GROUP BY ALL),
f AS (SELECT run, node, lx, hx FROM live WHERE n_points > 0 QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY coalesce(conf, '-infinity'::DOUBLE) DESC, mask) = 1),
l AS (SELECT run, node, count(DISTINCT mask) AS masks, count(DISTINCT frame) AS frames, min(frame) AS first, max(frame) AS last, count(DISTINCT track) AS tracks FROM live GROUP BY ALL)
SELECT l.*, 'kind ' || prompt AS label, coalesce(b.lx, f.lx) AS lx, coalesce(b.hx, f.hx) AS hx FROM l JOIN v USING (run, node) LEFT JOIN b USING (run, node) LEFT JOIN f USING (run, node)""")
def build_nodes(spark, sf_dir):
    """Nodes of many recordings from masks, assignments, boxes and prompts."""
    key = F.col("o_orderkey")
    lx = (key % 64) * 0.125
    rows = scene.read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 1000").alias("run"), key.alias("mask"), (key % 90).alias("frame"), (key % 13).alias("track"),
        (key % 6).cast("int").alias("prompt"), (key % 10).alias("score"), F.when(key % 17 == 0, -1).otherwise(F.col("o_custkey") % 40).alias("node"),
        (key % 11).alias("n_points"), F.when(key % 7 != 0, (key % 41) * 0.125).cast("double").alias("conf"),
        lx.cast("double").alias("lx"), (lx + (1 + key % 3) * 0.25).cast("double").alias("hx"),
        *[F.lit(v).alias(e + k) for e, v in (("l", 0.0), ("h", 1.0)) for k in "yz"],
    )
    masks = rows.select("run", "mask", "frame", "track", "prompt", "score")
    vocab = rows.select("prompt").distinct().withColumn("label", F.concat(F.lit("kind "), "prompt"))
    found = graph.build_nodes(masks, rows.select("run", "mask", "node"), rows.select("run", "mask", "n_points", "conf", *SIDES), vocab)
    n = lambda c: F.size(c).cast("bigint").alias(c)
    return found.select("run", "node", n("masks"), n("frames"), F.array_min("frames").alias("first"), F.array_max("frames").alias("last"), n("tracks"), "label", "lx", "hx")


QUERIES, ORACLES = register.queries, register.oracles

"""Queries over embeddings, object boxes and point sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import box
from tesserae.operators import points, search, spatial
from tesserae.plans.registry import Registry
from tesserae.sources import scene

register = Registry()
#: The vectors that play the texts of queries, and the label that is looked for.
N_TEXTS, TOP = 5, 3

EMB = """cells AS (
  SELECT label AS id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
sums AS (SELECT id, pos, sum(x::DOUBLE) AS x FROM cells GROUP BY ALL),
lens AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-6) AS n FROM sums GROUP BY id),
objs AS (SELECT id, pos, x / n AS x FROM sums JOIN lens USING (id)),
qs AS (SELECT vec_id AS query, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS q FROM embeddings WHERE vec_id < 5),
scores AS (SELECT query, id, sum(q::DOUBLE * x) AS score FROM qs JOIN objs USING (pos) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scores)"""


def _emb(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "embeddings")
    objects = search.object_embeddings(rows.select(F.col("label").alias("id"), "embedding"))
    queries = rows.where(F.col("vec_id") < N_TEXTS).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return search.rank(queries, objects), rows


@register(f"WITH {EMB} SELECT query, id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 3")
def text_topk(spark, sf_dir):
    ranked, _ = _emb(spark, sf_dir)
    return ranked.where(F.col("rank") <= TOP).withColumn("score", F.round("score", 4))


@register(f"WITH {EMB} SELECT id, pos - 1 AS pos, round(x, 4) + 0.0 AS x FROM objs")
def object_embeddings(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), "embedding")
    found = search.object_embeddings(rows).select("id", F.posexplode("embedding").alias("pos", "x"))
    return found.withColumn("x", F.round("x", 4) + F.lit(0.0))


@register(f"""WITH {EMB},
named AS (SELECT *, 'label' || id = CASE WHEN query % 2 = 0 THEN 'label' || query ELSE 'unknown' END AS hit FROM ranked)
SELECT query, id, rank FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query) AS known FROM named)
WHERE CASE WHEN known THEN hit ELSE rank <= 3 END""")
def of_type_fallback(spark, sf_dir):
    ranked, rows = _emb(spark, sf_dir)
    labels = rows.select(F.col("label").alias("id")).distinct().withColumn("label", F.concat(F.lit("label"), "id"))
    text = F.when(F.col("query") % 2 == 0, F.concat(F.lit(" Label"), "query")).otherwise("unknown")
    asked = rows.where(F.col("vec_id") < N_TEXTS).select(F.col("vec_id").alias("query")).withColumn("text", text)
    return search.of_type(ranked, labels, asked, TOP)


GAP = """sqrt(pow(greatest(a.lx - b.hx, b.lx - a.hx, 0), 2) + pow(greatest(a.ly - b.hy, b.ly - a.hy, 0), 2)
  + pow(greatest(a.lz - b.hz, b.lz - a.hz, 0), 2))"""
REST = """greatest(least({a}.hx, {b}.hx) - greatest({a}.lx, {b}.lx), 0) * greatest(least({a}.hy, {b}.hy) - greatest({a}.ly, {b}.ly), 0)
  / greatest(({a}.hx - {a}.lx) * ({a}.hy - {a}.ly), 1e-6) >= 0.5
  AND {a}.lz >= {b}.lz + 0.05 AND {a}.lz <= {b}.hz + 0.1 AND {a}.lz >= {b}.hz - 0.75
  AND ({a}.hx - {a}.lx) * ({a}.hy - {a}.ly) * ({a}.hz - {a}.lz) < ({b}.hx - {b}.lx) * ({b}.hy - {b}.ly) * ({b}.hz - {b}.lz)"""
EDGES = f"""{scene.NODES},
able AS (SELECT * FROM nodes WHERE label NOT IN ('wall', 'floor', 'ceiling') AND greatest(hx - lx, hy - ly, hz - lz) <= 3),
pairs AS (SELECT a.run, a.node AS p, b.node AS q, {GAP} AS gap, {REST.format(a="a", b="b")} AS up, {REST.format(a="b", b="a")} AS down
  FROM able a JOIN able b ON a.run = b.run AND a.node < b.node),
edges AS (SELECT run, CASE WHEN NOT up AND down THEN q ELSE p END AS a, CASE WHEN NOT up AND down THEN p ELSE q END AS b,
  CASE WHEN up OR down THEN 'on' ELSE 'near' END AS relation, gap FROM pairs WHERE up OR down OR gap <= 0.25)"""


@register(f"""WITH {scene.NODES}
SELECT a.run, a.node AS a, b.node AS b, round({GAP}, 6) AS gap FROM nodes a JOIN nodes b ON a.run = b.run AND a.node < b.node
WHERE {GAP} <= 0.5""")
def box_gap_pairs(spark, sf_dir):
    return spatial.gap_pairs(scene.nodes(spark, sf_dir), 0.5).withColumn("gap", F.round("gap", 6))


def _edges(spark, sf_dir):
    return spatial.edges(scene.nodes(spark, sf_dir))


@register(f"WITH {EDGES} SELECT run, a, b, relation, round(gap, 6) AS gap FROM edges")
def edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("gap", F.round("gap", 6))


@register(f"WITH {EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def edge_counts(spark, sf_dir):
    return spatial.edge_counts(_edges(spark, sf_dir))


@register(f"""WITH {EDGES} SELECT run, a AS node, relation, b AS other FROM edges
UNION ALL SELECT run, b, CASE relation WHEN 'on' THEN 'under' ELSE relation END, a FROM edges""")
def neighbours(spark, sf_dir):
    return spatial.neighbours(_edges(spark, sf_dir))


def _related_sql(relation: str) -> str:
    back = "" if relation == "on" else "UNION ALL SELECT run, b, a, relation, gap, 1 FROM edges"
    only = "WHERE relation = 'on'" if relation == "on" else ""
    return f"""WITH {EDGES},
ends AS (SELECT run, a AS node, b AS anchor, relation, gap, 0 AS side FROM edges {only} {back}),
mine AS (SELECT ends.* FROM ends WHERE EXISTS (SELECT 1 FROM nodes WHERE nodes.run = ends.run AND nodes.node = ends.anchor AND label LIKE 'large%'))
SELECT run, node, anchor, round(gap, 6) AS gap FROM mine
QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY gap, relation DESC, anchor, side) = 1"""


def _related(spark, sf_dir, relation):
    anchors = scene.nodes(spark, sf_dir).where(F.col("label").startswith("large"))
    return spatial.related(_edges(spark, sf_dir), anchors, relation).withColumn("gap", F.round("gap", 6))


@register(_related_sql("on"))
def related_on(spark, sf_dir):
    return _related(spark, sf_dir, "on")


@register(_related_sql("near"))
def related_near(spark, sf_dir):
    return _related(spark, sf_dir, "near")


@register(f"""WITH {scene.NODES}, firsts AS (SELECT run, min(node) AS node FROM nodes GROUP BY run),
c AS (SELECT a.run, a.node AS anchor, b.node, rint(round({GAP} * 100, 3)) AS g,
  sqrt(pow((a.lx + a.hx) / 2 - (b.lx + b.hx) / 2, 2) + pow((a.ly + a.hy) / 2 - (b.ly + b.hy) / 2, 2) + pow((a.lz + a.hz) / 2 - (b.lz + b.hz) / 2, 2)) AS d
  FROM nodes a JOIN firsts f ON a.run = f.run AND a.node = f.node JOIN nodes b ON b.run = a.run AND b.node <> a.node)
SELECT run, anchor, node, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY g, d, node) AS rank FROM c) WHERE rank <= 5""".replace("rint(", "round_even(").replace("* 100, 3))", "* 100, 3), 0)"))
def nearest_box(spark, sf_dir):
    nodes = scene.nodes(spark, sf_dir).drop("label")
    firsts = nodes.groupBy("run").agg(F.min("node").alias("node"))
    return spatial.nearest(nodes, nodes.join(firsts, ["run", "node"], "left_semi"), 5)


@register(f"""WITH {scene.NODES}, d AS (SELECT run, node, sqrt(pow(greatest(lx - 8, 8 - hx, 0), 2) + pow(greatest(ly - 8, 8 - hy, 0), 2)
  + pow(greatest(lz - 0.5, 0.5 - hz, 0), 2)) AS distance FROM nodes)
SELECT run, node, round(distance, 6) AS distance, rank
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY distance, node) AS rank FROM d) WHERE rank <= 5""")
def position_topk(spark, sf_dir):
    found = spatial.at_position(scene.nodes(spark, sf_dir), (8.0, 8.0, 0.5), 5)
    return found.withColumn("distance", F.round("distance", 6))


VOLUME = "greatest({p}.hx - {p}.lx, 0) * greatest({p}.hy - {p}.ly, 0) * greatest({p}.hz - {p}.lz, 0)"
SHARED = " * ".join(f"greatest(least(a.h{k}, b.h{k}) - greatest(a.l{k}, b.l{k}), 0)" for k in box.AXES)


@register(f"""WITH {scene.NODES}, c AS (SELECT a.run, a.node AS a, b.node AS b,
  CASE WHEN least({VOLUME.format(p="a")}, {VOLUME.format(p="b")}) > 0 THEN {SHARED} / least({VOLUME.format(p="a")}, {VOLUME.format(p="b")}) ELSE 0 END AS share
  FROM nodes a JOIN nodes b ON a.run = b.run AND a.node < b.node)
SELECT run, a, b, round(share, 6) AS share FROM c WHERE share >= 0.3""")
def containment_pairs(spark, sf_dir):
    return spatial.containment_pairs(scene.nodes(spark, sf_dir), 0.3).withColumn("share", F.round("share", 6))


@register(f"""WITH {scene.POINTS} SELECT node, count(*) AS n,
  {", ".join(f"quantile_disc({k}, 0.02) AS l{k}, quantile_disc({k}, 0.98) AS h{k}" for k in "xyz")} FROM points GROUP BY node HAVING count(*) >= 50
UNION ALL SELECT node, count(*), {", ".join(f"min({k}), max({k})" for k in "xyz")} FROM points GROUP BY node HAVING count(*) < 50""")
def fit_box(spark, sf_dir):
    return points.fit_box(scene.points(spark, sf_dir))


@register(f"""WITH {scene.POINTS} SELECT node,
  {", ".join(f"round(quantile_cont({k}, 0.005), 5) AS l{k}, round(quantile_cont({k}, 0.995), 5) AS h{k}" for k in "xyz")} FROM points GROUP BY node""")
def linear_box(spark, sf_dir):
    found = points.linear_box(scene.points(spark, sf_dir))
    return found.select("node", *[F.round(e + k, 5).alias(e + k) for k in "xyz" for e in "lh"])


@register(f"""WITH {scene.POINTS},
m AS (SELECT node, count(*) AS n, {", ".join(f"median({k}) AS m{k}" for k in "xyz")} FROM points GROUP BY node),
d AS (SELECT node, {", ".join(f"median(abs({k} - m{k})) AS d{k}" for k in "xyz")} FROM points JOIN m USING (node) GROUP BY node),
kept AS (SELECT node, x, y, z FROM points JOIN m USING (node) JOIN d USING (node)
  WHERE n < 10 OR ({" AND ".join(f"abs({k} - m{k}) <= 3 * (1.4826 * d{k} + 1e-3)" for k in "xyz")}))
SELECT node, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM kept GROUP BY node""")
def robust_filter(spark, sf_dir):
    kept = points.robust_filter(scene.points(spark, sf_dir))
    bounds = [f(k).alias(e + k) for k in "xyz" for e, f in (("l", F.min), ("h", F.max))]
    return kept.groupBy("node").agg(F.count("*").alias("n"), *bounds)


VOXEL = (8.0, 4096.0, 0.03125)
CELLS = "CAST(floor(x / 8) AS BIGINT) AS vx, CAST(floor(y / 4096) AS BIGINT) AS vy, CAST(floor(z / 0.03125) AS BIGINT) AS vz"


@register(f"""WITH {scene.POINTS}, v AS (SELECT *, {CELLS} FROM points)
SELECT vx, vy, vz, node, x, y, z FROM v QUALIFY row_number() OVER (PARTITION BY vx, vy, vz ORDER BY node, x, y, z) = 1""")
def voxel_thin(spark, sf_dir):
    return points.thin(scene.points(spark, sf_dir), VOXEL, ["node", "x", "y", "z"])


@register(f"""WITH {scene.POINTS}, c AS (SELECT node, {CELLS}, count(*) AS n FROM points GROUP BY ALL),
t AS (SELECT node, sum(n * n) / sum(n) AS typical FROM c GROUP BY node)
SELECT node, vx, vy, vz, n FROM c JOIN t USING (node) WHERE n >= greatest(2.0, 0.1 * typical)""")
def dense_voxels(spark, sf_dir):
    return points.dense_voxels(scene.points(spark, sf_dir), VOXEL)


@register(f"""WITH {scene.POINTS}, p AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY x, y, z) - 1 AS place, count(*) OVER (PARTITION BY node) AS n FROM points),
w AS (SELECT DISTINCT node, CASE WHEN i = least(n, 40) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / greatest(least(n, 40) - 1, 1))) AS BIGINT) END AS place
  FROM (SELECT node, any_value(n) AS n FROM p GROUP BY node), range(40) r(i) WHERE i < least(n, 40))
SELECT p.node, p.place, x, y, z FROM p JOIN w ON p.node = w.node AND p.place = w.place""")
def spread_sample(spark, sf_dir):
    return points.spread_sample(scene.points(spark, sf_dir), 40, ["x", "y", "z"])


@register(f"WITH {scene.MASK_BOXES} SELECT frame, count(*) AS n FROM mask_boxes WHERE frame % 10 = 0 GROUP BY frame")
def strided_sample(spark, sf_dir):
    """The sampling operator itself: every tenth frame."""
    return points.strided(scene.mask_boxes(spark, sf_dir), "frame", 10).groupBy("frame").agg(F.count("*").alias("n"))


@register(f"WITH {scene.MASK_BOXES} SELECT mask, node FROM mask_boxes WHERE n_points > 0 AND (conf IS NULL OR conf >= 2.5)")
def reliable_filter(spark, sf_dir):
    masks = scene.mask_boxes(spark, sf_dir)
    return masks.where(points.reliable(masks)).select("mask", "node")


SIDES = ("lx", "ly", "lz", "hx", "hy", "hz")
BEST = f"""best AS (SELECT node, mask, {", ".join(SIDES)} FROM mask_boxes WHERE n_points > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY coalesce(conf, '-infinity'::DOUBLE) DESC, mask) = 1)"""


@register(f"WITH {scene.MASK_BOXES}, {BEST} SELECT * FROM best")
def most_confident(spark, sf_dir):
    return points.most_confident(scene.mask_boxes(spark, sf_dir))


def trimmed(column, q, plain):
    return f"CASE WHEN count(*) < 50 THEN {plain}({column}) ELSE quantile_disc({column}, {q}) END"


@register(f"""WITH {scene.MASK_BOXES}, {BEST},
p AS (SELECT node, unnest([lx, hx]) AS x, unnest([ly, hy]) AS y, unnest([lz, hz]) AS z FROM mask_boxes WHERE n_points > 0 AND (conf IS NULL OR conf >= 2.5)),
pooled AS (SELECT node, {", ".join(f"{trimmed(k, q, f)} AS {e}{k}" for k in "xyz" for e, q, f in (("l", 0.02, "min"), ("h", 0.98, "max")))} FROM p GROUP BY node)
SELECT best.node, {", ".join(f"coalesce(pooled.{c}, best.{c}) AS {c}" for c in SIDES)} FROM best LEFT JOIN pooled USING (node)""")
def node_box(spark, sf_dir):
    return points.node_box(scene.mask_boxes(spark, sf_dir))


QUERIES, ORACLES = register.queries, register.oracles

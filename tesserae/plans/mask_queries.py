"""Queries over run-length masks, visibility events, votes and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import events, masks, votes
from tesserae.plans.registry import Registry
from tesserae.sources import scene

register = Registry()
FRAME = ["run", "frame"]

UNION = f"""{scene.RUNS},
marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY run, frame, mask ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 1 ELSE 0 END AS fresh FROM raw_runs),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY run, frame, mask ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked),
whole AS (SELECT run, frame, mask, min(s) AS s, max(e) AS e FROM islands GROUP BY run, frame, mask, island)"""
AREA = f"{UNION}, areas AS (SELECT run, frame, mask, CAST(sum(e - s) AS BIGINT) AS area FROM whole GROUP BY ALL)"
PAIRS = f"""{AREA},
shares AS (SELECT a.run, a.frame, a.mask AS a, b.mask AS b, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared
  FROM whole a JOIN whole b ON a.run = b.run AND a.frame = b.frame AND a.mask < b.mask AND a.s < b.e AND b.s < a.e GROUP BY ALL),
pairs AS (SELECT s.*, x.area AS area_a, y.area AS area_b, shared / (x.area + y.area - shared) AS iou,
  shared / greatest(least(x.area, y.area), 1) AS contain
  FROM shares s JOIN areas x ON x.run = s.run AND x.frame = s.frame AND x.mask = s.a JOIN areas y ON y.run = s.run AND y.frame = s.frame AND y.mask = s.b)"""


@register(f"WITH {UNION} SELECT run, frame, mask, s, e FROM whole")
def run_union(spark, sf_dir):
    return masks.union(scene.mask_runs(spark, sf_dir), [*FRAME, "mask"])


@register(f"WITH {AREA} SELECT * FROM areas")
def run_area(spark, sf_dir):
    return masks.area(masks.union(scene.mask_runs(spark, sf_dir), [*FRAME, "mask"]), [*FRAME, "mask"])


def _pairs(spark, sf_dir):
    return masks.pairs(scene.mask_runs(spark, sf_dir), FRAME)


@register(f"WITH {PAIRS} SELECT run, frame, a, b, shared, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1")
def mask_iou(spark, sf_dir):
    found = _pairs(spark, sf_dir).where(F.col("iou") >= 0.1)
    return found.select(*FRAME, "a", "b", "shared", F.round("iou", 6).alias("iou"))


@register(f"WITH {PAIRS} SELECT run, frame, a, b, round(contain, 6) AS contain FROM pairs WHERE contain >= 0.3")
def mask_contain(spark, sf_dir):
    found = _pairs(spark, sf_dir).where(F.col("contain") >= 0.3)
    return found.select(*FRAME, "a", "b", F.round("contain", 6).alias("contain"))


@register(f"""WITH {UNION}, asked AS (SELECT DISTINCT run, frame, s + 3 AS pixel FROM raw_runs)
SELECT w.run, w.frame, pixel, mask FROM asked JOIN whole w ON w.run = asked.run AND w.frame = asked.frame AND s <= pixel AND pixel < e""")
def point_in_mask(spark, sf_dir):
    runs = scene.mask_runs(spark, sf_dir)
    asked = runs.select(*FRAME, (F.col("s") + 3).alias("pixel")).distinct()
    return masks.points_in_masks(runs, asked, FRAME)


@register(f"""WITH {PAIRS} SELECT run, a, b, round(median(contain), 6) AS share, count(*) AS frames FROM pairs GROUP BY run, a, b
HAVING count(*) >= 2 AND median(contain) >= 0.1""")
def duplicate_pairs(spark, sf_dir):
    found = masks.duplicate_pairs(_pairs(spark, sf_dir), ["run"], 0.1, 2)
    return found.withColumn("share", F.round("share", 6))


RUNS = f"""{scene.VIS},
seen AS (SELECT *, f - row_number() OVER (PARTITION BY obj ORDER BY f) AS island FROM vis WHERE px >= 100),
short AS (SELECT obj, min(f) AS s, max(f) AS t FROM seen GROUP BY obj, island HAVING count(*) >= 2),
fresh AS (SELECT *, CASE WHEN s - lag(t) OVER (PARTITION BY obj ORDER BY s) - 1 < 6 THEN 0 ELSE 1 END AS new FROM short),
sess AS (SELECT *, sum(new) OVER (PARTITION BY obj ORDER BY s) AS k FROM fresh),
vruns AS (SELECT obj, min(s) AS start, max(t) AS "end" FROM sess GROUP BY obj, k)"""
EVENTS = f"""{RUNS}, gaps AS (SELECT obj, "end" AS l, lead(start) OVER (PARTITION BY obj ORDER BY start) AS b FROM vruns),
ev AS (SELECT obj, l AS frame, 0 AS kind, b - l AS gap FROM gaps WHERE b IS NOT NULL UNION ALL SELECT obj, b, 1, b - l FROM gaps WHERE b IS NOT NULL)"""


def _runs(spark, sf_dir):
    return events.visible_runs(scene.visibility(spark, sf_dir), 100, 2, 6)


@register(f'WITH {RUNS} SELECT obj, start, "end" FROM vruns')
def visible_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@register(f"WITH {EVENTS} SELECT * FROM ev")
def hide_revisit_events(spark, sf_dir):
    return events.hide_revisit(_runs(spark, sf_dir))


@register(f"""WITH {EVENTS}, m AS (SELECT obj, f AS frame, px % 3 AS id FROM vis WHERE px % 5 <> 0),
g AS (SELECT obj, l, b FROM gaps WHERE b IS NOT NULL)
SELECT obj, l AS "left", b AS back, CASE WHEN o IS NULL OR n IS NULL THEN 'missed' WHEN o = n THEN 'kept' ELSE 'switched' END AS outcome FROM (
  SELECT obj, l, b, (SELECT id FROM m WHERE m.obj = g.obj AND frame <= l AND frame > l - 5 ORDER BY frame DESC LIMIT 1) AS o,
    (SELECT id FROM m WHERE m.obj = g.obj AND frame >= b AND frame < b + 5 ORDER BY frame LIMIT 1) AS n FROM g)""")
def revisit_outcome(spark, sf_dir):
    pixels = scene.visibility(spark, sf_dir)
    matches = pixels.where(F.col("px") % 5 != 0).select("obj", F.col("f").alias("frame"), (F.col("px") % 3).alias("id"))
    gaps = events.pair_events(events.hide_revisit(events.visible_runs(pixels, 100, 2, 6)))
    return events.revisit_outcomes(gaps, matches, 5)


@register(f"""WITH {scene.VOTES} SELECT node, prompt, CAST(sum(score) AS BIGINT) AS total FROM votes GROUP BY node, prompt
QUALIFY row_number() OVER (PARTITION BY node ORDER BY sum(score) DESC, prompt) = 1""")
def label_vote(spark, sf_dir):
    return votes.label_vote(scene.votes(spark, sf_dir))


@register(f"""WITH {scene.VOTES}, c AS (SELECT DISTINCT node, prompt, (node * 7 + prompt * 13) % 32 / 32 AS cosine FROM votes),
w AS (SELECT node, prompt, round(sum(score) * exp(10 * (any_value(cosine) - any_value(top))), 9) AS w
  FROM votes JOIN c USING (node, prompt) JOIN (SELECT node, max(cosine) AS top FROM c GROUP BY node) USING (node) GROUP BY node, prompt)
SELECT node, prompt FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, prompt) = 1""")
def weighted_label(spark, sf_dir):
    cast = scene.votes(spark, sf_dir)
    cosine = cast.select("node", "prompt").distinct().withColumn("cosine", (F.col("node") * 7 + F.col("prompt") * 13) % 32 / 32)
    return votes.weighted_label(cast, cosine, 10.0)


@register(f"""WITH {scene.VOTES} SELECT node, prompt, count(*) AS n FROM votes GROUP BY node, prompt
QUALIFY row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, prompt) = 1""")
def mode_map(spark, sf_dir):
    return votes.mode(scene.votes(spark, sf_dir), "node", "prompt")


@register("""SELECT o_custkey % 40 AS node, o_orderkey % 13 AS sam_id, count(*) AS n FROM orders GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY count(*) DESC, o_orderkey % 13) = 1""")
def largest_track(spark, sf_dir):
    rows = scene.mask_boxes(spark, sf_dir).select("node", (F.col("mask") % 13).alias("sam_id"))
    return votes.mode(rows, "node", "sam_id")


@register("""WITH t AS (SELECT DISTINCT c_nationkey % 5 AS clip, c_custkey % 17 AS sam_id FROM customer),
n AS (SELECT clip, max(sam_id) + 1 AS n FROM t GROUP BY clip),
o AS (SELECT clip, coalesce(sum(n) OVER (ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT clip, sam_id, CAST(sam_id + b AS BIGINT) AS track FROM t JOIN o USING (clip)""")
def clip_offset(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "customer")
    tracks = rows.select((F.col("c_nationkey") % 5).alias("clip"), (F.col("c_custkey") % 17).alias("sam_id")).distinct()
    return votes.offset_clips(tracks)


@register("""SELECT s_suppkey AS mask, s_suppkey * 7 % 90 AS node,
CAST(dense_rank() OVER (ORDER BY s_suppkey * 7 % 90) - 1 AS BIGINT) AS number FROM supplier""")
def dense_renumber(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "supplier")
    rows = rows.select(F.col("s_suppkey").alias("mask"), (F.col("s_suppkey") * 7 % 90).alias("node"))
    return votes.renumber(rows, "node", "number").select("mask", "node", "number")


@register("""SELECT o_custkey AS node, count(DISTINCT o_orderpriority) AS clips FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def multi_clip_objects(spark, sf_dir):
    rows = scene.read(spark, sf_dir, "orders")
    return votes.multi_clip(rows.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("clip")))


@register("""SELECT c_custkey AS key, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def alignment_check(spark, sf_dir):
    left = scene.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    right = scene.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return votes.unaligned(left, right, "key")


QUERIES, ORACLES = register.queries, register.oracles

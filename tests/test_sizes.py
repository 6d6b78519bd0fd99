"""Shuffles of large tables: the memory of a task must not follow the input."""

import random

from tesserae.functions import plan
from tesserae.operators import masks, refine, spatial, views


def test_grid_of_many_boxes_is_shuffled_in_parts_that_grow_with_it(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for node in range(120):
        low = [rng.randrange(40) / 8 for _ in range(3)]
        rows.append((node % 2, node, *low, *(v + rng.randrange(1, 8) / 8 for v in low)))
    nodes = spark.createDataFrame(rows, "run int, node int, lx double, ly double, lz double, hx double, hy double, hz double")
    apart = lambda p, q: sum(max(p[2 + k] - q[5 + k], q[2 + k] - p[5 + k], 0) ** 2 for k in range(3)) ** 0.5
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and apart(p, q) <= 0.5}
    monkeypatch.setattr(plan, "PART", 100)
    found = spatial.gap_pairs(nodes, 0.5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() > 10
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _runs(spark, rng, n=400):
    rows = [(f % 2, f % 3, rng.randrange(4), s, s + rng.randrange(1, 30)) for f, s in ((rng.randrange(6), rng.randrange(12) * 20) for _ in range(n))]
    pixels = {}
    for run, frame, mask, s, e in rows:
        pixels.setdefault((run, frame, mask), set()).update(range(s, e))
    return spark.createDataFrame(rows * 2, "run long, frame long, mask long, s long, e long"), pixels


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_masks_are_dealt_to_parts_that_grow_with_them(spark, monkeypatch):
    runs, pixels = _runs(spark, random.Random(2))
    monkeypatch.setattr(plan, "PART", 50)
    whole = masks.union(runs, ["run", "frame", "mask"])
    assert whole.rdd.getNumPartitions() == 16
    got = {}
    for r in whole.collect():
        held = got.setdefault((r.run, r.frame, r.mask), set())
        assert not held & set(range(r.s - 1, r.e + 1))
        held.update(range(r.s, r.e))
    assert got == pixels


def test_pairs_of_large_masks_carry_their_areas(spark, monkeypatch):
    runs, pixels = _runs(spark, random.Random(3))
    monkeypatch.setattr(plan, "PART", 50)
    found = masks.pairs(runs, ["run", "frame"])
    assert _plan(found).count("Join") == 1  # areas go along with the intervals
    want = {(*x[:2], x[2], y[2]): (len(p & q), len(p), len(q)) for x, p in pixels.items() for y, q in pixels.items() if x[:2] == y[:2] and x[2] < y[2] and p & q}
    assert {(r.run, r.frame, r.a, r.b): (r.shared, r.area_a, r.area_b) for r in found.collect()} == want


def test_label_places_come_from_intervals_not_from_pixels(spark):
    runs, pixels = _runs(spark, random.Random(4), 60)
    found = views.panel_layout(runs, 7, ["run", "frame"])
    assert "Join" not in _plan(found)
    got = {(r.run, r.frame, r.mask): (r.area, r.x, r.y) for r in found.collect()}
    want = {}
    for key, held in pixels.items():
        n, sx, sy = len(held), sum(p // 7 for p in held), sum(p % 7 for p in held)
        _, y, x = min(((n * (p // 7) - sx) ** 2 + (n * (p % 7) - sy) ** 2, p % 7, p // 7) for p in held)
        want[key] = (n, x, y)
    assert got == want


def test_frames_are_grouped_in_batches(spark, monkeypatch):
    rng = random.Random(5)
    score = {f: {m: rng.randrange(20) / 4 for m in range(rng.randrange(1, 7))} for f in range(40)}
    iou = {f: {(a, b): rng.random() for a in of for b in of if a < b and rng.random() < 0.7} for f, of in score.items() if f % 5}
    rows = spark.createDataFrame([(0, f, m, v) for f, of in score.items() for m, v in of.items()], "run int, frame int, mask int, score double")
    pairs = spark.createDataFrame([(0, f, a, b, v) for f, of in iou.items() for (a, b), v in of.items()], "run int, frame int, a int, b int, iou double")
    monkeypatch.setattr(refine, "FRAMES", 3)
    found = refine.complete_link_groups(rows, pairs, ["run", "frame"], 0.3)
    assert "FlatMapCoGroups" not in _plan(found)
    want = {(f, m): g for f, of in score.items() for m, g in refine.complete_link(of, iou.get(f, {}), 0.3).items()}
    assert {(r.frame, r.mask): r.group for r in found.collect()} == want

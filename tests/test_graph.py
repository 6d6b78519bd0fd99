"""Hand-computed scenes, brute-force twins and properties of the object-map operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import vec
from tesserae.operators import evals, events, geometry, masks, memory, points, refine, spatial
from tesserae.sources import stages
from tesserae.streaming import object_memory

NODE = "run long, node long, label string, lx double, ly double, lz double, hx double, hy double, hz double"


def nodes(spark, *rows):
    return spark.createDataFrame([(0, i, label, *map(float, box)) for i, label, box in rows], NODE)


def test_on_near_and_structure(spark):
    scene = nodes(
        spark,
        (1, "sofa", (0, 0, 0, 2, 1, 0.8)),
        (2, "cushion", (0.2, 0.2, 0.4, 0.6, 0.6, 0.6)),
        (3, "table", (2.25, 0, 0, 3, 1, 0.8)),
        (4, "wall", (0, 1, 0, 2, 1.1, 2)),
        (5, "rug", (0, -3.1, 0, 3.01, 0, 0.01)),
    )
    found = {(r.a, r.b, r.relation, round(r.gap, 6)) for r in spatial.edges(scene).collect()}
    assert found == {(2, 1, "on", 0.0), (1, 3, "near", 0.25)}


def test_grid_pairs_find_each_pair_once(spark):
    rng = np.random.default_rng(0)
    low = rng.uniform(-4, 4, (60, 3)).round(3)
    high = low + rng.uniform(0, 2.5, (60, 3)).round(3)
    scene = nodes(spark, *[(i, "x", (*low[i], *high[i])) for i in range(60)])
    found = sorted((r.a, r.b) for r in spatial.gap_pairs(scene, 0.4).collect())
    gap = lambda i, j: np.linalg.norm(np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0))
    assert found == [(i, j) for i, j in itertools.combinations(range(60), 2) if gap(i, j) <= 0.4]


def test_revisit_golden(spark):
    frames = [*range(0, 5), *range(8, 13)]
    rows = spark.createDataFrame([(7, f * 20, 1000) for f in frames], "obj int, f int, px int")
    runs = events.visible_runs(rows, 500, 50, 60, 20)
    found = sorted(tuple(r) for r in events.hide_revisit(runs).collect())
    assert found == [(7, 80, 0, 80), (7, 160, 1, 80)]
    short = spark.createDataFrame([(7, f * 20, 1000) for f in [*range(0, 5), *range(7, 12)]], "obj int, f int, px int")
    assert events.hide_revisit(events.visible_runs(short, 500, 50, 60, 20)).count() == 0


def test_fit_box_under_fifty_points_is_plain(spark):
    rows = spark.createDataFrame([(1, float(i), 0.0, 1.0) for i in range(49)], "node int, x double, y double, z double")
    r = points.fit_box(rows).first()
    assert (r.n, r.lx, r.hx) == (49, 0.0, 48.0)


def test_normalized_and_prototype(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(
        vec.normalized(F.col("a")).alias("a"), vec.normalized(F.col("b")).alias("b")
    )
    got = row.first()
    assert got.a == [0.6, 0.8] and got.b is None


boxes = st.tuples(*[st.integers(0, 8)] * 3, *[st.integers(1, 6)] * 3)


@settings(max_examples=50, deadline=None)
@given(boxes, boxes)
def test_inside_is_a_share(a, b):
    a, b = (np.array([x[:3], np.add(x[:3], x[3:])], float) for x in (a, b))
    assert 0 <= refine.inside(a, b) <= 1
    assert math.isclose(memory.box_gap(a, b), memory.box_gap(b, a))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=200), st.integers(1, 20))
def test_mask_codec_round_trip(bits, height):
    bits = bits[: len(bits) // height * height] or [True] * height
    mask = np.array(bits, dtype=bool).reshape(-1, height).T
    flat = np.zeros(mask.size, dtype=bool)
    for s, e in geometry.decode_runs(geometry.encode_runs(mask)):
        flat[s:e] = True
    assert (flat == mask.T.ravel()).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, rng):
    w = np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)])
    best = max(
        sum(w[r, c] for r, c in zip(rows, cols, strict=True))
        for k in [min(n, m)]
        for rows in itertools.permutations(range(n), k)
        for cols in itertools.combinations(range(m), k)
    )
    pairs = evals.assign(w)
    assert len({r for r, _ in pairs}) == len(pairs) == len({c for _, c in pairs}) == min(n, m)
    assert sum(w[r, c] for r, c in pairs) == best


def test_mask_pairs_against_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(f), int(m), int(s), int(s + n)) for f, m, s, n in zip(*(rng.integers(a, b, 120) for a, b in ((0, 3), (0, 5), (0, 900), (1, 300))), strict=True)]
    df = spark.createDataFrame(rows, "run int, frame int, mask int, s int, e int")
    got = {(r.frame, r.a, r.b): (r.shared, r.area_a, r.area_b) for r in masks.pairs(df, ["run", "frame"]).collect()}
    sets: dict = {}
    for _, f, m, s, e in rows:
        sets.setdefault((f, m), set()).update(range(s, e))
    want = {}
    for (f, a), (g, b) in itertools.combinations(sorted(sets), 2):
        if f == g and (n := len(sets[f, a] & sets[f, b])):
            want[f, a, b] = (n, len(sets[f, a]), len(sets[f, b]))
    assert got == want


def test_clusters_against_all_pairs():
    rng = np.random.default_rng(1)
    cloud = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in ((0, 0, 0), (1, 0, 0), (0, 2, 0))])
    got = refine.clusters(cloud)
    cube, of, n = np.unique(np.floor(cloud / 0.1).astype(int), axis=0, return_inverse=True, return_counts=True)
    dense = n >= max(2, 0.1 * (n**2).sum() / n.sum())
    forest = refine.Forest()
    for i, j in itertools.combinations(np.flatnonzero(dense), 2):
        if np.linalg.norm((cube[i] - cube[j]) * 0.1) <= 0.3 + 1e-6:
            forest.join(i, j)
    roots = [forest.find(i) if dense[i] else -1 for i in of.reshape(-1)]
    assert [g >= 0 for g in got] == [r >= 0 for r in roots]
    assert len({*zip(got.tolist(), roots, strict=True)}) == len(set(got.tolist())) == len(set(roots))


def test_complete_link_needs_all_members():
    iou = {(1, 2): 0.7, (2, 3): 0.7, (1, 3): 0.1}
    assert refine.complete_link({1: 0.9, 2: 0.8, 3: 0.7}, iou, 0.6) == {1: 0, 2: 0, 3: 1}


def test_greedy_merges_keep_split_siblings_apart():
    final, steps = refine.duplicate_merge([(0.95, 1, 2), (0.92, 2, 3), (0.5, 1, 4)], {1: 5, 2: 3, 3: 9, 4: 1}, apart=[{1, 3}])
    assert final == {1: 1, 2: 1, 3: 3, 4: 4} and steps == [(1, 2)]


def test_merge_takes_the_part_into_the_whole():
    line = np.linspace([0, 0, 0], [1, 1, 1], 50)
    thing = lambda low, high, frames, n: {"label": "a", "box": np.array([[low] * 3, [high] * 3], float), "frames": set(frames), "masks": n, "dino": np.ones(4), "points": line}  # noqa: E731, E501
    final, steps = refine.merge_parts({1: thing(0, 1, [1, 2], 2), 2: thing(0, 2, [3, 4, 5], 3), 3: thing(5, 6, [9], 1)})
    assert final == {1: 2, 2: 2, 3: 3} and steps[0]["kept"] == 2


def seen(track, x, dino=(1.0, 0.0), y=0.0, reliable=True):
    corners = np.array([[x, y, 0], [x + 0.5, y + 0.5, 0.5]])
    return memory.Observation(np.array(dino), corners, 10, "a", (track,), reliable=reliable)


def test_memory_follows_cuts_and_rejects_late_frames():
    m = memory.ObjectMemory()
    assert m.step(0, [seen(1, 0.0)]) == [0]
    assert m.step(1, [seen(1, 0.2)]) == [0] and m.trace[0]["via"] == "track"
    assert m.step(2, [seen(1, 5.0, dino=(0.0, 1.0))]) == [1]  # jumped: cut, nothing fits, new
    with pytest.raises(ValueError):
        m.step(2, [])


def test_memory_bad_pose_cuts_nothing():
    m = memory.ObjectMemory()
    first = m.step(0, [seen(t, 10.0 * t) for t in range(4)])
    moved = [seen(t, 10.0 * t + (2.0 if t < 3 else 0.0)) for t in range(4)]
    assert m.step(1, moved) == first
    assert m.last_view[0][1][0][0] == 0.0  # not remembered in a bad frame


def test_memory_merges_unseen_together():
    m = memory.ObjectMemory()
    m.step(0, [seen(1, 0.0)])
    m.step(1, [seen(2, 0.0, reliable=False)])  # unreliable: an object of its own
    assert m.step(2, [seen(2, 0.05)]) == [0] and m.find(1) == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for run in range(2):
        for f in range(12):
            for k in range(3):
                v = np.eye(4)[k] + rng.normal(0, 0.1, 4)
                rows.append((run, f, run * 100 + f * 3 + k, k if rng.random() < 0.8 else 50 + f, v.tolist(), k * 0.8, 0.0, 0.0, k * 0.8 + 0.5, 0.5, 0.5, 5, bool(rng.random() < 0.8)))
    df = spark.createDataFrame(rows, object_memory.INPUT)
    batch = object_memory.in_batch(df)
    for part in range(3):  # three files, in order of frames
        df.where(f"frame div 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(object_memory.INPUT).parquet(str(tmp_path / "in"))
    stream = object_memory.run_once(object_memory.in_stream(source))
    a = {(r.run, r.mask): r.via for r in batch.collect()}
    b = {(r.run, r.mask): r.via for r in stream.collect()}
    assert a == b and len(a) == 72


def test_umeyama_from_sums(spark):
    rng = np.random.default_rng(2)
    src = rng.normal(size=(50, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    dst = 1.7 * src @ q.T + [1, 2, 3]
    df = spark.createDataFrame(np.concatenate([src, dst], axis=1).tolist(), "sx double, sy double, sz double, dx double, dy double, dz double")
    s, r, t, rms = geometry.umeyama_from_sums(df)
    s2, r2, t2 = geometry.umeyama(src, dst)
    assert np.allclose(r, q) and np.allclose(t, [1, 2, 3]) and abs(s - 1.7) < 1e-9 and rms < 1e-5
    assert np.allclose(r, r2) and np.allclose(t, t2) and abs(s - s2) < 1e-9


def test_project_undoes_backproject():
    k = np.array([[50.0, 0, 20], [0, 50, 15], [0, 0, 1]])
    c2w = np.eye(4)
    c2w[:3, 3] = [1, 2, 3]
    depth = np.full((30, 40), 2.0)
    world, (v, u) = geometry.backproject(depth, k, c2w)
    pu, pv, ok = geometry.project(world, depth, k, c2w)
    assert ok.all() and (pu == u).all() and (pv == v).all()
    assert not geometry.project(world + [0, 0, 1.0], depth, k, c2w)[2].any()  # behind the depth


def test_mask_to_box_and_erosion():
    k = np.array([[50.0, 0, 20], [0, 50, 15], [0, 0, 1]])
    mask = np.zeros((30, 40), dtype=bool)
    mask[5:25, 5:35] = True
    assert geometry.erode(mask).sum() == 16 * 26
    corners, cloud, _ = geometry.mask_to_box(np.full((30, 40), 2.0), k, np.eye(4), mask)
    assert len(cloud) == 16 * 26 and np.isclose(corners[0][2], 2.0)
    assert geometry.mask_to_box(np.zeros((30, 40)), k, np.eye(4), mask) is None


def test_perfect_map_scores_one(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 10), (0, 2, 2, 5)], "run int, id int, obj int, n long")
    n = spark.createDataFrame([(0, 15)], "run int, n long")
    assert evals.identity(pairs, n, n).first().idf1 == 1.0


def test_stage_log(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("r", 1, 2)], stages.SCHEMAS["graph"])
    with pytest.raises(Exception):
        stages.load(spark, root, "graph", "r")
    stages.save(df, root, "graph", "r", {"a": 1})
    assert stages.load(spark, root, "graph", "r").collect()[0].node == 2
    stages.save(spark.createDataFrame([("r", 1, [1.0])], stages.SCHEMAS["features"]), root, "features", "r")
    late = {(r.stage, r.reason) for r in stages.stale(stages.log(spark, root), {"graph": {"a": 2}}).collect()}
    assert late == {("graph", "newer features"), ("graph", "parameters")}
    with pytest.raises(ValueError):
        stages.checked(df, "masks")


def test_groups_by_frame(spark):
    rows = spark.createDataFrame([(0, f, m, 1.0 - m / 10) for f in (0, 1) for m in (1, 2, 3)] + [(1, 0, 1, 0.5)], "run int, frame int, mask int, score double")
    pairs = spark.createDataFrame([(0, 0, 1, 2, 0.9), (0, 1, 2, 3, 0.9)], "run int, frame int, a int, b int, iou double")
    got = {(r.run, r.frame, r.mask): r.group for r in refine.complete_link_groups(rows, pairs, ["run", "frame"], 0.6).collect()}
    assert got == {(0, 0, 1): 0, (0, 0, 2): 0, (0, 0, 3): 1, (0, 1, 1): 0, (0, 1, 2): 1, (0, 1, 3): 1, (1, 0, 1): 0}

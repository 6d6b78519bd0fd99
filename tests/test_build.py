"""The refinement chain, observations, crops, alignment and point scoring on small made-up recordings."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import alignment, build, truth


def blob(rng, centre, n=40):
    return np.asarray(centre) + rng.uniform(-0.1, 0.1, (n, 3))


@pytest.fixture(scope="module")
def recording(spark):
    """Object 1: two things far apart (split). 2 and 3: one thing under two masks a frame (duplicates). 4: inside 5 (part)."""
    rng = np.random.default_rng(0)
    masks, points, looks, runs = [], [], [], []
    spots = {1: [(0, 0, 0), (3, 0, 0)], 2: [(6, 0, 0)], 3: [(6, 0, 0)], 4: [(9, 0, 0)], 5: [(9, 0, 0)]}
    m = 0
    for node, places in spots.items():
        frames = {4: [20, 21, 22], 5: range(30, 36)}.get(node, range(6))
        for f in frames:
            place = places[f % len(places)]
            masks.append((0, m, f, node * 10, 7, 1.0, node, True))
            points += [(0, m, *p) for p in blob(rng, place).tolist()]
            looks.append((0, m, [1.0, 0.0] if node >= 4 else [0.0, 1.0]))
            start = {2: 1000, 3: 1001}.get(node, node * 5000)
            runs.append((0, f, m, start, start + (98 if node == 3 else 100)))
            m += 1
    kinds = "run bigint, mask bigint, frame bigint, track bigint, prompt bigint, score double, node bigint, reliable boolean"
    return (
        spark.createDataFrame(masks, kinds),
        spark.createDataFrame(points, "run bigint, mask bigint, x double, y double, z double"),
        spark.createDataFrame(looks, "run bigint, mask bigint, dino array<double>"),
        spark.createDataFrame(runs, "run bigint, frame bigint, mask bigint, s bigint, e bigint"),
    )


def test_chain(spark, recording):
    masks, points, looks, runs = recording
    out, families = build.split(masks, points)
    assert {(r.node, r.family) for r in families.collect()} == {(1, 1), (6, 1)}
    trust = spark.createDataFrame([(0, n, 0.9, 12, 90.0, False) for n in (1, 2, 6)] + [(0, 5, None, 12, 90.0, False)], "run bigint, node bigint, coverage double, views bigint, arc double, tiny boolean")
    final = build.refine_runs(masks, points, looks, runs, trust=trust)
    by_track = {}
    for r in final.collect():
        by_track.setdefault(r.track, set()).add(r.node)
    assert by_track == {10: {1, 6}, 20: {2}, 30: {2}, 40: {-1}, 50: {-1}}
    numbered, _ = build.renumber_runs(final.drop("label"))
    assert {r.node for r in numbered.collect()} == {-1, 0, 1, 2}
    saved = {r.old: r.node for r in build.saved_node(masks, numbered).collect()}
    assert saved[2] == saved[3] and set(saved) == {1, 2, 3}


def test_consensus_step(spark, recording):
    masks, points, looks, runs = recording
    seen = lambda m: spark.createDataFrame([(0, f, n, [f]) for f in range(4) for n in (1, 6)], "run bigint, frame bigint, node bigint, masks array<bigint>")
    final = build.refine_runs(masks, points, looks, runs, sightings=seen)
    assert {r.node for r in final.where("track = 10").collect()} == {1, 6}  # parts of a split never merge


def test_observations(spark, recording):
    masks, points, looks, _ = recording
    groups = masks.where("frame = 0").select("run", "frame", "mask", F.when(F.col("node") == 3, 2).otherwise(F.col("node")).alias("group"))
    found = {r.group: r for r in build.observations(masks, groups, looks, points).collect()}
    assert found[2].tracks == [20, 30] and found[2].n_points == 80 and found[2].prompt == 7 and found[2].reliable
    assert np.allclose(found[2].dino, [0.0, 1.0]) and 5.8 < found[2].lx < found[2].hx < 6.2


def test_crops(spark):
    df = spark.createDataFrame([(10, 20, 30, 25)], "a int, b int, c int, d int")
    cols = [F.col(c) for c in "abcd"]
    padded = df.select(*[c.alias(n) for c, n in zip(alignment.pad_box(*cols, 100, 100), "abcd", strict=True)]).first()
    assert tuple(padded) == (8, 19, 32, 25)
    square = df.select(*[c.alias(n) for c, n in zip(alignment.square_box(*cols, 40, 100), "abcd", strict=True)]).first()
    assert tuple(square) == (10, 12, 30, 32)
    runs = spark.createDataFrame([(1, 3, 5), (1, 12, 14), (2, 8, 12)], "m int, s int, e int")
    got = {r.m: (r.x0, r.y0, r.x1, r.y1) for r in alignment.bounds_of_runs(runs, ["m"], 10).collect()}
    assert got == {1: (0, 2, 2, 5), 2: (0, 0, 2, 10)}


def test_suppression(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (0, 2, 0.8, 0.0, 0.0, 2.0, 1.9), (0, 3, 0.7, 5.0, 5.0, 6.0, 6.0)], "image int, box int, score double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box for r in alignment.suppress(df, ["image"], 0.5).collect()) == [1, 3]


def test_world_from_camera_and_axes():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    pose = np.concatenate([q, [[1.0], [2.0], [3.0]]], axis=1)
    out = alignment.world_from_camera(pose, np.eye(4))
    assert np.allclose(q @ out[:3, 3] + [1, 2, 3], 0) and np.allclose(out[:3, :3], q.T)
    turn = alignment.frame_of(np.array([0, 0, 1.0]), np.array([0, 2.0, 1.0]))
    assert np.allclose(turn @ turn.T, np.eye(3)) and np.allclose(turn[0], [0, 1, 0])


def level_camera(heading, pitch, up):
    """Right, down and view axes of a camera that is level about ``up``, turned by ``heading`` and tilted by ``pitch``."""
    base = alignment.frame_of(up, np.array([0.3, 0.9, 0.2]))
    flat = np.cos(heading) * base[0] + np.sin(heading) * base[1]
    right = np.cross(flat, up)
    view = np.cos(pitch) * flat + np.sin(pitch) * up
    return np.stack([right, np.cross(view, right), view])


def test_gravity_of_cameras_that_turn_about_one_axis():
    up = np.array([0.2, -0.5, 0.8]) / np.linalg.norm([0.2, -0.5, 0.8])
    # All look down steeply: their own ups lean to the side they look to, their right axes do not.
    axes = np.stack([level_camera(h, -0.9, up) for h in np.linspace(0, 2, 9)])
    assert np.allclose(alignment.gravity_up(axes[:, 0], axes[:, 1]), up)
    still = np.stack([level_camera(0.4, 0.1, up)] * 5)
    assert np.allclose(alignment.gravity_up(still[:, 0], still[:, 1]), -still[0, 1])
    one = alignment.gravity_up(axes[:1, 0], axes[:1, 1])
    assert np.allclose(one, -axes[0, 1])


def test_alignment_of_a_room():
    """A box-shaped room seen from inside: z comes up, x goes along a wall, and errors against the truth are small."""
    up = np.array([0.1, 0.3, 0.9]) / np.linalg.norm([0.1, 0.3, 0.9])
    room = alignment.frame_of(up, np.array([1.0, 0.2, 0.0]))  # the walls, in the model's world
    centres = np.array([[0.1 * i, 0.05 * i * i, 0.02 * i] for i in range(8)])
    cameras = []
    for i, c in enumerate(centres):
        r = level_camera(0.3 + 0.4 * i, -0.2, up)
        cameras.append(np.concatenate([r, (-r @ c)[:, None]], axis=1))
    cameras = np.stack(cameras)
    walls = lambda turn: np.repeat(np.stack([room[0], room[1], -room[0], room[2]]), 50, axis=0) @ turn.T
    sim3 = truth.alignment(cameras, alignment.gravity_up(cameras[:, 0, :3], cameras[:, 1, :3]), 2.0, walls)
    assert np.allclose(sim3[2, :3], 2 * up) and np.isclose(abs(sim3[:3, :3] @ room[0] / 2).max(), 1)
    true = 2 * centres @ room.T + [4, 5, 6]
    errors = truth.alignment_errors(centres, true, sim3, 0.0)
    assert all(abs(v) < 1e-3 for v in errors.values())
    tilted = truth.alignment_errors(centres, true, 1.1 * sim3, np.radians(3))
    assert np.isclose(tilted["scale_error"], 0.1) and np.isclose(tilted["wall_error_deg"], 3)
    fit, rms = truth.truth_frame(None)
    assert (fit == np.eye(4)).all() and rms == 0


def test_normals_of_a_slanted_wall():
    k = np.array([[50.0, 0, 20], [0, 50, 15], [0, 0, 1]])
    u = np.indices((30, 40))[1]
    normal = np.array([0.6, 0.0, -0.8])
    depth = -1.6 / (normal[0] * (u - 20) / 50 + normal[2])  # the plane normal . p = -1.6
    found = truth.depth_normals(depth, k, np.eye(3))
    assert len(found) == 28 * 38 and np.allclose(abs(found @ normal), 1, atol=1e-6)


def test_metric_scale_and_truth_boxes(spark):
    px = spark.createDataFrame([(0, f, r * 2.0, 2.0) for f, rs in enumerate(((1, 2, 3), (4, 5, 6), (2, 2, 2))) for r in rs], "run int, frame int, metric double, relative double")
    assert alignment.metric_scale(px).first().scale == 2.0
    rng = np.random.default_rng(0)
    cloud = [(1, *p) for p in rng.normal(0, 1, (80, 3)).tolist()] + [(1, 90.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    got = alignment.truth_boxes(spark.createDataFrame(cloud, "obj int, x double, y double, z double"), ["obj"]).collect()
    assert [r.obj for r in got] == [1] and got[0].hx < 10


def test_nearest_within_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 1, (60, 3)), rng.uniform(0, 1, (40, 3))
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(a)], "scene int, point int, x double, y double, z double")
    cloud = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(b)], "scene int, obj int, x double, y double, z double")
    got = {r.point: r.obj for r in alignment.nearest_within(points, cloud, ["scene"], 0.15).collect()}
    for i, p in enumerate(a):
        d = np.linalg.norm(b - p, axis=1)
        assert got[i] == (int(d.argmin()) if d.min() <= 0.15 else None)


def test_segmentation_and_precision(spark):
    near = spark.createDataFrame([("s", 0, 1), ("s", 1, 1), ("s", 2, None)], "scene string, point int, obj int")
    ranked = spark.createDataFrame([("s", 1, "sofa", 1), ("s", 1, "lamp", 2)], "scene string, obj int, label string, rank int")
    truth = spark.createDataFrame([("s", 0, 7), ("s", 1, 7), ("s", 2, 7)], "scene string, point int, object int")
    cats = spark.createDataFrame([("s", 7, "sofa", "vis_sim"), ("s", 7, "lamp", "synonym")], "scene string, object int, label string, category string")
    r = alignment.segmentation(near, ranked, truth, cats, 1).first()
    assert (round(r.vis_sim, 6), round(r.missing, 6), r.synonym) == (0.666667, 0.333333, 0.0)
    assert round(alignment.segmentation(near, ranked, truth, cats, 2).first().synonym, 6) == 0.666667
    pred = spark.createDataFrame([("s", 1, v) for v in range(4)] + [("s", 2, v) for v in range(10, 14)], "scene string, p int, vertex int")
    real = spark.createDataFrame([("s", 5, v) for v in range(5)], "scene string, t int, vertex int")
    ious = alignment.set_ious(pred, real, ["scene"])
    assert {(x.p, x.t): x.iou for x in ious.collect()} == {(1, 5): 0.8}
    order = spark.createDataFrame([("q", 2, 1), ("q", 1, 2)], "query string, p int, rank int")
    targets = spark.createDataFrame([("q", 5)], "query string, t int")
    assert alignment.precision_at(ious.drop("scene"), order, targets, (0.5, 0.9)).first().ap == 0.25
    assert len(list(itertools.chain(alignment.CATEGORIES))) == 6

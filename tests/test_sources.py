"""Readers, lifting from depth, and the search command."""

import argparse
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import lift
from tesserae.plans import search_cli
from tesserae.sources import dataset


def write_png(image: np.ndarray, kind: int) -> bytes:
    """A PNG whose rows all use one filter."""
    depth = 16 if image.dtype == np.uint16 else 8
    channels = 1 if image.ndim == 2 else image.shape[2]
    rows = image.reshape(image.shape[0], -1)
    rows = (rows.astype(">u2").view(np.uint8) if depth == 16 else rows).astype(int)
    step, above, out = channels * depth // 8, np.zeros(rows.shape[1], int), b""
    for line in rows:
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(axis=0)
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(near, [left, above, corner])}[kind]
        out += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    colour = {1: 0, 3: 2}[channels]
    chunk = lambda k, d: struct.pack(">I4s", len(d), k) + d + b"\0\0\0\0"
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    for image in (rng.integers(0, 65536, (7, 9)).astype(np.uint16), rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)):
        assert (dataset.png(write_png(image, kind)) == image).all()


def test_readers(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("\n".join(" ".join(str(i * 100 + k) for k in range(16)) for i in range(3)) + "\n")
    got = dataset.poses(spark, str(tmp_path / "poses.txt")).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1, 2] and got[2].c2w[15] == 215.0
    (tmp_path / "o.json").write_text(json.dumps({"objects": [{"id": 1, "class_name": "sofa"}, {"id": 2, "class_name": "undefined"}]}))
    (tmp_path / "l.json").write_text(json.dumps({"dataset": {"samples": [{"object_id": 1, "labels": {"image_attributes": {"synonyms": ["couch"]}}}]}}))
    found = dataset.objects(spark, str(tmp_path / "o.json"), str(tmp_path / "l.json"))
    assert {r.object_id: r.labels for r in found.collect()} == {1: {"synonyms": ["couch"]}, 2: {}}
    assert [r.class_name for r in dataset.class_names(found, promptable=True).collect()] == ["sofa"]
    (tmp_path / "q.json").write_text(json.dumps({"level0": {"couch": [1, 5]}, "level1": {}}))
    assert dataset.text_queries(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "v.txt").write_text(" a \n\nb\n")
    assert [(r.prompt, r.text) for r in dataset.prompts(spark, str(tmp_path / "v.txt")).collect()] == [(0, "a"), (1, "b")]
    assert dataset.prompts(spark, "indoor").count() == 102
    ids = np.array([[0, 1], [1, 1], [2, 0]], dtype=np.uint16)
    (tmp_path / "semantic_instance_4.png").write_bytes(write_png(ids, 2))
    runs = dataset.instance_runs(spark, str(tmp_path / "semantic_instance_*.png"))
    assert sorted((r.object_id, r.s, r.e) for r in runs.collect()) == [(1, 1, 2), (1, 3, 5), (2, 2, 3)]
    assert sorted((r.object_id, r.prompt) for r in dataset.truth_masks(runs, found).collect()) == [(1, 0), (2, 1)]
    (tmp_path / "depth_4.png").write_bytes(write_png(ids * 1000, 0))
    d = dataset.depth_images(spark, str(tmp_path / "depth_*.png")).first()
    assert (d.frame, d.h, d.w) == (4, 3, 2) and np.frombuffer(d.depth, "<f4")[4] == 2.0
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "a.mov").write_bytes(b"x")
    assert dataset.videos(spark, str(tmp_path / "clips"), "phone/a").first().clip == 0
    with pytest.raises(FileNotFoundError):
        dataset.videos(spark, str(tmp_path / "clips"), "phone/a+b")


def test_sources_are_checked():
    assert dataset.parse_source("replica/room_0/00") == ("room_0", "00")
    for bad in ("replica/room_9/00", "phone/a", "replica/room_0/02"):
        with pytest.raises(ValueError):
            dataset.parse_source(bad)
    assert dataset.make_run("phone/a", 2)["pose_source"] == "vggt"
    with pytest.raises(ValueError):
        dataset.make_run("phone/a", 2, "gt")


def test_frame_labels(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 5, 0, "a"), (1, 9, 1, "b"), (1, 12, 1, "b")], "run int, frame int, clip int, name string")
    assert [r.label for r in dataset.frame_labels(rows).orderBy("frame").collect()] == ["a frame 0", "a frame 5", "b frame 0", "b frame 3"]


@pytest.fixture
def scene(spark):
    """A wall at 2 m that two cameras see; object 1 covers its middle, object 2 has a mask in one frame only."""
    k, eye = [50.0, 0.0, 20.0, 0.0, 50.0, 15.0, 0.0, 0.0, 1.0], np.eye(4)
    moved = eye.copy()
    moved[0, 3] = 0.1
    depth = np.full((30, 40), 2.0, "<f4").tobytes()
    cameras = spark.createDataFrame(
        [(0, f, 30, 40, 30, 40, depth, None, k, c.ravel().tolist()) for f, c in ((0, eye), (1, moved))],
        "run long, frame long, height int, width int, h int, w int, depth binary, conf binary, k array<double>, c2w array<double>",
    )
    box = lambda u0, u1, v0, v1: [(u * 30 + v0, u * 30 + v1) for u in range(u0, u1)]
    spans = {10: box(10, 30, 5, 25), 11: box(8, 28, 5, 25), 20: box(30, 40, 5, 25)}
    runs = spark.createDataFrame([(0, m, s, e) for m, x in spans.items() for s, e in x], "run long, mask long, s long, e long")
    masks = spark.createDataFrame([(0, 0, 10, 1, 0), (0, 1, 11, 1, 0), (0, 0, 20, 2, 1)], "run long, frame long, mask long, node long, prompt long")
    return lift.frame_rows(cameras, runs, masks)


def test_boxes_and_agreement(scene):
    boxes = {r.mask: r for r in lift.mask_boxes(scene).collect()}
    assert np.isclose(boxes[10].lz, 2.0) and boxes[10].n_points == 16 * 16 and np.isclose(boxes[10].lx, (12 - 20) / 50 * 2)
    points = lift.lifted_points(scene)
    n = {r.node: r["count"] for r in points.groupBy("node").count().collect()}
    assert n == {1: 800, 2: 200}
    kept = lift.agreed_points(points, scene)
    after = {r.node: r["count"] for r in kept.groupBy("node").count().collect()}
    assert after[2] == 200 and 700 <= after[1] <= 800  # what no other view sees stays
    assert lift.object_boxes(kept).count() == 2
    cover = {r.node: r.coverage for r in lift.coverage(points, scene).collect()}
    assert cover[1] > 0.9 and cover[2] == 1.0


def test_sightings(scene):
    found = {(r.frame, r.node): r.masks for r in lift.sightings(lift.lifted_points(scene), scene).collect()}
    assert found[0, 1] == [10] and found[1, 1] == [11] and found[0, 2] == [20]
    assert found[1, 2] == []  # frame 1 sees object 2, and no mask holds it there


def test_search_command(spark):
    kinds = "run long, node long, label string, lx double, ly double, lz double, hx double, hy double, hz double"
    nodes = spark.createDataFrame([(0, 1, "sofa", 0.0, 0.0, 0.0, 2.0, 1.0, 0.8), (0, 2, "cushion", 0.2, 0.2, 0.4, 0.6, 0.6, 0.6), (0, 3, "lamp", 3.0, 0.0, 0.0, 3.2, 0.2, 1.0)], kinds)
    objects = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, embedding array<double>")
    texts = spark.createDataFrame([("couch", [1.0, 0.0]), ("pillow", [0.0, 1.0])], "text string, embedding array<double>")

    def ask(*argv):
        return [r.node for r in search_cli.answer(nodes, objects, texts, search_cli.parser().parse_args([*argv, "--map", "m"])).collect()]

    assert ask("couch", "--top", "2") == [1, 3]
    assert ask("--on", "sofa") == [2] and ask("cushion", "--near", "sofa") == [2] and ask("--on", "unknown") == []
    assert ask("lamp", "--nearest", "couch") == [3]
    assert ask("--position", "3", "0", "0")[0] == 3 and ask("sofa", "--position", "3", "0", "0") == [1]
    for bad in (["--near", "a", "--on", "b"], ["--nearest", "couch"], []):
        with pytest.raises(ValueError):
            search_cli.check(search_cli.parser().parse_args([*bad, "--map", "m"]))
    assert isinstance(search_cli.parser(), argparse.ArgumentParser) and F is not None


def test_describe(spark):
    from tesserae.operators import spatial

    kinds = "run long, node long, label string, lx double, ly double, lz double, hx double, hy double, hz double"
    nodes = spark.createDataFrame([(0, 1, "sofa", 0.0, 0.0, 0.0, 2.0, 1.0, 0.8), (0, 2, "cushion", 0.2, 0.2, 0.4, 0.6, 0.6, 0.6)], kinds)
    got = {r.node: r.text for r in search_cli.describe(nodes, spatial.edges(nodes)).collect()}
    assert got == {1: "sofa at (1.00, 0.50, 0.40); under 2", 2: "cushion at (0.40, 0.40, 0.50); on 1"}


def test_predictions_replace_scenes(spark, tmp_path):
    from tesserae.sources import stages

    root, emb = str(tmp_path), "scene string, obj int, embedding array<double>"
    cloud = lambda *rows: spark.createDataFrame(list(rows), "scene string, obj int, x double, y double, z double")
    one = spark.createDataFrame([("a", 1, [1.0])], emb)
    stages.save_prediction(cloud(("a", 1, 0.0, 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0)), one, root, "m")
    stages.save_prediction(cloud(("a", 2, 0.0, 0.0, 0.0), ("a", 3, 0.0, 0.0, 0.0)), one, root, "m")
    stages.save_prediction(cloud(("a", 9, 0.0, 0.0, 0.0)), one, root, "n")
    got = sorted((r.scene, r.obj) for r in stages.predictions(spark, root, "points", "m").collect())
    assert got == [("a", 2), ("a", 3), ("b", 1)]
    assert stages.predictions(spark, root, "embeddings", "n").count() == 1

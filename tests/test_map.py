"""From saved stages to a saved graph, and back as nodes; the views and the sample of the ground truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.colour import channels
from tesserae.operators import geometry, graph, search, spatial, truth, views
from tesserae.sources import stages


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Two objects over 12 frames, each under one track; the second is also under a doubled mask in each frame."""
    where = str(tmp_path_factory.mktemp("stages"))
    masks, boxes, dino, text, m = [], [], [], [], 0
    for f in range(12):
        for thing, track, start in ((0, 1, 10), (1, 2, 200), (1, 3, 201)):
            image = np.zeros(1200, dtype=bool)
            image[start : start + 90] = True
            masks.append(("r", m, f, thing, track, 1.0, geometry.encode_runs(image.reshape(40, 30).T)))
            low = [5.0 * thing, 0.01 * f, 0.0]
            boxes.append(("r", m, low, [low[0] + 1, low[1] + 1, 1.0], 60, 5.0))
            dino.append(("r", m, [1.0 - thing, float(thing)]))
            text.append(("r", m, [0.5, float(thing)]))
            m += 1
    for name, rows in (("masks", masks), ("boxes", boxes), ("features", dino), ("siglip", text)):
        params = graph.vocab_params(["sofa", "lamp"]) if name == "masks" else {}
        stages.save(spark.createDataFrame(rows, stages.SCHEMAS[name]), where, name, "r", params)
    return where


def test_rebuild_saves_a_searchable_graph(spark, root):
    trust = graph.rebuild(spark, root, "r", spark.createDataFrame([("r", f) for f in range(14)], "run string, frame bigint"))
    history = trust["trace"].where("kind = 'history'").orderBy("frame").collect()
    assert [r.n for r in history] == [2] * 12 + [0, 0] and history[-1].node == 2
    match = trust["trace"].where("kind = 'match'").collect()
    assert len(match) == 24 and {r.via for r in match} == {"new", "track"} and all(r.reliable for r in match)
    nodes = {r.node: r for r in graph.load_nodes(spark, root, "r").collect()}
    assert {(r.label, tuple(r.tracks), len(r.frames)) for r in nodes.values()} == {("sofa", (1,), 12), ("lamp", (2, 3), 12)}
    assert all(len(r.masks) in (12, 24) and r.hx > r.lx for r in nodes.values())
    saved = {r.old: r.node for r in trust["moved"].collect()}
    assert set(saved.values()) == set(nodes)
    written = spark.read.parquet(f"{root}/graph_match/run_id=r").collect()
    assert len(written) == 24 and all(r.saved == saved[r.node] for r in written)


def test_cached_observations_are_checked(spark, root, tmp_path):
    assert [tuple(r) for r in graph.mask_vocab(spark, root, "r").collect()] == [(0, "sofa"), (1, "lamp")]
    where = str(tmp_path)
    stages.save(spark.createDataFrame([("r", 0, [1.0])], stages.SCHEMAS["features"]), where, "features", "r")
    with pytest.raises(FileNotFoundError, match="masks, boxes, siglip"):
        graph.cached_observations(spark, where, "r")
    stages.save(spark.createDataFrame([("r", 0, [0.0] * 3, [1.0] * 3, 5, 1.0)], stages.SCHEMAS["boxes"]), where, "boxes", "r")
    stages.save(spark.createDataFrame([("r", 0, [1.0])], stages.SCHEMAS["siglip"]), where, "siglip", "r")
    stages.save(spark.createDataFrame([("r", 0, 0, 0, 1, 1.0, "")], stages.SCHEMAS["masks"]), where, "masks", "r", graph.vocab_params(["a"]))
    with pytest.raises(ValueError, match="older than masks: boxes, features, siglip"):
        graph.cached_observations(spark, where, "r")
    masks = spark.createDataFrame([(0, 3)], "mask int, prompt int")
    vocab = spark.createDataFrame([(0, "a")], "prompt int, label string")
    with pytest.raises(ValueError, match="vocabulary"):
        graph.check_inputs(masks, [masks], vocab)
    with pytest.raises(ValueError, match="aligned"):
        graph.check_inputs(masks, [masks.where("mask = 1")], vocab)


def test_node_without_a_reliable_mask_has_the_most_confident_box(spark):
    rows = [(0, 1, 5, 1.0), (0, 2, 5, 2.0), (0, 3, 0, 9.0), (0, 4, 0, None)]
    boxes = spark.createDataFrame([(*r, *[float(r[1])] * 3, *[r[1] + 1.0] * 3) for r in rows], "run int, mask int, n_points int, conf double, lx double, ly double, lz double, hx double, hy double, hz double")
    assigned = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 3, 7), (0, 4, 8), (0, 5, -1)], "run int, mask int, node int")
    found = {r.node: (r.lx, r.hx) for r in graph.node_boxes(assigned, boxes).collect()}
    assert found == {7: (2.0, 3.0), 8: (None, None)}
    cloud = spark.createDataFrame([(0, 2, float(i), 0.0, 0.0) for i in range(100)], "run int, mask int, x double, y double, z double")
    sure = boxes.withColumn("conf", F.lit(3.0))
    assert {r.node: (r.lx, r.hx) for r in graph.node_boxes(assigned, sure, cloud).collect()}[7] == (1.0, 97.0)


def test_truth_sample_is_bounded_and_fixed(spark):
    points = spark.createDataFrame([(n, f, float(i), 0.0, 1.0) for n in (1, 2) for f in (0, 1) for i in range(30 * n)], "node int, frame int, x double, y double, z double")
    kept = truth.sampled_per_frame(points, ["node"], most=40, least=40)
    assert {(r.node, r.frame): r["count"] for r in kept.groupBy("node", "frame").count().collect()} == {(2, 0): 40, (2, 1): 40}
    assert sorted(kept.collect()) == sorted(truth.sampled_per_frame(points.repartition(5), ["node"], most=40, least=40).collect())


def test_views(spark):
    runs = spark.createDataFrame([(0, 1, 5, 0, 10), (0, 1, 6, 20, 24), (0, 1, 6, 22, 40)], "run int, frame int, mask int, s int, e int")
    rows = {r.mask: (r.place, r.area, r.x, r.y) for r in views.panel_layout(runs, 10, ["run", "frame"]).collect()}
    assert rows == {5: (2, 10, 0, 4), 6: (1, 20, 2, 4)}
    nodes = spark.createDataFrame([(0, 1, "sofa", 0.0, 0.0, 0.0, 2.0, 1.0, 1.0), (0, 2, "x", None, None, None, None, None, None)], "run int, node int, label string, lx double, ly double, lz double, hx double, hy double, hz double")
    drawn = views.svg(views.top_down(nodes, [9]), 0)
    assert drawn.count("<rect") == 1 and 'opacity="0.25"' in drawn and "sofa 1" in drawn
    with pytest.raises(ValueError):
        views.svg(views.top_down(nodes), 0, most=0)
    shades = spark.range(500).select(*channels(F.col("id"))).collect()
    assert all(90 <= c <= 255 for r in shades for c in r) and len(set(shades)) > 490
    edges = spark.createDataFrame([(0, 1, 2, "near", 0.1), (0, 3, 2, "on", 0.0), (0, 0, 4, "near", 0.0)], "run int, a int, b int, relation string, gap double")
    assert [r.a for r in spatial.listing(edges).orderBy("place").collect()] == [3, 0, 1]


def test_many_queries_meet_objects_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "FEW", 3)
    monkeypatch.setattr(search, "BLOCK", 4)
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(11)], "query int, q array<double>")
    objects = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "id int, embedding array<double>")
    found = search.rank(queries, objects)
    assert found.count() == 77 and "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert {r.id for r in found.where("rank = 1").collect()} == {6}

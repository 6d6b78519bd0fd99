"""Nearest objects of a class, image helpers and encoders."""

import numpy as np

from tesserae.functions import encoders
from tesserae.operators import evals, geometry

BOXES = "lx double, ly double, lz double, hx double, hy double, hz double"


def cube(x):
    return (float(x), 0.0, 0.0, float(x) + 1, 1.0, 1.0)


def test_nearest_objects(spark):
    truth = spark.createDataFrame(
        [(0, 1, "table", *cube(0)), (0, 2, "chair", *cube(2)), (0, 3, "chair", *cube(5)), (0, 4, "chair", *cube(9))],
        f"run int, object int, class string, {BOXES}",
    )
    nodes = [(0, 10, "table", 5, 1, "table", *cube(0)), (0, 11, "chair", 3, 2, "chair", *cube(2)), (0, 12, "chair", 3, 3, "chair", *cube(5)), (0, 13, "chair", 3, None, None, *cube(1.2)), (0, 14, "lamp", 9, 4, "chair", *cube(9))]
    kinds = f"run int, node int, label string, frames int, owner int, owner_class string, {BOXES}"
    r = evals.nearest_objects(truth, spark.createDataFrame(nodes, kinds)).first()
    # asked: table -> chair (2), and each chair for the nearest other chair
    assert (r.queries, r.anchor, r.reach, r.oracle) == (4, 1.0, 1.0, 1.0)
    # by label the unowned chair is taken first by 1 and 2; 3 finds 2; 4 finds 3
    assert r.labels == 0.5
    none = evals.nearest_objects(truth, spark.createDataFrame(nodes[3:4], kinds)).first()
    assert (none.anchor, none.reach, none.oracle, none.labels) == (0.0, 0.0, 0.0, 0.0)


def test_images():
    image = np.arange(12.0).reshape(3, 4)
    assert np.allclose(geometry.upsample(image, (3, 4)), image)
    big = geometry.upsample(image, (6, 8))
    assert big.shape == (6, 8) and np.isclose(big.mean(), image.mean()) and big[0, 0] == 0.0
    depth = np.ones((5, 5))
    depth[:, 3:] = 2.0
    assert geometry.smooth_depth(depth).tolist()[2] == [True, True, False, False, True]


def test_encoders(spark):
    class Double:
        def encode(self, rows):
            return np.stack([rows["x"] * 3.0, rows["x"] * 4.0], axis=1)

    encoders.register("double", Double)
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "id int, x double")
    got = {r.id: [round(v, 6) for v in r.embedding] for r in encoders.embed(df, "double", ["id"]).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    table = spark.createDataFrame([("m", "a", [1.0])], "model string, text string, embedding array<double>")
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    assert {r.text: r.embedding for r in encoders.look_up(texts, table, "m").collect()} == {"a": [1.0], "b": None}

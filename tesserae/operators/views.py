"""Data of the views: what a frame's panel and the map from above show. Pixels are drawn by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.colour import channels
from tesserae.operators import masks as mask_ops

DIMMED = 0.25


def panel_layout(runs: DataFrame, height: int, by: list[str]) -> DataFrame:
    """by, mask, place, area, x, y: the order in which a frame's masks are drawn, large ones first, and where labels go.

    runs: by, mask, s, e (column-major pixels of images ``height`` high). A label sits on the mask's pixel nearest to its
    centroid, the upper left one on ties; distances are whole numbers, so they are exact.
    """
    key = [*by, "mask"]
    whole = mask_ops.union(runs, key).where(F.col("e") > F.col("s"))
    column = F.explode(F.sequence(F.floor(F.col("s") / height), F.floor((F.col("e") - 1) / height))).alias("x")
    top, end = F.greatest(F.col("s") - F.col("x") * height, F.lit(0)), F.least(F.col("e") - F.col("x") * height, F.lit(height))
    pieces = whole.select(*key, "s", "e", column).select(*key, "x", top.alias("y0"), (end - 1).alias("y1"))
    n, of_mask = F.col("y1") - F.col("y0") + 1, Window.partitionBy(*key)
    pieces = pieces.withColumn("area", F.sum(n).over(of_mask)).withColumn("sx", F.sum(n * F.col("x")).over(of_mask))
    pieces = pieces.withColumn("sy", F.sum(F.expr("(y0 + y1) * (y1 - y0 + 1) div 2")).over(of_mask))
    # in a column, the row nearest to the centroid: the upper one of two that are as near, then moved into the piece
    row = F.expr("sy div area + if(2 * (sy % area) > area, 1, 0)")
    pieces = pieces.withColumn("y", F.greatest("y0", F.least("y1", row)))
    off = lambda c, s: F.col("area") * F.col(c) - F.col(s)
    away = off("x", "sx") * off("x", "sx") + off("y", "sy") * off("y", "sy")
    spots = pieces.groupBy(*key).agg(F.min(F.struct(away.alias("d"), "y", "x")).alias("at"), F.first("area").alias("area"))
    order = Window.partitionBy(*by).orderBy(F.col("area").desc(), "mask")
    return spots.select(*key, F.row_number().over(order).alias("place"), "area", "at.x", "at.y")


def top_down(nodes: DataFrame, highlight: list[int] | None = None) -> DataFrame:
    """run, node, label, x, y, width, depth, alpha and colour of each object's rectangle; others than ``highlight`` are dim."""
    lit = F.lit(True) if highlight is None else F.col("node").isin(*highlight)
    red, green, blue = channels(F.col("node"))
    side = lambda k: F.col(f"h{k}") - F.col(f"l{k}")
    return nodes.where(F.col("lx").isNotNull()).select(
        "run", "node", "label", F.col("lx").alias("x"), F.col("ly").alias("y"), side("x").alias("width"), side("y").alias("depth"),
        F.when(lit, 1.0).otherwise(DIMMED).alias("alpha"), red.alias("red"), green.alias("green"), blue.alias("blue"),
    )


def svg(rectangles: DataFrame, run, most: int = 1000) -> str:
    """A drawing of one run's map from above; an error if it has more than ``most`` objects."""
    rows = rectangles.where(F.col("run") == run).orderBy("node").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} objects")
    box = lambda r: f'<rect x="{r.x}" y="{r.y}" width="{r.width}" height="{r.depth}" fill="rgb({r.red},{r.green},{r.blue})" opacity="{r.alpha}"><title>{r.label} {r.node}</title></rect>'  # noqa: E731, E501
    xs, ys = [x for r in rows for x in (r.x, r.x + r.width)], [y for r in rows for y in (r.y, r.y + r.depth)]
    frame = f"{min(xs)} {min(ys)} {max(xs) - min(xs)} {max(ys) - min(ys)}" if rows else "0 0 1 1"
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{frame}">{"".join(map(box, rows))}</svg>'

"""Vector expressions over array columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where lengths differ."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector; null for an empty, non-finite or near-zero one."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & finite & (norm(v) > 1e-6), F.transform(v, lambda x: x.cast("double") / norm(v)))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def prototype_similarity(descriptor: Column, bank: Column) -> Column:
    """Largest cosine of a unit descriptor to a bank of unit descriptors, within [0, 1]; 0 without any."""
    return F.coalesce(F.array_max(F.transform(bank, lambda b: clipped(dot(descriptor, b)))), F.lit(0.0))


def vector_sum(rows: DataFrame, by: list[str], vector: str, out: str = "total") -> DataFrame:
    """Sum of a vector column by key. Components are summed apart, so partial sums combine before the shuffle."""
    return (
        rows.select(*by, F.posexplode(vector).alias("_pos", "_x"))
        .groupBy(*by, "_pos")
        .agg(F.sum(F.col("_x").cast("double")).alias("_x"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_v"))
        .select(*by, F.transform("_v", lambda p: p["_x"]).alias(out))
    )

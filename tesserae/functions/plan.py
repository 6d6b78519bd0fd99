"""Plan helpers: checked broadcasts, grid joins and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def small_side(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint if the table has ``most`` rows at most; else the table as it is, for Spark to plan."""
    return F.broadcast(df) if len(df.limit(most + 1).take(most + 1)) <= most else df


#: Rows that one task of a large shuffle holds, about.
PART = 500_000


def parts(df: DataFrame, rows: int) -> int | None:
    """How many parts a shuffle of ``rows`` rows needs, so that no task grows with the input; None where one is enough."""
    return max(-(-rows // PART), df.sparkSession.sparkContext.defaultParallelism) if rows > PART else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """The table dealt to ``n`` parts by its keys; as it is, for Spark to plan, if that is None."""
    return df if n is None else df.repartition(n, *keys)


def grid_rows(df: DataFrame, prefix: str, cell: float, reach: float = 0.0, axes: str = "xyz") -> int:
    """The number of rows of ``grid_cells``, which the planner takes for that of boxes."""
    n = F.lit(1)
    for k in axes:
        low = F.floor((F.col(f"{prefix}l{k}") - reach) / cell)
        n = n * (F.abs(F.floor((F.col(f"{prefix}h{k}") + reach) / cell) - low) + 1)
    return df.agg(F.sum(n)).first()[0] or 0


def grid_cells(df: DataFrame, prefix: str, cell: float, reach: float = 0.0, axes: str = "xyz") -> DataFrame:
    """A row for each grid cell that the box, grown by ``reach``, touches: columns cell_<axis>."""
    for k in axes:
        low = F.floor((F.col(f"{prefix}l{k}") - reach) / cell)
        high = F.floor((F.col(f"{prefix}h{k}") + reach) / cell)
        df = df.withColumn(f"cell_{k}", F.explode(F.sequence(low, high)))
    return df


def grid_pairs(left: DataFrame, right: DataFrame, cell: float, reach: float, by: list[str], axes: str = "xyz") -> DataFrame:
    """Pairs of boxes (a_*, b_*) whose boxes are within ``reach`` on every axis, each pair once.

    Both sides go to grid cells and meet by equality, which shuffles on (by, cell) and never compares all pairs. A
    pair that shares several cells is kept in the one where its overlap begins.
    """
    cells = [f"cell_{k}" for k in axes]
    n = parts(left, grid_rows(left, "a_", cell, reach, axes))
    a, b = grid_cells(left, "a_", cell, reach, axes), grid_cells(right, "b_", cell, 0.0, axes)
    if n is not None:  # the planner would broadcast a whole side, which it takes for as small as before the grid
        a, b = dealt(a, n, *by, *cells), dealt(b, n, *by, *cells).hint("shuffle_hash")
    met = a.join(b, [*by, *cells])
    for k in axes:
        start = F.floor(F.greatest(F.col(f"a_l{k}") - reach, F.col(f"b_l{k}")) / cell)
        met = met.where(F.col(f"cell_{k}") == start)
        met = met.where((F.col(f"a_l{k}") - reach <= F.col(f"b_h{k}")) & (F.col(f"b_l{k}") <= F.col(f"a_h{k}") + reach))
    return met.drop(*cells)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def global_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct values of a column numbered 0, 1, ... in order, without one task for all of them.

    Values are dealt by range and numbered within their part; parts start where the counts of those before end.
    """
    dealt = df.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    fixed = cut(dealt)  # the parts must not change between the two uses
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return fixed.withColumn("_at", place).join(F.broadcast(starts), "_part").select(column, (F.col("_at") + F.col("_start")).alias(out))


def shared_folder(spark) -> str:
    """The cluster's shared folder for checkpoints. Only a session on one machine gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cuts-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Scene-shaped views of the driver's tables: each as a DataFrame and as a DuckDB common table expression.

Coordinates are multiples of 1/8 and so exact. Every row of a table is used; large tables become many scenes (``run``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, node, label and box of objects; 400 to a run; the label 'economy...' plays the shell."""
    key = F.col("p_partkey")
    lx, ly, lz = (key * 37 % 128) * 0.125, (key * 101 % 128) * 0.125, (F.col("p_size") % 8) * 0.125
    return read(spark, sf_dir, "part").select(
        F.expr("(p_partkey - 1) div 400").alias("run"),
        key.alias("node"),
        F.when(F.lower("p_type").startswith("economy"), "wall").otherwise(F.lower("p_type")).alias("label"),
        lx.cast("double").alias("lx"),
        ly.cast("double").alias("ly"),
        lz.cast("double").alias("lz"),
        (lx + (1 + key % 7) * 0.125).cast("double").alias("hx"),
        (ly + (1 + key % 5) * 0.125).cast("double").alias("hy"),
        (lz + (1 + F.col("p_size") % 6) * 0.125).cast("double").alias("hz"),
    )


NODES = """nodes AS (
  SELECT (p_partkey - 1) // 400 AS run, p_partkey AS node,
         CASE WHEN starts_with(lower(p_type), 'economy') THEN 'wall' ELSE lower(p_type) END AS label,
         (p_partkey * 37 % 128) * 0.125::DOUBLE AS lx, (p_partkey * 101 % 128) * 0.125::DOUBLE AS ly, (p_size % 8) * 0.125::DOUBLE AS lz,
         (p_partkey * 37 % 128) * 0.125::DOUBLE + (1 + p_partkey % 7) * 0.125::DOUBLE AS hx,
         (p_partkey * 101 % 128) * 0.125::DOUBLE + (1 + p_partkey % 5) * 0.125::DOUBLE AS hy,
         (p_size % 8) * 0.125::DOUBLE + (1 + p_size % 6) * 0.125::DOUBLE AS hz
  FROM part)"""


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, frame, mask, s, e: half-open pixel intervals; 2000 orders to a run, 50 frames, 10 masks."""
    return read(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 2000").alias("run"),
        (F.col("l_orderkey") % 50).alias("frame"),
        (F.col("l_suppkey") % 10).alias("mask"),
        ((F.col("l_partkey") % 200) * 16).alias("s"),
        ((F.col("l_partkey") % 200) * 16 + F.col("l_quantity").cast("bigint")).alias("e"),
    )


RUNS = """raw_runs AS (
  SELECT l_orderkey // 2000 AS run, l_orderkey % 50 AS frame, l_suppkey % 10 AS mask,
         (l_partkey % 200) * 16 AS s, (l_partkey % 200) * 16 + CAST(l_quantity AS BIGINT) AS e
  FROM lineitem)"""


def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj, f, px: pixels by hour and object, for hours in which the object has any."""
    ts = F.col("ts").cast("timestamp")
    return (
        read(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 20).alias("obj"), (F.floor(F.unix_micros(ts) / 3600000000) - 473352).alias("f"))
        .agg(F.floor(F.sum("value")).cast("bigint").alias("px"))
    )


VIS = """vis AS (
  SELECT user_id % 20 AS obj, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) - 473352 AS f, CAST(floor(sum(value)) AS BIGINT) AS px
  FROM events GROUP BY ALL)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, ord (a total order of equal rows apart), x, y, z."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("node"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_discount").alias("z"),
    )


POINTS = """points AS (
  SELECT l_suppkey % 50 AS node, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, prompt, score in hundredths: sums of integers are exact in any order."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("node"),
        (F.col("l_linenumber") - 1).alias("prompt"),
        F.round((1 - F.col("l_discount")) * 100).cast("bigint").alias("score"),
    )


VOTES = """votes AS (
  SELECT l_suppkey AS node, l_linenumber - 1 AS prompt, CAST(round((1 - l_discount) * 100) AS BIGINT) AS score FROM lineitem)"""


def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask, node, frame, n_points, conf (null for each 7th) and box of masks with depth."""
    key = F.col("o_orderkey")
    lx = (key % 64) * 0.125
    return read(spark, sf_dir, "orders").select(
        key.alias("mask"),
        (F.col("o_custkey") % 40).alias("node"),
        (key % 90).alias("frame"),
        (key % 11).alias("n_points"),
        F.when(key % 7 != 0, (key % 41) * 0.125).cast("double").alias("conf"),
        lx.cast("double").alias("lx"),
        ((key % 32) * 0.25).cast("double").alias("ly"),
        ((key % 5) * 0.5).cast("double").alias("lz"),
        (lx + (1 + key % 3) * 0.25).cast("double").alias("hx"),
        ((key % 32) * 0.25 + (1 + key % 4) * 0.125).cast("double").alias("hy"),
        ((key % 5) * 0.5 + 0.75).cast("double").alias("hz"),
    )


MASK_BOXES = """mask_boxes AS (
  SELECT o_orderkey AS mask, o_custkey % 40 AS node, o_orderkey % 90 AS frame, o_orderkey % 11 AS n_points,
         CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 41) * 0.125::DOUBLE END AS conf,
         (o_orderkey % 64) * 0.125::DOUBLE AS lx, (o_orderkey % 64) * 0.125::DOUBLE + (1 + o_orderkey % 3) * 0.25::DOUBLE AS hx,
         (o_orderkey % 32) * 0.25::DOUBLE AS ly, (o_orderkey % 32) * 0.25::DOUBLE + (1 + o_orderkey % 4) * 0.125::DOUBLE AS hy,
         (o_orderkey % 5) * 0.5::DOUBLE AS lz, (o_orderkey % 5) * 0.5::DOUBLE + 0.75::DOUBLE AS hz
  FROM orders)"""

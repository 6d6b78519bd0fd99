"""The stage catalogue: tables by run, a log that marks what is complete, and what is out of date.

A stage is a Parquet table with a partition for each run. Its row in the log is written last, so a stage counts as
saved only when all of it is there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stage -> stages whose rows it is made of.
UPSTREAM = {
    "frames": (),
    "masks": ("frames",),
    "features": ("masks",),
    "siglip": ("masks",),
    "vggt": ("frames",),
    "boxes": ("masks", "vggt"),
    "graph": ("masks", "features", "siglip", "boxes"),
}

#: Columns of every stage; a table is checked against them when it is saved and when it is read.
SCHEMAS = {
    "frames": "run_id string, frame int, clip smallint",
    "masks": "run_id string, mask_id bigint, frame int, prompt smallint, sam_id int, score float, counts string",
    "features": "run_id string, mask_id bigint, dino array<float>",
    "siglip": "run_id string, mask_id bigint, siglip array<float>",
    "vggt": "run_id string, frame int, h int, w int, depth binary, conf binary, k array<double>, c2w array<double>",
    "boxes": "run_id string, mask_id bigint, lo array<float>, hi array<float>, n_points int, conf float",
    "graph": "run_id string, mask_id bigint, node int",
    "events": "run_id string, object_id int, frame int, kind tinyint, gap int",
}
LOG = "run_id string, stage string, params string, n_rows bigint, saved_at timestamp"


def checked(df: DataFrame, stage: str) -> DataFrame:
    """The stage's columns in order; an error names what is missing or of another type."""
    wanted = T._parse_datatype_string(SCHEMAS[stage])
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}" for f in wanted if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"stage {stage}: {', '.join(map(str, wrong))}")
    return df.select(*wanted.names)


def save(df: DataFrame, root: str, stage: str, run_id: str, params: dict | None = None) -> None:
    """Replace the run's partition of a stage, then log it."""
    spark = df.sparkSession
    path = f"{root}/{stage}/run_id={run_id}"
    checked(df, stage).where(F.col("run_id") == run_id).drop("run_id").write.mode("overwrite").parquet(path)
    n = spark.read.parquet(path).count()
    row = spark.createDataFrame([(run_id, stage, json.dumps(params or {}, sort_keys=True), n)], LOG.rsplit(",", 1)[0])
    row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/stage_log")


def log(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of every run and stage."""
    rows = spark.read.schema(LOG).parquet(f"{root}/stage_log")
    best = rows.groupBy("run_id", "stage").agg(F.max(F.struct("saved_at", "params", "n_rows")).alias("x"))
    return best.select("run_id", "stage", "x.*")


def load(spark: SparkSession, root: str, stage: str, run_id: str) -> DataFrame:
    """A saved stage of a run; an error if it was never completed."""
    if log(spark, root).where((F.col("run_id") == run_id) & (F.col("stage") == stage)).isEmpty():
        raise FileNotFoundError(f"{stage} of {run_id} is not complete")
    path = f"{root}/{stage}/run_id={run_id}"
    kinds = ", ".join(p for p in SCHEMAS[stage].split(", ") if not p.startswith("run_id "))
    return checked(spark.read.schema(kinds).parquet(path).withColumn("run_id", F.lit(run_id)), stage)


def stale(entries: DataFrame, params: dict[str, dict] | None = None) -> DataFrame:
    """run_id, stage, reason for logged stages that other parameters or a newer upstream stage have put out of date."""
    spark = entries.sparkSession
    edges = spark.createDataFrame([(s, u) for s, us in UPSTREAM.items() for u in us], "stage string, upstream string")
    newer = (
        entries.alias("e")
        .join(F.broadcast(edges).alias("g"), F.col("e.stage") == F.col("g.stage"))
        .join(entries.alias("u"), (F.col("u.run_id") == F.col("e.run_id")) & (F.col("u.stage") == F.col("g.upstream")))
        .where(F.col("u.saved_at") > F.col("e.saved_at"))
        .select("e.run_id", "e.stage", F.concat(F.lit("newer "), F.col("g.upstream")).alias("reason"))
    )
    if not params:
        return newer.distinct()
    now = spark.createDataFrame([(s, json.dumps(p, sort_keys=True)) for s, p in params.items()], "stage string, now string")
    other = entries.join(F.broadcast(now), "stage").where(F.col("params") != F.col("now"))
    return newer.union(other.select("run_id", "stage", F.lit("parameters").alias("reason"))).distinct()


def save_prediction(points: DataFrame, embeddings: DataFrame, root: str, method: str) -> None:
    """A method's map: its points (scene, obj, x, y, z) and embeddings (scene, obj, embedding), a partition a scene.

    Scenes that are written replace what the method had for them; other scenes and methods stay.
    """
    for name, df in (("points", points), ("embeddings", embeddings)):
        held = df.withColumn("method", F.lit(method))
        writer = held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("method", "scene").parquet(f"{root}/prediction_{name}")


def predictions(spark: SparkSession, root: str, name: str, method: str) -> DataFrame:
    """A method's points or embeddings; other methods' partitions are not read."""
    return spark.read.parquet(f"{root}/prediction_{name}").where(F.col("method") == method).drop("method")

"""Readers of the input files: poses, images, objects, queries, prompts; and the frame catalogue of a run."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The scenes, the camera, classes that name no object, and the default prompts.
SCENES = ("room_0", "room_1", "room_2", "office_0", "office_1", "office_2", "office_3", "office_4")
N_FRAMES, HEIGHT, WIDTH = 2000, 680, 1200
CAMERA = (600.0, 600.0, 599.5, 339.5)
NON_OBJECTS = ("undefined", "non-plane", "anonymize_picture", "anonymize_text")
IGNORED = (*NON_OBJECTS, "wall", "floor", "ceiling")
PROMPTS = (
    "air vent", "armchair", "backpack", "bag", "basket", "bathtub", "bed", "bench", "blanket", "blinds", "book",
    "bookshelf", "bottle", "bowl", "box", "bulletin board", "cabinet", "cable", "camera", "candle", "ceiling light",
    "chair", "clock", "clothes", "coat rack", "coffee maker", "column", "computer mouse", "counter", "cup", "curtain",
    "cushion", "desk", "desk organizer", "dishwasher", "door", "drawer", "fan", "faucet", "fire extinguisher",
    "flower pot", "headphones", "jar", "kettle", "keyboard", "lamp", "laptop", "light switch", "microwave", "mirror",
    "monitor", "mug", "ottoman", "oven", "pan", "paper towel", "partition", "phone", "picture", "pillow", "pipe",
    "plant", "plate", "poster", "power outlet", "power strip", "printer", "projector", "radiator", "refrigerator",
    "remote control", "rug", "sculpture", "shelf", "shoe", "shower", "sink", "smoke detector", "soap dispenser", "sofa",
    "speaker", "stool", "storage bin", "stove", "table", "tablet", "television", "thermostat", "tissue box", "toaster",
    "toilet", "toilet paper", "towel", "toy", "trash can", "tray", "tv stand", "umbrella", "vase", "wardrobe",
    "whiteboard", "window",
)
PROMPT_LISTS = {"indoor": PROMPTS}


def parse_source(source: str) -> tuple[str, str]:
    """Scene and sequence of ``replica/<scene>/<00 or 01>``."""
    parts = source.split("/")
    if len(parts) != 3 or parts[0] != "replica" or parts[1] not in SCENES or parts[2] not in ("00", "01"):
        raise ValueError(f"no such source: {source!r}")
    return parts[1], parts[2]


def make_run(source: str, stride: int, mask_source: str = "sam3", pose_source: str | None = None, vocab: str = "") -> dict:
    """The catalogue key of a run; recordings without ground truth only take predicted masks and poses."""
    known = source.startswith("replica/")
    pose_source = pose_source or ("gt" if known else "vggt")
    if stride < 1 or (not known and (mask_source, pose_source) != ("sam3", "vggt")):
        raise ValueError(f"{source}: stride must be positive, and without ground truth masks are sam3 and poses vggt")
    return {"source": source, "stride": stride, "mask_source": mask_source, "pose_source": pose_source, "vocab": vocab if mask_source == "sam3" else ""}


def video_names(source: str) -> list[str]:
    """The clips of ``phone/<a>+<b>``, in order."""
    if not source.startswith("phone/"):
        raise ValueError(f"no recording: {source!r}")
    return source.removeprefix("phone/").split("+")


def videos(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """clip, name, path: the one file of each clip; an error if there is none or more than one."""
    files = spark.read.format("binaryFile").load(f"{folder}/*").select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    names = spark.createDataFrame(list(enumerate(video_names(source))), "clip int, name string")
    found = names.join(files.select("path", stem.alias("name")), "name", "left")
    wrong = found.groupBy("name").agg(F.count("path").alias("n")).where("n != 1").take(1)
    if wrong:
        raise FileNotFoundError(f"{source}: expected one file for {wrong[0]['name']}, found {wrong[0]['n']}")
    return found.select("clip", "name", "path")


def frame_numbers(spark: SparkSession, stride: int, n: int = N_FRAMES) -> DataFrame:
    return spark.range(0, n, stride).withColumnRenamed("id", "frame")


def frame_labels(frames: DataFrame) -> DataFrame:
    """Adds label: name and the frame's number within its clip. frames: run, frame, clip, name."""
    first = F.min("frame").over(Window.partitionBy("run", "clip"))
    return frames.withColumn("label", F.format_string("%s frame %d", F.col("name"), F.col("frame") - first))


def poses(spark: SparkSession, path: str) -> DataFrame:
    """frame, c2w (16 numbers): one line a frame."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("frame", "line"))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    return lines.select(F.col("frame").cast("bigint").alias("frame"), numbers.alias("c2w"))


def objects(spark: SparkSession, semantic: str, labels: str | None = None) -> DataFrame:
    """object_id, class_name, labels (map of name lists; empty where there are none)."""
    rows = spark.read.json(semantic, multiLine=True, schema="objects array<struct<id:bigint,class_name:string>>")
    found = rows.select(F.explode("objects").alias("o")).select(F.col("o.id").alias("object_id"), "o.class_name")
    none = F.create_map().cast("map<string,array<string>>")
    if labels is None:
        return found.withColumn("labels", none)
    kind = "dataset struct<samples:array<struct<object_id:bigint,labels:struct<image_attributes:map<string,array<string>>>>>>"
    samples = spark.read.json(labels, multiLine=True, schema=kind).select(F.explode("dataset.samples").alias("s"))
    named = samples.select(F.col("s.object_id").alias("object_id"), F.col("s.labels.image_attributes").alias("labels"))
    return found.join(named, "object_id", "left").withColumn("labels", F.coalesce("labels", none))


def text_queries(spark: SparkSession, path: str, level: str = "level0") -> DataFrame:
    """query, object_id for each target of each query of a level."""
    rows = spark.read.json(path, multiLine=True, schema=f"{level} map<string,array<bigint>>")
    return rows.select(F.explode(level).alias("query", "ids")).select("query", F.explode("ids").alias("object_id"))


def class_names(found: DataFrame, promptable: bool = False) -> DataFrame:
    """prompt, class_name: distinct classes numbered in order."""
    names = found.select("class_name").distinct()
    names = names.where(~F.col("class_name").isin(*NON_OBJECTS)) if promptable else names
    return names.select((F.row_number().over(Window.orderBy("class_name")) - 1).alias("prompt"), "class_name")


def prompts(spark: SparkSession, name: str) -> DataFrame:
    """prompt, text: a named list, or the lines of a file without blank ones."""
    if name in PROMPT_LISTS:
        return spark.createDataFrame(list(enumerate(PROMPT_LISTS[name])), "prompt int, text string")
    lines = spark.read.text(name, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    kept = lines.select("at", F.trim("text").alias("text")).where("text != ''")
    return kept.select((F.row_number().over(Window.orderBy("at")) - 1).alias("prompt"), "text")


def png(data: bytes) -> np.ndarray:
    """Pixels of an uninterlaced 8- or 16-bit PNG: (height, width) or (height, width, channels)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    width, height, depth, colour, _, _, woven = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or woven:
        raise ValueError("unsupported PNG")
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            made = line.copy()
        elif kind == 1:
            made = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            made = line + above
        else:
            made = _sequential(line, above, step, int(kind))
        out[y] = above = made
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return pixels.reshape(height, width, channels).squeeze(axis=2) if channels == 1 else pixels.reshape(height, width, channels)


def _sequential(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """The two filters in which a byte needs its left neighbour: average and Paeth."""
    x, up = line.tolist(), above.tolist()
    for i in range(len(x)):
        a, b, c = (x[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        x[i] = (x[i] + guess) & 255
    return np.asarray(x, np.uint8)


def _images(spark: SparkSession, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.regexp_extract("path", r"_(\d+)\.png$", 1).cast("bigint").alias("frame"), "content")


def depth_images(spark: SparkSession, pattern: str) -> DataFrame:
    """frame, h, w, depth (floats in metres, bytes): millimetres in 16 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [png(c).astype("<f4") / np.float32(1000) for c in b["content"]]
            yield pd.DataFrame({"frame": b["frame"], "h": [i.shape[0] for i in images], "w": [i.shape[1] for i in images], "depth": [i.tobytes() for i in images]})

    return _images(spark, pattern).mapInPandas(run, "frame bigint, h int, w int, depth binary")


def instance_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """frame, object_id, s, e: column-major runs of each object's pixels; 0 is no object."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, content in zip(b["frame"], b["content"], strict=True):
                flat = png(content).T.ravel()
                edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
                ids = flat[edge[:-1]].astype(np.int64)
                keep = ids > 0
                yield pd.DataFrame({"frame": frame, "object_id": ids[keep], "s": edge[:-1][keep], "e": edge[1:][keep]})

    return _images(spark, pattern).mapInPandas(run, "frame bigint, object_id bigint, s bigint, e bigint")


def truth_masks(runs: DataFrame, found: DataFrame) -> DataFrame:
    """frame, object_id, prompt, score: a mask for every known object of a frame; the prompt numbers its class."""
    seen = runs.select("frame", "object_id").distinct()
    named = found.join(F.broadcast(class_names(found)), "class_name").select("object_id", "prompt")
    return seen.join(named, "object_id").select("frame", "object_id", "prompt", F.lit(1.0).alias("score"))

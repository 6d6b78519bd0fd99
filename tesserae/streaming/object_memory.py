"""The object memory over a table (a group for each run) and over a stream (a state for each run)."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.functions.plan import shared_folder
from tesserae.operators.memory import ObjectMemory, Observation

#: Columns of an observation row, and of what comes back.
INPUT = "run bigint, frame bigint, mask bigint, track bigint, dino array<float>, lx double, ly double, lz double, hx double, hy double, hz double, n_points bigint, reliable boolean"
OUTPUT = "run bigint, frame bigint, mask bigint, node bigint, via string"


def _observation(row) -> Observation:
    corners = np.asarray([[row.lx, row.ly, row.lz], [row.hx, row.hy, row.hz]], dtype=np.float32)
    tracks = () if pd.isna(row.track) else (int(row.track),)
    return Observation(row.dino, corners, int(row.n_points), None, tracks, reliable=bool(row.reliable))


def advance(memory: ObjectMemory, rows: pd.DataFrame) -> list[tuple]:
    """Feed rows frame by frame, in order of (frame, mask); late frames come back with node -1 and via ``late``."""
    out = []
    for (run, frame), group in rows.sort_values(["run", "frame", "mask"]).groupby(["run", "frame"], sort=True):
        if memory.frame is not None and frame <= memory.frame:
            out += [(run, frame, m, -1, "late") for m in group["mask"]]
            continue
        ids = memory.step(int(frame), [_observation(r) for r in group.itertuples(index=False)])
        out += [(run, frame, m, i, t["via"]) for m, i, t in zip(group["mask"], ids, memory.trace, strict=True)]
    return out


COLUMNS = ["run", "frame", "mask", "node", "via"]


def in_batch(observations: DataFrame) -> DataFrame:
    """run, frame, mask, node (as of the end, after merges), via. Runs are independent and go in parallel."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        memory = ObjectMemory()
        out = pd.DataFrame(advance(memory, rows), columns=COLUMNS)
        out["node"] = [memory.find(i) for i in out["node"]]
        return out

    return observations.groupBy("run").applyInPandas(whole, OUTPUT)


def in_stream(observations: DataFrame) -> DataFrame:
    """The same over a stream: run, frame, mask, node (as of its frame), via. A late frame is rejected, not an error."""

    def some(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = pickle.loads(state.get[0]) if state.exists else ObjectMemory()
        rows = pd.concat(list(batches))
        out = pd.DataFrame(advance(memory, rows), columns=COLUMNS)
        state.update((pickle.dumps(memory),))
        yield out

    return observations.groupBy("run").applyInPandasWithState(some, OUTPUT, "memory binary", "append", "NoTimeout")


def run_once(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now; the result is a table in the cluster's shared folder."""
    place = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{place}/out")
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/out")

"""The interface for external encoders: models that turn images or texts into vectors, one load a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Rows in, one vector a row out."""

    def encode(self, rows: pd.DataFrame) -> np.ndarray: ...


_loaders: dict[str, Callable[[], Encoder]] = {}


def register(name: str, load: Callable[[], Encoder]) -> None:
    """File a loader under a name; it is called once on each worker that needs it."""
    _loaders[name] = load


def embed(df: DataFrame, name: str, keep: list[str], batch: int = 32) -> DataFrame:
    """The kept columns and ``embedding``: unit vectors; a row whose vector has no direction gets zeros."""
    load = _loaders[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                v = np.asarray(encoder.encode(part), dtype=np.float32)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.where(length > 1e-6, v / np.maximum(length, 1e-6), 0)
                yield part[keep].assign(embedding=list(v))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInPandas(run, f"{kinds}, embedding array<float>")


def look_up(texts: DataFrame, table: DataFrame, model: str) -> DataFrame:
    """texts with the embeddings that a table (model, text, embedding) holds; null where it has none."""
    return texts.join(table.where(F.col("model") == model).select("text", "embedding"), "text", "left")

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one Arrow batch. Texts may be long, so batches stay small enough for a worker's memory.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (local mode, as in tests) gets a temporary folder; on a cluster that is
    an error, as no other machine could read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def map_batches(
    df: DataFrame,
    func: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    schema: str | T.StructType,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` over dictionaries of columns: func turns an iterator of input batches into output batches."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)

        def inputs() -> Iterator[dict[str, list]]:
            for whole in batches:
                for at in range(0, whole.num_rows, batch_rows):
                    part = whole.slice(at, batch_rows)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(names)}

        for found in func(inputs()):
            columns = [pa.array(found[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, out)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the table holds."""
    return df.select(*[df[c] for c in columns])

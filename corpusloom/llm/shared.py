"""Checkpointing and column helpers that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder in ``spark.checkpoint.dir``, or the one the caller has set; there is no machine-local fallback."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    own = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own)


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """The row as one struct: whatever its columns are called, they clash with nothing."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def join_largest(left: DataFrame, plan: DataFrame, keys: list[str], weight: str, rows: int = 200_000) -> DataFrame:
    """Inner join with a ``plan`` that has one row per key and, in ``weight``, how many rows of ``left`` have the key.

    The ``rows`` heaviest keys are broadcast, a bounded size; every other key has at most a
    1 / ``rows`` share of ``left`` and may meet in one task of a join by shuffle.
    """
    largest = F.broadcast(plan.orderBy(F.desc(weight), *keys).limit(rows))
    out = left.join(largest, keys)
    if plan.limit(rows + 1).count() > rows:
        out = out.unionByName(left.join(largest, keys, "left_anti").join(plan, keys).select(out.columns))
    return out

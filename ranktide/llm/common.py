"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches of whole texts of at most this size from now on (Spark's own bound is 64 MB), so that a worker
    holds little beside what it computes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages start from files that
    outlive any executor, and none of them repeats the work."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILTER_BITS = 27


def filter_bit(column: str = "doc_id"):
    """Where a value's bit is in a :func:`bit_filter`."""
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def bit_filter(ids: DataFrame, column: str = "doc_id", at=None) -> np.ndarray:
    """A bit set of fixed size (16 MB) that holds every value of ``column`` and, by chance, others; ``at`` is the bit's
    place where it is not that of :func:`filter_bit`."""
    at = filter_bit(column) if at is None else at
    words = (ids.select((at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_filter(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def set_aside(df: DataFrame, taken: set[str]):
    """``df`` with its columns of the ``taken`` names (whatever their case) under other names, and a function that gives
    a result's columns their names back."""
    used, names = {c.lower() for c in df.columns} | taken, []
    for c in df.columns:
        new = c
        while c.lower() in taken and new.lower() in used:
            new += "_"
        used.add(new.lower())
        names.append(new)
    back = dict(zip(names, df.columns))
    return df.toDF(*names), lambda out: out.toDF(*[back.get(c, c) for c in out.columns])


def batches(rows, schema: pa.Schema, size: int = 2000):
    """Arrow batches of at most ``size`` of the tuples that ``rows`` yields."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pack(part, schema)
            part = []
    if part:
        yield pack(part, schema)


def pack(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def each_row(it):
    """The rows of Arrow batches as tuples."""
    for b in it:
        yield from zip(*(c.to_pylist() for c in b.columns))

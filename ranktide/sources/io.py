"""Sources and sinks (A1-A12): JSON-lines ingest, Parquet/CSV/JSON writers,
idempotent writes and post-write validation."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None,
               strict: bool = True, sample_size: int | None = None) -> DataFrame:
    """A1/A2: JSON lines with an explicit schema. ``strict`` fails the job on a
    malformed line (FAILFAST), otherwise malformed lines are dropped. Listed
    columns absent from a record come back null. ``sample_size`` reads the first
    n lines of gzip files, see :func:`read_jsonl_gz`."""
    if sample_size is not None:
        if not strict:
            raise ValueError("sample_size counts lines, malformed ones among them; it goes with strict reading")
        return read_jsonl_gz(spark, path, schema, columns, sample_size)
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.select(*columns) if columns else df


def _plain(uri: str) -> str:
    return urlparse(uri).path


def first_lines(spark: SparkSession, path: str | Sequence[str], n: int) -> DataFrame:
    """H8: (value): the first ``n`` lines of gzip files in the order of their paths.

    A gzip file cannot be split, so it is one partition in line order, whatever its members, and ``limit`` takes its
    first lines and reads no further. Which file the n-th line is in comes from counts by file, of one file first, then of
    twice as many each time, until they suffice: files beyond are not opened."""
    files = sorted(map(unquote, spark.read.text(path).inputFiles()), key=_plain)
    if any(not f.endswith(".gz") for f in files):
        raise ValueError("the first lines are defined for gzip files only: others are split")
    whole, cut, left, at, step = [], None, n, 0, 1
    while at < len(files) and left > 0:
        group = files[at: at + step]
        counts = {_plain(unquote(r.f)): r.n for r in spark.read.text(group).groupBy(F.input_file_name().alias("f")).agg(
            F.count(F.lit(1)).alias("n")).collect()}  # one row a file of the group
        for f in group:
            lines = counts.get(_plain(f), 0)
            if lines > left:
                cut = f
                break
            whole.append(f)
            left -= lines
            if not left:
                break
        if cut:
            break
        at, step = at + step, step * 2
    parts = [spark.read.text(whole)] if whole else []
    parts += [spark.read.text(cut).limit(left)] if cut and left else []
    if not parts:
        return spark.createDataFrame([], "value string")
    return reduce(DataFrame.unionByName, parts)


def read_jsonl_gz(spark: SparkSession, path: str | Sequence[str], schema: StructType, columns: Sequence[str] | None = None,
                  sample_size: int | None = None) -> DataFrame:
    """A1: gzip JSON lines (a file, a folder or several), one task a file. Keys that a record lacks are null, keys that
    the schema lacks are left out. A malformed or blank line fails the job, if it is among the first ``sample_size``."""
    lines = spark.read.text(path) if sample_size is None else first_lines(spark, path, sample_size)
    blank = F.raise_error(F.lit("blank line among JSON lines")).cast("string")
    value = F.when(F.trim("value") == "", blank).otherwise(F.col("value"))
    rows = lines.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.select(*columns) if columns else rows


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A3: numeric coercion, unparsable -> null (``try_cast``; ANSI mode is on)."""
    for c in columns:
        df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Parquet sink; ``mode="ignore"`` makes re-runs skip an existing
    output. Partitioning by split gives partition pruning on read."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines, one object per row (a map is a table, not one object)."""
    df.write.mode("overwrite").json(path)
    return path


def validate_written(written: DataFrame, expected: DataFrame, unit_columns: Sequence[str] = ()) -> DataFrame:
    """One row per check; ``ok`` is true when the re-read output has the
    same row count and schema, and every ``unit_columns`` value is in [0, 1]."""
    same_schema = [(f.name, f.dataType.simpleString()) for f in written.schema.fields] == [
        (f.name, f.dataType.simpleString()) for f in expected.schema.fields
    ]
    checks = written.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"bad_{c}") for c in unit_columns],
    )
    n_expected = expected.agg(F.count(F.lit(1))).scalar()
    rows = checks.select(
        F.struct(F.lit("row_count").alias("check"), (F.col("n") == n_expected).alias("ok")).alias("a"),
        F.struct(F.lit("schema").alias("check"), F.lit(same_schema).alias("ok")).alias("b"),
        *[F.struct(F.lit(f"unit_range:{c}").alias("check"), (F.col(f"bad_{c}") == 0).alias("ok")).alias(f"c{i}")
          for i, c in enumerate(unit_columns)],
    )
    cols = ["a", "b", *[f"c{i}" for i in range(len(unit_columns))]]
    return rows.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def scratch_path(spark: SparkSession, name: str) -> str:
    from ranktide.session import checkpoint_dir
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")

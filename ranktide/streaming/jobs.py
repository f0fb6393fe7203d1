"""Structured Streaming forms of the chunked cleaning job (K1) and the live
interaction log's daily per-user counts (K2).

Both read a file source (new files are new chunks), run with
``trigger(availableNow=True)`` for bounded catch-up (or any processing-time
trigger in production) and keep their checkpoints and outputs under the
shared checkpoint folder, so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ranktide.functions import text as T
from ranktide.session import checkpoint_dir


def _workdir(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, path_glob: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path_glob)


def clean_stream(stream: DataFrame, ts_col: str, text_cols: Sequence[str], required: Sequence[str],
                 dedup_subset: Sequence[str], watermark: str = "1 day") -> DataFrame:
    """K1: row-wise cleaning (B2 none-like strings, B3 blank -> null + drop) and
    duplicate removal across chunks with ``dropDuplicatesWithinWatermark``."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    out = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))   # watermarks need TIMESTAMP (not NTZ)
    for c in text_cols:
        if isinstance(types.get(c), StringType):
            out = out.withColumn(c, T.blank_to_null(T.none_like_to_null(c)))
    out = out.dropna(how="any", subset=list(required))
    return out.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(list(dedup_subset))


def run_to_parquet(df: DataFrame, name: str, base: str | None = None) -> str:
    """Append the stream to Parquet (A7) until the available input is consumed.
    A job that is started again with the same ``base`` goes on where it ended."""
    base = base or _workdir(df.sparkSession, name)
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start(os.path.join(base, "data")))
    q.awaitTermination()
    return os.path.join(base, "data")


def daily_counts_stream(stream: DataFrame, user_col: str = "user_id", ts_col: str = "ts",
                        watermark: str = "1 day") -> DataFrame:
    """K2: per-user calendar-day counts (the streaming form of C2)."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return s.groupBy(user_col, F.window(ts_col, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def run_counts_to_table(counts: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Update-mode aggregation written by ``foreachBatch`` into a Parquet log
    with a folder per batch (a repeated batch replaces its own); the final
    value of a key is its latest row. With the same ``base`` a job that is
    started again goes on where it ended."""
    spark = counts.sparkSession
    base = base or _workdir(spark, name)
    data = os.path.join(base, "data")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(data, f"batch_id={batch_id}"))

    q = (counts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    log = spark.read.parquet(data)
    latest = log.groupBy("user_id", "w").agg(F.max(F.struct("batch_id", "n")).alias("_b"))
    return latest.select(
        "user_id", F.to_date(F.col("w.start")).alias("day"), F.col("_b.n").alias("n")
    )

"""Queries for sources, sinks (A1-A12) and the streaming jobs (K1, K2).

Inputs that the reference reads as JSON lines are first written by Spark from
the given tables into the shared checkpoint folder, then ingested.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.operators import features as G
from ranktide.plans.registry import register
from ranktide.sources import fixtures as fx
from ranktide.sources import io as IO
from ranktide.streaming import jobs as S

VAL_YEAR, TEST_YEAR = 2000, 2001
REVIEW_JSON_COLS = ["user_id", "parent_asin", "asin", "rating", "helpful_vote", "verified_purchase",
                    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _review_json(spark, sf_dir, with_garbage: bool):
    r = fx.reviews(spark, sf_dir).select(
        *REVIEW_JSON_COLS, F.unix_millis(F.col("timestamp").cast("timestamp")).alias("timestamp")
    )
    path = IO.scratch_path(spark, "reviews-jsonl")
    lines = r.select(F.to_json(F.struct("*")).alias("value"))
    if with_garbage:
        bad = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("{broken "), F.col("doc_id").cast("string")).alias("value"))
        lines = lines.unionByName(bad)
    lines.write.mode("overwrite").text(path)
    schema = r.schema
    return path, schema


_REVIEWS_MS_SQL = """SELECT user_id, parent_asin, asin, rating, helpful_vote, verified_purchase,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch_ms(timestamp) AS BIGINT) AS timestamp FROM reviews"""


@register("ingest_jsonl", _REVIEWS_MS_SQL)
def q_ingest_jsonl(spark, sf_dir):
    path, schema = _review_json(spark, sf_dir, with_garbage=False)
    return IO.read_jsonl(spark, path, schema, strict=True)


@register("ingest_tolerant", _REVIEWS_MS_SQL)
def q_ingest_tolerant(spark, sf_dir):
    path, schema = _review_json(spark, sf_dir, with_garbage=True)
    return IO.read_jsonl(spark, path, schema, strict=False)


GZ_LINES = 1500   # sample_size: the limit is the feature


@register("ingest_gz", f"""SELECT parent_asin, title, CAST(NULL AS VARCHAR) AS subtitle, price FROM metadata
                           ORDER BY parent_asin LIMIT {GZ_LINES}""")
def q_ingest_gz(spark, sf_dir):
    """A1/H8: the first lines of several gzip files in order; a null price is a key that the record lacks."""
    m = fx.metadata(spark, sf_dir, with_arrays=False).select("parent_asin", "title", F.col("price").cast("string").alias("price"))
    path = IO.scratch_path(spark, "meta-gz")
    (m.repartitionByRange(6, "parent_asin").sortWithinPartitions("parent_asin")
     .select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path))
    columns = ["parent_asin", "title", "subtitle", "price"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return IO.coerce_numeric(IO.read_jsonl_gz(spark, path, schema, columns, GZ_LINES), ["price"])


@register("ingest_price_coerce", "SELECT parent_asin, title, price FROM metadata")
def q_ingest_price_coerce(spark, sf_dir):
    m = fx.metadata(spark, sf_dir, with_arrays=False).select(
        "parent_asin", "title", F.coalesce(F.col("price").cast("string"), F.lit("n/a")).alias("price")
    )
    path = IO.scratch_path(spark, "meta-jsonl")
    m.write.mode("overwrite").json(path)
    raw = IO.read_jsonl(spark, path, m.schema, columns=["parent_asin", "title", "price"], strict=True)
    return IO.coerce_numeric(raw, ["price"])


def _split_written(spark, sf_dir):
    r = fx.reviews(spark, sf_dir).withColumn("split", G.split_label("timestamp", VAL_YEAR, TEST_YEAR))
    r = r.where(F.col("split").isNotNull())
    path = IO.write_parquet(r, IO.scratch_path(spark, "splits"), partition_by=["split"])
    return r, path


@register(
    "split_roundtrip",
    f"SELECT *, 'val' AS split FROM reviews WHERE year(timestamp) >= {VAL_YEAR} AND year(timestamp) < {TEST_YEAR}",
)
def q_split_roundtrip(spark, sf_dir):
    _, path = _split_written(spark, sf_dir)
    # partition pruning: only the split=val folder is listed and read
    return spark.read.parquet(path).where(F.col("split") == "val")


@register(
    "split_validate",
    "SELECT * FROM (VALUES ('row_count', TRUE), ('schema', TRUE), ('unit_range:helpful_vote_norm', TRUE)) v(\"check\", ok)",
)
def q_split_validate(spark, sf_dir):
    r, path = _split_written(spark, sf_dir)
    back = spark.read.parquet(path).select(*r.columns)
    stats = G.fit_minmax(r.where(F.col("split") == "train"), ["helpful_vote"])
    return IO.validate_written(G.apply_minmax(back, stats, ["helpful_vote"]),
                               G.apply_minmax(r, stats, ["helpful_vote"]), ["helpful_vote_norm"])


@register(
    "write_ignore_rerun",
    "SELECT COUNT(*) AS n_rows FROM reviews WHERE rating >= 4",
)
def q_write_ignore_rerun(spark, sf_dir):
    path = IO.scratch_path(spark, "ignore")
    r = fx.reviews(spark, sf_dir)
    IO.write_parquet(r.where(F.col("rating") >= 4), path, mode="ignore")
    IO.write_parquet(r, path, mode="ignore")          # skipped: output exists
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "csv_roundtrip",
    "SELECT store, COUNT(parent_asin) AS product_count FROM metadata WHERE store IS NOT NULL GROUP BY store",
)
def q_csv_roundtrip(spark, sf_dir):
    s = G.store_stats(fx.metadata(spark, sf_dir, with_arrays=False)).select("store", "product_count")
    path = IO.write_csv(s, IO.scratch_path(spark, "csv"))
    return spark.read.option("header", True).schema(s.schema).csv(path)


@register(
    "json_map_roundtrip",
    "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS parent_asin, p_name AS title FROM part",
)
def q_json_map_roundtrip(spark, sf_dir):
    m = fx.metadata(spark, sf_dir, with_arrays=False).select("parent_asin", "title")
    path = IO.write_json(m, IO.scratch_path(spark, "json"))
    return spark.read.schema(m.schema).json(path)


# ------------------------------------------------------------------ K1 / K2
def _events_stream(spark, sf_dir):
    schema = fx.events(spark, sf_dir).schema
    return S.file_stream(spark, os.path.join(sf_dir, "events[.]parquet"), schema)


@register(
    "stream_daily_counts",
    "SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)",
)
def q_stream_daily_counts(spark, sf_dir):
    counts = S.daily_counts_stream(_events_stream(spark, sf_dir))
    return S.run_counts_to_table(counts, "daily-counts")


@register(
    "stream_clean",
    """WITH e AS (SELECT user_id, event_type, CASE WHEN trim(props) IN ('None', '', '[]', 'nan') THEN NULL ELSE props END AS props
                  FROM events)
       SELECT DISTINCT * FROM e WHERE user_id IS NOT NULL AND event_type IS NOT NULL""",
)
def q_stream_clean(spark, sf_dir):
    cleaned = S.clean_stream(_events_stream(spark, sf_dir), "ts", ["event_type", "props"],
                             ["user_id", "event_type"], ["user_id", "event_type", "props"])
    return spark.read.parquet(S.run_to_parquet(cleaned, "clean")).select("user_id", "event_type", "props")

"""Users and interaction-log tables (P1-P5) as append-only DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.relational import dense_index


def seed_users(users: DataFrame, candidates: DataFrame, is_new: bool = False, user_col: str = "user_id",
               ts_col: str = "created_at") -> DataFrame:
    """Insert-or-ignore. Candidates ``(user_id, created_at)`` not yet in
    ``users`` are appended with the ``is_new`` flag; existing rows are untouched."""
    fresh = (
        candidates.where(F.col(user_col).isNotNull())
        .groupBy(user_col).agg(F.min(ts_col).alias(ts_col))
        .join(users.select(user_col), user_col, "left_anti")
        .select(user_col, F.lit(is_new).alias("is_new"), ts_col)
    )
    return users.unionByName(fresh)


def empty_users(spark) -> DataFrame:
    return spark.createDataFrame([], "user_id string, is_new boolean, created_at timestamp_ntz")


def record_interactions(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Append (user_id, product_id, interaction_type, timestamp)."""
    rows = rows.select("user_id", "product_id", "interaction_type", "timestamp")
    return rows if log is None else log.unionByName(rows)


def users_newest_first(users: DataFrame) -> DataFrame:
    """All users, newest first (user id breaks ties)."""
    return users.select("user_id", "is_new", "created_at").orderBy(F.desc("created_at"), F.asc("user_id"))


def rank_within_key(df: DataFrame, key: str, order: list, out: str = "position") -> DataFrame:
    """1-based position of each row inside its key under ``order``, without a
    per-key window: global dense index (range-partitioned sort) minus the key's
    first index (an aggregate with map-side combine)."""
    idx = dense_index(df, [F.col(key).asc(), *order], "_g")
    first = idx.groupBy(key).agg(F.min("_g").alias("_g0"))
    return idx.join(first, key).withColumn(out, (F.col("_g") - F.col("_g0") + 1).cast("bigint")).drop("_g", "_g0")


def user_histories(log: DataFrame) -> DataFrame:
    """P5 for all users: each user's interactions newest first with their position."""
    return rank_within_key(
        log, "user_id", [F.col("timestamp").desc(), F.col("product_id").asc(), F.col("interaction_type").asc()]
    )


def user_history(log: DataFrame, user_id: str) -> DataFrame:
    """P5 for one user (the filter is pushed to the scan)."""
    return log.where(F.col("user_id") == user_id).select("product_id", "interaction_type", "timestamp").orderBy(
        F.desc("timestamp")
    )

"""Spam rules, de-duplication, k-core, top-N: edge cases and properties."""

import datetime as dt
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ranktide.operators import interactions as I

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _events(spark, rows):
    return spark.createDataFrame(
        [(u, T0 + dt.timedelta(seconds=s), None if r is None else float(r)) for u, s, r in rows], "user_id string, timestamp timestamp, rating double"
    )


def _spam(spark, rows, **kw):
    return {r["user_id"] for r in I.spam_users(_events(spark, rows), **kw).collect()}


def test_gap_rule_strict(spark):
    rows = [("a", 0, 1), ("a", 10, 1),          # exactly 10 s apart: not spam
            ("b", 0, 1), ("b", 9.999, 1),       # just under: spam
            ("c", 5, 1), ("c", 5, 1),           # equal timestamps: gap 0 -> spam
            ("d", 0, 1), ("d", 100, 1), ("d", 109, 1)]
    assert _spam(spark, rows, max_reviews_per_day=5, min_time_gap=10) == {"b", "c", "d"}


def test_gap_rule_crosses_bucket_edges(spark):
    rows = [("e", 19.5, 1), ("e", 20.5, 1), ("f", 0, 1), ("f", 25, 1), ("f", 40, 1)]
    assert _spam(spark, rows, max_reviews_per_day=5, min_time_gap=10) == {"e"}


def test_day_rule_counts_non_null_ratings(spark):
    five = [("a", 3600 * i, 1) for i in range(5)]
    six = [("b", 3600 * i, 1) for i in range(6)]
    six_with_null = [("c", 3600 * i, None if i == 0 else 1) for i in range(6)]
    got = _spam(spark, five + six + six_with_null, max_reviews_per_day=5, min_time_gap=0)
    assert got == {"b"}
    # the chunked variant counts rows, nulls included
    df = _events(spark, five + six + six_with_null)
    day_only = {r["user_id"] for r in I.spam_users_day_only(df, max_reviews_per_day=5).collect()}
    assert day_only == {"b", "c"}


def test_null_timestamp_never_flags(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 1.0)], "user_id string, timestamp timestamp, rating double")
    assert I.spam_users(df).count() == 0


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "user_id string, parent_asin string")


def test_k_core_strictly_greater(spark):
    rows = [("u1", f"i{j}") for j in range(3)] + [("u2", "i0"), ("u2", "i1")]
    res = I.k_core(_pairs(spark, rows), {"user_id": 2, "parent_asin": 0}, 3)
    assert {r["user_id"] for r in res.df.collect()} == {"u1"}   # u2 has exactly 2: dropped
    assert res.converged


def test_k_core_converged_property(spark):
    import random

    random.seed(7)
    rows = list({(f"u{random.randint(0, 40)}", f"i{random.randint(0, 25)}") for _ in range(600)})
    res = I.k_core(_pairs(spark, rows), {"user_id": 5, "parent_asin": 5}, 10)
    if res.converged:
        for col in ("user_id", "parent_asin"):
            assert res.df.groupBy(col).count().where(F.col("count") <= 5).count() == 0


def test_dedup_keeps_earliest_and_is_partition_invariant(spark):
    rows = [("u", "i", 3, 1), ("u", "i", 1, 2), ("u", "i", 1, 1), ("v", "i", 5, 9)]
    df = spark.createDataFrame(rows, "user_id string, parent_asin string, timestamp int, tb int")
    outs = []
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        outs.append(sorted(tuple(r) for r in I.dedup_user_item(df.repartition(n), order=["timestamp", "tb"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1] == outs[2] == [("u", "i", 1, 1), ("v", "i", 5, 9)]


def test_top_n_ties_by_id(spark):
    rows = [("u", "b"), ("u", "a"), ("v", "c"), ("w", "c")]
    top = [r["parent_asin"] for r in I.top_items(_pairs(spark, rows), top_n=2).collect()]
    assert top == ["c", "a"]
    kept = I.filter_top_n_items(_pairs(spark, rows), top_n=2)
    assert {r["parent_asin"] for r in kept.collect()} == {"a", "c"}


def test_k_core_takes_away_removed_values(spark, monkeypatch):
    """Nulls go, rows are not shuffled while few values are removed, and by shuffle the result is the same."""
    rng = np.random.default_rng(5)
    rows = [(f"u{u}", f"i{i}") for u, i in zip((60 * rng.random(900) ** 2).astype(int), (40 * rng.random(900) ** 2).astype(int))]
    df = spark.createDataFrame(rows + [(None, "i0"), ("u0", None), (None, None)] * 30, "user_id string, parent_asin string")
    few = I.k_core(df, {"user_id": 12, "parent_asin": 14}, 3)
    assert "hashpartitioning" not in few.df._jdf.queryExecution().toString()
    left = [r for r in rows + [(None, "i0"), ("u0", None), (None, None)] * 30]
    for _ in range(3):
        for at, k in ((0, 12), (1, 14)):
            n = Counter(r[at] for r in left)
            left = [r for r in left if r[at] is not None and n[r[at]] > k]
    got = Counter(map(tuple, few.df.collect()))
    assert 0 < len(left) < len(rows) and got == Counter(left)
    monkeypatch.setattr(I, "REMOVED_BROADCAST", 0)
    many = I.k_core(df, {"user_id": 12, "parent_asin": 14}, 3)
    assert Counter(map(tuple, many.df.collect())) == got
    assert (many.iterations, many.converged, many.rows_per_iteration) == (few.iterations, few.converged, few.rows_per_iteration)

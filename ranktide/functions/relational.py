"""Small relational building blocks shared by the operators.

All of them are plain DataFrame plans. The shapes are picked so that one hot
key (a user or item with a third of all rows) never ends up in one task:

* "first row per key" is a ``min(struct(order..., payload...))`` aggregate,
  which Spark combines map-side before the shuffle, instead of a
  ``row_number()`` window that sorts a whole group in one task;
* per-group statistics are aggregated (map-side combine) and joined back; AQE
  splits a skewed join partition, a window would not;
* dense indexes use a range-partitioned sort plus per-partition offsets
  instead of a window without ``PARTITION BY``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ranktide.session import cut_lineage

# Largest key set that is broadcast on the strength of a caller-proven bound
# (e.g. the N of a top-N). Anything else is left to AQE, which converts a
# join to a broadcast only after measuring the shuffled side.
BROADCAST_ROW_LIMIT = 2_000_000


def require_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return list(cols)


def existing_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def reject_complex(df: DataFrame, cols: Sequence[str]) -> None:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    bad = [c for c in cols if isinstance(types.get(c), (ArrayType, MapType, StructType))]
    if bad:
        raise ValueError(f"columns hold unhashable list/dict values: {bad}")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row per ``keys`` under the total order ``order``.

    ``order`` must make rows unique within a key (pass tiebreak columns). The
    winner is picked by ``min`` over a struct, an aggregate with a map-side
    partial step, so a key with millions of copies costs one row per task
    before the shuffle.
    """
    keys = list(keys)
    order = [c for c in order if c not in keys]
    payload = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)],
    )
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    out = best.select(
        *keys,
        *[F.col(f"_best.o{i}").alias(c) for i, c in enumerate(order)],
        *[F.col(f"_best.p{i}").alias(c) for i, c in enumerate(payload)],
    )
    return out.select(*df.columns)


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Attach group aggregates to every row (``groupby().transform`` form)."""
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, list(keys), "left")


def keep_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str,
              bound: int | None = None, anti: bool = False) -> DataFrame:
    """Semi (or anti) join against a key table.

    ``bound`` is a caller-proven upper limit on ``keys_df`` rows (a top-N);
    only then is the key table broadcast explicitly.
    """
    how = "left_anti" if anti else "left_semi"
    right = keys_df
    if bound is not None and bound <= BROADCAST_ROW_LIMIT:
        right = F.broadcast(keys_df)
    return df.join(right, on, how)


def dense_index(df: DataFrame, order: Sequence[str | Column], index_col: str = "idx") -> DataFrame:
    """0-based dense position of each row under ``order`` (zipWithIndex form).

    Range-partitioned global sort, then ``offset(partition) + position inside
    partition``. The sorted, tagged rows are checkpointed first so partition
    ids stay fixed between the offset job and the lookup. Only the
    per-partition counts (one row per partition) meet in one place.
    """
    tagged = (
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = cut_lineage(tagged)
    offsets = tagged.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")
    )
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid")
    out = out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint"))
    return out.drop("_pid", "_mid", "_off", "_m0")


def r6(c: Column | str) -> Column:
    """Round a double to 6 places (oracle comparisons use the same rounding)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def with_previous(df: DataFrame, key: str, order: str, value: str, out: str = "prev") -> DataFrame:
    """``lag(value) OVER (PARTITION BY key ORDER BY order)`` without putting a
    hot key in one task.

    Rows are range-partitioned on ``(key, order)``, so one key may span several
    bounded partitions. The lag is taken inside each partition, and the first
    row of a partition takes the previous partition's last row when the key
    continues across the boundary (one row per partition meets in one place).
    ``order`` must be unique within a key for a deterministic result.
    """
    tagged = (
        df.orderBy(F.col(key), F.col(order))
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = cut_lineage(tagged)
    w = Window.partitionBy("_pid", key).orderBy("_mid")
    local = tagged.withColumn(out, F.lag(value).over(w))
    edges = tagged.groupBy("_pid").agg(
        F.min("_mid").alias("_first_mid"),
        F.max_by(F.col(key), F.col("_mid")).alias("_last_key"),
        F.max_by(F.col(value), F.col("_mid")).alias("_last_val"),
    )
    wp = Window.orderBy("_pid")
    edges = edges.select(
        "_pid", "_first_mid",
        F.lag("_last_key").over(wp).alias("_pk"), F.lag("_last_val").over(wp).alias("_pv"),
    )
    res = local.join(F.broadcast(edges), "_pid")
    carry = (F.col("_mid") == F.col("_first_mid")) & (F.col("_pk") == F.col(key))
    res = res.withColumn(out, F.when(carry, F.col("_pv")).otherwise(F.col(out)))
    return res.drop("_pid", "_mid", "_first_mid", "_pk", "_pv")

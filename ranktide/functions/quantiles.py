"""Exact order statistics without a single-task sort.

``percentile`` in Spark is exact but buffers every value of a group in one
aggregation buffer; for a global statistic that is one task holding the whole
column. Here values are first reduced to ``(value, count)`` (map-side
combine, so a value held by a third of the rows is one row per task), then
a range-partitioned sort gives each distinct value its cumulative position,
and the rows holding the wanted positions are picked out. Pandas' / DuckDB's
linear interpolation (``quantile_cont``) is reproduced exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.session import cut_lineage


def cumulative_counts(df: DataFrame, order: Sequence[Column | str], weight: str, out: str = "cum_before") -> DataFrame:
    """Exclusive running sum of ``weight`` under a global ``order``.

    Global sort (range partitioning), per-partition running sums via a window
    over the partition id (each range partition is one bounded task), plus the
    per-partition offsets (one row per partition).
    """
    tagged = (
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tagged = cut_lineage(tagged)
    w_in = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_loc", F.coalesce(F.sum(weight).over(w_in), F.lit(0)))
    per = tagged.groupBy("_pid").agg(F.sum(weight).alias("_tot"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_tot").over(w_off), F.lit(0)))
    res = local.join(F.broadcast(per.select("_pid", "_off")), "_pid")
    return res.withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint")).drop("_pid", "_mid", "_off", "_loc")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return (
        df.select(x.alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles_from_counts(vc: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with a column per probability; ``vc`` is ``(v, n)`` with distinct v."""
    cum = cumulative_counts(vc, [F.col("v").asc()], "n", "c0")
    total = vc.agg(F.sum("n")).scalar()
    aggs = []
    picked = cum
    for p, name in zip(probs, names):
        h = (total - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        has_lo = (F.col("c0") <= lo) & (lo < F.col("c0") + F.col("n"))
        has_hi = (F.col("c0") <= hi) & (hi < F.col("c0") + F.col("n"))
        picked = picked.withColumn(f"_{name}_lo", F.when(has_lo, F.col("v"))).withColumn(
            f"_{name}_hi", F.when(has_hi, F.col("v"))
        ).withColumn(f"_{name}_h", h - lo)
        aggs += [F.max(f"_{name}_lo").alias(f"_{name}_lo"), F.max(f"_{name}_hi").alias(f"_{name}_hi"),
                 F.max(f"_{name}_h").alias(f"_{name}_h")]
    one = picked.agg(*aggs)
    return one.select(*[
        (F.col(f"_{n}_lo") + F.col(f"_{n}_h") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
        for n in names
    ])


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    return exact_quantiles_from_counts(value_counts(df, column), probs, names)

"""Interaction filters: spam users, user-item de-duplication, k-core, top-N items."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.relational import first_per_key, keep_keys, require_columns
from ranktide.session import cut_lineage


def _seconds(ts: str) -> F.Column:
    # NTZ and LTZ timestamps both become epoch seconds with fractions (UTC session).
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def spam_users(
    df: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "timestamp",
    rating_col: str = "rating",
    max_reviews_per_day: int = 5,
    min_time_gap: float = 10,
) -> DataFrame:
    """Users with > ``max_reviews_per_day`` non-null ratings on one calendar day,
    or two consecutive rows less than ``min_time_gap`` seconds apart.

    The gap rule is evaluated without sorting a user's history in one task:
    with buckets of width ``min_time_gap``, two rows in one bucket are closer
    than the gap, and otherwise only neighbouring buckets can hold such a pair
    (last row of bucket b-1 vs first row of bucket b). Each bucket aggregate
    row is sent to its own key and to the next bucket's key, and a second
    aggregate compares them, so the rule is two aggregations with map-side
    combine and no join. Rows with a null user or timestamp never flag.
    """
    require_columns(df, [user_col, ts_col, rating_col])
    base = df.where(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
    day = (
        base.groupBy(user_col, F.to_date(ts_col).alias("_day"))
        .agg(F.count(rating_col).alias("_n"))
        .where(F.col("_n") > max_reviews_per_day)
        .select(user_col)
    )
    flagged = day
    if min_time_gap > 0:
        gap = F.lit(float(min_time_gap))
        secs = base.select(user_col, _seconds(ts_col).alias("_s"))
        buckets = secs.groupBy(user_col, F.floor(F.col("_s") / gap).alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")
        )
        sent = buckets.select(user_col, F.explode(F.array(
            F.struct(F.col("_b").alias("k"), F.col("_n").alias("n"), F.col("_lo").alias("lo"),
                     F.lit(None).cast("double").alias("prev_hi")),
            F.struct((F.col("_b") + 1).alias("k"), F.lit(0).cast("bigint").alias("n"),
                     F.lit(None).cast("double").alias("lo"), F.col("_hi").alias("prev_hi")),
        )).alias("x")).select(user_col, "x.*")
        per_key = sent.groupBy(user_col, "k").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("prev_hi").alias("prev_hi")
        )
        close = per_key.where((F.col("n") >= 2) | (F.col("lo") - F.col("prev_hi") < gap)).select(user_col)
        flagged = flagged.unionByName(close)
    return flagged.distinct()


def remove_spam(df: DataFrame, user_col: str = "user_id", **kw) -> DataFrame:
    """All rows of spam users removed."""
    return keep_keys(df, spam_users(df, user_col=user_col, **kw), user_col, anti=True)


def spam_users_day_only(
    df: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp",
    max_reviews_per_day: int = 5, min_time_gap: float | None = None,
) -> DataFrame:
    """Memory-optimised variant (C2): only the per-day rule, counting every row
    (nulls included); ``min_time_gap`` is accepted and ignored as in the reference."""
    del min_time_gap
    return (
        df.where(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
        .groupBy(user_col, F.to_date(ts_col).alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > max_reviews_per_day)
        .select(user_col)
        .distinct()
    )


def remove_spam_day_only(df: DataFrame, user_col: str = "user_id", **kw) -> DataFrame:
    return keep_keys(df, spam_users_day_only(df, user_col=user_col, **kw), user_col, anti=True)


def dedup_user_item(
    df: DataFrame,
    user_col: str = "user_id",
    item_col: str = "parent_asin",
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """First interaction per (user, item) under ``order`` (C3, decision D2)."""
    require_columns(df, [user_col, item_col, *order])
    return first_per_key(df, [user_col, item_col], order)


@dataclass
class KCoreResult:
    df: DataFrame
    iterations: int
    converged: bool
    rows_per_iteration: list[int]


REMOVED_BROADCAST = 500_000   # removed values of a column that are broadcast; more are joined by shuffle


def k_core(df: DataFrame, thresholds: dict[str, int], max_iterations: int = 3) -> KCoreResult:
    """Iterative k-core (C4): per pass, in dict order, keep values whose row count
    is strictly greater than the threshold; stop when a pass removes nothing.

    Passes run on the distinct key combinations and their row counts, not on
    the rows: counts are aggregates (map-side combine), and a pass takes away
    the rows of the values that it removes. These are few against those that
    stay, so neither the combinations nor, at the end, the rows (which are kept
    unless one of their values was ever removed) are shuffled for them while
    they number at most ``REMOVED_BROADCAST`` a column. Each pass that removes
    something is written to the shared checkpoint folder.
    """
    cols = require_columns(df, list(thresholds))
    keys = cut_lineage(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
    before = _rows(keys)
    sizes: list[int] = []
    converged = False
    removed: dict[str, list[tuple[DataFrame, int]]] = {c: [] for c in cols}
    it = 0
    for it in range(1, max_iterations + 1):
        for col, k in thresholds.items():
            gone = cut_lineage(keys.groupBy(col).agg(F.sum("_n").alias("_s")).where((F.col("_s") <= k) & F.col(col).isNotNull()).select(col))
            n = gone.count()
            keys = keys.where(F.col(col).isNotNull())
            if n:
                removed[col].append((gone, n))
                keys = _without(keys, col, [(gone, n)])
        after = _rows(keys)
        sizes.append(after)
        if after == before:
            converged = True
            break
        before, keys = after, cut_lineage(keys)
    if all(sum(n for _, n in r) <= REMOVED_BROADCAST for r in removed.values()):
        out = df
        for col in cols:
            out = _without(out.where(F.col(col).isNotNull()), col, removed[col])
        out = out.select(*cols, *[c for c in df.columns if c not in cols])
    else:
        out = keep_keys(df, keys.select(*cols), cols)
    return KCoreResult(out, it, converged, sizes)


def _without(df: DataFrame, col: str, removed: list[tuple[DataFrame, int]]) -> DataFrame:
    """Rows of ``df`` whose ``col`` is none of the removed values."""
    if not removed:
        return df
    values = reduce(DataFrame.unionAll, [r for r, _ in removed])
    return keep_keys(df, F.broadcast(values) if sum(n for _, n in removed) <= REMOVED_BROADCAST else values, col, anti=True)


def _rows(keys: DataFrame) -> int:
    return keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def item_counts(df: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    return df.groupBy(item_col).agg(F.count(F.lit(1)).alias("n_interactions"))


def top_items(df: DataFrame, item_col: str = "parent_asin", top_n: int = 10000) -> DataFrame:
    """The ``top_n`` items by row count, ties by item id (D3)."""
    return (
        item_counts(df, item_col)
        .orderBy(F.desc("n_interactions"), F.asc(item_col))
        .limit(top_n)
    )


def filter_top_n_items(df: DataFrame, item_col: str = "parent_asin", top_n: int = 10000) -> DataFrame:
    """Rows of the ``top_n`` most frequent items (C5). The key set has at most
    ``top_n`` rows, so it is broadcast when that bound is small enough."""
    keys = top_items(df, item_col, top_n).select(item_col)
    return keep_keys(df, keys, item_col, bound=top_n)


def keep_active_items(meta: DataFrame, interactions: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """Metadata rows of items that occur in the interactions."""
    return keep_keys(meta, interactions.select(item_col), item_col)


def metadata_coverage(meta: DataFrame, interactions: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """Items with metadata / active items."""
    items = interactions.select(item_col).distinct()
    known = meta.select(item_col).distinct().withColumn("_m", F.lit(1))
    return items.join(known, item_col, "left").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("_m").alias("n_with_metadata")
    ).withColumn("coverage", F.round(F.col("n_with_metadata") / F.col("n_items"), 6))

"""Profiling summaries (E1-E15) and the data side of the charts (Q1-Q8).

Every summary is a small DataFrame; the work behind it is aggregates with
map-side combine. Order statistics use :mod:`ranktide.functions.quantiles`,
and per-group size statistics are computed from the count-of-counts table,
so a global sort only ever sees distinct group sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from ranktide.functions.quantiles import exact_quantiles, exact_quantiles_from_counts
from ranktide.functions.relational import with_previous

VERIFIED_LABELS = {0: "Unverified", 1: "Verified"}   # fixed labels of the verified comparison
AUTO_TOP_N, AUTO_TOP_N_WHEN_OVER = 15, 20              # pie: top 15 + Other when > 20 categories
OTHER_LABEL = "Other"
SKETCH_LG = 12                                         # registers of a distinct sketch, as a power of two
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_LG / 2)         # three standard errors of merged sketches


def _types(df):
    return {f.name: f.dataType for f in df.schema.fields}


def _missing(c: str, t) -> F.Column:
    x = F.col(c)
    return (x.isNull() | F.isnan(x)) if isinstance(t, (DoubleType, FloatType)) else x.isNull()


# ------------------------------------------------------------------ E1
def missing_summary(df: DataFrame) -> DataFrame:
    """Per column: missing count (NaN counts for floats), percent (2 dp), complete flag."""
    types = _types(df)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_missing(c, t)).alias(f"m_{i}") for i, (c, t) in enumerate(types.items())],
    )
    stacked = one.select(
        "_rows",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing_count"))
            for i, c in enumerate(types)
        ])).alias("s"),
    )
    return stacked.select(
        "s.column", "s.missing_count",
        F.round(F.col("s.missing_count") * 100.0 / F.col("_rows"), 2).alias("missing_pct"),
        (F.col("s.missing_count") == 0).alias("is_complete"),
    )


def missing_overview(df: DataFrame) -> DataFrame:
    """Total rows, complete columns and overall completeness percent (2 dp)."""
    per = missing_summary(df)
    ncols = len(df.columns)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return per.agg(
        rows.alias("total_rows"),
        F.count_if(F.col("is_complete")).alias("n_complete_columns"),
        F.round((rows * ncols - F.sum("missing_count")) * 100.0 / (rows * ncols), 2).alias("overall_completeness"),
    )


# ------------------------------------------------------------------ E2 / E13 / E14
def distribution(df: DataFrame, column: str) -> DataFrame:
    """count, missing, mean, median, std (n-1), min, q25, q75, max and the
    bias-corrected skewness / excess kurtosis (pandas / DuckDB definitions, D6),
    rounded to 4 places. Non-numeric columns are rejected."""
    t = _types(df)[column]
    if not isinstance(t, NumericType):
        raise ValueError(f"column {column!r} must be numeric")
    x = F.col(column).cast("double")
    valid = x.isNotNull() & ~F.isnan(x)
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~valid | x.isNull()).alias("missing_count"),
        F.count(F.when(valid, x)).alias("count"),
        F.avg(F.when(valid, x)).alias("mean"),
        F.stddev_samp(F.when(valid, x)).alias("std"),
        F.min(F.when(valid, x)).alias("min"),
        F.max(F.when(valid, x)).alias("max"),
        F.skewness(F.when(valid, x)).alias("g1"),
        F.kurtosis(F.when(valid, x)).alias("g2"),
    )
    q = exact_quantiles(df, column, [0.5, 0.25, 0.75], ["median", "q25", "q75"])
    qs = q.select(F.struct("median", "q25", "q75")).scalar()
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    r4 = lambda c: F.round(c, 4)
    return stats.select(
        F.lit(column).alias("column"),
        F.col("missing_count"),
        F.round(F.col("missing_count") * 100.0 / F.col("rows"), 2).alias("missing_pct"),
        F.col("count"),
        r4(F.col("mean")).alias("mean"), r4(qs.getField("median")).alias("median"),
        r4(F.col("std")).alias("std"), r4(F.col("min")).alias("min"),
        r4(qs.getField("q25")).alias("q25"), r4(qs.getField("q75")).alias("q75"),
        r4(F.col("max")).alias("max"), r4(skew).alias("skewness"), r4(kurt).alias("kurtosis"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One distribution row per numeric column."""
    out = None
    for c in columns:
        d = distribution(df, c)
        out = d if out is None else out.unionByName(d)
    return out


# ------------------------------------------------------------------ E3
def sparsity(df: DataFrame, user_col: str = "user_id", item_col: str = "parent_asin") -> DataFrame:
    """Distinct users x distinct items vs row count (D15: rows, not pairs)."""
    s = df.agg(
        F.countDistinct(user_col).alias("n_users"),
        F.countDistinct(item_col).alias("n_items"),
        F.count(F.lit(1)).alias("n_interactions"),
    )
    possible = (F.col("n_users") * F.col("n_items")).cast("bigint")
    sp = F.when(possible > 0, F.round((1 - F.col("n_interactions") / possible) * 100, 2)).otherwise(F.lit(0.0))
    return s.select(
        "n_users", "n_items", "n_interactions", possible.alias("possible_interactions"),
        sp.alias("sparsity_pct"), F.round(100 - sp, 2).alias("density_pct"),
    )


# ------------------------------------------------------------------ E4 / E5
def group_sizes(df: DataFrame, group_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))


def size_histogram(df: DataFrame, group_col: str) -> DataFrame:
    """Count-of-counts: (n = group size, m = groups of that size)."""
    return group_sizes(df, group_col).groupBy("n").agg(F.count(F.lit(1)).alias("m"))


def activity(df: DataFrame, group_col: str = "user_id") -> DataFrame:
    """Group-size statistics (2 dp): groups, mean, median, std (n-1), min, max, total."""
    cc = size_histogram(df, group_col)
    med = exact_quantiles_from_counts(
        cc.select(F.col("n").cast("double").alias("v"), F.col("m").alias("n")), [0.5], ["median"]
    ).select("median").scalar()
    s = cc.agg(
        F.sum("m").alias("g"), F.sum(F.col("n") * F.col("m")).alias("tot"),
        F.sum(F.col("n").cast("double") ** 2 * F.col("m")).alias("sq"),
        F.min("n").alias("mn"), F.max("n").alias("mx"),
    )
    g = F.col("g").cast("double")
    mean = F.col("tot") / g
    var = (F.col("sq") - F.col("tot").cast("double") ** 2 / g) / (g - 1)
    return s.select(
        F.lit(group_col).alias("group_col"), F.col("g").alias("n_groups"),
        F.round(mean, 2).alias("mean_activity"), F.round(med, 2).alias("median_activity"),
        F.round(F.sqrt(var), 2).alias("std_activity"),
        F.col("mn").alias("min_activity"), F.col("mx").alias("max_activity"),
        F.col("tot").alias("total_interactions"),
    )


def long_tail(df: DataFrame, group_col: str = "parent_asin", threshold: int = 80) -> DataFrame:
    """Head = groups (largest first) whose cumulative share of rows stays
    <= threshold %, at least one. Worked on the count-of-counts table: within
    a level of m groups of size n the cumulative sum grows by n per group."""
    if not 0 < threshold < 100:
        raise ValueError("threshold must be between 0 and 100")
    cc = size_histogram(df, group_col)
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    lv = cc.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("m")).over(w), F.lit(0)))
    total = cc.agg(F.sum(F.col("n") * F.col("m"))).scalar()
    # groups j = 1..m of this level with 100 * (before + n*j) <= threshold * total
    room = F.floor((F.lit(threshold) * total - 100 * F.col("before")) / (100 * F.col("n")))
    lv = lv.withColumn("k", F.least(F.col("m"), F.greatest(F.lit(0), room)).cast("bigint"))
    s = lv.agg(
        F.sum("m").alias("total_groups"), F.sum("k").alias("k_sum"),
        F.max("n").alias("top_n"), F.sum(F.col("k") * F.col("n")).alias("k_rows"),
        F.sum(F.col("n") * F.col("m")).alias("total"),
    )
    head = F.greatest(F.col("k_sum"), F.lit(1))
    head_rows = F.when(F.col("k_sum") >= 1, F.col("k_rows")).otherwise(F.col("top_n"))
    hp = F.round(head * 100.0 / F.col("total_groups"), 2)
    return s.select(
        F.lit(group_col).alias("group_col"), "total_groups", head.alias("head_groups"),
        (F.col("total_groups") - head).alias("tail_groups"), hp.alias("head_pct"),
        F.round(100 - hp, 2).alias("tail_pct"), head_rows.alias("head_interactions"),
        (F.col("total") - head_rows).alias("tail_interactions"),
        F.round(head_rows * 100.0 / F.col("total"), 2).alias("head_coverage_pct"),
    )


# ------------------------------------------------------------------ E6 / E7 / Q1 / Q2 / Q5 / Q8
def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share of rows); nulls dropped."""
    vc = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = vc.agg(F.sum("count")).scalar()
    return vc.withColumn("share", F.round(F.col("count") / total, 6))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("count"), F.asc(column)).limit(n)


def year_counts(df: DataFrame, ts_col: str = "timestamp", from_year: int | None = None) -> DataFrame:
    """Rows per year (optionally from a year on)."""
    y = df.select(F.year(ts_col).alias("year")).where(F.col("year").isNotNull())
    if from_year is not None:
        y = y.where(F.col("year") >= from_year)
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("count"))


def time_range(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """First and last timestamp."""
    return df.agg(F.min(ts_col).alias("min_ts"), F.max(ts_col).alias("max_ts"))


def mean_by_flag(df: DataFrame, flag_col: str = "verified_purchase", value_col: str = "rating") -> DataFrame:
    """Mean value per 0/1 flag, labelled."""
    f = F.col(flag_col).cast("int")
    label = F.when(f == 1, F.lit(VERIFIED_LABELS[1])).when(f == 0, F.lit(VERIFIED_LABELS[0]))
    return df.groupBy(label.alias(flag_col)).agg(F.avg(F.col(value_col).cast("double")).alias("avg_" + value_col))


def bar_counts(df: DataFrame, column: str) -> DataFrame:
    """Q1: value counts; numeric columns come sorted by value, others by count."""
    vc = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if isinstance(_types(df)[column], NumericType):
        return vc.orderBy(column)
    return vc.orderBy(F.desc("count"), F.asc(column))


def top_n_other(df: DataFrame, column: str, top_n: int | None = None, keep_null: bool = False) -> DataFrame:
    """Q2 (and Q8 without index sort): top-n labels plus one ``Other`` row with
    the rest; n = 15 when unset and there are more than 20 labels."""
    base = df if keep_null else df.where(F.col(column).isNotNull())
    vc = base.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if top_n is None:
        n_labels = vc.count()
        top_n = AUTO_TOP_N if n_labels > AUTO_TOP_N_WHEN_OVER else max(n_labels, 1)
    # the top labels are a top-n (TakeOrderedAndProject), so broadcasting them is bounded
    top = vc.orderBy(F.desc("count"), F.asc_nulls_first(column)).limit(top_n).select(
        F.col(column).alias("_k"), F.lit(1).alias("_top")
    )
    marked = vc.join(F.broadcast(top), vc[column].eqNullSafe(top["_k"]), "left")
    label = F.when(F.col("_top") == 1, F.col(column).cast("string")).otherwise(F.lit(OTHER_LABEL))
    return marked.groupBy(label.alias("label")).agg(F.sum("count").alias("count"))


def first_n_by_value(df: DataFrame, column: str, n: int) -> DataFrame:
    """Q8 with index sort: counts incl. null, sorted by value, first n kept, no Other."""
    vc = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return vc.orderBy(F.asc_nulls_last(column)).limit(n)


# ------------------------------------------------------------------ Q3 / Q4
def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], nulls dropped, last bin closed; empty
    bins are listed with count 0."""
    x = F.col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    lo = vals.agg(F.min("x")).scalar()
    hi = vals.agg(F.max("x")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)))
    counts = vals.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counts, "bin", "left").select(
        "bin",
        F.round(lo + F.col("bin") * width, 6).alias("left"),
        F.round(lo + (F.col("bin") + 1) * width, 6).alias("right"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )
    return out


def box_stats(df: DataFrame, column: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, outlier count."""
    q = exact_quantiles(df, column, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    qs = q.select(F.struct("q1", "median", "q3")).scalar()
    q1, q3 = qs.getField("q1"), qs.getField("q3")
    iqr = q3 - q1
    x = F.col(column).cast("double")
    lo_f, hi_f = q1 - whisker * iqr, q3 + whisker * iqr
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return vals.agg(
        F.round(F.first(q1), 6).alias("q1"), F.round(F.first(qs.getField("median")), 6).alias("median"),
        F.round(F.first(q3), 6).alias("q3"),
        F.round(F.min(F.when(F.col("x") >= lo_f, F.col("x"))), 6).alias("whisker_low"),
        F.round(F.max(F.when(F.col("x") <= hi_f, F.col("x"))), 6).alias("whisker_high"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("n_outliers"),
    )


# ------------------------------------------------------------------ E8 / Q7
def user_gap_stats(df: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp",
                   rating_col: str = "rating", flag_below: float = 10.0) -> DataFrame:
    """Per user: non-null ratings and the smallest gap in seconds between
    consecutive rows (null for one-row users), plus the bot flag of the scatter."""
    secs = F.unix_micros(F.col(ts_col).cast("timestamp")) / F.lit(1_000_000.0)
    base = df.where(F.col(user_col).isNotNull()).select(user_col, rating_col, secs.alias("_s"))
    prev = with_previous(base, user_col, "_s", "_s", "_p")
    out = prev.groupBy(user_col).agg(
        F.count(rating_col).alias("total_ratings"),
        F.min(F.col("_s") - F.col("_p")).alias("min_time_gap"),
    )
    return out.withColumn("min_time_gap", F.round("min_time_gap", 6)).withColumn(
        "possible_bot", F.coalesce(F.col("min_time_gap") < flag_below, F.lit(False))
    )


# ------------------------------------------------------------------ E9
def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair in one aggregate, long form."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(F.col(f"c{i}"), 6).alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])).alias("s")).select("s.*")


# ------------------------------------------------------------------ E11 / E15 / A10
def nunique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.countDistinct(c).alias(f"n{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_unique")) for i, c in enumerate(columns)
    ])).alias("s")).select("s.*")


def _daily_values(df: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """(day, column, value); rows without a day count nowhere."""
    return df.select(F.to_date(day).alias("day"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("s")).where("day IS NOT NULL").select("day", "s.*")


def distinct_sketches(df: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """(day, column, sketch), one HyperLogLog sketch for each day and column; nulls count for nothing.

    The rows are read once, sketches are built before the shuffle. Kept as a table, new days are appended and any range
    of days is merged without a look at the rows (:func:`distinct_in_ranges`)."""
    return _daily_values(df, columns, day).groupBy("day", "column").agg(
        F.hll_sketch_agg("value", F.lit(SKETCH_LG)).alias("sketch"))


def days_of(ranges: DataFrame) -> DataFrame:
    """(lo, hi, day) for each day of the ranges ``(lo, hi)``, both ends included."""
    valid = ranges.where("lo <= hi").distinct()
    return valid.withColumn("day", F.explode(F.sequence("lo", "hi")))


def distinct_in_ranges(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lo, hi, column, n_estimated, error): the days' sketches merged. ``error`` is the share of the true number
    that an estimate stays within but in some 3 of 1,000 cases. Ranges without rows give none."""
    merged = days_of(ranges).join(sketches, "day").groupBy("lo", "hi", "column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimated"))
    return merged.withColumn("error", F.lit(SKETCH_ERROR))


def nunique_in_ranges(df: DataFrame, columns: Sequence[str], day: str, ranges: DataFrame) -> DataFrame:
    """(lo, hi, column, n_unique), exact; rows are reduced to distinct values of a day first."""
    daily = _daily_values(df, columns, day).distinct()
    return days_of(ranges).join(daily, "day").groupBy("lo", "hi", "column").agg(F.countDistinct("value").alias("n_unique"))


def array_shape_stats(df: DataFrame, depth_col: str = "categories", empty_col: str = "features") -> DataFrame:
    """Mean category depth (non-list -> 0) and share of empty feature lists."""
    depth = F.coalesce(F.size(depth_col), F.lit(0))
    depth = F.when(depth < 0, F.lit(0)).otherwise(depth)
    return df.agg(
        F.round(F.avg(depth), 6).alias("mean_depth"),
        F.max(depth).alias("max_depth"),
        F.round(F.count_if(F.coalesce(F.size(empty_col), F.lit(0)) <= 0) * 100.0 / F.count(F.lit(1)), 2).alias(
            "empty_features_pct"
        ),
    )


def split_report(splits: dict[str, DataFrame], user_col: str = "user_id", item_col: str = "parent_asin") -> DataFrame:
    """A10: rows, distinct users and items per split."""
    out = None
    for name, d in splits.items():
        r = d.agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct(user_col).alias("n_users"),
            F.countDistinct(item_col).alias("n_items"),
        ).select(F.lit(name).alias("split"), "*")
        out = r if out is None else out.unionByName(r)
    return out

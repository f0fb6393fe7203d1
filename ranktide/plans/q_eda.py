"""Queries for profiling summaries and chart frames (E*, Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.functions import text as T
from ranktide.operators import eda as E
from ranktide.plans import sqlfrag as S
from ranktide.plans.registry import register
from ranktide.session import cut_lineage
from ranktide.sources import fixtures as fx
from ranktide.sources import io as IO

META_COLS = [
    ("parent_asin", "s"), ("title", "s"), ("store", "s"), ("price", "d"), ("description", "s"),
    ("average_rating", "d"), ("rating_number", "i"), ("categories", "a"), ("features", "a"),
]


def _miss(c, t):
    return f"({c} IS NULL OR isnan({c}))" if t == "d" else f"{c} IS NULL"


_MISSING_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, COUNT(*) FILTER (WHERE {_miss(c, t)}) AS missing_count,
               ROUND(COUNT(*) FILTER (WHERE {_miss(c, t)}) * 100.0 / COUNT(*), 2) AS missing_pct,
               COUNT(*) FILTER (WHERE {_miss(c, t)}) = 0 AS is_complete FROM metadata"""
    for c, t in META_COLS
)


@register("eda_missing", _MISSING_SQL)
def q_eda_missing(spark, sf_dir):
    return E.missing_summary(fx.metadata(spark, sf_dir))


@register(
    "eda_missing_overview",
    f"""WITH m AS ({_MISSING_SQL})
        SELECT (SELECT COUNT(*) FROM metadata) AS total_rows, COUNT(*) FILTER (WHERE is_complete) AS n_complete_columns,
               ROUND(((SELECT COUNT(*) FROM metadata) * {len(META_COLS)} - SUM(missing_count)) * 100.0
                     / ((SELECT COUNT(*) FROM metadata) * {len(META_COLS)}), 2) AS overall_completeness FROM m""",
)
def q_eda_missing_overview(spark, sf_dir):
    return E.missing_overview(fx.metadata(spark, sf_dir))


def _dist_sql(col: str, src: str, name: str | None = None) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{name or col}' AS column, COUNT(*) FILTER (WHERE {x} IS NULL OR isnan({x})) AS missing_count,
              ROUND(COUNT(*) FILTER (WHERE {x} IS NULL OR isnan({x})) * 100.0 / COUNT(*), 2) AS missing_pct,
              COUNT({x}) AS count, ROUND(AVG({x}), 4) AS mean, ROUND(quantile_cont({x}, 0.5), 4) AS median,
              ROUND(stddev_samp({x}), 4) AS std, ROUND(MIN({x}), 4) AS min,
              ROUND(quantile_cont({x}, 0.25), 4) AS q25, ROUND(quantile_cont({x}, 0.75), 4) AS q75,
              ROUND(MAX({x}), 4) AS max, ROUND(skewness({x}), 4) AS skewness, ROUND(kurtosis({x}), 4) AS kurtosis
       FROM {src}"""


@register("eda_distribution", _dist_sql("price", "metadata"))
def q_eda_distribution(spark, sf_dir):
    return E.distribution(fx.metadata(spark, sf_dir, with_arrays=False), "price")


@register(
    "describe_features",
    _dist_sql("rating", "reviews") + " UNION ALL " + _dist_sql("helpful_vote", "reviews"),
)
def q_describe_features(spark, sf_dir):
    return E.describe(fx.reviews(spark, sf_dir), ["rating", "helpful_vote"])


@register(
    "word_count_distribution",
    _dist_sql("n_words", f"(SELECT len({S.words('text')}) AS n_words FROM documents)"),
)
def q_word_count_distribution(spark, sf_dir):
    # the statistics and the quantiles start from the counts: each text is split once
    d = cut_lineage(fx.table(spark, sf_dir, "documents").select(T.word_count("text").alias("n_words")))
    return E.distribution(d, "n_words")


@register(
    "eda_sparsity",
    """SELECT n_users, n_items, n_interactions, possible_interactions,
              CASE WHEN possible_interactions > 0 THEN ROUND((1 - n_interactions / possible_interactions) * 100, 2) ELSE 0.0 END AS sparsity_pct,
              ROUND(100 - CASE WHEN possible_interactions > 0 THEN ROUND((1 - n_interactions / possible_interactions) * 100, 2) ELSE 0.0 END, 2) AS density_pct
       FROM (SELECT COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT parent_asin) AS n_items, COUNT(*) AS n_interactions,
                    CAST(COUNT(DISTINCT user_id) * COUNT(DISTINCT parent_asin) AS BIGINT) AS possible_interactions FROM reviews)""",
)
def q_eda_sparsity(spark, sf_dir):
    return E.sparsity(fx.reviews(spark, sf_dir))


@register(
    "eda_activity",
    """WITH g AS (SELECT user_id, COUNT(*) AS n FROM reviews GROUP BY user_id)
       SELECT 'user_id' AS group_col, COUNT(*) AS n_groups, ROUND(AVG(n), 2) AS mean_activity,
              ROUND(quantile_cont(n, 0.5), 2) AS median_activity, ROUND(stddev_samp(n), 2) AS std_activity,
              MIN(n) AS min_activity, MAX(n) AS max_activity, CAST(SUM(n) AS BIGINT) AS total_interactions FROM g""",
)
def q_eda_activity(spark, sf_dir):
    return E.activity(fx.reviews(spark, sf_dir), "user_id")


@register(
    "eda_long_tail",
    """WITH g AS (SELECT parent_asin, COUNT(*) AS n FROM reviews GROUP BY parent_asin),
            c AS (SELECT n, SUM(n) OVER (ORDER BY n DESC, parent_asin ROWS UNBOUNDED PRECEDING) AS cum,
                         SUM(n) OVER () AS total, ROW_NUMBER() OVER (ORDER BY n DESC, parent_asin) AS rk FROM g),
            h AS (SELECT GREATEST(COUNT(*) FILTER (WHERE cum * 100 <= 80 * total), 1) AS head, COUNT(*) AS groups,
                         MAX(total) AS total FROM c),
            hi AS (SELECT SUM(n) AS head_rows FROM c, h WHERE rk <= h.head)
       SELECT 'parent_asin' AS group_col, groups AS total_groups, head AS head_groups, groups - head AS tail_groups,
              ROUND(head * 100.0 / groups, 2) AS head_pct, ROUND(100 - ROUND(head * 100.0 / groups, 2), 2) AS tail_pct,
              CAST(head_rows AS BIGINT) AS head_interactions, CAST(total - head_rows AS BIGINT) AS tail_interactions,
              ROUND(head_rows * 100.0 / total, 2) AS head_coverage_pct
       FROM h, hi""",
)
def q_eda_long_tail(spark, sf_dir):
    return E.long_tail(fx.reviews(spark, sf_dir), "parent_asin", 80)


@register(
    "eda_long_tail_users",
    """WITH g AS (SELECT user_id, COUNT(*) AS n FROM reviews GROUP BY user_id),
            c AS (SELECT n, SUM(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) AS cum,
                         SUM(n) OVER () AS total, ROW_NUMBER() OVER (ORDER BY n DESC, user_id) AS rk FROM g),
            h AS (SELECT GREATEST(COUNT(*) FILTER (WHERE cum * 100 <= 50 * total), 1) AS head, COUNT(*) AS groups,
                         MAX(total) AS total FROM c),
            hi AS (SELECT SUM(n) AS head_rows FROM c, h WHERE rk <= h.head)
       SELECT 'user_id' AS group_col, groups AS total_groups, head AS head_groups, groups - head AS tail_groups,
              ROUND(head * 100.0 / groups, 2) AS head_pct, ROUND(100 - ROUND(head * 100.0 / groups, 2), 2) AS tail_pct,
              CAST(head_rows AS BIGINT) AS head_interactions, CAST(total - head_rows AS BIGINT) AS tail_interactions,
              ROUND(head_rows * 100.0 / total, 2) AS head_coverage_pct
       FROM h, hi""",
)
def q_eda_long_tail_users(spark, sf_dir):
    return E.long_tail(fx.reviews(spark, sf_dir), "user_id", 50)


@register(
    "value_counts_rating",
    """SELECT rating, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
       FROM reviews WHERE rating IS NOT NULL GROUP BY rating""",
)
def q_value_counts_rating(spark, sf_dir):
    return E.value_counts(fx.reviews(spark, sf_dir), "rating")


@register(
    "top10_items",
    """SELECT parent_asin, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
       FROM reviews GROUP BY parent_asin ORDER BY count DESC, parent_asin LIMIT 10""",
)
def q_top10_items(spark, sf_dir):
    return E.top_values(fx.reviews(spark, sf_dir), "parent_asin", 10)


@register("year_counts", "SELECT year(timestamp) AS year, COUNT(*) AS count FROM reviews GROUP BY 1")
def q_year_counts(spark, sf_dir):
    return E.year_counts(fx.reviews(spark, sf_dir))


@register(
    "year_counts_recent",
    "SELECT year(timestamp) AS year, COUNT(*) AS count FROM reviews WHERE year(timestamp) >= 1998 GROUP BY 1",
)
def q_year_counts_recent(spark, sf_dir):
    return E.year_counts(fx.reviews(spark, sf_dir), from_year=1998)


@register("time_range", "SELECT MIN(timestamp) AS min_ts, MAX(timestamp) AS max_ts FROM reviews")
def q_time_range(spark, sf_dir):
    return E.time_range(fx.reviews(spark, sf_dir))


@register(
    "verified_mean",
    """SELECT CASE WHEN verified_purchase THEN 'Verified' ELSE 'Unverified' END AS verified_purchase,
              ROUND(AVG(rating), 6) AS avg_rating FROM reviews GROUP BY 1""",
)
def q_verified_mean(spark, sf_dir):
    out = E.mean_by_flag(fx.reviews(spark, sf_dir))
    return out.withColumn("avg_rating", F.round("avg_rating", 6))


@register(
    "user_gap_stats",
    """WITH e AS (SELECT user_id, value AS rating, epoch_us(ts) / 1000000.0 AS s FROM events WHERE user_id IS NOT NULL),
            g AS (SELECT user_id, rating, s - LAG(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM e)
       SELECT user_id, COUNT(rating) AS total_ratings, ROUND(MIN(gap), 6) AS min_time_gap,
              COALESCE(ROUND(MIN(gap), 6) < 10.0, FALSE) AS possible_bot
       FROM g GROUP BY user_id""",
)
def q_user_gap_stats(spark, sf_dir):
    ev = fx.events(spark, sf_dir).withColumnRenamed("value", "rating")
    return E.user_gap_stats(ev, ts_col="ts")


_CORR_COLS = ["rating", "helpful_vote", "verified"]


@register(
    "corr_matrix",
    "WITH r AS (SELECT rating, helpful_vote, CAST(verified_purchase AS INT) AS verified FROM reviews) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(corr({a}, {b}), 6) AS corr FROM r"
        for a in _CORR_COLS for b in _CORR_COLS
    ),
)
def q_corr_matrix(spark, sf_dir):
    r = fx.reviews(spark, sf_dir).withColumn("verified", F.col("verified_purchase").cast("int"))
    return E.correlation_matrix(r, _CORR_COLS)


@register(
    "nunique",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) AS n_unique FROM reviews"
        for c in ["user_id", "parent_asin", "asin", "rating"]
    ),
)
def q_nunique(spark, sf_dir):
    return E.nunique(fx.reviews(spark, sf_dir), ["user_id", "parent_asin", "asin", "rating"])


SKETCHED = ["user_id", "parent_asin", "asin", "rating"]


@register(
    "nunique_sketch",
    """WITH y AS (SELECT DISTINCT year(timestamp) AS y FROM reviews),
            r AS (SELECT make_date(y, 1, 1) AS lo, make_date(y, 12, 31) AS hi FROM y
                  UNION SELECT make_date(MIN(y), 1, 1), make_date(MAX(y), 12, 31) FROM y),
            d AS (SELECT lo, hi, v.* FROM r JOIN reviews v ON CAST(v.timestamp AS DATE) BETWEEN lo AND hi) """
    + " UNION ALL ".join(
        f"SELECT lo, hi, '{c}' AS column, COUNT(DISTINCT {c}) AS n_unique, TRUE AS within_error FROM d GROUP BY lo, hi"
        for c in SKETCHED
    ),
)
def q_nunique_sketch(spark, sf_dir):
    """Sketches by day are stored, later days appended; each year and the whole time are merged from them and held
    against the exact numbers."""
    reviews = fx.reviews(spark, sf_dir).select(*SKETCHED, "timestamp")
    path = IO.scratch_path(spark, "sketches")
    for part in ("year(timestamp) < 2000", "year(timestamp) >= 2000"):
        E.distinct_sketches(reviews.where(part), SKETCHED, "timestamp").write.mode("append").parquet(path)
    years = reviews.select(F.year("timestamp").alias("y")).distinct()
    ends = years.select(F.col("y").alias("a"), F.col("y").alias("b")).unionByName(years.agg(F.min("y").alias("a"), F.max("y").alias("b")))
    ranges = ends.select(F.make_date("a", F.lit(1), F.lit(1)).alias("lo"), F.make_date("b", F.lit(12), F.lit(31)).alias("hi")).distinct()
    near = E.distinct_in_ranges(spark.read.parquet(path), ranges)
    exact = E.nunique_in_ranges(reviews, SKETCHED, "timestamp", ranges)
    within = F.abs(F.col("n_estimated") - F.col("n_unique")) <= F.ceil(F.col("error") * F.col("n_unique"))
    return exact.join(near, ["lo", "hi", "column"], "left").select(
        "lo", "hi", "column", "n_unique", F.coalesce(within, F.lit(False)).alias("within_error"))


@register(
    "category_depth",
    """SELECT ROUND(AVG(COALESCE(len(categories), 0)), 6) AS mean_depth, MAX(COALESCE(len(categories), 0)) AS max_depth,
              ROUND(COUNT(*) FILTER (WHERE COALESCE(len(features), 0) <= 0) * 100.0 / COUNT(*), 2) AS empty_features_pct
       FROM metadata""",
)
def q_category_depth(spark, sf_dir):
    return E.array_shape_stats(fx.metadata(spark, sf_dir))


@register(
    "histogram_bins",
    """WITH v AS (SELECT price AS x FROM metadata WHERE price IS NOT NULL AND NOT isnan(price)),
            s AS (SELECT MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / 10.0 AS w FROM v),
            c AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR((x - lo) / w), 9) END AS INT) AS bin, COUNT(*) AS n
                  FROM v, s GROUP BY 1),
            b AS (SELECT CAST(range AS INT) AS bin FROM range(10))
       SELECT b.bin, ROUND(lo + b.bin * w, 6) AS left, ROUND(lo + (b.bin + 1) * w, 6) AS right,
              CAST(COALESCE(c.n, 0) AS BIGINT) AS count
       FROM b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""",
)
def q_histogram_bins(spark, sf_dir):
    return E.histogram(fx.metadata(spark, sf_dir, with_arrays=False), "price", 10)


@register(
    "boxplot_stats",
    """WITH v AS (SELECT price AS x FROM metadata WHERE price IS NOT NULL AND NOT isnan(price)),
            q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v)
       SELECT ROUND(q1, 6) AS q1, ROUND(med, 6) AS median, ROUND(q3, 6) AS q3,
              ROUND(MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
              ROUND(MAX(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
              COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM v, q GROUP BY q1, med, q3""",
)
def q_boxplot_stats(spark, sf_dir):
    return E.box_stats(fx.metadata(spark, sf_dir, with_arrays=False), "price")


@register(
    "top_n_other",
    """WITH c AS (SELECT store, COUNT(*) AS n FROM metadata WHERE store IS NOT NULL GROUP BY store),
            r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, store) AS rk FROM c)
       SELECT CASE WHEN rk <= 15 THEN store ELSE 'Other' END AS label, CAST(SUM(n) AS BIGINT) AS count
       FROM r GROUP BY 1""",
)
def q_top_n_other(spark, sf_dir):
    return E.top_n_other(fx.metadata(spark, sf_dir, with_arrays=False), "store")


@register("bar_counts", "SELECT rating, COUNT(*) AS count FROM reviews WHERE rating IS NOT NULL GROUP BY rating")
def q_bar_counts(spark, sf_dir):
    return E.bar_counts(fx.reviews(spark, sf_dir), "rating")


@register(
    "categorical_overview",
    """SELECT CAST(average_rating AS DOUBLE) AS average_rating, COUNT(*) AS count FROM metadata
       GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 10""",
)
def q_categorical_overview(spark, sf_dir):
    return E.first_n_by_value(fx.metadata(spark, sf_dir, with_arrays=False), "average_rating", 10)

"""Queries for the interaction filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.operators import interactions as I
from ranktide.plans.registry import register
from ranktide.sources import fixtures as fx

# Parameters of the fixture stand-ins (FIXTURES.md): the events table plays the
# review log for spam rules; both rules bite at 7 per day and 60 seconds.
SPAM_MAX_PER_DAY = 7
SPAM_MIN_GAP_S = 60
KCORE_CONVERGING = {"user_id": 20, "parent_asin": 20}
KCORE_NOT_CONVERGING = {"user_id": 25, "parent_asin": 20}
TOP_N = 100

REVIEW_COLS = (
    "user_id, parent_asin, asin, timestamp, rating, helpful_vote, verified_purchase, "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey"
)
DEDUP_SQL = f"""
SELECT {REVIEW_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, parent_asin
                               ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM reviews) WHERE rn = 1
"""


def kcore_sql(thresholds: dict[str, int], iterations: int, source: str = "dd") -> str:
    """Unrolled k-core CTEs; a converged pass is a fixed point, so running all
    ``iterations`` passes equals stopping early."""
    parts, prev, n = [], source, 0
    for _ in range(iterations):
        for col, k in thresholds.items():
            n += 1
            name = f"kc{n}"
            parts.append(
                f"{name} AS (SELECT * FROM {prev} WHERE {col} IN "
                f"(SELECT {col} FROM {prev} GROUP BY {col} HAVING COUNT(*) > {k}))"
            )
            prev = name
    return ",\n".join(parts), prev


def _events_spam_sql(max_day: int, gap: int) -> str:
    return f"""
WITH e AS (SELECT user_id, ts, value AS rating FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
d AS (SELECT user_id FROM e GROUP BY user_id, CAST(ts AS DATE) HAVING COUNT(rating) > {max_day}),
g AS (SELECT user_id, epoch_us(ts) / 1000000.0
             - LAG(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM e),
s AS (SELECT user_id FROM d UNION SELECT user_id FROM g WHERE gap < {gap})
"""


def _reviews_dedup(spark, sf_dir):
    return I.dedup_user_item(fx.reviews(spark, sf_dir), order=["timestamp", *fx.REVIEW_TIEBREAK])


# ------------------------------------------------------------------ C1 / C2
@register("spam_users", _events_spam_sql(SPAM_MAX_PER_DAY, SPAM_MIN_GAP_S) + "SELECT DISTINCT user_id FROM s")
def q_spam_users(spark, sf_dir):
    ev = fx.events(spark, sf_dir).withColumnRenamed("value", "rating")
    return I.spam_users(ev, ts_col="ts", max_reviews_per_day=SPAM_MAX_PER_DAY, min_time_gap=SPAM_MIN_GAP_S)


@register(
    "spam_filter",
    _events_spam_sql(SPAM_MAX_PER_DAY, SPAM_MIN_GAP_S)
    + "SELECT * FROM events WHERE user_id NOT IN (SELECT user_id FROM s)",
)
def q_spam_filter(spark, sf_dir):
    ev = fx.events(spark, sf_dir)
    flagged = I.spam_users(
        ev.withColumnRenamed("value", "rating"), ts_col="ts",
        max_reviews_per_day=SPAM_MAX_PER_DAY, min_time_gap=SPAM_MIN_GAP_S,
    )
    return ev.join(flagged, "user_id", "left_anti")


@register(
    "spam_day_only",
    f"""SELECT * FROM events WHERE user_id NOT IN (
          SELECT user_id FROM events WHERE ts IS NOT NULL
          GROUP BY user_id, CAST(ts AS DATE) HAVING COUNT(*) > {SPAM_MAX_PER_DAY - 2})""",
)
def q_spam_day_only(spark, sf_dir):
    return I.remove_spam_day_only(
        fx.events(spark, sf_dir), ts_col="ts", max_reviews_per_day=SPAM_MAX_PER_DAY - 2
    )


@register(
    "spam_reviews_filter",
    f"""WITH s AS (SELECT user_id FROM reviews GROUP BY user_id, CAST(timestamp AS DATE) HAVING COUNT(rating) > 3)
        SELECT user_id, parent_asin, timestamp, rating, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM reviews WHERE user_id NOT IN (SELECT user_id FROM s)""",
)
def q_spam_reviews(spark, sf_dir):
    # Day-granular fixture timestamps: equal timestamps give gap 0, so the gap
    # rule would flag every user with two orders on one day; test the day rule
    # on reviews and the gap rule on events.
    r = fx.reviews(spark, sf_dir).select(
        "user_id", "parent_asin", "timestamp", "rating", *fx.REVIEW_TIEBREAK
    )
    return I.remove_spam(r, max_reviews_per_day=3, min_time_gap=0)


# ------------------------------------------------------------------ C3
@register("dedup_user_item", DEDUP_SQL)
def q_dedup_user_item(spark, sf_dir):
    return _reviews_dedup(spark, sf_dir)


# ------------------------------------------------------------------ C4
def _kcore_oracle(th):
    ctes, last = kcore_sql(th, 3)
    return f"WITH dd AS ({DEDUP_SQL}),\n{ctes}\nSELECT * FROM {last}"


@register("k_core", _kcore_oracle(KCORE_CONVERGING))
def q_k_core(spark, sf_dir):
    return I.k_core(_reviews_dedup(spark, sf_dir), KCORE_CONVERGING, max_iterations=3).df


@register("k_core_unconverged", _kcore_oracle(KCORE_NOT_CONVERGING))
def q_k_core_unconverged(spark, sf_dir):
    return I.k_core(_reviews_dedup(spark, sf_dir), KCORE_NOT_CONVERGING, max_iterations=3).df


# ------------------------------------------------------------------ C5
def _filtered(spark, sf_dir):
    return I.k_core(_reviews_dedup(spark, sf_dir), KCORE_CONVERGING, max_iterations=3).df


def _top_sql(n):
    ctes, last = kcore_sql(KCORE_CONVERGING, 3)
    return (
        f"WITH dd AS ({DEDUP_SQL}),\n{ctes},\n"
        f"top AS (SELECT parent_asin, COUNT(*) AS n_interactions FROM {last} GROUP BY parent_asin "
        f"ORDER BY n_interactions DESC, parent_asin LIMIT {n})\n"
    ), last


@register("top_n_items", _top_sql(TOP_N)[0] + f"SELECT * FROM {_top_sql(TOP_N)[1]} WHERE parent_asin IN (SELECT parent_asin FROM top)")
def q_top_n_items(spark, sf_dir):
    return I.filter_top_n_items(_filtered(spark, sf_dir), top_n=TOP_N)


@register("top_items", _top_sql(10)[0] + "SELECT parent_asin, n_interactions FROM top")
def q_top_items(spark, sf_dir):
    """Minimum slice: reviews -> dedup -> k-core -> 10 most reviewed items."""
    return I.top_items(_filtered(spark, sf_dir), top_n=10)


# ------------------------------------------------------------------ C6 / C7
@register(
    "active_metadata",
    f"""WITH dd AS ({DEDUP_SQL}), t AS (SELECT parent_asin FROM reviews WHERE rating >= 5)
        SELECT parent_asin, title, store, price, average_rating, rating_number FROM metadata
        WHERE parent_asin IN (SELECT parent_asin FROM t)""",
)
def q_active_metadata(spark, sf_dir):
    act = fx.reviews(spark, sf_dir).where(F.col("rating") >= 5)
    m = fx.metadata(spark, sf_dir, with_arrays=False).select(
        "parent_asin", "title", "store", "price", "average_rating", "rating_number"
    )
    return I.keep_active_items(m, act)


@register(
    "metadata_coverage",
    """WITH t AS (SELECT DISTINCT parent_asin FROM reviews WHERE rating >= 5),
            m AS (SELECT DISTINCT parent_asin FROM metadata WHERE description IS NOT NULL)
       SELECT COUNT(*) AS n_items, COUNT(m.parent_asin) AS n_with_metadata,
              ROUND(COUNT(m.parent_asin) / COUNT(*), 6) AS coverage
       FROM t LEFT JOIN m ON t.parent_asin = m.parent_asin""",
)
def q_metadata_coverage(spark, sf_dir):
    act = fx.reviews(spark, sf_dir).where(F.col("rating") >= 5)
    m = fx.metadata(spark, sf_dir, with_arrays=False).where(F.col("description").isNotNull())
    return I.metadata_coverage(m, act)

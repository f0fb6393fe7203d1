"""Queries for encoders, weights, features, splits and scaling (G*, A10, E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.functions.relational import r6
from ranktide.operators import clean as C
from ranktide.operators import features as G
from ranktide.plans.registry import register
from ranktide.sources import fixtures as fx

# Fixture stand-ins for 2021 / 2022 (FIXTURES.md).
VAL_YEAR, TEST_YEAR = 2000, 2001
# Store-tier parameters that separate the three tiers on the fixture stores.
TIER_SMALL_MAX, TIER_LARGE_MIN, TIER_RATING = 10, 14, 3.0
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

SPLIT_SQL = f"""CASE WHEN year(timestamp) < {VAL_YEAR} THEN 'train'
                     WHEN year(timestamp) < {TEST_YEAR} THEN 'val'
                     WHEN year(timestamp) >= {TEST_YEAR} THEN 'test' END"""


def _reviews(spark, sf_dir):
    return fx.reviews(spark, sf_dir)


# ------------------------------------------------------------------ G1
@register(
    "label_codes",
    """SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INT) AS code
       FROM (SELECT DISTINCT user_id AS value FROM reviews)""",
)
def q_label_codes(spark, sf_dir):
    return G.fit_label_codes(_reviews(spark, sf_dir), "user_id")


@register(
    "encoded_reviews",
    f"""WITH uc AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INT) AS code
                   FROM (SELECT DISTINCT user_id AS value FROM reviews)),
            ic AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INT) AS code
                   FROM (SELECT DISTINCT parent_asin AS value FROM reviews))
       SELECT {KEYS}, uc.code AS user_id, ic.code AS parent_asin, r.parent_asin AS parent_asin_original
       FROM reviews r JOIN uc ON uc.value = r.user_id JOIN ic ON ic.value = r.parent_asin""",
)
def q_encoded_reviews(spark, sf_dir):
    r = _reviews(spark, sf_dir).select(*fx.REVIEW_TIEBREAK, "user_id", "parent_asin")
    out, _ = G.encode_labels(r, ["user_id", "parent_asin"], keep_original={"parent_asin": "parent_asin_original"})
    return out


# ------------------------------------------------------------------ G2 / G3
@register(
    "interaction_matrix",
    f"""WITH t AS (SELECT user_id, parent_asin FROM reviews WHERE year(timestamp) < {VAL_YEAR}),
            v AS (SELECT user_id, parent_asin FROM reviews WHERE year(timestamp) >= {VAL_YEAR} AND year(timestamp) < {TEST_YEAR}),
            b AS (SELECT * FROM t UNION ALL SELECT * FROM v),
            uc AS (SELECT user_id, CAST(ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS INT) AS u FROM (SELECT DISTINCT user_id FROM b)),
            ic AS (SELECT parent_asin, CAST(ROW_NUMBER() OVER (ORDER BY parent_asin) - 1 AS INT) AS i FROM (SELECT DISTINCT parent_asin FROM b))
       SELECT u, i, CAST(COUNT(*) AS DOUBLE) AS value FROM t JOIN uc USING (user_id) JOIN ic USING (parent_asin)
       GROUP BY u, i""",
)
def q_interaction_matrix(spark, sf_dir):
    tr, va, _ = G.time_based_split(_reviews(spark, sf_dir), "timestamp", VAL_YEAR, TEST_YEAR)
    return G.prepare_interaction_matrices(tr, va).train


@register(
    "user_item_matrix",
    "SELECT user_id, parent_asin, CAST(SUM(rating) AS DOUBLE) AS value FROM reviews GROUP BY user_id, parent_asin",
)
def q_user_item_matrix(spark, sf_dir):
    return G.build_user_item_matrix(_reviews(spark, sf_dir))


# ------------------------------------------------------------------ G4 / G5 / B25
@register(
    "confidence_weight",
    f"""SELECT {KEYS}, CAST(CASE WHEN verified_purchase THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence_weight,
               CAST(1.0 AS DOUBLE) AS implicit_weight,
               CAST(CASE WHEN verified_purchase THEN 1.0 ELSE 0.7 END AS DOUBLE) * CAST(1.0 AS DOUBLE) AS final_weight
        FROM reviews""",
)
def q_confidence_weight(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    out = r.transform(G.apply_confidence_weight).transform(G.set_implicit_weight).transform(G.add_final_weight)
    return out.select(*fx.REVIEW_TIEBREAK, "confidence_weight", "implicit_weight", "final_weight")


# ------------------------------------------------------------------ G6
@register(
    "user_segment",
    f"""WITH a AS (SELECT user_id, COUNT(rating) AS n FROM reviews GROUP BY user_id)
        SELECT {KEYS}, r.user_id,
               CASE WHEN n > 0 AND n <= 2 THEN 'Light' WHEN n > 2 AND n <= 10 THEN 'Medium'
                    WHEN n > 10 THEN 'Heavy' END AS user_segment
        FROM reviews r JOIN a USING (user_id)""",
)
def q_user_segment(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    return G.add_user_segment(r).select(*fx.REVIEW_TIEBREAK, "user_id", "user_segment")


# ------------------------------------------------------------------ G7
@register(
    "add_features",
    f"""WITH u AS (SELECT user_id, AVG(CAST(verified_purchase AS INT)) AS x FROM reviews GROUP BY user_id),
            i AS (SELECT asin, AVG(rating) AS y FROM reviews GROUP BY asin)
        SELECT {KEYS}, ROUND(u.x, 6) AS user_verified_ratio, ROUND(i.y, 6) AS item_avg_rating,
               CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend
        FROM reviews r JOIN u USING (user_id) JOIN i USING (asin)""",
)
def q_add_features(spark, sf_dir):
    # keyed on the variant ``asin`` as the reference's training path does
    out = G.add_features(_reviews(spark, sf_dir), item_key="asin")
    return out.select(
        *fx.REVIEW_TIEBREAK, r6("user_verified_ratio").alias("user_verified_ratio"),
        r6("item_avg_rating").alias("item_avg_rating"), "is_weekend",
    )


@register(
    "train_features_apply",
    f"""WITH t AS (SELECT * FROM reviews WHERE year(timestamp) < {VAL_YEAR}),
            v AS (SELECT * FROM reviews WHERE year(timestamp) >= {VAL_YEAR} AND year(timestamp) < {TEST_YEAR}),
            u AS (SELECT user_id, AVG(CAST(verified_purchase AS INT)) AS x FROM t GROUP BY user_id),
            i AS (SELECT parent_asin, AVG(rating) AS y FROM t GROUP BY parent_asin)
        SELECT {KEYS}, ROUND(COALESCE(u.x, 0.5), 6) AS user_verified_ratio,
               ROUND(COALESCE(i.y, (SELECT AVG(rating) FROM t)), 6) AS item_avg_rating,
               CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend
        FROM v LEFT JOIN u USING (user_id) LEFT JOIN i USING (parent_asin)""",
)
def q_train_features_apply(spark, sf_dir):
    tr, va, _ = G.time_based_split(_reviews(spark, sf_dir), "timestamp", VAL_YEAR, TEST_YEAR)
    out = G.apply_train_features(va, tr)
    return out.select(
        *fx.REVIEW_TIEBREAK, r6("user_verified_ratio").alias("user_verified_ratio"),
        r6("item_avg_rating").alias("item_avg_rating"), "is_weekend",
    )


# ------------------------------------------------------------------ G9 / A10
@register("time_split", f"SELECT {KEYS}, {SPLIT_SQL} AS split FROM reviews")
def q_time_split(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    return r.select(*fx.REVIEW_TIEBREAK, G.split_label("timestamp", VAL_YEAR, TEST_YEAR).alias("split"))


@register(
    "split_report",
    f"""SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT parent_asin) AS n_items
        FROM (SELECT *, {SPLIT_SQL} AS split FROM reviews) WHERE split IS NOT NULL GROUP BY split""",
)
def q_split_report(spark, sf_dir):
    from ranktide.operators.eda import split_report

    tr, va, te = G.time_based_split(_reviews(spark, sf_dir), "timestamp", VAL_YEAR, TEST_YEAR)
    return split_report({"train": tr, "val": va, "test": te})


# ------------------------------------------------------------------ G10 / B13
@register(
    "minmax_train_fit",
    f"""WITH r AS (SELECT *, LN(1 + helpful_vote) AS hv, CASE WHEN verified_purchase THEN 1.0 ELSE 0.7 END AS cw,
                          {SPLIT_SQL} AS split FROM reviews),
            s AS (SELECT MIN(hv) AS hv_lo, MAX(hv) AS hv_hi, MIN(cw) AS cw_lo, MAX(cw) AS cw_hi FROM r WHERE split = 'train')
        SELECT {KEYS}, split,
               ROUND(CASE WHEN hv_hi = hv_lo THEN 0.0 ELSE (hv - hv_lo) / (hv_hi - hv_lo) END, 6) AS helpful_vote_norm,
               ROUND(CASE WHEN cw_hi = cw_lo THEN 0.0 ELSE (cw - cw_lo) / (cw_hi - cw_lo) END, 6) AS confidence_weight_norm
        FROM r, s WHERE split IS NOT NULL""",
)
def q_minmax_train_fit(spark, sf_dir):
    r = _reviews(spark, sf_dir).transform(lambda d: C.handle_outliers(d, ["helpful_vote"]))
    r = G.apply_confidence_weight(r).withColumn("split", G.split_label("timestamp", VAL_YEAR, TEST_YEAR))
    r = C.sanitize_numeric(r, ["helpful_vote", "confidence_weight"]).where(F.col("split").isNotNull())
    cols = ["helpful_vote", "confidence_weight"]
    stats = G.fit_minmax(r.where(F.col("split") == "train"), cols)
    out = G.apply_minmax(r, stats, cols)
    return out.select(
        *fx.REVIEW_TIEBREAK, "split", r6("helpful_vote_norm").alias("helpful_vote_norm"),
        r6("confidence_weight_norm").alias("confidence_weight_norm"),
    )


# ------------------------------------------------------------------ G11 / E10
@register(
    "store_stats",
    """SELECT store, COUNT(parent_asin) AS product_count, ROUND(AVG(average_rating), 6) AS avg_rating
       FROM metadata WHERE store IS NOT NULL GROUP BY store""",
)
def q_store_stats(spark, sf_dir):
    s = G.store_stats(fx.metadata(spark, sf_dir, with_arrays=False))
    return s.withColumn("avg_rating", r6("avg_rating"))


@register(
    "store_tier",
    f"""WITH s AS (SELECT store, COUNT(parent_asin) AS n, AVG(average_rating) AS r FROM metadata
                   WHERE store IS NOT NULL GROUP BY store)
        SELECT m.parent_asin, m.store,
               CASE WHEN s.n >= {TIER_LARGE_MIN} AND COALESCE(s.r >= {TIER_RATING}, FALSE) THEN 'Premium'
                    WHEN s.n > {TIER_SMALL_MAX} OR COALESCE(s.r >= 3.6, FALSE) THEN 'Trusted'
                    WHEN s.n IS NOT NULL THEN 'Small Seller' END AS store_tier
        FROM metadata m LEFT JOIN s USING (store)""",
)
def q_store_tier(spark, sf_dir):
    m = fx.metadata(spark, sf_dir, with_arrays=False)
    out = G.add_store_tier(m, TIER_SMALL_MAX, TIER_LARGE_MIN, TIER_RATING)
    return out.select("parent_asin", "store", "store_tier")


# ------------------------------------------------------------------ G12
@register(
    "user_sample",
    "SELECT user_id FROM (SELECT DISTINCT user_id FROM reviews) ORDER BY md5(user_id || '|42'), user_id LIMIT 100",
)
def q_user_sample(spark, sf_dir):
    return G.sample_users(_reviews(spark, sf_dir), 100, seed=42)

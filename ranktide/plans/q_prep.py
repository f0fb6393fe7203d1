"""Queries for the composed preprocessing job, late text binding and encoder persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.functions.relational import r6
from ranktide.operators import eda as E
from ranktide.operators import features as G
from ranktide.operators import preprocess as P
from ranktide.plans.q_filters import kcore_sql
from ranktide.plans.registry import register
from ranktide.sources import fixtures as fx
from ranktide.sources import io as IO

VAL_YEAR, TEST_YEAR, MAX_PER_DAY, TOP_N = 2000, 2001, 9, 500
TIER = (10, 14, 3.0)
KCORE = {"user_id": 5, "parent_asin": 5}
# Day-granular fixture timestamps: equal times have gap 0, so the gap rule is off here (spam_users tests it).
SETTINGS = P.Settings(max_reviews_per_day=MAX_PER_DAY, min_time_gap=0, k_core=KCORE, top_n=TOP_N,
                      val_year=VAL_YEAR, test_year=TEST_YEAR, store_tier=TIER, tiebreak=tuple(fx.REVIEW_TIEBREAK))


def reviews_with_text(spark, sf_dir):
    """Reviews with a title and a text: the fixture's review texts, by the product's number."""
    t = fx.review_texts(spark, sf_dir).select("review_id", "title", "text")
    r = fx.reviews(spark, sf_dir)
    return r.join(t, r.l_partkey == t.review_id, "left").drop("review_id")


def prepared(spark, sf_dir) -> P.Prepared:
    return P.preprocess(reviews_with_text(spark, sf_dir), fx.metadata(spark, sf_dir, with_arrays=False), SETTINGS)


_KCORE, _LAST = kcore_sql(KCORE, 3, "dd")
_NULL = "CASE WHEN trim({0}, ' ' || chr(9) || chr(10) || chr(13)) IN ('None', '', '[]', 'nan') THEN NULL ELSE {0} END"
PREP_SQL = f"""
WITH rt AS (SELECT r.*, {_NULL.format('t.title')} AS title, {_NULL.format('t.text')} AS text0
            FROM reviews r LEFT JOIN review_texts t ON t.review_id = r.l_partkey),
spam AS (SELECT user_id FROM rt GROUP BY user_id, CAST(timestamp AS DATE) HAVING COUNT(rating) > {MAX_PER_DAY}),
ok AS (SELECT * FROM rt WHERE user_id NOT IN (SELECT user_id FROM spam)),
dd AS (SELECT * FROM ok QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, parent_asin
       ORDER BY timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1),
{_KCORE},
top AS (SELECT parent_asin FROM {_LAST} GROUP BY parent_asin ORDER BY COUNT(*) DESC, parent_asin LIMIT {TOP_N}),
fin AS (SELECT *, LN(1 + helpful_vote) AS hv, CASE WHEN verified_purchase THEN 1.0 ELSE 0.7 END AS cw,
               COUNT(rating) OVER (PARTITION BY user_id) AS act,
               DENSE_RANK() OVER (ORDER BY user_id) - 1 AS u, DENSE_RANK() OVER (ORDER BY parent_asin) - 1 AS i,
               CASE WHEN year(timestamp) < {VAL_YEAR} THEN 'train' WHEN year(timestamp) < {TEST_YEAR} THEN 'val'
                    ELSE 'test' END AS split
        FROM {_LAST} WHERE parent_asin IN (SELECT parent_asin FROM top)),
"""


@register(
    "prepared_report",
    PREP_SQL + """z AS (SELECT unnest(['train', 'val', 'test']) AS split)
    SELECT z.split, COUNT(user_id) AS n_rows, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT parent_asin) AS n_items
    FROM z LEFT JOIN fin USING (split) GROUP BY z.split""",
)
def q_prepared_report(spark, sf_dir):
    """The whole job, its splits written and read back, and the report of what was written."""
    p = prepared(spark, sf_dir)
    path = IO.scratch_path(spark, "prepared")
    back = {}
    for name, df in (("train", p.train), ("val", p.val), ("test", p.test)):
        IO.write_parquet(df, f"{path}/{name}")
        back[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
    return E.split_report(back)


@register(
    "prepared_validation",
    PREP_SQL + """sc AS (SELECT MIN(hv) AS hl, MAX(hv) AS hh, MIN(cw) AS cl, MAX(cw) AS ch FROM fin WHERE split = 'train'),
    uv AS (SELECT user_id, AVG(CAST(verified_purchase AS INT)) AS x FROM fin WHERE split = 'train' GROUP BY user_id),
    iv AS (SELECT parent_asin, AVG(rating) AS y FROM fin WHERE split = 'train' GROUP BY parent_asin)
    SELECT fin.u AS user_id, fin.i AS parent_asin, fin.user_id AS user_id_original, fin.parent_asin AS parent_asin_original,
           fin.l_orderkey, fin.l_linenumber, rating, title,
           CASE WHEN text0 IS NULL OR len(regexp_extract_all(text0, '\\S+')) < 5 THEN NULL
                ELSE LEAST(len(regexp_extract_all(text0, '\\S+')), 250) END AS text_words,
           ROUND(CASE WHEN hh = hl THEN 0.0 ELSE (hv - hl) / (hh - hl) END, 6) AS helpful_vote_norm,
           ROUND(CASE WHEN ch = cl THEN 0.0 ELSE (cw - cl) / (ch - cl) END, 6) AS final_weight_norm,
           CASE WHEN act <= 2 THEN 'Light' WHEN act <= 10 THEN 'Medium' ELSE 'Heavy' END AS user_segment,
           ROUND(COALESCE(x, 0.5), 6) AS user_verified_ratio,
           ROUND(COALESCE(y, (SELECT AVG(rating) FROM fin WHERE split = 'train')), 6) AS item_avg_rating,
           CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend
    FROM fin CROSS JOIN sc LEFT JOIN uv USING (user_id) LEFT JOIN iv USING (parent_asin) WHERE split = 'val'""",
)
def q_prepared_validation(spark, sf_dir):
    """Validation rows with codes, original ids, bound texts, scaled columns and train-fitted features."""
    out = prepared(spark, sf_dir).val
    words = F.size(F.expr("regexp_extract_all(text, '\\\\S+', 0)"))
    return out.select(
        "user_id", "parent_asin", "user_id_original", "parent_asin_original", "l_orderkey", "l_linenumber",
        F.col("rating").cast("int").alias("rating"), "title", F.when(F.col("text").isNotNull(), words).alias("text_words"),
        r6("helpful_vote_norm").alias("helpful_vote_norm"), r6("final_weight_norm").alias("final_weight_norm"),
        "user_segment", r6("user_verified_ratio").alias("user_verified_ratio"),
        r6("item_avg_rating").alias("item_avg_rating"), "is_weekend")


@register(
    "prepared_metadata",
    PREP_SQL + f"""am AS (SELECT * FROM metadata WHERE parent_asin IN (SELECT parent_asin FROM fin)
                          AND description IS NOT NULL AND trim(description) <> ''),
    st AS (SELECT store, COUNT(parent_asin) AS n, AVG(average_rating) AS r FROM am WHERE store IS NOT NULL GROUP BY store)
    SELECT am.parent_asin, am.store, CASE WHEN n >= {TIER[1]} AND COALESCE(r >= {TIER[2]}, FALSE) THEN 'Premium'
           WHEN n > {TIER[0]} OR COALESCE(r >= 3.6, FALSE) THEN 'Trusted' WHEN n IS NOT NULL THEN 'Small Seller' END AS store_tier
    FROM am LEFT JOIN st USING (store)""",
)
def q_prepared_metadata(spark, sf_dir):
    return prepared(spark, sf_dir).metadata.select("parent_asin", "store", "store_tier")


@register(
    "late_text_binding",
    f"""WITH k AS (SELECT user_id, parent_asin, timestamp, MIN(rating) AS rating FROM reviews WHERE rating >= 4
                   GROUP BY ALL),
        t AS (SELECT r.user_id, r.parent_asin, r.timestamp, x.title, x.text FROM reviews r
              LEFT JOIN review_texts x ON x.review_id = r.l_partkey
              QUALIFY ROW_NUMBER() OVER (PARTITION BY r.user_id, r.parent_asin, r.timestamp
                                         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)
        SELECT k.*, t.title, length(t.text) AS text_chars FROM k LEFT JOIN t USING (user_id, parent_asin, timestamp)""",
)
def q_late_text_binding(spark, sf_dir):
    r = fx.reviews(spark, sf_dir)
    keys = r.where("rating >= 4").groupBy(*P.TEXT_KEYS).agg(F.min("rating").alias("rating"))
    library = fx.review_texts(spark, sf_dir).select(F.col("review_id").alias("l_partkey"), "title", "text")
    out = P.bind_text(keys, r, order=fx.REVIEW_TIEBREAK, library=library, ref="l_partkey")
    return out.select(*P.TEXT_KEYS, "rating", "title", F.length("text").cast("long").alias("text_chars"))


@register(
    "metadata_alignment",
    "SELECT parent_asin, COUNT(*) AS n FROM reviews GROUP BY parent_asin",
)
def q_metadata_alignment(spark, sf_dir):
    """Interactions per item, after proof that every item has metadata."""
    r = P.assert_aligned(fx.reviews(spark, sf_dir).select("parent_asin"), fx.metadata(spark, sf_dir, with_arrays=False))
    return r.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n"))


@register(
    "encoder_roundtrip",
    """SELECT user_id, parent_asin, u, i, COUNT(*) AS n
       FROM (SELECT user_id, parent_asin, DENSE_RANK() OVER (ORDER BY user_id) - 1 AS u,
                    DENSE_RANK() OVER (ORDER BY parent_asin) - 1 AS i FROM reviews) GROUP BY ALL""",
)
def q_encoder_roundtrip(spark, sf_dir):
    """Encoders written, loaded, applied and undone."""
    r = fx.reviews(spark, sf_dir).select("user_id", "parent_asin")
    path = IO.scratch_path(spark, "encoders")
    P.save_encoders({c: G.fit_label_codes(r, c) for c in r.columns}, path)
    loaded = {c: P.load_encoder(spark, path, c) for c in r.columns}
    coded, _ = G.encode_labels(r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n")), r.columns, loaded)
    coded = coded.select("n", F.col("user_id").alias("u"), F.col("parent_asin").alias("i"), "user_id", "parent_asin")
    for c in ("user_id", "parent_asin"):
        coded = P.decode_labels(coded, c, loaded[c])
    return coded

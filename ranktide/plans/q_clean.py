"""Queries for cleaning, text and metadata operators (B*, A4, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.functions import text as T
from ranktide.functions.relational import r6
from ranktide.operators import clean as C
from ranktide.plans import sqlfrag as S
from ranktide.plans.registry import register
from ranktide.sources import fixtures as fx

NONE_LIKE = "('None', '', '[]', 'nan')"
IMG_HI = "https://img.example.com/hi/"
IMG_LG = "https://img.example.com/lg/"


# ------------------------------------------------------------------ B2 / B3
@register(
    "clean_reviews",
    rf"""SELECT * FROM (
          SELECT review_id,
                 CASE WHEN title IN {NONE_LIKE} THEN NULL ELSE title END AS title,
                 CASE WHEN text IN {NONE_LIKE} OR regexp_matches(text, '^\s*$') THEN NULL ELSE text END AS text,
                 lang, n_chars
          FROM review_texts) WHERE text IS NOT NULL""",
)
def q_clean_reviews(spark, sf_dir):
    return (
        fx.review_texts(spark, sf_dir)
        .transform(lambda d: C.replace_none_strings(d, ["title", "text", "n_chars"]))
        .transform(lambda d: C.remove_missing_values(d, ["text"]))
    )


@register(
    "missing_drop",
    r"""SELECT * FROM (
          SELECT review_id,
                 CASE WHEN regexp_matches(title, '^\s*$') THEN NULL ELSE title END AS title,
                 CASE WHEN regexp_matches(text, '^\s*$') THEN NULL ELSE text END AS text, lang, n_chars
          FROM review_texts) WHERE title IS NOT NULL AND text IS NOT NULL""",
)
def q_missing_drop(spark, sf_dir):
    return C.remove_missing_values(fx.review_texts(spark, sf_dir), ["title", "text"])


# ------------------------------------------------------------------ B4 / B5
@register(
    "dedup_exact",
    """SELECT user_id, parent_asin, asin, timestamp, rating, helpful_vote, verified_purchase,
              l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, parent_asin, timestamp, rating
              ORDER BY asin, helpful_vote, verified_purchase, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
          FROM reviews) WHERE rn = 1""",
)
def q_dedup_exact(spark, sf_dir):
    return C.remove_duplicates(
        fx.reviews(spark, sf_dir), ["user_id", "parent_asin", "timestamp", "rating"]
    )


@register(
    "duplicate_stats",
    """WITH r AS (SELECT user_id, parent_asin, timestamp, rating FROM reviews),
            g AS (SELECT COUNT(*) AS n FROM r GROUP BY user_id, parent_asin, timestamp, rating)
       SELECT CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(n) - COUNT(*) AS BIGINT) AS n_duplicates,
              ROUND((SUM(n) - COUNT(*)) * 100.0 / SUM(n), 2) AS pct_duplicates FROM g""",
)
def q_duplicate_stats(spark, sf_dir):
    r = fx.reviews(spark, sf_dir).select("user_id", "parent_asin", "timestamp", "rating")
    return C.duplicate_stats(r)


# ------------------------------------------------------------------ B10
@register(
    "text_filter",
    f"""SELECT review_id, CASE WHEN len({S.words('text')}) < 5 THEN NULL
                              WHEN len({S.words('text')}) > 250 THEN array_to_string(list_slice({S.words('text')}, 1, 250), ' ')
                              ELSE text END AS text
        FROM review_texts""",
)
def q_text_filter(spark, sf_dir):
    return C.filter_text(fx.review_texts(spark, sf_dir).select("review_id", "text"), "text", 5, 250)


@register(
    "word_counts",
    f"SELECT review_id, CAST(len({S.words('text')}) AS INT) AS n_words FROM review_texts",
)
def q_word_counts(spark, sf_dir):
    return fx.review_texts(spark, sf_dir).select("review_id", T.word_count("text").alias("n_words"))


# ------------------------------------------------------------------ B6-B9, B11, B12
@register(
    "helpful_log1p",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              ROUND(LN(1 + helpful_vote), 6) AS helpful_vote,
              CASE WHEN l_linenumber = 3 THEN NULL ELSE epoch_ms(CAST(epoch_ms(timestamp) AS BIGINT)) END AS ts,
              CAST(rating AS BIGINT) AS rating
       FROM reviews""",
)
def q_helpful_log1p(spark, sf_dir):
    r = fx.reviews(spark, sf_dir)
    raw_ms = F.when(F.col("l_linenumber") == 3, F.lit("not-a-number")).otherwise(
        F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string")
    )
    r = r.withColumn("ts", raw_ms).withColumn("images", F.array())
    out = (
        r.transform(C.drop_useless_columns)
        .transform(lambda d: C.handle_outliers(d, ["helpful_vote"]))
        .transform(lambda d: C.convert_timestamp(d, "ts"))
        .transform(lambda d: C.convert_to_integer(d, ["rating"]))
    )
    return out.select(*fx.REVIEW_TIEBREAK, r6("helpful_vote").alias("helpful_vote"), "ts", "rating")


@register("high_signal", "SELECT * FROM reviews WHERE rating >= 4")
def q_high_signal(spark, sf_dir):
    return C.filter_high_signal_ratings(fx.reviews(spark, sf_dir), 4.0)


@register("date_floor", "SELECT * FROM reviews WHERE timestamp >= TIMESTAMP '1996-01-01'")
def q_date_floor(spark, sf_dir):
    return C.date_floor(fx.reviews(spark, sf_dir), "timestamp", "1996-01-01")


# ------------------------------------------------------------------ B14-B17
@register("html_clean", f"SELECT page_id, {S.clean_text_field('html')} AS text FROM pages")
def q_html_clean(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    return p.select("page_id", T.clean_text_field("html").alias("text"))


@register("retrieval_text_clean", f"SELECT page_id, {S.clean_retrieval('html')} AS text FROM pages")
def q_retrieval_text_clean(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    return p.select("page_id", T.clean_retrieval_text("html").alias("text"))


@register(
    "metadata_text_clean",
    f"""SELECT parent_asin, {S.clean_meta('title')} AS title, {S.clean_meta('description')} AS description,
               {S.clean_meta(S.numpy_str('categories'))} AS categories,
               {S.clean_meta(S.numpy_str('features'))} AS features
        FROM metadata""",
)
def q_metadata_text_clean(spark, sf_dir):
    m = fx.metadata(spark, sf_dir).select("parent_asin", "title", "description", "categories", "features")
    return C.clean_metadata_columns(m, ["title", "description", "categories", "features"])


@register(
    "combined_text",
    f"""SELECT parent_asin, lower({S.clean_meta('title')} || ' ' || {S.clean_meta(S.numpy_str('categories'))} || ' ' ||
                                 {S.clean_meta(S.numpy_str('features'))} || ' ' || {S.clean_meta('description')}) AS combined_text
        FROM metadata""",
)
def q_combined_text(spark, sf_dir):
    m = fx.metadata(spark, sf_dir)
    return C.combined_text_content(m).select("parent_asin", "combined_text")


@register(
    "combined_text_any",
    f"""SELECT parent_asin, COALESCE(title, '') || ' ' || COALESCE(description, '') || ' ' ||
               COALESCE({S.numpy_str('features')}, '') || ' ' || COALESCE({S.numpy_str('categories')}, '') AS combined_text
        FROM metadata""",
)
def q_combined_text_any(spark, sf_dir):
    m = fx.metadata(spark, sf_dir).select("parent_asin", "title", "description", "features", "categories")
    return C.combined_text_any(m).select("parent_asin", "combined_text")


# ------------------------------------------------------------------ B18
def _meta_cat_text():
    return "array_to_string([p_type, p_brand], ', ')"


@register(
    "process_metadata",
    f"""WITH a AS (SELECT DISTINCT parent_asin FROM reviews WHERE rating >= 5),
            m AS (SELECT parent_asin, COALESCE(title, 'Unknown Title') AS t, 'Unknown Brand' AS b,
                         CASE WHEN len(categories) > 0 THEN array_to_string(categories, ', ') ELSE 'Unknown Category' END AS c,
                         description AS d
                  FROM metadata WHERE parent_asin IN (SELECT parent_asin FROM a)),
            x AS (SELECT parent_asin, {S.clean_text_field('t')} AS title, {S.clean_text_field('b')} AS brand,
                         {S.clean_text_field('c')} AS categories, {S.clean_text_field('d')} AS description FROM m)
       SELECT *, lower('Product Title: ' || title || '. Brand: ' || brand || '. Categories: ' || categories
                       || '. Description: ' || description) AS combined_text FROM x""",
)
def q_process_metadata(spark, sf_dir):
    active = fx.reviews(spark, sf_dir).where(F.col("rating") >= 5)
    return C.process_metadata(fx.metadata(spark, sf_dir), active)


# ------------------------------------------------------------------ B21 / O1
@register(
    "rag_chunks",
    f"""WITH s AS (
          SELECT CAST(parent_asin AS VARCHAR) AS id, {S.clean_retrieval('title')} AS t,
                 {S.clean_retrieval("COALESCE(description, '') || ' ' || " + S.list_text('features'))} AS d,
                 {S.list_text('categories')} AS c
          FROM metadata WHERE parent_asin IS NOT NULL AND title IS NOT NULL)
        SELECT id,
               'Product ID: ' || id || chr(10) || 'Title: ' || t || chr(10) || 'Category: ' ||
               CASE WHEN c <> '' THEN replace(c, ' ', ' > ') ELSE 'Unknown Category' END || chr(10) ||
               'Description and Features: ' || d AS document,
               substring(t, 1, 100) AS title
        FROM s WHERE t <> '' AND lower(t) <> 'nan' AND length(d) >= 10""",
)
def q_rag_chunks(spark, sf_dir):
    return C.rag_chunks(fx.metadata(spark, sf_dir))


# ------------------------------------------------------------------ B22 / B23
def _with_images(spark, sf_dir):
    """Metadata plus an ``images`` array derived from ``part``: empty for some
    products, an empty ``hi_res`` for others."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    img = F.struct(
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(IMG_HI), key)).alias("hi_res"),
        F.concat(F.lit(IMG_LG), key).alias("large"),
    )
    imgs = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<struct<hi_res:string,large:string>>")).otherwise(
        F.array(img, F.struct(F.lit("x").alias("hi_res"), F.lit("y").alias("large")))
    )
    return p.select(F.concat(F.lit("P"), key).alias("parent_asin"), imgs.alias("images"))


_IMG_SQL = f"""
WITH im AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS parent_asin,
                   CASE WHEN p_size % 7 = 0 THEN NULL
                        WHEN p_size % 5 <> 0 THEN '{IMG_HI}' || lpad(CAST(p_partkey AS VARCHAR), 8, '0')
                        ELSE '{IMG_LG}' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS image_url
            FROM part),
     tg AS (SELECT DISTINCT parent_asin FROM reviews WHERE rating >= 5)
"""


@register(
    "image_pick",
    _IMG_SQL + "SELECT parent_asin, image_url FROM im WHERE image_url IS NOT NULL AND parent_asin IN (SELECT parent_asin FROM tg)",
)
def q_image_pick(spark, sf_dir):
    targets = fx.reviews(spark, sf_dir).where(F.col("rating") >= 5)
    return C.image_map(_with_images(spark, sf_dir), targets)


@register(
    "image_coverage",
    _IMG_SQL + """SELECT COUNT(*) AS n_targets, COUNT(im.image_url) AS n_found,
                         COUNT(*) - COUNT(im.image_url) AS n_fallback
                  FROM tg LEFT JOIN im ON im.parent_asin = tg.parent_asin""",
)
def q_image_coverage(spark, sf_dir):
    targets = fx.reviews(spark, sf_dir).where(F.col("rating") >= 5)
    return C.image_coverage(_with_images(spark, sf_dir), targets)


# ------------------------------------------------------------------ B24
@register(
    "display_titles",
    """SELECT parent_asin, CASE WHEN length(COALESCE(description, 'Unknown Product ❓')) > 50
                               THEN substring(COALESCE(description, 'Unknown Product ❓'), 1, 47) || '...'
                               ELSE COALESCE(description, 'Unknown Product ❓') END AS display_title
       FROM metadata""",
)
def q_display_titles(spark, sf_dir):
    m = fx.metadata(spark, sf_dir, with_arrays=False)
    return m.select("parent_asin", T.display_title("description").alias("display_title"))

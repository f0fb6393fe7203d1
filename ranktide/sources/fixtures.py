"""Views over the driver tables that stand in for reviews and product metadata.

``reviews`` and ``metadata`` are built with the DataFrame API so Catalyst can
prune columns and push filters into the Parquet scans. ``REVIEWS_SQL`` and
``METADATA_SQL`` are the same views as portable SQL (used by the oracles).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _code(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 8, "0"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review interactions (user, product, variant, time, rating, votes, flag)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_tax", "l_returnflag",
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        _code("U", F.col("o_custkey")).alias("user_id"),
        _code("P", F.col("l_partkey")).alias("parent_asin"),
        F.concat(
            _code("P", F.col("l_partkey")), F.lit("-"), (F.col("l_suppkey") % 3).cast("string")
        ).alias("asin"),
        F.col("o_orderdate").alias("timestamp"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"),
        F.round(F.col("l_tax") * 100).cast("int").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


# Columns that make a review row unique; used as the total-order tiebreak.
REVIEW_TIEBREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def metadata(spark: SparkSession, sf_dir: str, with_arrays: bool = True) -> DataFrame:
    """Product metadata: title, store, price (nullable), description, rating stats."""
    p = table(spark, sf_dir, "part")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("description"))
    r = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.avg(F.ceil(F.col("l_quantity") / 10)).alias("average_rating"),
            F.count(F.lit(1)).alias("rating_number"),
        )
    )
    m = (
        p.join(d, d.doc_id == p.p_partkey, "left")
        .join(r, r.l_partkey == p.p_partkey, "left")
        .select(
            _code("P", F.col("p_partkey")).alias("parent_asin"),
            F.col("p_name").alias("title"),
            F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("store"),
            F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("p_retailprice"))
            .alias("price"),
            "description", "average_rating", "rating_number",
            "p_type", "p_brand", "p_name", "p_size",
        )
    )
    if with_arrays:
        m = m.withColumn("categories", F.array("p_type", "p_brand")).withColumn(
            "features",
            F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(
                F.array("p_name", "p_type")
            ),
        )
    return m.drop("p_type", "p_brand", "p_name", "p_size")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review text rows from ``documents`` with None-like and blank values
    injected by expression (the table itself has none)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = (
        F.when(k % 11 == 0, F.lit("nan")).when(k % 11 == 1, F.lit("   "))
        .when(k % 11 == 2, F.lit("[]")).when(k % 11 == 3, F.lit(None).cast("string"))
        .otherwise(F.col("text"))
    )
    title = (
        F.when(k % 7 == 0, F.lit("None")).when(k % 7 == 1, F.lit(""))
        .otherwise(F.concat(F.col("source"), F.lit(" "), F.col("lang")))
    )
    return d.select(k.alias("review_id"), title.alias("title"), text.alias("text"), "lang", "n_chars")


# ---------------------------------------------------------------- SQL forms
REVIEWS_SQL = """
SELECT CONCAT('U', LPAD(CAST(o.o_custkey AS VARCHAR), 8, '0')) AS user_id,
       CONCAT('P', LPAD(CAST(l.l_partkey AS VARCHAR), 8, '0')) AS parent_asin,
       CONCAT('P', LPAD(CAST(l.l_partkey AS VARCHAR), 8, '0'), '-', CAST(l.l_suppkey % 3 AS VARCHAR)) AS asin,
       o.o_orderdate AS timestamp,
       CAST(CEIL(l.l_quantity / 10) AS INT) AS rating,
       CAST(ROUND(l.l_tax * 100) AS INT) AS helpful_vote,
       l.l_returnflag <> 'R' AS verified_purchase,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

METADATA_SQL = """
SELECT CONCAT('P', LPAD(CAST(p.p_partkey AS VARCHAR), 8, '0')) AS parent_asin,
       p.p_name AS title, CONCAT(p.p_brand, '/', p.p_type) AS store,
       CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE p.p_retailprice END AS price,
       d.text AS description, r.average_rating, r.rating_number,
       [p.p_type, p.p_brand] AS categories,
       CASE WHEN p.p_size % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p.p_name, p.p_type] END AS features
FROM part p
LEFT JOIN documents d ON d.doc_id = p.p_partkey
LEFT JOIN (SELECT l_partkey, AVG(CEIL(l_quantity / 10)) AS average_rating, COUNT(*) AS rating_number
           FROM lineitem GROUP BY l_partkey) r ON r.l_partkey = p.p_partkey
"""


REVIEW_TEXTS_SQL = """
SELECT doc_id AS review_id,
       CASE WHEN doc_id % 7 = 0 THEN 'None' WHEN doc_id % 7 = 1 THEN '' ELSE source || ' ' || lang END AS title,
       CASE WHEN doc_id % 11 = 0 THEN 'nan' WHEN doc_id % 11 = 1 THEN '   ' WHEN doc_id % 11 = 2 THEN '[]'
            WHEN doc_id % 11 = 3 THEN NULL ELSE text END AS text,
       lang, n_chars
FROM documents
"""


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the ``reviews`` and ``metadata`` CTEs.

    A query that has CTEs of its own starts with ``WITH``; they are appended
    after the two views.
    """
    head = (
        f"WITH reviews AS ({REVIEWS_SQL}), metadata AS ({METADATA_SQL}), "
        f"review_texts AS ({REVIEW_TEXTS_SQL})"
    )
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"

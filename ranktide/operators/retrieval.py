"""Retrieval side: catalogue upsert, exact vector search, context blocks and
prompt rows (O1-O6, F7). Embeddings are an input column; no model inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.models.topk import blocked_topk
from ranktide.session import cut_lineage

# Fixed values that must equal the reference's behaviour.
CONTEXT_SEPARATOR = "\n\n--- PRODUCT ---\n"
REQUEST_WITH_CONTEXT = "User Request: %s\n\nAvailable Products Context:\n%s"
REQUEST_NOT_FOUND = "User Request: %s\n\n(No specific products found in the catalog matching this request.)"
HISTORY_TURNS = 4
# Our own placeholder; the serving prompt policy text is not part of this library.
DEFAULT_SYSTEM_PROMPT = "You are a product recommendation assistant. Answer only from the provided context."


def upsert_latest(current: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """O2: last write wins per id. Rows carry a ``version``; the newest per id is
    kept with a ``max(struct(version, ...))`` aggregate (map-side combine)."""
    both = current.unionByName(updates)
    payload = [c for c in both.columns if c not in (id_col, "version")]
    best = both.groupBy(id_col).agg(F.max(F.struct("version", *payload)).alias("_b"))
    return best.select(id_col, "_b.version", *[F.col(f"_b.{c}").alias(c) for c in payload])


def upsert_buckets(root: str, updates: DataFrame, id_col: str = "id", buckets: int = 64) -> list[int]:
    """O2 on a stored catalogue: last write wins per id, only buckets that get updates are rewritten.

    The catalogue under ``root`` is Parquet by hash bucket of the id; ``buckets`` must stay what it was when the
    catalogue began (about its bytes over 128 MB). Returns the buckets touched, at most ``buckets`` numbers. The merged
    rows are a table of their own before anything is replaced, so a lost executor costs no rows; a bucket's files are
    replaced when the job commits, and an upsert that failed then is repeated with the same result."""
    if "bucket" in updates.columns:
        raise ValueError("the column name bucket is taken")
    spark = updates.sparkSession
    dealt = updates.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
    touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())
    if not touched:
        return touched
    try:
        current = spark.read.schema(dealt.schema).parquet(root).where(F.col("bucket").isin(touched))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        current = dealt.limit(0)
    merged = cut_lineage(upsert_latest(current.drop("bucket"), dealt.drop("bucket"), id_col).withColumn(
        "bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(root)
    return touched


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue that :func:`upsert_buckets` keeps."""
    return spark.read.parquet(root).drop("bucket")


def vector_search(queries: DataFrame, catalog: DataFrame, k: int = 5, qid: str = "qid", cid: str = "id",
                  vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """O4 exact: k nearest catalogue vectors by squared L2 distance (ties by id)."""
    out = blocked_topk(queries, catalog, k, qid=qid, cid=cid, vec=vec, metric="l2", exclude_self=exclude_self)
    return out.withColumnRenamed("score", "distance")


def context_blocks(hits: DataFrame, docs: DataFrame, qid: str = "qid", cid: str = "id",
                   doc_col: str = "document") -> DataFrame:
    """The hits' documents in rank order joined by the product separator
    (at most k per query, so collecting them per query is bounded)."""
    j = hits.join(docs.select(cid, doc_col), cid)
    agg = j.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", doc_col))).alias("_d"))
    return agg.select(qid, F.array_join(F.transform("_d", lambda x: x[doc_col]), CONTEXT_SEPARATOR).alias("context"))


def last_turns(history: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", n: int = HISTORY_TURNS) -> DataFrame:
    """the last ``n`` turns of each conversation (a conversation is small)."""
    w = Window.partitionBy(conv_col).orderBy(F.desc(turn_col))
    return history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def prompt_rows(conversations: DataFrame, contexts: DataFrame, conv_col: str = "conv_id",
                system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """(conv_id, position, role, content): system message, the last four
    turns before the final user turn, then the final user message augmented
    with its context block or the not-found note."""
    last_user = conversations.where(F.col("role") == "user").groupBy(conv_col).agg(
        F.max_by(F.struct("turn", "text"), F.col("turn")).alias("_q")
    ).select(conv_col, F.col("_q.turn").alias("_qt"), F.col("_q.text").alias("_qtext"))
    before = conversations.join(last_user, conv_col).where(F.col("turn") < F.col("_qt"))
    hist = last_turns(before.select(conv_col, "turn", "role", "text"), conv_col)
    hist_rows = hist.select(conv_col, (F.col("turn") + 1).alias("_ord"), "role", F.col("text").alias("content"))
    q = last_user.join(contexts, conv_col, "left")
    content = F.when(
        F.col("context").isNotNull() & (F.col("context") != ""),
        F.format_string(REQUEST_WITH_CONTEXT, F.col("_qtext"), F.col("context")),
    ).otherwise(F.format_string(REQUEST_NOT_FOUND, F.col("_qtext")))
    user_row = q.select(conv_col, (F.col("_qt") + 1000).alias("_ord"), F.lit("user").alias("role"), content.alias("content"))
    sys_row = last_user.select(conv_col, F.lit(0).cast("bigint").alias("_ord"), F.lit("system").alias("role"),
                               F.lit(system_prompt).alias("content"))
    rows = sys_row.unionByName(hist_rows.withColumn("_ord", F.col("_ord").cast("bigint"))).unionByName(
        user_row.withColumn("_ord", F.col("_ord").cast("bigint"))
    )
    w = Window.partitionBy(conv_col).orderBy("_ord")
    return rows.withColumn("position", F.row_number().over(w) - 1).drop("_ord")

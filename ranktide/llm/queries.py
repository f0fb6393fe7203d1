"""One query per operator, over its whole table, with production parameters; SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm import align, bpe, chat, decontam, langid, lm, merkle, neardup, oracles, quality, sharding, substring, urls, warc
from ranktide.llm.common import read, shared_path

SHARDS = 40
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RULES = [urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"),
         urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/")]
EXTRA_CONVERSATION = "\\### Assistant: </turn> ok"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence verdict of every document."""
    out = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; documents labelled as good and never as toxic are the
    target."""
    target = read(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    ).where("good AND NOT coalesce(toxic, FALSE)").select("doc_id")
    out = lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page. The dictionary is of all documents; a page is labelled through the document that its
    path numbers: block if that is labelled bad or toxic."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    counts = urls.dictionary(read(spark, sf_dir, "documents").select("text"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")).where("block IS NOT NULL")
    numbered = urls.located(pages).withColumn("doc_id", F.expr("try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS long)"))
    model = urls.train(numbered.join(labels, "doc_id"), counts)
    return urls.judge(pages, RULES, counts, model).withColumn("odds", F.round("odds", 6))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back."""
    root = shared_path(spark, "warc")
    manifest = warc.write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), root, min_revisit_bytes=0)
    return warc.read(manifest, root, payload=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into 40 shards of a hash tree, and where each would be with one more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, sharding.even_tree(SHARDS), sharding.even_tree(SHARDS + 1))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, rendered and read back."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_CONVERSATION).alias("text"))
    return chat.read_back(chat.render(given.unionByName(extra)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text to ids and back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.rank_file(public_tokenizers.path(TOKENIZER)))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document of smaller id has, cut from every document."""
    out = substring.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, proofs and verification of every document."""
    return merkle.manifest(read(spark, sf_dir, "documents").select(*merkle.COLUMNS))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers in every document, aligned, with corpus-wide pair counts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, *(bpe.rank_file(public_tokenizers.path(n)) for n in (SIDE_A, SIDE_B)))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, bpe.rank_file(public_tokenizers.path(TOKENIZER)))
    return out.withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_neardup, op3_decontamination, op4_lm, op5_urls, op6_warc, op7_sharding, op8_chat, op9_bpe, op10_substring,
                              op11_merkle, op12_alignment, op13_langid)
}


def oracle_sql() -> dict[str, str]:
    """SQL for all but the URL model (op5), tokenizers (op9, op12) and the language model (op13), which have tests by
    brute force."""
    return {"op1_quality": oracles.op1(), "op2_neardup": oracles.op2(), "op3_decontamination": oracles.op3(),
            "op4_lm": oracles.op4(), "op6_warc": oracles.op6(), "op7_sharding": oracles.op7(SHARDS),
            "op8_chat": oracles.op8(EXTRA_CONVERSATION), "op10_substring": oracles.op10(), "op11_merkle": oracles.op11()}

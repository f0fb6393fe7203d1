"""Frames for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Documents from (doc_id, text) pairs, with clashing extra columns on request."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    if extra:
        for name in ("shard", "slot", "size", "row", "chunk", "start", "class_id", "h", "pos", "kind", "n_words"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}

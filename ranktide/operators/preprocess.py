"""The preprocessing job from cleaned rows to written splits, composed of the single operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.relational import first_per_key, keep_keys, reject_complex
from ranktide.operators import clean as C
from ranktide.operators import features as G
from ranktide.operators import interactions as I
from ranktide.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    none_columns: tuple[str, ...] = ("title", "text", "description", "store")
    required: tuple[str, ...] = ("user_id", "parent_asin", "rating", "timestamp")
    min_words: int = 5
    max_words: int = 250
    max_reviews_per_day: int = 5
    min_time_gap: int = 10
    k_core: dict[str, int] = field(default_factory=lambda: {"user_id": 5, "parent_asin": 5})
    k_core_passes: int = 3
    top_n: int = 10000
    val_year: int = 2021
    test_year: int = 2022
    store_tier: tuple[int, int, float] = (2, 50, 4.4)
    tiebreak: tuple[str, ...] = ()


@dataclass
class Prepared:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    metadata: DataFrame
    encoders: dict[str, DataFrame]   # column -> (value, code)


SCALED = ("helpful_vote", "confidence_weight", "final_weight")
TEXTS = ("title", "text")
TEXT_KEYS = ("user_id", "parent_asin", "timestamp")
KEY_BROADCAST = 200_000   # rows whose keys are broadcast to find their texts; more are joined by shuffle


def present_rows(reviews: DataFrame, s: Settings) -> DataFrame:
    """None-like strings as nulls, rows without a required value left out."""
    return C.remove_missing_values(C.replace_none_strings(reviews, s.none_columns), s.required)


def clean_rows(reviews: DataFrame, s: Settings) -> DataFrame:
    """Row-wise cleaning and exact de-duplication."""
    df = present_rows(reviews, s)
    df = C.remove_duplicates(df, [c for c in df.columns if c not in TEXTS], order=TEXTS)
    df = C.handle_outliers(df, ["helpful_vote"])
    return C.filter_text(df, "text", s.min_words, s.max_words)


def bind_text(df: DataFrame, texts: DataFrame, columns: Sequence[str] = ("title", "text"),
              order: Sequence[str] = (), library: DataFrame | None = None, ref: str | None = None) -> DataFrame:
    """Late text binding: the texts of (user, item, time), joined after all filters have run on narrow rows. The first
    text under ``order`` (then the columns themselves) counts; rows without one keep nulls. The filtered keys restrict
    the texts before they are reduced to one per key, so texts of dropped rows are not sorted.

    With a ``library`` (``ref``, columns) the rows of ``texts`` name their text by ``ref`` alone. The first name of each
    key under ``order`` (then the name) is found without any text, and each text of the library is moved once, not once
    for every row that names it; of several texts of one name the first by the columns counts."""
    keys = list(TEXT_KEYS)
    if library is not None:
        named = bind_text(df, texts, (ref,), order)
        first = first_per_key(library.select(ref, *columns), [ref], columns)
        return named.join(first, ref, "left").select(*df.columns, *columns)
    own = texts.select(*keys, *columns, *(c for c in order if c not in columns)).join(df.select(*keys).distinct(), keys, "left_semi")
    first = first_per_key(own, keys, list(dict.fromkeys([*order, *columns]))).select(*keys, *columns)
    return df.join(first, keys, "left")


def assert_aligned(interactions: DataFrame, meta: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """``interactions`` unchanged; the job fails when an item has no metadata row."""
    known = meta.select(item_col).distinct().withColumn("_known", F.lit(True))
    out = interactions.join(known, item_col, "left")
    seen = F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("no metadata for item "), F.col(item_col)))
    return out.where(seen.isNull()).select(*interactions.columns)


def active_metadata(meta: DataFrame, interactions: DataFrame, s: Settings, item_col: str = "parent_asin") -> DataFrame:
    """Metadata of active items: cleaned, one row per item, with the store's tier."""
    m = I.keep_active_items(meta, interactions, item_col)
    m = C.remove_missing_values(C.replace_none_strings(m, s.none_columns), [item_col, "description"])
    m = C.remove_duplicates(m, [item_col], order=[c for c in m.columns if c != item_col])
    small, large, rating = s.store_tier
    return G.add_store_tier(m, small, large, rating)


def preprocess(reviews: DataFrame, meta: DataFrame, s: Settings = Settings()) -> Prepared:
    """Clean, drop spam, de-duplicate, k-core, top-N, weigh, bind texts, encode, split by time, scale and featurise.

    ``timestamp`` and ``rating`` come typed (B8, B9 run at ingest). Everything up to the text binding carries narrow
    rows: texts are read again for the keys that the filters leave, cleaned and bound, so texts of dropped rows are
    neither shuffled nor written. The cleaned rows and the filtered rows are written once, since the spam rules, the
    k-core, the encoders and the three splits all start from them."""
    rows = present_rows(reviews, s)
    bare = rows.drop(*TEXTS)
    reject_complex(bare, bare.columns)
    narrow = cut_lineage(C.handle_outliers(C.remove_duplicates(bare), ["helpful_vote"]))
    df = I.remove_spam(narrow, max_reviews_per_day=s.max_reviews_per_day, min_time_gap=s.min_time_gap)
    df = I.dedup_user_item(df, order=["timestamp", *s.tiebreak])
    df = I.k_core(df, s.k_core, s.k_core_passes).df
    df = I.filter_top_n_items(df, top_n=s.top_n)
    df = G.add_final_weight(G.set_implicit_weight(G.apply_confidence_weight(df)))
    df = G.add_user_segment(df)
    df = cut_lineage(df)
    n = df.count()
    own = keep_keys(rows, df.select(*TEXT_KEYS).distinct(), list(TEXT_KEYS), bound=n if n <= KEY_BROADCAST else None)
    df = cut_lineage(bind_text(df, clean_rows(own, s), order=s.tiebreak))
    metadata = active_metadata(meta, df, s)
    df = df.withColumn("user_id_original", F.col("user_id")).withColumn("parent_asin_original", F.col("parent_asin"))
    df, encoders = G.encode_labels(df, ["user_id", "parent_asin"])
    df = cut_lineage(C.sanitize_numeric(df, SCALED))
    train, val, test = G.time_based_split(df, "timestamp", s.val_year, s.test_year)
    stats = G.fit_minmax(train, SCALED)
    train, val, test = (G.apply_minmax(d, stats, SCALED) for d in (train, val, test))
    return Prepared(G.add_features(train), G.apply_train_features(val, train), G.apply_train_features(test, train),
                    metadata, encoders)


# ------------------------------------------------------------------ persistence
def save_encoders(encoders: dict[str, DataFrame], path: str) -> None:
    """Each mapping as Parquet under ``path``, one folder per column."""
    for column, mapping in encoders.items():
        mapping.write.mode("overwrite").parquet(f"{path}/{column}")


def load_encoder(spark, path: str, column: str) -> DataFrame:
    return spark.read.schema("value string, code int").parquet(f"{path}/{column}")


def decode_labels(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Codes back to the original values (unknown codes: null)."""
    m = mapping.select(F.col("code").alias(column), F.col("value").alias("_value"))
    return df.join(m, column, "left").withColumn(column, F.col("_value")).select(*df.columns)

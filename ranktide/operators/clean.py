"""Cleaning, projections and predicates (B1-B25); every operator is
``f(df, ...) -> DataFrame`` and chains with ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from ranktide.functions import text as T
from ranktide.functions.relational import (
    existing_columns,
    first_per_key,
    reject_complex,
    require_columns,
)


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def replace_none_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B2: strings "None", "", "[]", "nan" -> null; empty arrays -> null (D1);
    numeric columns and absent columns are skipped."""
    types = _types(df)
    for c in existing_columns(df, columns):
        t = types[c]
        if isinstance(t, StringType):
            df = df.withColumn(c, T.none_like_to_null(c))
        elif isinstance(t, ArrayType):
            df = df.withColumn(c, F.when(F.size(c) == 0, F.lit(None)).otherwise(F.col(c)))
    return df


def remove_missing_values(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """With a subset, whitespace-only strings there become null; then rows
    with a null in the subset (all columns if none given) are dropped."""
    if subset:
        subset = existing_columns(df, subset)
        types = _types(df)
        for c in subset:
            if isinstance(types[c], StringType):
                df = df.withColumn(c, T.blank_to_null(c))
        return df.dropna(how="any", subset=list(subset))
    return df.dropna(how="any")


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                      order: Sequence[str] = ()) -> DataFrame:
    """One row per ``subset`` (all columns if none). The kept row is the
    first under ``order`` (D2: earliest timestamp, remaining columns break ties)."""
    if subset is None:
        return df.dropDuplicates()
    subset = existing_columns(df, subset)
    reject_complex(df, subset)
    if not order:
        order = [c for c in df.columns if c not in subset]
    return first_per_key(df, subset, order)


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Full-row duplicate count and percent (one aggregate over row groups)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return out.select(
        F.col("n_rows").cast("bigint").alias("n_rows"),
        (F.col("n_rows") - F.col("n_distinct")).cast("bigint").alias("n_duplicates"),
        F.round((F.col("n_rows") - F.col("n_distinct")) * 100.0 / F.col("n_rows"), 2).alias("pct_duplicates"),
    )


def drop_useless_columns(df: DataFrame, columns: Sequence[str] = ("images",)) -> DataFrame:
    """B6."""
    return df.drop(*existing_columns(df, columns))


def handle_outliers(df: DataFrame, columns: Sequence[str] = ("helpful_vote",)) -> DataFrame:
    """log1p in place."""
    for c in require_columns(df, columns):
        df = df.withColumn(c, F.log1p(F.col(c).cast("double")))
    return df


def convert_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Unix milliseconds -> timestamp, unparsable -> null."""
    require_columns(df, [column])
    return df.withColumn(column, F.timestamp_millis(F.expr(f"try_cast(`{column}` AS BIGINT)")))


def convert_to_integer(df: DataFrame, columns: Sequence[str] = ("rating",)) -> DataFrame:
    """Truncation toward zero; a null value fails the job."""
    for c in require_columns(df, columns):
        guard = F.assert_true(F.col(c).isNotNull(), F.lit(f"null in integer column {c}"))
        df = df.withColumn(c, F.when(guard.isNull(), F.col(c).cast("bigint")))
    return df


def filter_text(df: DataFrame, column: str = "text", min_words: int = 5, max_words: int = 250) -> DataFrame:
    """Fewer than ``min_words`` -> null (row kept); more than ``max_words``
    -> first ``max_words`` words joined by one space."""
    require_columns(df, [column])
    return df.withColumn(column, T.filter_text_words(column, min_words, max_words))


def filter_high_signal_ratings(df: DataFrame, min_rating: float = 4.0) -> DataFrame:
    """B11 (inclusive)."""
    require_columns(df, ["rating"])
    return df.where(F.col("rating") >= F.lit(min_rating))


def date_floor(df: DataFrame, column: str = "timestamp", floor: str = "2017-01-01") -> DataFrame:
    """``ts >= floor`` (pushed into the Parquet scan)."""
    return df.where(F.col(column) >= F.to_timestamp(F.lit(floor)))


def sanitize_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+-inf, NaN and null -> 0.0."""
    for c in existing_columns(df, columns):
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        df = df.withColumn(c, F.when(bad, F.lit(0.0)).otherwise(x))
    return df


def numpy_list_str(c) -> F.Column:
    """``str()`` of a string array as pandas reads it from Parquet (``['a' 'b']``)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " "), F.lit("]"))


def clean_metadata_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B15 applied per column; arrays are first rendered the way the reference's
    ``str()`` renders them."""
    types = _types(df)
    for c in existing_columns(df, columns):
        src = numpy_list_str(c) if isinstance(types[c], ArrayType) else F.col(c).cast("string")
        df = df.withColumn(c, T.clean_metadata_text(src))
    return df


def combined_text_content(df: DataFrame) -> DataFrame:
    """lower(title categories features description) after B15."""
    cols = ["title", "categories", "features", "description"]
    df = clean_metadata_columns(df, cols)
    return df.withColumn("combined_text", F.lower(F.concat_ws(" ", *[F.col(c) for c in cols])))


def combined_text_any(df: DataFrame) -> DataFrame:
    """Whichever of title/text/description/features/categories exist, null -> ""."""
    types = _types(df)
    parts = []
    for c in existing_columns(df, ["title", "text", "description", "features", "categories"]):
        col = numpy_list_str(c) if isinstance(types[c], ArrayType) else F.col(c).cast("string")
        parts.append(F.coalesce(col, F.lit("")))
    return df.withColumn("combined_text", F.concat_ws(" ", *parts))


def process_metadata(meta: DataFrame, active_items: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """Metadata of active items with cleaned title/brand/description/
    categories and a lower-cased ``combined_text`` (decision D8 for defaults)."""
    meta = meta.join(active_items.select(item_col).distinct(), item_col, "left_semi")
    types = _types(meta)
    title = F.coalesce(F.col("title"), F.lit(T.UNKNOWN_TITLE)) if "title" in types else F.lit(T.UNKNOWN_TITLE)
    brand = F.coalesce(F.col("brand"), F.lit(T.UNKNOWN_BRAND)) if "brand" in types else F.lit(T.UNKNOWN_BRAND)
    if "description" not in types:
        desc = F.lit("")
    elif isinstance(types["description"], ArrayType):
        desc = F.array_join(F.col("description"), " ")
    else:
        desc = F.col("description")
    if "categories" in types and isinstance(types["categories"], ArrayType):
        cats = F.col("categories")
        if isinstance(types["categories"].elementType, ArrayType):
            cats = F.array_distinct(F.flatten(cats))
        cat_text = F.when(F.size(cats) > 0, F.array_join(cats, ", "))
    else:
        cat_text = F.col("categories") if "categories" in types else F.lit(None)
    cat_text = F.when(cat_text.isNull() | (cat_text == ""), F.lit(T.UNKNOWN_CATEGORY)).otherwise(cat_text)
    out = meta.select(
        item_col,
        T.clean_text_field(title).alias("title"),
        T.clean_text_field(brand).alias("brand"),
        T.clean_text_field(cat_text).alias("categories"),
        T.clean_text_field(desc).alias("description"),
    )
    return out.withColumn(
        "combined_text",
        F.lower(F.format_string(T.METADATA_TEMPLATE, "title", "brand", "categories", "description")),
    )


def rag_chunks(meta: DataFrame, item_col: str = "parent_asin", min_desc_chars: int = 10) -> DataFrame:
    """One retrieval chunk per product with a usable title and at least
    ``min_desc_chars`` characters of description + features."""
    types = _types(meta)

    def as_text(c):
        if c not in types:
            return F.lit("")
        if isinstance(types[c], ArrayType):
            return T.list_to_text(c)
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    # tag stripping and unescaping of whole descriptions is the CPU-heavy part
    base = meta.where(F.col(item_col).isNotNull() & F.col("title").isNotNull())
    staged = base.select(
        F.col(item_col).cast("string").alias("id"),
        T.clean_retrieval_text(F.col("title")).alias("_title"),
        T.clean_retrieval_text(F.concat(as_text("description"), F.lit(" "), as_text("features"))).alias("_desc"),
        as_text("categories").alias("_cats"),
    )
    staged = staged.where(
        (F.col("_title") != "") & (F.lower("_title") != "nan") & (F.length("_desc") >= min_desc_chars)
    )
    category = F.when(F.col("_cats") != "", F.replace(F.col("_cats"), F.lit(" "), F.lit(" > "))).otherwise(
        F.lit(T.UNKNOWN_CATEGORY)
    )
    return staged.select(
        "id",
        F.format_string(T.CHUNK_TEMPLATE, F.col("id"), F.col("_title"), category, F.col("_desc")).alias("document"),
        F.substring("_title", 1, 100).alias("title"),
    )


def pick_image(df: DataFrame, images_col: str = "images") -> DataFrame:
    """First image's ``hi_res``, else its ``large``; null when neither."""
    first = F.get(F.col(images_col), 0)
    hi = first.getField("hi_res")
    lg = first.getField("large")
    url = F.when(hi.isNotNull() & (hi != ""), hi).when(lg.isNotNull() & (lg != ""), lg)
    return df.withColumn("image_url", url)


def image_map(meta: DataFrame, targets: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """B22 + A9: (item, url) for target items that have an image."""
    picked = pick_image(meta.join(targets.select(item_col).distinct(), item_col, "left_semi"))
    return picked.where(F.col("image_url").isNotNull()).select(item_col, "image_url")


def image_coverage(meta: DataFrame, targets: DataFrame, item_col: str = "parent_asin") -> DataFrame:
    """Targets, targets with an image, targets needing the fallback image."""
    t = targets.select(item_col).distinct()
    found = image_map(meta, t, item_col).select(item_col).withColumn("_f", F.lit(1))
    j = t.join(found, item_col, "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count("_f").alias("n_found"),
        (F.count(F.lit(1)) - F.count("_f")).alias("n_fallback"),
    )

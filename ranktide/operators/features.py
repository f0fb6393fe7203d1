"""Encoders, weights, features, splits and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.relational import dense_index, require_columns, with_group_stats
from ranktide.session import cut_lineage

# Fixed values that must equal the reference's behaviour.
SEGMENT_LABELS = ("Light", "Medium", "Heavy")
STORE_TIERS = ("Premium", "Trusted", "Small Seller")
TRUSTED_RATING_LITERAL = 3.6   # hard-coded second Trusted condition (D14)
VERIFIED_WEIGHT = 1.0
UNVERIFIED_WEIGHT = 0.7
DEFAULT_USER_VERIFIED_RATIO = 0.5
HASHED_FROM = 500_000   # values of a mapping; Spark chooses the join of shorter ones


# ------------------------------------------------------------------ G1
def fit_label_codes(df: DataFrame, column: str) -> DataFrame:
    """Mapping ``(value, code)``: codes 0..n-1 in sorted value order (nulls
    excluded). Built with a distributed dense index, never on the driver."""
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return _coded(values)


def _coded(values: DataFrame) -> DataFrame:
    return dense_index(values, [F.col("value").asc()], "code").select("value", F.col("code").cast("int").alias("code"))


def fit_all_label_codes(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """The mapping of each column. The values of columns of one type are gathered in one pass over ``df``."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if len(columns) < 2 or len({types[c] for c in columns}) > 1:
        return {c: fit_label_codes(df, c) for c in columns}
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).alias("value")) for n, c in enumerate(columns)])
    values = cut_lineage(df.select(F.inline(each)).where(F.col("value").isNotNull()).distinct())
    return {c: _coded(values.where(F.col("n") == n).select("value")) for n, c in enumerate(columns)}


def apply_label_codes(df: DataFrame, column: str, mapping: DataFrame,
                      handle_invalid: str = "error", keep_original: str | None = None) -> DataFrame:
    """Replace ``column`` by its code. Unseen values fail the job
    (``handle_invalid="error"``) or become null (``"keep_null"``). A mapping too long for a broadcast is held by parts in
    the tasks, so that rows need no sort (which spills) to meet their codes."""
    m = mapping.select(F.col("value").alias(column), F.col("code").alias("_code"))
    if mapping.count() > HASHED_FROM:
        m = m.hint("shuffle_hash")
    out = df.join(m, column, "left")
    code = F.col("_code")
    if handle_invalid == "error":
        code = F.when(
            F.assert_true(code.isNotNull() | F.col(column).isNull(), F.lit(f"unseen label in {column}")).isNull(),
            code,
        )
    if keep_original:
        out = out.withColumn(keep_original, F.col(column))
    return out.withColumn(column, code).drop("_code").select(
        *[c for c in df.columns], *([keep_original] if keep_original else [])
    )


def encode_labels(df: DataFrame, columns: Sequence[str], encoders: dict | None = None,
                  keep_original: dict[str, str] | None = None):
    """Fit (or reuse) mappings for ``columns`` and apply them; returns (df, encoders). ``keep_original`` names, by
    column, further columns at the end for the values that were replaced."""
    require_columns(df, columns)
    encoders, kept = dict(encoders or {}), keep_original or {}
    new = list(dict.fromkeys(c for c in columns if c not in encoders))
    encoders |= fit_all_label_codes(df, new)
    for c in columns:
        df = apply_label_codes(df, c, encoders[c], keep_original=kept.get(c))
    return df, encoders


# ------------------------------------------------------------------ G2 / G3
@dataclass
class InteractionMatrices:
    train: DataFrame       # (u, i, value): duplicate rows summed, 1.0 each
    val: DataFrame
    eval_users: DataFrame  # distinct validation users (u)
    users: DataFrame       # (user_id, u)
    items: DataFrame       # (parent_asin, i)


def prepare_interaction_matrices(train: DataFrame, val: DataFrame, user_col: str = "user_id",
                                 item_col: str = "parent_asin") -> InteractionMatrices:
    """Shared dense indexes over train and val, every row counts 1.0."""
    both = train.select(user_col, item_col).unionByName(val.select(user_col, item_col))
    users = fit_label_codes(both, user_col).select(F.col("value").alias(user_col), F.col("code").alias("u"))
    items = fit_label_codes(both, item_col).select(F.col("value").alias(item_col), F.col("code").alias("i"))

    def long(df):
        return (
            df.join(users, user_col).join(items, item_col)
            .groupBy("u", "i").agg(F.count(F.lit(1)).cast("double").alias("value"))
        )

    tr, va = long(train), long(val)
    return InteractionMatrices(tr, va, va.select("u").distinct(), users, items)


def build_user_item_matrix(df: DataFrame, user_col: str = "user_id", item_col: str = "parent_asin",
                           value_col: str = "rating") -> DataFrame:
    """(user, item, summed value) long form."""
    return df.groupBy(user_col, item_col).agg(F.sum(value_col).cast("double").alias("value"))


# ------------------------------------------------------------------ G4 / G5 / B25
def apply_confidence_weight(df: DataFrame, verified_col: str = "verified_purchase",
                            weight_col: str = "confidence_weight",
                            verified_weight: float = VERIFIED_WEIGHT,
                            unverified_weight: float = UNVERIFIED_WEIGHT) -> DataFrame:
    """1/true -> verified weight, 0/false -> unverified weight, other -> null."""
    v = F.col(verified_col).cast("int")
    return df.withColumn(
        weight_col,
        F.when(v == 1, F.lit(float(verified_weight))).when(v == 0, F.lit(float(unverified_weight))),
    )


def set_implicit_weight(df: DataFrame, weight_col: str = "implicit_weight", value: float = 1.0) -> DataFrame:
    """G5."""
    return df.withColumn(weight_col, F.lit(float(value)))


def add_final_weight(df: DataFrame) -> DataFrame:
    """final_weight = confidence x implicit."""
    return df.withColumn("final_weight", F.col("confidence_weight") * F.col("implicit_weight"))


# ------------------------------------------------------------------ G6 / G7 / G8
def add_user_segment(df: DataFrame, user_col: str = "user_id", light_max: int = 2,
                     medium_max: int = 10) -> DataFrame:
    """Non-null ratings per user binned (0,light] (light,medium] (medium,inf)."""
    out = with_group_stats(df, [user_col], [F.count("rating").alias("_act")])
    a = F.col("_act")
    seg = (
        F.when((a > 0) & (a <= light_max), F.lit(SEGMENT_LABELS[0]))
        .when((a > light_max) & (a <= medium_max), F.lit(SEGMENT_LABELS[1]))
        .when(a > medium_max, F.lit(SEGMENT_LABELS[2]))
    )
    return out.withColumn("user_segment", seg).drop("_act")


def add_features(df: DataFrame, user_col: str = "user_id", item_key: str = "parent_asin",
                 ts_col: str = "timestamp") -> DataFrame:
    """User verified ratio, item mean rating (``item_key``, D5), weekend flag."""
    out = with_group_stats(df, [user_col], [F.avg(F.col("verified_purchase").cast("double")).alias("user_verified_ratio")])
    out = with_group_stats(out, [item_key], [F.avg(F.col("rating").cast("double")).alias("item_avg_rating")])
    return out.withColumn("is_weekend", (F.weekday(ts_col) >= 5).cast("int"))


def apply_train_features(df: DataFrame, train: DataFrame, user_col: str = "user_id",
                         item_key: str = "parent_asin", ts_col: str = "timestamp") -> DataFrame:
    """Train-fitted ratios/means looked up for val/test with defaults
    (0.5 for unknown users, the train mean rating for unknown items)."""
    ur = train.groupBy(user_col).agg(F.avg(F.col("verified_purchase").cast("double")).alias("_ur"))
    im = train.groupBy(item_key).agg(F.avg(F.col("rating").cast("double")).alias("_im"))
    global_mean = train.agg(F.avg(F.col("rating").cast("double"))).scalar()
    out = df.join(ur, user_col, "left").join(im, item_key, "left")
    return (
        out.withColumn("user_verified_ratio", F.coalesce("_ur", F.lit(DEFAULT_USER_VERIFIED_RATIO)))
        .withColumn("item_avg_rating", F.coalesce(F.col("_im"), global_mean))
        .withColumn("is_weekend", (F.weekday(ts_col) >= 5).cast("int"))
        .drop("_ur", "_im")
    )


# ------------------------------------------------------------------ G9
def split_label(ts_col: str = "timestamp", val_year: int = 2021, test_year: int = 2022) -> F.Column:
    y = F.year(ts_col)
    return F.when(y < val_year, F.lit("train")).when(y < test_year, F.lit("val")).when(y >= test_year, F.lit("test"))


def time_based_split(df: DataFrame, ts_col: str = "timestamp", val_year: int = 2021, test_year: int = 2022):
    """(train, val, test); null timestamps land in none."""
    y = F.year(ts_col)
    return (
        df.where(y < val_year),
        df.where((y >= val_year) & (y < test_year)),
        df.where(y >= test_year),
    )


# ------------------------------------------------------------------ G10
def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row stats frame ``{c}_min, {c}_max`` (fit on train)."""
    aggs = []
    for c in columns:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}_min"), F.max(F.col(c).cast("double")).alias(f"{c}_max")]
    return df.agg(*aggs)


def apply_minmax(df: DataFrame, stats: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x-min)/(max-min); constant column -> 0; not clipped for val/test.

    The train statistics enter as scalar subqueries of the one-row ``stats``
    frame, so the plan stays lazy and no join is needed."""
    out = df
    for c in columns:
        lo = stats.select(f"{c}_min").scalar()
        hi = stats.select(f"{c}_max").scalar()
        out = out.withColumn(
            f"{c}{suffix}",
            F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c).cast("double") - lo) / (hi - lo)),
        )
    return out


# ------------------------------------------------------------------ G11
def store_stats(meta: DataFrame) -> DataFrame:
    """Products and mean rating per store (null stores dropped)."""
    return meta.where(F.col("store").isNotNull()).groupBy("store").agg(
        F.count("parent_asin").alias("product_count"),
        F.avg("average_rating").alias("avg_rating"),
    )


def add_store_tier(meta: DataFrame, small_max: int = 2, large_min: int = 50,
                   rating_threshold: float = 4.4, trusted_rating: float = TRUSTED_RATING_LITERAL) -> DataFrame:
    """Premium / Trusted / Small Seller per store, joined back (null store -> null)."""
    s = store_stats(meta)
    n, r = F.col("product_count"), F.col("avg_rating")
    tier = (
        F.when((n >= large_min) & F.coalesce(r >= rating_threshold, F.lit(False)), F.lit(STORE_TIERS[0]))
        .when((n > small_max) | F.coalesce(r >= trusted_rating, F.lit(False)), F.lit(STORE_TIERS[1]))
        .otherwise(F.lit(STORE_TIERS[2]))
    )
    return meta.join(s.select("store", tier.alias("store_tier")), "store", "left")


# ------------------------------------------------------------------ G12 / G13
def sample_users(df: DataFrame, n: int, user_col: str = "user_id", seed: int = 42) -> DataFrame:
    """``n`` distinct users without replacement, reproducible for any
    partitioning (hash order); all users when n <= 0. The limit is the feature."""
    users = df.select(user_col).where(F.col(user_col).isNotNull()).distinct()
    if n <= 0:
        return users
    return users.orderBy(F.md5(F.concat(F.col(user_col).cast("string"), F.lit(f"|{seed}"))), F.col(user_col)).limit(n)


def sample_user_fraction(df: DataFrame, rate: float = 0.1, user_col: str = "user_id", seed: int = 42) -> DataFrame:
    """floor(rate x users) users."""
    n = int(df.select(user_col).distinct().count() * rate)
    return sample_users(df, max(n, 0), user_col, seed) if n > 0 else df.select(user_col).limit(0)

"""Column-expression builders for text cleaning (all JVM-side except unescape)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that must equal the reference's behaviour.
NONE_LIKE_STRINGS = ["None", "", "[]", "nan"]            # replaced by null
METADATA_BLANK_STRINGS = ["[]", "None", ""]              # cleaned to ""
METADATA_STRIP_CHARS = "[]\u2714\ufe0f\u3010\u3011"  # [ ] heavy check mark, variation selector 16, 【 】 -> space
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_BRAND = "Unknown Brand"
UNKNOWN_CATEGORY = "Unknown Category"
UNKNOWN_PRODUCT = "Unknown Product \u2753"  # display fallback (ends with a red question mark)
CHUNK_TEMPLATE = "Product ID: %s\nTitle: %s\nCategory: %s\nDescription and Features: %s"
METADATA_TEMPLATE = "Product Title: %s. Brand: %s. Categories: %s. Description: %s"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def collapse_ws(c: Column | str) -> Column:
    """``" ".join(s.split())``: runs of whitespace -> one space, ends stripped."""
    return strip_ws(F.regexp_replace(_c(c), r"\s+", " "))


def words(c: Column | str) -> Column:
    """Whitespace-split words (empty array for blank text, null for null)."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def none_like_to_null(c: Column | str) -> Column:
    return F.when(_c(c).isin(*NONE_LIKE_STRINGS), F.lit(None).cast("string")).otherwise(_c(c))


def blank_to_null(c: Column | str) -> Column:
    return F.when(_c(c).rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(_c(c))


def filter_text_words(c: Column | str, min_words: int = 5, max_words: int = 250) -> Column:
    """Short texts -> null, long ones -> first ``max_words`` words joined by a space."""
    n = word_count(c)
    return (
        F.when(n < min_words, F.lit(None).cast("string"))
        .when(n > max_words, F.array_join(F.slice(words(c), 1, max_words), " "))
        .otherwise(_c(c))
    )


def clean_text_field(c: Column | str) -> Column:
    """Blank/null -> ""; ``<[^>]+>`` -> space; whitespace collapsed and stripped."""
    s = _c(c)
    cleaned = collapse_ws(F.regexp_replace(s, r"<[^>]+>", " "))
    return F.when(s.isNull() | (strip_ws(s) == ""), F.lit("")).otherwise(cleaned)


def clean_metadata_text(c: Column | str) -> Column:
    """``[]``/``None``/blank -> ""; bracket and check-mark symbols -> space; collapse."""
    s = F.coalesce(_c(c), F.lit("None"))
    stripped = strip_ws(s)
    swapped = F.translate(s, METADATA_STRIP_CHARS, " " * len(METADATA_STRIP_CHARS))
    return F.when(stripped.isin(*METADATA_BLANK_STRINGS), F.lit("")).otherwise(collapse_ws(swapped))


@F.pandas_udf(StringType())
def _html_unescape(s: pd.Series) -> pd.Series:
    """HTML character references (named and numeric) -> characters, per Arrow batch."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


# Marked non-deterministic only so the optimizer does not copy it into filters
# pushed below a projection (the Python call would then run twice per row).
html_unescape = _html_unescape.asNondeterministic()


def strip_tags_lazy(c: Column | str) -> Column:
    """``<.*?>`` (non-greedy, ``.`` stops at newlines) -> space."""
    return F.regexp_replace(_c(c), r"<[^\n]*?>", " ")


def clean_retrieval_text(c: Column | str) -> Column:
    """Null -> ""; tags -> space; HTML unescape *after* tag removal (D9); collapse."""
    s = F.coalesce(_c(c), F.lit(""))
    return collapse_ws(html_unescape(strip_tags_lazy(s)))


def list_to_text(c: Column | str) -> Column:
    """Array -> elements joined by a space, dropping null and 'nan'; null -> ""."""
    arr = F.filter(_c(c), lambda x: x.isNotNull() & (x != "nan"))
    return F.coalesce(F.array_join(arr, " "), F.lit(""))


def display_title(c: Column | str, width: int = 50, keep: int = 47) -> Column:
    s = F.coalesce(_c(c).cast("string"), F.lit(UNKNOWN_PRODUCT))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, keep), F.lit("..."))).otherwise(s)

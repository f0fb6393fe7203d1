"""DuckDB SQL fragments mirroring :mod:`ranktide.functions.text` (oracle side)."""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def words(x: str) -> str:
    s = strip(x)
    return rf"(CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array({s}, '\s+') END)"


def clean_text_field(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN '' ELSE {collapse(f'regexp_replace({x}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} END)"


def unescape(x: str) -> str:
    """Character references that occur in the fixture pages; ``&amp;`` last."""
    out = x
    for ent, ch in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"),
                    ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")]:
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


def clean_retrieval(x: str) -> str:
    tags = rf"regexp_replace(COALESCE({x}, ''), '<[^\n]*?>', ' ', 'g')"
    return collapse(unescape(tags))


def list_text(x: str) -> str:
    return f"COALESCE(array_to_string(list_filter({x}, lambda e: e IS NOT NULL AND e <> 'nan'), ' '), '')"


def numpy_str(x: str) -> str:
    return f"('[' || array_to_string(list_transform({x}, lambda e: '''' || e || ''''), ' ') || ']')"


def clean_meta(x: str) -> str:
    s = f"COALESCE({x}, 'None')"
    chars = "[]\u2714\ufe0f\u3010\u3011"
    swapped = f"translate({s}, '{chars}', '{' ' * len(chars)}')"
    return f"(CASE WHEN {strip(s)} IN ('[]', 'None', '') THEN '' ELSE {collapse(swapped)} END)"

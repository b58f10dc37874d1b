from tablelens.functions.display import (
    composite_label,
    format_stat,
    key_label,
    percent_of,
    round_stat,
    short_label,
)
from tablelens.functions.json import json_canonical, json_kind, json_normalise, json_variant, looks_like_json
from tablelens.functions.nulls import (
    EMPTY_ONLY_TOKENS,
    FOLDED_NULL_TOKENS,
    NULL_POLICIES,
    STRICT_NULL_TOKENS,
    WHITESPACE,
    col_of,
    is_null_token,
    null_if_token,
    strip_ws,
)
from tablelens.functions.numeric import NUMERIC_GUARD, nan_to_null, parses_as_number, to_double

__all__ = [
    "EMPTY_ONLY_TOKENS",
    "FOLDED_NULL_TOKENS",
    "NULL_POLICIES",
    "NUMERIC_GUARD",
    "STRICT_NULL_TOKENS",
    "WHITESPACE",
    "col_of",
    "composite_label",
    "format_stat",
    "is_null_token",
    "json_canonical",
    "json_kind",
    "json_normalise",
    "json_variant",
    "key_label",
    "looks_like_json",
    "nan_to_null",
    "null_if_token",
    "parses_as_number",
    "percent_of",
    "round_stat",
    "short_label",
    "strip_ws",
    "to_double",
]

"""JSON text handling.

The JSON column stays text so it can be grouped, counted and deduplicated;
the parsed VARIANT is an optional side column (VARIANT is not groupable).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of

# Cell texts that mean "no value" in a JSON column.
EMPTY_JSON_TEXTS = ("", "{}", "[]")


def looks_like_json(c: str | Column) -> Column:
    """True where the text holds a ``{`` or ``[``."""
    v = col_of(c)
    return v.contains("{") | v.contains("[")


def json_normalise(c: str | Column) -> Column:
    """NULL for empty / ``{}`` / ``[]`` cells, the text otherwise."""
    v = col_of(c)
    return F.when(~v.isin(*EMPTY_JSON_TEXTS), v)


def json_kind(c: str | Column) -> Column:
    """``null``, ``text`` (no bracket), ``json`` (parses) or ``invalid``."""
    v = json_normalise(c)
    return (
        F.when(v.isNull(), F.lit("null"))
        .when(~looks_like_json(v), F.lit("text"))
        .when(F.try_parse_json(v).isNotNull(), F.lit("json"))
        .otherwise(F.lit("invalid"))
    )


def json_variant(c: str | Column) -> Column:
    """Parsed VARIANT where the normalised text is valid JSON, else NULL."""
    v = json_normalise(c)
    return F.when(looks_like_json(v), F.try_parse_json(v))


def json_canonical(c: str | Column) -> Column:
    """Canonical JSON text for parseable cells, the original text otherwise."""
    v = json_normalise(c)
    return F.coalesce(F.to_json(json_variant(v)), v)

"""Display helpers as column expressions.

They run inside the plan, so formatted reports can be written out by Spark
instead of being rendered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions.nulls import col_of


def round_stat(c: str | Column, decimals: int = 2) -> Column:
    """Half-up decimal rounding of a statistic."""
    return F.round(col_of(c), decimals)


def percent_of(n: str | Column, total: str | Column, decimals: int = 1) -> Column:
    """``100 * n / total`` rounded; NULL when the total is zero."""
    return F.round(F.try_divide(F.lit(100.0) * col_of(n), col_of(total)), decimals)


def format_stat(c: str | Column, decimals: int = 2) -> Column:
    """Thousands separators; whole numbers without decimals; ``None`` for NULL."""
    v = col_of(c).cast("double")
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("None"))
        .when(v == F.floor(v), F.format_number(v, 0))
        .otherwise(F.format_number(v, decimals))
    )


def short_label(c: str | Column, width: int = 20, ellipsis: bool = True) -> Column:
    """First ``width`` characters, with ``...`` when cut and ``ellipsis``."""
    v = col_of(c).cast("string")
    cut = F.left(v, F.lit(width))
    if not ellipsis:
        return cut
    return F.when(F.length(v) > width, F.concat(cut, F.lit("..."))).otherwise(v)


def key_label(c: str | Column, null_label: str = "None") -> Column:
    """Text of a key with NULL shown as ``null_label``."""
    return F.coalesce(col_of(c).cast("string"), F.lit(null_label))


def composite_label(keys: list[str], null_label: str = "None") -> Column:
    """``k0`` for one key, ``k0+<n>more`` for a composite key."""
    first = key_label(keys[0], null_label)
    if len(keys) == 1:
        return first
    return F.concat(first, F.lit(f"+{len(keys) - 1}more"))

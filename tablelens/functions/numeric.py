"""Numeric coercion as a column expression.

ANSI mode makes a plain ``cast`` raise on bad text, and ``try_cast`` accepts
forms such as ``1d`` that no common tool reads as a number. A regular
expression guard fixes the grammar; ``try_cast`` then does the conversion and
NaN is folded to NULL so that means and maxima are not poisoned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from tablelens.functions.nulls import WHITESPACE, col_of, strip_ws

# Fixed value: accepted numeric grammar (sign, digits with optional point,
# optional exponent, or infinity), case-insensitive, after trimming.
NUMERIC_GUARD = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"
# With what a cell that matches the grammar begins, whitespace before it included.
_BEGINS = (*"+-.0123456789iI", *WHITESPACE)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def parses_as_number(c: str | Column) -> Column:
    """True where the text matches the numeric grammar (NULL stays NULL).

    Most text is told by its first character, most numbers as they stand; only
    the rest is stripped.
    """
    v, text = col_of(c), strip_ws(c)
    return F.substring(v, 1, 1).isin(*_BEGINS) & (v.rlike(NUMERIC_GUARD) | text.rlike(NUMERIC_GUARD))


def to_double(c: str | Column, source_type: DataType | None = None) -> Column:
    """Double value of a cell, NULL where it is not a number or is NaN (which the grammar of text does not have)."""
    col = col_of(c)
    if isinstance(source_type, NumericType):
        return nan_to_null(col.cast("double"))
    text = col.cast("string")
    # The cast takes no whitespace beyond ASCII.
    return F.when(parses_as_number(text), F.coalesce(text.try_cast("double"), strip_ws(text).try_cast("double")))


def sum_of(v: Column, exact_scale: int | None = None) -> Column:
    """Sum of a double column (NULL without values).

    With ``exact_scale``, values with at most that many decimals (and 18
    digits) are accumulated as ``DECIMAL(18, scale)`` and the total is returned
    as a double. A double sum depends on the order in which tasks and partial
    aggregates are merged; the decimal sum does not, so reruns and other
    engines give the same bits. Values that do not fit (more decimals, more
    digits, infinity) are neither rounded nor refused: they are added as
    doubles, as without ``exact_scale``.
    """
    if exact_scale is None:
        return F.sum(v)
    exact = v.try_cast(f"decimal(18,{exact_scale})")
    fits = F.coalesce(exact.cast("double") == v, F.lit(False))
    whole = F.sum(F.when(fits, exact)).cast("double")
    rest = F.sum(F.when(~fits, v))
    return F.coalesce(whole + rest, whole, rest)


def mean_of(v: Column, exact_scale: int | None = None) -> Column:
    """Mean of a double column; see ``sum_of`` for ``exact_scale``."""
    if exact_scale is None:
        return F.avg(v)
    return F.try_divide(sum_of(v, exact_scale), F.count(v).cast("double"))


def std_of(v: Column, ddof: int = 1, exact_scale: int | None = None) -> Column:
    """Standard deviation of a double column (NULL for no more than ``ddof`` values).

    With ``exact_scale``, whole numbers of 10^-scale units are summed with
    their squares in decimals, centred on a whole number next to the mean
    (``sum((u - q)^2) = sum(u^2) - q * (sum(u) + r)`` with ``r = sum(u) - q *
    n``, all exact), and only the last steps are in doubles. So the result has
    the same bits whatever order rows arrive in, and large values with small
    deviations lose nothing. If some value does not fit (see ``sum_of``), or a
    sum needs more than 38 digits, the result is the built-in deviation.
    """
    plain = (F.stddev_samp if ddof == 1 else F.stddev_pop)(v)
    if exact_scale is None:
        return plain
    unit, unfit = exact_units(v, exact_scale)
    n = F.count(v)
    spread = exact_spread(n, F.sum(unit).cast("decimal(38,0)"), F.try_sum(unit * unit))
    std = F.sqrt(spread / (n.cast("double") - F.lit(float(ddof)))) / F.lit(float(10**exact_scale))
    usable = (F.count_if(unfit) == 0) & spread.isNotNull() & (n > ddof)
    return F.when(usable, std).otherwise(plain)


def exact_units(v: Column, scale: int) -> tuple[Column, Column]:
    """A double as a whole number of 10^-scale units (NULL if it does not fit, see ``sum_of``), and whether it does not."""
    exact = v.try_cast(f"decimal(18,{scale})")
    fits = F.coalesce(exact.cast("double") == v, F.lit(False))
    unit = (F.when(fits, exact) * F.lit(10**scale).cast("decimal(18,0)")).try_cast("decimal(19,0)")
    return unit, ~fits & v.isNotNull()


def exact_spread(count: Column, total: Column, squares: Column) -> Column:
    """Sum of squared deviations from the mean, from a count and exact sums of whole numbers and their squares."""
    n, size = count.cast("decimal(19,0)"), F.nullif(count.cast("double"), F.lit(0.0))
    q = F.floor(total.cast("double") / size).try_cast("decimal(19,0)")
    r = F.try_subtract(total, F.try_multiply(q, n))
    centred = F.try_subtract(squares, F.try_multiply(q, F.try_add(total, r))).cast("double")
    rest = r.cast("double")
    # The centred sum is never smaller than what r takes off, but for the last rounding.
    return F.when(centred.isNotNull(), F.greatest(centred - rest * rest / size, F.lit(0.0)))


def whole_stats(c: str | Column) -> tuple[Column, Column, Column]:
    """Minimum, maximum (bigint) and sum (38 digits) of a whole-number column in its own type, without a double."""
    whole = col_of(c).cast("bigint")
    return F.min(whole), F.max(whole), F.sum(whole.cast("decimal(19,0)")).cast("decimal(38,0)")

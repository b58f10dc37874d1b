"""Null tokens and whitespace stripping as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The null-token lists of the three analyses. They decide which
# cells count as missing, so they must stay exactly as written.
# Strict policy (ads): compared case-sensitively.
STRICT_NULL_TOKENS = ("", "null", "NULL", "None", "N/A", "NA")
# Folded policy (tweets): compared after lower-casing.
FOLDED_NULL_TOKENS = ("", "na", "n/a", "none", "null", "nan", "#n/a", "#null!", "undefined")
# Empty-only policy (posts).
EMPTY_ONLY_TOKENS = ("",)

NULL_POLICIES = {
    "strict": (STRICT_NULL_TOKENS, False),
    "folded": (FOLDED_NULL_TOKENS, True),
    "empty": (EMPTY_ONLY_TOKENS, False),
}

# Python's str.strip removes every character for which str.isspace() holds,
# while Spark's trim only removes the space character. The set is derived
# from that rule (all such characters lie below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
ASCII_WHITESPACE = "".join(ch for ch in WHITESPACE if ch.isascii())


def col_of(c: str | Column) -> Column:
    """Column for a name that may hold spaces, dots or backticks (e.g. ``Page Category``)."""
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind.

    ``btrim`` with a character set is a plain scan from both ends, cheaper
    than a regular expression. It looks each character up in the set, so text
    with as many bytes as characters is looked up in the ten of one byte.
    """
    v = col_of(c)
    one_byte = F.octet_length(v) == F.char_length(v)
    return F.when(one_byte, F.btrim(v, F.lit(ASCII_WHITESPACE))).otherwise(F.btrim(v, F.lit(WHITESPACE)))


def is_null_token(
    c: str | Column,
    tokens: Iterable[str] = FOLDED_NULL_TOKENS,
    trim: bool = True,
    fold_case: bool = True,
) -> Column:
    """True where the cell is NULL or, after optional trim/lower-casing, a token."""
    v = col_of(c)
    if trim:
        v = strip_ws(v)
    if fold_case:
        v = F.lower(v)
        tokens = sorted({t.lower() for t in tokens})
    else:
        tokens = sorted(set(tokens))
    return v.isNull() | v.isin(*tokens)


def null_if_token(
    c: str | Column,
    tokens: Iterable[str] = FOLDED_NULL_TOKENS,
    trim: bool = True,
    fold_case: bool = True,
) -> Column:
    """The cell (trimmed when ``trim``) or NULL where it is a null token (S3)."""
    tokens = tuple(tokens)
    value = strip_ws(c) if trim else col_of(c)
    return F.when(~is_null_token(c, tokens, trim, fold_case), value)

"""Text -> typed coercions with "bad value becomes NULL" semantics.

All of these are built-in Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen and are evaluated where the scan happens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.util import col_of


def nan_to_null(c) -> Column:
    """NaN -> NULL, so percentiles and sorts behave like SQL, not like IEEE."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_double(c) -> Column:
    """Text or number -> DOUBLE; unparsable text, NaN and blanks -> NULL."""
    c = col_of(c)
    return nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def to_bigint_half_even(c) -> Column:
    """Number -> nullable BIGINT rounded half-to-even (pandas ``round``)."""
    d = to_double(c)
    return F.bround(d, 0).try_cast("bigint")


def to_bigint_trunc(c) -> Column:
    """Number text -> BIGINT truncated toward zero (``astype(int)`` on floats)."""
    return to_double(c).try_cast("bigint")


def to_timestamp_safe(c) -> Column:
    """ISO text -> TIMESTAMP; unparsable -> NULL."""
    c = col_of(c)
    return F.try_to_timestamp(F.trim(c.cast("string")))


def strip_thousands(c) -> Column:
    """``"1,224"`` -> 1224.0; unparsable -> NULL."""
    c = col_of(c)
    return to_double(F.regexp_replace(c.cast("string"), ",", ""))


def norm_text(c) -> Column:
    """trim + upper; the literal text ``NAN`` (a stringified missing value) -> NULL."""
    c = col_of(c)
    return F.nullif(F.upper(F.trim(c.cast("string"))), F.lit("NAN"))

"""Parcel-key (borough / block / lot) column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.coerce import to_bigint_trunc
from lotline.functions.util import col_of


def _zfill(c: Column, width: int) -> Column:
    # zero-pad like str.zfill: never truncates a longer value
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def parcel_key_text(boro, block, lot) -> Column:
    """10-char key ``B BBBBB LLLL``; unparsable parts become 0 (text-key rule)."""
    b = F.coalesce(to_bigint_trunc(col_of(boro)), F.lit(0))
    bl = F.coalesce(to_bigint_trunc(col_of(block)), F.lit(0))
    lt = F.coalesce(to_bigint_trunc(col_of(lot)), F.lit(0))
    return F.concat(_zfill(b, 1), _zfill(bl, 5), _zfill(lt, 4))


def parcel_key_int(boro, block, lot) -> Column:
    """``boro*1e9 + block*1e4 + lot`` as BIGINT; any NULL part -> NULL."""
    b = to_bigint_trunc(col_of(boro))
    bl = to_bigint_trunc(col_of(block))
    lt = to_bigint_trunc(col_of(lot))
    return b * F.lit(1_000_000_000) + bl * F.lit(10_000) + lt


def normalise_parcel_key(c) -> Column:
    """int / text / ``'123.0'`` / punctuated -> digits without leading zeros.

    A float rendering keeps its fractional digits out of the key (``.0``
    suffix dropped first); a value without any digit becomes NULL.
    """
    s = F.trim(col_of(c).cast("string"))
    s = F.regexp_replace(s, r"\.0+$", "")
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return F.nullif(digits, F.lit("")).try_cast("decimal(38,0)").cast("string")


def parent_lot(lot) -> Column:
    """Condominium unit lots (>= 1000) belong to the building parcel, lot 1."""
    lt = col_of(lot)
    return F.when(lt >= 1000, F.lit(1).cast("bigint")).otherwise(lt.cast("bigint"))

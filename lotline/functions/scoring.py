"""Valuation scoring formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotline.functions.util import col_of

# Fixed values of the scoring rules.
BUY_AT = 70
HOLD_AT = 40
INTERVAL_MAE_MULTIPLIER = 1.0


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))


def roi_pct(predicted, market) -> Column:
    p, m = col_of(predicted).cast("double"), col_of(market).cast("double")
    return F.when(m > 0, (p - m) / m * 100.0).otherwise(F.lit(0.0))


def investment_score(predicted, market) -> Column:
    """0..100 integer score from ROI, valuation gap and a gap-size penalty."""
    p, m = col_of(predicted).cast("double"), col_of(market).cast("double")
    roi = roi_pct(p, m)
    gap = F.when(m > 0, (p - m) / m).otherwise(F.lit(0.0))
    roi_score = (_clamp(roi, -20.0, 20.0) + 20.0) / 40.0 * 100.0
    val_score = (_clamp(gap, -0.30, 0.30) + 0.30) / 0.60 * 100.0
    penalty = F.least(F.abs(gap) * 100.0, F.lit(30.0))
    raw = roi_score * 0.60 + val_score * 0.30 - penalty * 0.10
    return _clamp(F.bround(raw, 0), 0.0, 100.0).cast("int")


def deal_label(score) -> Column:
    s = col_of(score)
    return F.when(s >= BUY_AT, "Buy").when(s >= HOLD_AT, "Hold").otherwise("Avoid")


def legacy_investment_score(predicted, market) -> Column:
    """clip(50 + 2.5 * ROI, 0, 100) as a double."""
    p, m = col_of(predicted).cast("double"), col_of(market).cast("double")
    roi = F.try_divide(p - m, m) * 100.0  # market <= 0 is invalid input -> NULL, not an error
    return _clamp(50.0 + roi * 2.5, 0.0, 100.0)


def valuation_interval(predicted, mae, units=None, per_unit_target=None) -> tuple[Column, Column]:
    """(low, high) = predicted -/+ MAE (x max(units,1) for per-unit models), low >= 0.

    NULL when the MAE is missing/non-positive or the prediction is negative.
    """
    p, e = col_of(predicted).cast("double"), col_of(mae).cast("double")
    half = e * INTERVAL_MAE_MULTIPLIER
    if units is not None and per_unit_target is not None:
        u = F.greatest(F.coalesce(col_of(units).cast("double"), F.lit(0.0)), F.lit(1.0))
        half = F.when(col_of(per_unit_target), e * u * INTERVAL_MAE_MULTIPLIER).otherwise(half)
    ok = e.isNotNull() & (e > 0) & (p >= 0)
    return (
        F.when(ok, F.greatest(F.lit(0.0), p - half)),
        F.when(ok, p + half),
    )

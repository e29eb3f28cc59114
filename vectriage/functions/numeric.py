"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, digits: int = 2) -> Column:
    """ROUND(x, digits) with halves rounded away from zero, on doubles.

    Spark's ``round`` goes through BigDecimal and disagrees with other
    engines on values such as 1.005; this form is plain double arithmetic
    (``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``) and is repeatable in
    any SQL engine.  Null stays null.
    """
    x = _col(c).cast("double")
    scale = float(10 ** digits)
    return F.signum(x) * (F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def safe_ratio(num, den) -> Column:
    """num / den when den > 0, else 0.0 (may exceed 1)."""
    n, d = _col(num), _col(den)
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def pct(part, whole, digits: int = 2) -> Column:
    """part * 100 / whole rounded half away from zero; null when whole is 0."""
    p, w = _col(part), _col(whole)
    return F.when(w != 0, round_half_away(p.cast("double") * F.lit(100.0) / w.cast("double"), digits))

"""Banding rules turned into CASE expressions.

The thresholds are fixed values of the triage rules; they are arguments
so callers can move them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Duplicate assessment by cosine distance (strictly below).
DUPLICATE_BANDS = ((0.05, "Very Likely Duplicate"), (0.10, "Likely Duplicate"), (0.20, "Possibly Related"))
DUPLICATE_ELSE = "Different Issue"

# Similarity percent bands (at or above), five-band form.
SIMILARITY_BANDS_5 = ((90.0, "Nearly identical"), (80.0, "Very similar"), (70.0, "Similar"), (60.0, "Somewhat related"))
SIMILARITY_ELSE_5 = "Different"
# Three-band form.
SIMILARITY_BANDS_3 = ((80.0, "high"), (60.0, "medium"))
SIMILARITY_ELSE_3 = "low"

# Recommendation confidence bands (at or above).
CONFIDENCE_BANDS = ((80.0, "HIGH"), (60.0, "MEDIUM"), (40.0, "LOW"))
CONFIDENCE_ELSE = "VERY LOW"

# Review sentiment by score.
SENTIMENT_BY_SCORE = ((1, "Very Negative"), (2, "Negative"), (3, "Neutral"), (4, "Positive"), (5, "Very Positive"))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def below_bands(c, bands, otherwise) -> Column:
    """First band whose threshold is strictly above the value."""
    x = _col(c)
    expr = None
    for limit, label in bands:
        expr = F.when(x < limit, label) if expr is None else expr.when(x < limit, label)
    return expr.otherwise(otherwise)


def at_least_bands(c, bands, otherwise) -> Column:
    """First band whose threshold the value reaches; null input -> otherwise."""
    x = _col(c)
    expr = None
    for limit, label in bands:
        expr = F.when(x >= limit, label) if expr is None else expr.when(x >= limit, label)
    return expr.otherwise(otherwise)


def duplicate_assessment(distance, bands=DUPLICATE_BANDS, otherwise=DUPLICATE_ELSE) -> Column:
    return below_bands(distance, bands, otherwise)


def similarity_band(similarity_pct, five: bool = True) -> Column:
    if five:
        return at_least_bands(similarity_pct, SIMILARITY_BANDS_5, SIMILARITY_ELSE_5)
    return at_least_bands(similarity_pct, SIMILARITY_BANDS_3, SIMILARITY_ELSE_3)


def confidence_band(confidence, bands=CONFIDENCE_BANDS, otherwise=CONFIDENCE_ELSE) -> Column:
    return at_least_bands(confidence, bands, otherwise)


def sentiment_from_score(score) -> Column:
    x = _col(score)
    expr = None
    for value, label in SENTIMENT_BY_SCORE:
        expr = F.when(x == value, label) if expr is None else expr.when(x == value, label)
    return expr

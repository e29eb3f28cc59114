"""String column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading/trailing white space in the Unicode sense (Python's str.strip),
# not only the ASCII space that Spark's trim removes.
_STRIP_RE = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading and trailing white space (tabs, newlines included)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def preview(c, width: int = 200) -> Column:
    """First ``width`` characters plus '...' when the text is longer."""
    x = _col(c)
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))).otherwise(x)


def stars(score) -> Column:
    """One star character per score point."""
    return F.repeat(F.lit("⭐"), _col(score).cast("int"))

"""Column-expression helpers (JVM-side, inside whole-stage codegen)."""

from vectriage.functions.numeric import round_half_away, safe_ratio, pct
from vectriage.functions.text import strip_ws, preview, stars

__all__ = ["round_half_away", "safe_ratio", "pct", "strip_ws", "preview", "stars"]

"""Operators: each takes and returns Spark DataFrames.

Import from the modules (``vectriage.operators.knn``, ``.search``,
``.triage``, ``.trends``, ``.ivf``, ...); the names below are re-exported
for convenience where they do not shadow a module name.
"""

from vectriage.operators.ivf import build_ivf, ivf_search, load_ivf, save_ivf
from vectriage.operators.search import (batch_search, duplicate_detection, filtered_search_resolved, find_similar,
                                        keyword_search, multi_factor_search, multi_field_search,
                                        time_weighted_search)
from vectriage.operators.triage import categorize, category_votes, recommend, triage_one_pass, triage_summary
from vectriage.operators.trends import semantic_clusters, trend_detection, trending

__all__ = ["build_ivf", "ivf_search", "save_ivf", "load_ivf", "find_similar", "batch_search",
           "filtered_search_resolved", "duplicate_detection", "keyword_search", "multi_field_search",
           "time_weighted_search", "multi_factor_search", "recommend", "categorize", "category_votes",
           "triage_one_pass", "triage_summary", "trending", "semantic_clusters", "trend_detection"]

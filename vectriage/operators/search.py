"""Similarity search built on ``knn``: filters, payload, scores.

All functions take a base DataFrame with an id and a vector column and a
DataFrame of queries ``(query_id, embedding)``; one query is one row, so a
batch of queries is the same call as a single one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectriage.functions.bands import duplicate_assessment, similarity_band
from vectriage.functions.numeric import round_half_away
from vectriage.functions.timefn import ts_ntz
from vectriage.operators.knn import join_payload, knn_bounded


def similarity_pct(distance: Column, metric: str = "cosine", digits: int | None = 2) -> Column:
    """(1 - distance) * 100, rounded; only meaningful for cosine, else null."""
    if metric.lower() != "cosine":
        return F.lit(None).cast("double")
    raw = (F.lit(1.0) - distance) * F.lit(100.0)
    return raw if digits is None else round_half_away(raw, digits)


def filter_condition(df: DataFrame, filters: dict | None) -> Column | None:
    """AND of ``col == value`` (scalars) and ``col IN (...)`` (lists).

    Values are bound as literals, never pasted into SQL text.  A key that
    is not a column of ``df`` is an error.
    """
    if not filters:
        return None
    conds = []
    for key, value in filters.items():
        if key not in df.columns:
            raise ValueError(f"filter column {key!r} not in {df.columns}")
        if isinstance(value, (list, tuple, set)):
            conds.append(F.col(key).isin(list(value)))
        else:
            conds.append(F.col(key) == F.lit(value))
    return reduce(lambda a, b: a & b, conds)


def neighbors(base: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *,
              id_col: str = "ticket_id", vec_col: str = "embedding",
              query_id: str = "query_id", query_vec: str = "embedding",
              index=None, fraction: float = 0.1, **knn_opts) -> DataFrame:
    """Exact knn, or the IVF search when an index of ``base`` is given.

    Exact search over all pairs grows as queries x base; for large query
    sets (per-row searches such as trending over a big table) pass an
    ``IVFIndex`` so each query reads only ``fraction`` of the lists.
    """
    return neighbors_bounded(base, queries, k, metric, id_col=id_col, vec_col=vec_col, query_id=query_id,
                             query_vec=query_vec, index=index, fraction=fraction, **knn_opts)[0]


def neighbors_bounded(base, queries, k, metric="cosine", *, id_col="ticket_id", vec_col="embedding",
                      query_id="query_id", query_vec="embedding", index=None, fraction=0.1, **knn_opts):
    """``neighbors`` plus the proven row bound of the result (or None)."""
    if index is not None:
        from vectriage.operators.ivf import ivf_search
        within = knn_opts.pop("within", None)
        if knn_opts:
            raise ValueError(f"options of the exact search beside an index: {sorted(knn_opts)}")
        res = ivf_search(index, queries, k, fraction, query_id=query_id, query_vec=query_vec, metric=metric)
        return (res if within is None else res.where(F.col("distance") < within)), None
    return knn_bounded(base, queries, k, metric, base_id=id_col, base_vec=vec_col,
                       query_id=query_id, query_vec=query_vec, **knn_opts)


def search(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", *,
           id_col: str = "ticket_id", vec_col: str = "embedding",
           query_id: str = "query_id", query_vec: str = "embedding",
           payload: list[str] | None = None, **knn_opts) -> DataFrame:
    """knn plus the base row's payload columns joined back after top-k.

    Output: ``query_id, rank, <id_col>, <payload...>, distance``.
    """
    res, bound = neighbors_bounded(base, queries, k, metric, id_col=id_col, vec_col=vec_col,
                                   query_id=query_id, query_vec=query_vec, **knn_opts)
    res = res.withColumnRenamed("neighbor_id", id_col)
    if query_id != "query_id":
        res = res.withColumnRenamed("query_id", query_id)
    cols = [c for c in (payload or []) if c != id_col]
    if cols:
        # payload rows join back many-to-one on the unique id; a bounded
        # result is broadcast so the base is streamed, not shuffled
        res = join_payload(res, bound, base.select(id_col, *cols), id_col)
    return res.select(query_id, "rank", id_col, *cols, "distance")


def find_similar(base: DataFrame, queries: DataFrame, k: int = 10, *,
                 filters: dict | None = None, metric: str = "cosine",
                 filter_mode: str = "pre", overfetch: int = 2,
                 id_col: str = "ticket_id", vec_col: str = "embedding",
                 payload: list[str] | None = None, similarity_digits: int = 2,
                 **knn_opts) -> DataFrame:
    """Find similar rows for every query.

    ``filter_mode='pre'`` filters the base first, so every query gets k
    rows whenever k rows pass the filter.  ``'post'`` searches
    ``k * overfetch`` neighbours, filters them, and keeps the first k,
    so a selective filter can return fewer than k.
    Output adds ``similarity_score`` (cosine only, null otherwise) and
    ranks 1..n after filtering.
    """
    cond = filter_condition(base, filters)
    payload = list(payload or [])
    need = payload + [c for c in (filters or {}) if c not in payload]
    if filter_mode == "pre":
        b = base.where(cond) if cond is not None else base
        if cond is not None and knn_opts.get("index") is not None:
            from vectriage.operators.ivf import restrict
            knn_opts = dict(knn_opts, index=restrict(knn_opts["index"], b))
        res = search(b, queries, k, metric, id_col=id_col, vec_col=vec_col, payload=payload, **knn_opts)
    elif filter_mode == "post":
        res = search(base, queries, k * overfetch, metric, id_col=id_col, vec_col=vec_col,
                     payload=need, **knn_opts)
        if cond is not None:
            res = res.where(cond)
        w = Window.partitionBy("query_id").orderBy("rank")
        res = (res.withColumn("rank", F.row_number().over(w).cast("long"))
                  .where(F.col("rank") <= k)
                  .select("query_id", "rank", id_col, *payload, "distance"))
    else:
        raise ValueError("filter_mode must be 'pre' or 'post'")
    return res.withColumn("similarity_score", similarity_pct(F.col("distance"), metric, similarity_digits))


def filtered_search_resolved(base: DataFrame, queries: DataFrame, k: int = 10, limit: int = 5,
                             min_satisfaction: int = 4, **opts) -> DataFrame:
    """Top-k, then keep resolved tickets with a resolution and a good rating,
    then the first ``limit`` per query (the search-inside-filter form)."""
    res = search(base, queries, k, payload=["title", "category", "status", "resolution",
                                            "satisfaction_score"], **opts)
    res = res.where((F.col("status") == "resolved") & F.col("resolution").isNotNull()
                    & (F.col("satisfaction_score") >= min_satisfaction))
    w = Window.partitionBy("query_id").orderBy("rank")
    return (res.withColumn("rank", F.row_number().over(w).cast("long"))
               .where(F.col("rank") <= limit)
               .withColumn("similarity_score_pct", similarity_pct(F.col("distance")))
               .drop("status"))


def batch_search(base: DataFrame, queries: DataFrame, k: int = 10, **opts) -> DataFrame:
    """Many queries in one search; each query keeps its id and text."""
    res = search(base, queries.select("query_id", "embedding"), k, payload=["title", "category"], **opts)
    texts = queries.select("query_id", "query_text")
    return (res.join(texts, "query_id")
               .withColumn("similarity_pct", similarity_pct(F.col("distance"))))


def duplicate_detection(base: DataFrame, queries: DataFrame, k: int = 10, max_distance: float = 0.20,
                        payload=("title", "status", "created_at"), exclude_self: bool = False,
                        **opts) -> DataFrame:
    """Neighbours below ``max_distance`` with a duplicate assessment.

    ``exclude_self`` drops the query's own row after top-k (when the
    queries are rows of the base)."""
    id_col = opts.get("id_col", "ticket_id")
    res = search(base, queries, k, payload=list(payload), within=max_distance, **opts)
    if exclude_self:
        res = res.where(F.col(id_col) != F.col("query_id"))
    return (res.where(F.col("distance") < max_distance)
               .withColumn("similarity_pct", similarity_pct(F.col("distance"), digits=1))
               .withColumn("duplicate_assessment", duplicate_assessment(F.col("distance"))))


def with_similarity_bands(res: DataFrame, col: str = "similarity_score") -> DataFrame:
    """Add the five-band and three-band similarity labels."""
    return (res.withColumn("similarity_band", similarity_band(F.col(col), five=True))
               .withColumn("similarity_marker", similarity_band(F.col(col), five=False)))


def multi_field_search(base: DataFrame, queries: DataFrame, k: int = 20, limit: int = 10,
                       boost_categories=("Billing", "Payment"), boost_tag: str = "refund",
                       **opts) -> DataFrame:
    """Semantic distance plus metadata boosts; best ``limit`` by final score.

    ``category_boost`` takes the first matching branch while
    ``final_score`` adds both boosts, as the rule is written.
    """
    res = search(base, queries, k, payload=["title", "category", "tags"], **opts)
    in_cat = F.col("category").isin(list(boost_categories))
    has_tag = F.coalesce(F.array_contains("tags", boost_tag), F.lit(False))
    res = (res.withColumnRenamed("distance", "semantic_distance")
              .withColumn("category_boost", F.when(in_cat, 0.1).when(has_tag, 0.15).otherwise(0.0))
              .withColumn("final_score", round_half_away(
                  (F.lit(1.0) - F.col("semantic_distance")) * 100.0
                  + F.when(in_cat, 10.0).otherwise(0.0) + F.when(has_tag, 15.0).otherwise(0.0), 2)))
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")
    return (res.withColumn("score_rank", F.row_number().over(w).cast("long"))
               .where(F.col("score_rank") <= limit))


def time_weighted_search(base: DataFrame, queries: DataFrame, as_of, k: int = 20, limit: int = 10,
                         half_days: float = 30.0, **opts) -> DataFrame:
    """similarity * exp(-age_days / 30); age in whole 24-hour days."""
    res = search(base, queries, k, payload=["title", "created_at"], **opts)
    as_of_ts = ts_ntz(as_of)
    # whole 24-hour days, not calendar-date differences
    age = F.expr("timestampdiff(DAY, created_at, _as_of)")
    res = res.withColumn("_as_of", as_of_ts)
    res = (res.withColumn("similarity_pct", similarity_pct(F.col("distance")))
              .withColumn("age_days", age.cast("long"))
              .withColumn("time_weighted_score", round_half_away(
                  (F.lit(1.0) - F.col("distance")) * 100.0
                  * F.exp(-F.col("age_days").cast("double") / F.lit(half_days)), 2))
              .drop("_as_of"))
    w = Window.partitionBy("query_id").orderBy(F.desc("time_weighted_score"), "rank")
    return (res.withColumn("score_rank", F.row_number().over(w).cast("long"))
               .where(F.col("score_rank") <= limit))


def multi_factor_search(base: DataFrame, queries: DataFrame, as_of, category: str, days: int = 30,
                        k: int = 20, limit: int = 10, **opts) -> DataFrame:
    """Top-k, then category and recency filters, then a composite score."""
    res = search(base, queries, k, payload=["title", "category", "priority", "created_at",
                                            "satisfaction_score"], **opts)
    since = ts_ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    prio = (F.when(F.col("priority") == "high", 15.0)
             .when(F.col("priority") == "medium", 10.0).otherwise(5.0))
    res = (res.where((F.col("category") == category) & (F.col("created_at") >= since))
              .withColumn("semantic_similarity", similarity_pct(F.col("distance"), digits=1))
              .withColumn("composite_score", round_half_away(
                  (F.lit(1.0) - F.col("distance")) * 80.0 + prio
                  + F.coalesce(F.col("satisfaction_score").cast("double"), F.lit(0.0)), 1)))
    w = Window.partitionBy("query_id").orderBy(F.desc("composite_score"), "rank")
    return (res.withColumn("score_rank", F.row_number().over(w).cast("long"))
               .where(F.col("score_rank") <= limit))


def keyword_search(base: DataFrame, text_col: str, keyword: str, id_col: str) -> DataFrame:
    """Rows whose text contains the keyword (case-sensitive LIKE '%kw%')."""
    return base.where(F.col(text_col).contains(keyword)).select(id_col)


def keyword_vs_semantic(base: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = 10,
                        min_keyword_len: int = 1, **opts) -> DataFrame:
    """Per query and word of it (of at least ``min_keyword_len`` letters, each
    once, ``position`` from 1): how many rows contain that word, how many the
    semantic search returns, and how many are in both.  A query without words
    has one row with a null keyword.

    Rows are counted per word, partial in each task, and the counts joined to
    the words of the queries; only the words of the k semantic hits are
    compared with the query's, so no pairs of queries and rows are made.
    """
    split = r"[^\p{L}\p{N}]+"
    tokens = lambda c: F.array_distinct(F.split(F.lower(c), split))
    kw = queries.select("query_id", F.posexplode_outer(F.filter(tokens("query_text"), lambda t: F.length(t) >= min_keyword_len))
                        .alias("_at", "keyword"))
    kw = kw.select("query_id", (F.coalesce("_at", F.lit(0)) + 1).cast("long").alias("position"), "keyword")
    kh = (base.select(F.explode(tokens(text_col)).alias("keyword")).groupBy("keyword")
              .agg(F.count(F.lit(1)).alias("keyword_hits")))
    nn, bound = neighbors_bounded(base, queries.select("query_id", "embedding"), k, id_col=id_col, **opts)
    sh = nn.select("query_id", F.col("neighbor_id").alias(id_col))
    hits = F.broadcast(sh) if bound is not None and bound * 64 <= (256 << 20) else sh
    both = (base.select(id_col, text_col).join(hits, id_col)
                .select("query_id", F.explode(tokens(text_col)).alias("keyword"))
                .join(kw.select("query_id", "keyword"), ["query_id", "keyword"])
                .groupBy("query_id", "keyword").agg(F.count(F.lit(1)).alias("overlap")))
    semantic = sh.groupBy("query_id").agg(F.count(F.lit(1)).alias("semantic_hits"))
    return (kw.join(kh, "keyword", "left")
              .join(semantic, "query_id", "left")
              .join(both, ["query_id", "keyword"], "left")
              .select("query_id", "position", "keyword",
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                        for c in ("keyword_hits", "semantic_hits", "overlap")]))

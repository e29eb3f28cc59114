"""Trending issues: recent tickets whose neighbours cluster by title.

Anchors are the tickets created in the window ``[as_of - days, ...)``;
each anchor searches the whole base (the per-row lateral search), the
anchor itself is dropped after top-k (it uses one of the k places), pairs
above the distance threshold are dropped, and pairs are grouped by the
anchor's title.  Aggregates are partial per task; the list of similar
titles is bounded to five per group by a window before it is collected.

With more anchors than fit a broadcast, the exact search compares an anchor
only with the rows that can lie under the distance threshold
(``operators/ring.py``); ``index=`` (an ``IVFIndex``) and ``fraction=`` through
``**opts`` search an index instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectriage.functions.timefn import ts_ntz
from vectriage.operators.knn import join_payload
from vectriage.operators.search import neighbors_bounded


def recent(base: DataFrame, as_of, days: int, ts_col: str = "created_at") -> DataFrame:
    """Rows created at or after ``as_of - days``.  On a table written by
    ``write_partitioned_tickets`` the same bound is also put on the
    ``created_date`` partition column, so whole date folders are pruned."""
    since = ts_ntz(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    out = base.where(F.col(ts_col) >= since)
    if "created_date" in base.columns:
        out = out.where(F.col("created_date") >= F.to_date(since))
    return out


def similar_pairs(base: DataFrame, as_of, days: int = 7, k: int = 10, max_distance: float = 0.2,
                  **opts) -> DataFrame:
    """(anchor, neighbour) pairs: anchor_id, anchor_title, anchor_date,
    neighbor_id, neighbor_title, neighbor_date, distance."""
    anchors = recent(base, as_of, days)
    nn, bound = neighbors_bounded(base.select("ticket_id", "embedding"),
                                  anchors.select(F.col("ticket_id").alias("query_id"), "embedding"), k,
                                  id_col="ticket_id", within=max_distance, **opts)
    nn = nn.where((F.col("distance") < max_distance) & (F.col("neighbor_id") != F.col("query_id")))
    a = anchors.select(F.col("ticket_id").alias("query_id"), F.col("title").alias("anchor_title"),
                       F.col("created_at").alias("anchor_date"))
    b = base.select(F.col("ticket_id").alias("neighbor_id"), F.col("title").alias("neighbor_title"),
                    F.col("created_at").alias("neighbor_date"))
    return (join_payload(join_payload(nn, bound, a, "query_id"), bound, b, "neighbor_id")
              .select(F.col("query_id").alias("anchor_id"), "anchor_title", "anchor_date",
                      "neighbor_id", "neighbor_title", "neighbor_date", "distance"))


def _latest_titles(pairs: DataFrame, n: int, by_date: bool) -> DataFrame:
    """Up to n distinct neighbour titles per anchor title: latest first
    (by_date) or alphabetical."""
    t = pairs.groupBy("anchor_title", "neighbor_title").agg(F.max("neighbor_date").alias("_last"))
    order = [F.desc("_last"), "neighbor_title"] if by_date else ["neighbor_title"]
    w = Window.partitionBy("anchor_title").orderBy(*order)
    t = t.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n)
    return (t.groupBy("anchor_title")
             .agg(F.array_sort(F.collect_list(F.struct("_pos", "neighbor_title"))).alias("_titles"))
             .select("anchor_title", F.transform("_titles", lambda s: s["neighbor_title"]).alias("titles")))


def trending(base: DataFrame, as_of, days: int = 7, min_cluster_size: int = 3,
             max_distance: float = 0.2, k: int = 10, limit: int = 10, n_titles: int = 5,
             **opts) -> DataFrame:
    """Titles of recent tickets with at least ``min_cluster_size`` distinct
    similar tickets; the ``limit`` largest clusters, latest first.

    ``similar_issues`` holds the latest distinct neighbour titles (by
    their newest ticket, then title).
    """
    pairs = similar_pairs(base, as_of, days, k, max_distance, **opts)
    stats = (pairs.groupBy("anchor_title").agg(
        F.count_distinct("neighbor_id").alias("cluster_size"),
        F.min("anchor_date").alias("first_occurrence"),
        F.max("neighbor_date").alias("last_occurrence"))
        .where(F.col("cluster_size") >= min_cluster_size))
    out = stats.join(_latest_titles(pairs, n_titles, by_date=True), "anchor_title")
    return (out.select(F.col("anchor_title").alias("representative_issue"),
                       F.col("cluster_size").cast("long").alias("cluster_size"),
                       "first_occurrence", "last_occurrence",
                       F.col("titles").alias("similar_issues"))
               .orderBy(F.desc("cluster_size"), F.desc("last_occurrence"), "representative_issue")
               .limit(limit))


def semantic_clusters(base: DataFrame, as_of, days: int = 7, min_cluster_size: int = 3,
                      max_distance: float = 0.2, k: int = 5, limit: int = 10, **opts) -> DataFrame:
    """Clusters of recent tickets; up to five distinct neighbour titles in
    alphabetical order."""
    pairs = similar_pairs(base, as_of, days, k, max_distance, **opts)
    stats = (pairs.groupBy("anchor_title").agg(
        F.count_distinct("neighbor_id").alias("cluster_size"),
        F.min("anchor_date").alias("first_occurrence"),
        F.max("neighbor_date").alias("last_occurrence"))
        .where(F.col("cluster_size") >= min_cluster_size))
    out = stats.join(_latest_titles(pairs, 5, by_date=False), "anchor_title")
    return (out.select(F.col("anchor_title").alias("representative_issue"),
                       F.col("cluster_size").cast("long").alias("cluster_size"),
                       "first_occurrence", "last_occurrence",
                       F.col("titles").alias("similar_issues"))
               .orderBy(F.desc("cluster_size"), F.desc("last_occurrence"), "representative_issue")
               .limit(limit))


def trend_detection(base: DataFrame, as_of, days: int = 7, min_cluster_size: int = 3,
                    max_distance: float = 0.15, k: int = 5, limit: int = 10, **opts) -> DataFrame:
    """Anchor titles with many very close recent neighbours, newest first seen."""
    pairs = similar_pairs(base, as_of, days, k, max_distance, **opts)
    stats = (pairs.groupBy("anchor_title").agg(
        F.count_distinct("neighbor_id").alias("cluster_size"),
        F.min("anchor_date").alias("first_seen"))
        .where(F.col("cluster_size") >= min_cluster_size))
    out = stats.join(_latest_titles(pairs, 5, by_date=False), "anchor_title")
    return (out.select(F.col("anchor_title").alias("representative_issue"),
                       F.col("cluster_size").cast("long").alias("cluster_size"),
                       "first_seen", F.col("titles").alias("related_issues"))
               .orderBy(F.desc("cluster_size"), F.desc("first_seen"), "representative_issue")
               .limit(limit))

"""Registered queries: one Spark plan and (when SQL can say it) one DuckDB oracle per key.

Every query reads whole tables of ``sf_dir`` (or views Spark derives
from them with joins), so its work grows with the data.  Tickets search
against all tickets with every ticket as a query (the per-row lateral
search); text search embeds all of ``documents`` and uses every
``benchmark`` passage as a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectriage.functions.numeric import round_half_away
from vectriage.operators import knn as knn_mod
from vectriage.plans import oracle as O
from vectriage.sources.fixtures import raw_reviews_fx, tickets_fx, TICKETS_AS_OF

QUERIES: dict = {}
ORACLE: dict = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def ticket_queries(tickets: DataFrame) -> DataFrame:
    """Every ticket as a query: (query_id, embedding)."""
    return tickets.select(F.col("ticket_id").alias("query_id"), "embedding")


# ---------------------------------------------------------------- vectors

def _knn_key(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tickets_fx(spark, sf_dir).select("ticket_id", "embedding")
        res = knn_mod.knn(t, ticket_queries(t), 10, metric, base_id="ticket_id")
        return res.select("query_id", "neighbor_id", "rank",
                          round_half_away("distance", 6).alias("distance"))
    sql = O.with_ctes(O.TICKETS, O.topk_cte("nn", "tickets", "ticket_id", "tickets", "ticket_id", 10, metric)) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM nn"""
    return run, sql


for _m in ("cosine", "euclidean", "dot"):
    _fn, _sql = _knn_key(_m)
    register(f"knn_{_m}", _sql)(_fn)


# ---------------------------------------------------------------- reviews

def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectriage.operators.reviews import enrich_reviews
    return enrich_reviews(raw_reviews_fx(spark, sf_dir))


REVIEWS_WITH = O.with_ctes(O.RAW_REVIEWS, O.REVIEWS)


@register("reviews_enrich", REVIEWS_WITH + "SELECT * FROM reviews")
def q_reviews_enrich(spark, sf_dir):
    return reviews(spark, sf_dir)


# ---------------------------------------------------------------- search

def _tickets(spark, sf_dir):
    return tickets_fx(spark, sf_dir)


def _r6(c="distance"):
    return round_half_away(c, 6).alias("distance")


TK = O.TICKETS
SIMILAR_PAYLOAD = ["title", "description", "category", "priority", "status", "resolution",
                   "satisfaction_score", "resolution_time_hours", "created_at"]


@register("find_similar", O.with_ctes(TK, O.tickets_knn(5)) + f"""
SELECT nn.query_id, nn.rank, b.ticket_id, {', '.join('b.' + c for c in SIMILAR_PAYLOAD)},
       {O.rha('nn.distance', 6)} AS distance, {O.sim('nn.distance', 2)} AS similarity_score
FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id""")
def q_find_similar(spark, sf_dir):
    from vectriage.operators.search import find_similar
    t = _tickets(spark, sf_dir)
    res = find_similar(t, ticket_queries(t), 5, payload=SIMILAR_PAYLOAD)
    return res.select("query_id", "rank", "ticket_id", *SIMILAR_PAYLOAD, _r6(), "similarity_score")


FILTERS = {"status": "resolved", "category": ["cat1", "cat2", "cat3"]}
_FILTER_SQL = "b.status = 'resolved' AND b.category IN ('cat1', 'cat2', 'cat3')"


@register("filtered_search", O.with_ctes(TK, O.tickets_knn(5, base_where=_FILTER_SQL)) + f"""
SELECT nn.query_id, nn.rank, b.ticket_id, b.title, b.category, b.status,
       {O.rha('nn.distance', 6)} AS distance, {O.sim('nn.distance', 2)} AS similarity_score
FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id""")
def q_filtered_search(spark, sf_dir):
    from vectriage.operators.search import find_similar
    t = _tickets(spark, sf_dir)
    res = find_similar(t, ticket_queries(t), 5, filters=FILTERS, payload=["title", "category", "status"])
    return res.select("query_id", "rank", "ticket_id", "title", "category", "status", _r6(), "similarity_score")


@register("filtered_search_post", O.with_ctes(TK, O.tickets_knn(10)) + f"""
SELECT query_id, rank, ticket_id, title, category, status, {O.rha('distance', 6)} AS distance,
       {O.sim('distance', 2)} AS similarity_score
FROM (SELECT nn.query_id, CAST(row_number() OVER (PARTITION BY nn.query_id ORDER BY nn.rank) AS BIGINT) AS rank,
             b.ticket_id, b.title, b.category, b.status, nn.distance
      FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id WHERE {_FILTER_SQL})
WHERE rank <= 5""")
def q_filtered_search_post(spark, sf_dir):
    from vectriage.operators.search import find_similar
    t = _tickets(spark, sf_dir)
    res = find_similar(t, ticket_queries(t), 5, filters=FILTERS, filter_mode="post", overfetch=2,
                       payload=["title", "category", "status"])
    return res.select("query_id", "rank", "ticket_id", "title", "category", "status", _r6(), "similarity_score")


@register("filtered_search_resolved", O.with_ctes(TK, O.tickets_knn(10)) + f"""
SELECT query_id, rank, ticket_id, title, category, resolution, satisfaction_score,
       {O.rha('distance', 6)} AS distance, {O.sim('distance', 2)} AS similarity_score_pct
FROM (SELECT nn.query_id, CAST(row_number() OVER (PARTITION BY nn.query_id ORDER BY nn.rank) AS BIGINT) AS rank,
             b.ticket_id, b.title, b.category, b.resolution, b.satisfaction_score, nn.distance
      FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id
      WHERE b.status = 'resolved' AND b.resolution IS NOT NULL AND b.satisfaction_score >= 4)
WHERE rank <= 5""")
def q_filtered_search_resolved(spark, sf_dir):
    from vectriage.operators.search import filtered_search_resolved
    t = _tickets(spark, sf_dir)
    res = filtered_search_resolved(t, ticket_queries(t), 10, 5)
    return res.select("query_id", "rank", "ticket_id", "title", "category", "resolution", "satisfaction_score",
                      _r6(), "similarity_score_pct")


@register("batch_search", O.with_ctes(TK, O.tickets_knn(3)) + f"""
SELECT nn.query_id, q.title || ' ' || q.description AS query_text, nn.rank, b.ticket_id, b.title, b.category,
       {O.rha('nn.distance', 6)} AS distance, {O.sim('nn.distance', 2)} AS similarity_pct
FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id JOIN tickets q ON q.ticket_id = nn.query_id""")
def q_batch_search(spark, sf_dir):
    from vectriage.operators.search import batch_search
    t = _tickets(spark, sf_dir)
    queries = t.select(F.col("ticket_id").alias("query_id"),
                       F.concat(F.col("title"), F.lit(" "), F.col("description")).alias("query_text"),
                       "embedding")
    res = batch_search(t, queries, 3)
    return res.select("query_id", "query_text", "rank", "ticket_id", "title", "category", _r6(), "similarity_pct")


_SIM5 = " ".join(f"WHEN s >= {v} THEN '{lab}'" for v, lab in
                 ((90.0, "Nearly identical"), (80.0, "Very similar"), (70.0, "Similar"), (60.0, "Somewhat related")))


@register("similarity_bands", O.with_ctes(TK, O.tickets_knn(5)) + f"""
SELECT query_id, rank, ticket_id, s AS similarity_score,
       CASE {_SIM5} ELSE 'Different' END AS similarity_band,
       CASE WHEN s >= 80.0 THEN 'high' WHEN s >= 60.0 THEN 'medium' ELSE 'low' END AS similarity_marker
FROM (SELECT nn.query_id, nn.rank, nn.neighbor_id AS ticket_id, {O.sim('nn.distance', 2)} AS s FROM nn)""")
def q_similarity_bands(spark, sf_dir):
    from vectriage.operators.search import find_similar, with_similarity_bands
    t = _tickets(spark, sf_dir)
    res = with_similarity_bands(find_similar(t, ticket_queries(t), 5))
    return res.select("query_id", "rank", "ticket_id", "similarity_score", "similarity_band", "similarity_marker")


MF_CATS = ("cat1", "cat2")
MF_TAG = "urgent"


@register("multi_field_search", O.with_ctes(TK, O.tickets_knn(20)) + f"""
SELECT * FROM (
  SELECT nn.query_id, nn.rank, b.ticket_id, b.title, b.category, {O.rha('nn.distance', 6)} AS semantic_distance,
    CASE WHEN b.category IN ('cat1', 'cat2') THEN 0.1::DOUBLE WHEN list_contains(b.tags, 'urgent') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      AS category_boost,
    {O.rha("((1.0 - nn.distance) * 100.0 + CASE WHEN b.category IN ('cat1', 'cat2') THEN 10.0 ELSE 0.0 END + CASE WHEN list_contains(b.tags, 'urgent') THEN 15.0 ELSE 0.0 END)", 2)} AS final_score
  FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id)
QUALIFY CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS BIGINT) <= 10""")
def q_multi_field_search(spark, sf_dir):
    from vectriage.operators.search import multi_field_search
    t = _tickets(spark, sf_dir)
    res = multi_field_search(t, ticket_queries(t), 20, 10, boost_categories=MF_CATS, boost_tag=MF_TAG)
    return res.select("query_id", "rank", "ticket_id", "title", "category",
                      round_half_away("semantic_distance", 6).alias("semantic_distance"),
                      "category_boost", "final_score")


_AGE = f"CAST(date_sub('day', b.created_at, {O.AS_OF}) AS BIGINT)"


@register("time_weighted_search", O.with_ctes(TK, O.tickets_knn(20)) + f"""
SELECT * FROM (
  SELECT nn.query_id, nn.rank, b.ticket_id, b.title, b.created_at, {O.rha('nn.distance', 6)} AS distance,
         {O.sim('nn.distance', 2)} AS similarity_pct, {_AGE} AS age_days,
         {O.rha(f"((1.0 - nn.distance) * 100.0 * exp(-CAST({_AGE} AS DOUBLE) / 30.0))", 2)} AS time_weighted_score
  FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY time_weighted_score DESC, rank) <= 10""")
def q_time_weighted_search(spark, sf_dir):
    from vectriage.operators.search import time_weighted_search
    t = _tickets(spark, sf_dir)
    res = time_weighted_search(t, ticket_queries(t), TICKETS_AS_OF, 20, 10)
    return res.select("query_id", "rank", "ticket_id", "title", "created_at", _r6(), "similarity_pct",
                      "age_days", "time_weighted_score")


MFS_CATEGORY, MFS_DAYS = "cat3", 365


@register("multi_factor_search", O.with_ctes(TK, O.tickets_knn(20)) + f"""
SELECT * FROM (
  SELECT nn.query_id, nn.rank, b.ticket_id, b.title, b.category, b.priority, b.created_at, b.satisfaction_score,
         {O.rha('nn.distance', 6)} AS distance, {O.sim('nn.distance', 1)} AS semantic_similarity,
         {O.rha("((1.0 - nn.distance) * 80.0 + CASE b.priority WHEN 'high' THEN 15.0 WHEN 'medium' THEN 10.0 ELSE 5.0 END + coalesce(CAST(b.satisfaction_score AS DOUBLE), 0.0))", 1)} AS composite_score
  FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id
  WHERE b.category = '{MFS_CATEGORY}' AND b.created_at >= {O.AS_OF} - INTERVAL {MFS_DAYS} DAYS)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY composite_score DESC, rank) <= 10""")
def q_multi_factor_search(spark, sf_dir):
    from vectriage.operators.search import multi_factor_search
    t = _tickets(spark, sf_dir)
    res = multi_factor_search(t, ticket_queries(t), TICKETS_AS_OF, MFS_CATEGORY, MFS_DAYS, 20, 10)
    return res.select("query_id", "rank", "ticket_id", "title", "category", "priority", "created_at",
                      "satisfaction_score", _r6(), "semantic_similarity", "composite_score")


# ---------------------------------------------------------------- triage

REC_DISTANCE = 0.75  # the reference 0.30 only ever matches the query ticket itself here


def _examples(c="example_tickets"):
    return F.array_join(F.transform(c, lambda x: x["ticket_id"].cast("string")), ",").alias("example_ids")


def _rec_key(key, max_distance, weights, sim_digits, avg_digits, top_n):
    sql = O.with_ctes(TK, O.tickets_knn(20), O.recommend_ctes(
        "nn", 20, max_distance, weights, sim_digits, avg_digits, top_n)) + "SELECT * FROM r_out"

    @register(key, sql)
    def run(spark, sf_dir):
        from vectriage.operators.triage import recommend
        t = _tickets(spark, sf_dir)
        res = recommend(t, ticket_queries(t), 20, max_distance=max_distance, weights=weights,
                        sim_digits=sim_digits, avg_digits=avg_digits, top_n=top_n)
        return res.select("query_id", "solution_rank", "resolution", "frequency", "avg_satisfaction",
                          "avg_resolution_hours", "avg_similarity_pct", "confidence_score", _examples())
    return run


_rec_key("recommend_solution", REC_DISTANCE, (0.3, 15.0, 0.5), 2, 2, 1)
_rec_key("recommend_solution_v2", None, (0.4, 20.0, 0.4), 2, 2, 3)
_rec_key("recommend_solution_v3", REC_DISTANCE, (0.3, 15.0, 0.5), 1, 1, 1)


@register("recommend_bands", O.with_ctes(TK, O.tickets_knn(20), O.recommend_ctes("nn", 20, REC_DISTANCE)) + """
SELECT query_id, resolution, confidence_score,
       CASE WHEN confidence_score >= 80.0 THEN 'HIGH' WHEN confidence_score >= 60.0 THEN 'MEDIUM'
            WHEN confidence_score >= 40.0 THEN 'LOW' ELSE 'VERY LOW' END AS confidence_band
FROM r_out""")
def q_recommend_bands(spark, sf_dir):
    from vectriage.functions.bands import confidence_band
    from vectriage.operators.triage import recommend
    t = _tickets(spark, sf_dir)
    res = recommend(t, ticket_queries(t), 20, max_distance=REC_DISTANCE)
    return res.select("query_id", "resolution", "confidence_score",
                      confidence_band(F.col("confidence_score")).alias("confidence_band"))


@register("auto_categorize", O.with_ctes(TK, O.tickets_knn(10), O.categorize_ctes("nn", 10)) + "SELECT * FROM c_out")
def q_auto_categorize(spark, sf_dir):
    from vectriage.operators.triage import categorize
    t = _tickets(spark, sf_dir)
    return categorize(t, ticket_queries(t), 10)


@register("category_votes", O.with_ctes(TK, O.tickets_knn(10)) + f"""
SELECT query_id, category, vote_count, avg_similarity_pct,
       {O.rha("(CAST(vote_count AS DOUBLE) * 100.0 / CAST(sum(vote_count) OVER (PARTITION BY query_id) AS DOUBLE))", 2)} AS confidence_pct,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY vote_count DESC, avg_similarity_pct DESC, category) AS BIGINT) AS category_rank
FROM (SELECT nn.query_id, b.category, CAST(count(*) AS BIGINT) AS vote_count,
             {O.rha('(avg(1.0 - nn.distance) * 100.0)', 2)} AS avg_similarity_pct
      FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id GROUP BY nn.query_id, b.category)
QUALIFY category_rank <= 3""")
def q_category_votes(spark, sf_dir):
    from vectriage.operators.triage import category_votes
    t = _tickets(spark, sf_dir)
    return category_votes(t, ticket_queries(t), 10, 3).select(
        "query_id", "category", "vote_count", "avg_similarity_pct", "confidence_pct", "category_rank")


_TRIAGE_SQL = O.with_ctes(TK, O.tickets_knn(20), O.categorize_ctes("nn", 10), O.recommend_ctes("nn", 20), """
sim5 AS (SELECT query_id, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY rank) AS similar_ids
         FROM nn WHERE rank <= 5 GROUP BY query_id),
tri AS (
  SELECT q.ticket_id AS query_id, coalesce(s.similar_ids, '') AS similar_ids, c.category, c.category_confidence,
         c.priority, r.resolution AS solution, r.confidence_score AS confidence,
         r.frequency AS similar_ticket_count, CAST(NULL AS VARCHAR) AS error
  FROM tickets q LEFT JOIN sim5 s ON s.query_id = q.ticket_id JOIN c_out c ON c.query_id = q.ticket_id
       JOIN r_out r ON r.query_id = q.ticket_id)""")


def _triage(spark, sf_dir):
    from vectriage.operators.triage import triage
    t = _tickets(spark, sf_dir)
    return triage(t, ticket_queries(t))


@register("batch_triage", _TRIAGE_SQL + "SELECT * FROM tri")
def q_batch_triage(spark, sf_dir):
    res = _triage(spark, sf_dir)
    return res.select("query_id",
                      F.array_join(F.transform("similar_tickets", lambda x: x["ticket_id"].cast("string")), ",")
                       .alias("similar_ids"),
                      "category", "category_confidence", "priority", "solution", "confidence",
                      "similar_ticket_count", "error")


@register("triage_summary", _TRIAGE_SQL + """
SELECT query_id, CASE WHEN solution IS NOT NULL THEN 'auto-resolve' ELSE 'manual review' END AS action,
       category || ' team' AS route_to, priority, solution,
       CASE WHEN solution IS NOT NULL THEN confidence END AS confidence,
       CASE WHEN solution IS NOT NULL THEN
         CASE WHEN confidence >= 80.0 THEN 'HIGH' WHEN confidence >= 60.0 THEN 'MEDIUM'
              WHEN confidence >= 40.0 THEN 'LOW' ELSE 'VERY LOW' END END AS confidence_band
FROM tri""")
def q_triage_summary(spark, sf_dir):
    from vectriage.operators.triage import triage_summary
    return triage_summary(_triage(spark, sf_dir))


PT_MIN_SIMILARITY = 0.30


@register("production_triage", O.with_ctes(TK, O.tickets_knn(20), f"""
s AS (SELECT nn.query_id, b.*, {O.sim('nn.distance', 1)} AS similarity_score, {O.units('nn.distance', 1)} AS units
      FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id WHERE (1.0 - nn.distance) >= {PT_MIN_SIMILARITY}),
cv AS (SELECT query_id, category, CAST(count(*) AS BIGINT) AS votes, {O.rha(O.avg_units('units', 1), 1)} AS avg_similarity
       FROM s GROUP BY query_id, category
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, avg_similarity DESC, category) = 1),
bs AS (SELECT query_id, resolution, CAST(count(*) AS BIGINT) AS frequency,
              CAST(sum(satisfaction_score) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS sat,
              avg(resolution_time_hours) AS tm
       FROM s WHERE status = 'resolved' AND resolution IS NOT NULL AND satisfaction_score >= 4
       GROUP BY query_id, resolution
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, sat DESC, tm ASC NULLS LAST, resolution) = 1),
ex AS (SELECT query_id, string_agg(CAST(ticket_id AS VARCHAR), ',' ORDER BY pos) AS similar_ids
       FROM (SELECT query_id, ticket_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, ticket_id) AS pos FROM s)
       WHERE pos <= 5 GROUP BY query_id)""") + f"""
SELECT q.ticket_id AS query_id, cv.category AS suggested_category, cv.votes AS category_confidence_votes,
       bs.resolution AS recommended_solution, bs.frequency AS solution_frequency,
       {O.rha('bs.sat', 1)} AS solution_satisfaction, {O.rha('bs.tm', 1)} AS solution_avg_hours,
       coalesce(ex.similar_ids, '') AS similar_ids, {O.AS_OF} AS triage_timestamp
FROM tickets q LEFT JOIN cv ON cv.query_id = q.ticket_id LEFT JOIN bs ON bs.query_id = q.ticket_id
     LEFT JOIN ex ON ex.query_id = q.ticket_id""")
def q_production_triage(spark, sf_dir):
    from vectriage.operators.triage import triage_one_pass
    t = _tickets(spark, sf_dir)
    res = triage_one_pass(t, ticket_queries(t), TICKETS_AS_OF, k=20, min_similarity=PT_MIN_SIMILARITY)
    return res.select("query_id", "suggested_category", "category_confidence_votes", "recommended_solution",
                      "solution_frequency", "solution_satisfaction", "solution_avg_hours",
                      F.array_join(F.transform("similar_historical_tickets",
                                               lambda x: x["ticket_id"].cast("string")), ",").alias("similar_ids"),
                      "triage_timestamp")


# ---------------------------------------------------------------- trends

TREND_DAYS = 365


def _pairs_sql(k, max_distance, days=TREND_DAYS):
    return O.with_ctes(TK, f"""recent AS (SELECT * FROM tickets WHERE created_at >= {O.AS_OF} - INTERVAL {days} DAYS)""",
                       O.tickets_knn(k, anchors="recent"), f"""
pairs AS (SELECT a.ticket_id AS anchor_id, a.title AS anchor_title, a.created_at AS anchor_date,
                 b.ticket_id AS neighbor_id, b.title AS neighbor_title, b.created_at AS neighbor_date, nn.distance
          FROM nn JOIN recent a ON a.ticket_id = nn.query_id JOIN tickets b ON b.ticket_id = nn.neighbor_id
          WHERE nn.distance < {max_distance} AND nn.neighbor_id <> nn.query_id)""")


def _titles_sql(by_date: bool) -> str:
    order = "max(neighbor_date) DESC, neighbor_title" if by_date else "neighbor_title"
    return f"""(SELECT anchor_title, string_agg(neighbor_title, '|' ORDER BY pos) AS titles FROM (
      SELECT anchor_title, neighbor_title, row_number() OVER (PARTITION BY anchor_title ORDER BY {order}) AS pos
      FROM pairs GROUP BY anchor_title, neighbor_title) WHERE pos <= 5 GROUP BY anchor_title)"""


@register("trending_issues", _pairs_sql(10, 0.70) + f"""
SELECT s.anchor_title AS representative_issue, s.cluster_size, s.first_occurrence, s.last_occurrence,
       t.titles AS similar_issues
FROM (SELECT anchor_title, CAST(count(DISTINCT neighbor_id) AS BIGINT) AS cluster_size,
             min(anchor_date) AS first_occurrence, max(neighbor_date) AS last_occurrence
      FROM pairs GROUP BY anchor_title HAVING count(DISTINCT neighbor_id) >= 3) s
JOIN {_titles_sql(True)} t ON t.anchor_title = s.anchor_title
ORDER BY cluster_size DESC, last_occurrence DESC, representative_issue LIMIT 10""")
def q_trending_issues(spark, sf_dir):
    from vectriage.operators.trends import trending
    t = _tickets(spark, sf_dir)
    res = trending(t, TICKETS_AS_OF, TREND_DAYS, 3, 0.70, 10, 10)
    return res.withColumn("similar_issues", F.array_join("similar_issues", "|"))


@register("trending_issues_ring", ORACLE["trending_issues"])
def q_trending_issues_ring(spark, sf_dir):
    """Trending issues by the search that leaves out pairs beyond the cut."""
    from vectriage.operators.trends import trending
    t = _tickets(spark, sf_dir)
    res = trending(t, TICKETS_AS_OF, TREND_DAYS, 3, 0.70, 10, 10, strategy="ring")
    return res.withColumn("similar_issues", F.array_join("similar_issues", "|"))


@register("semantic_clusters", _pairs_sql(5, 0.70) + f"""
SELECT s.anchor_title AS representative_issue, s.cluster_size, s.first_occurrence, s.last_occurrence,
       t.titles AS similar_issues
FROM (SELECT anchor_title, CAST(count(DISTINCT neighbor_id) AS BIGINT) AS cluster_size,
             min(anchor_date) AS first_occurrence, max(neighbor_date) AS last_occurrence
      FROM pairs GROUP BY anchor_title HAVING count(DISTINCT neighbor_id) >= 3) s
JOIN {_titles_sql(False)} t ON t.anchor_title = s.anchor_title
ORDER BY cluster_size DESC, last_occurrence DESC, representative_issue LIMIT 10""")
def q_semantic_clusters(spark, sf_dir):
    from vectriage.operators.trends import semantic_clusters
    t = _tickets(spark, sf_dir)
    res = semantic_clusters(t, TICKETS_AS_OF, TREND_DAYS, 3, 0.70, 5, 10)
    return res.withColumn("similar_issues", F.array_join("similar_issues", "|"))


@register("trend_detection", _pairs_sql(5, 0.65) + f"""
SELECT s.anchor_title AS representative_issue, s.cluster_size, s.first_seen, t.titles AS related_issues
FROM (SELECT anchor_title, CAST(count(DISTINCT neighbor_id) AS BIGINT) AS cluster_size, min(anchor_date) AS first_seen
      FROM pairs GROUP BY anchor_title HAVING count(DISTINCT neighbor_id) >= 3) s
JOIN {_titles_sql(False)} t ON t.anchor_title = s.anchor_title
ORDER BY cluster_size DESC, first_seen DESC, representative_issue LIMIT 10""")
def q_trend_detection(spark, sf_dir):
    from vectriage.operators.trends import trend_detection
    t = _tickets(spark, sf_dir)
    res = trend_detection(t, TICKETS_AS_OF, TREND_DAYS, 3, 0.65, 5, 10)
    return res.withColumn("related_issues", F.array_join("related_issues", "|"))


# ---------------------------------------------------------------- text: embed, search, keywords

def _docs_embedded(spark, sf_dir):
    from vectriage.functions.embed import HashingEmbedder
    from vectriage.sources.tables import read_table
    return HashingEmbedder().transform(read_table(spark, sf_dir, "documents"), "text")


def _reviews_embedded(spark, sf_dir):
    from vectriage.functions.embed import HashingEmbedder
    return HashingEmbedder().transform(reviews(spark, sf_dir), "combined_text")


def _benchmark_queries(spark, sf_dir):
    from vectriage.functions.embed import HashingEmbedder
    from vectriage.sources.tables import read_table
    b = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                      F.col("text").alias("query_text"))
    return HashingEmbedder().transform(b, "query_text")


DOCS_EMB = O.hash_embed_cte("de", "documents", "doc_id", "text")
DEFAULT_DIM = O.DEFAULT_DIM


@register("embed_documents", O.with_ctes(DOCS_EMB) + """
SELECT c.id AS doc_id, c.bucket, CAST(c.cnt AS DOUBLE) / m.nrm AS weight
FROM de_cnt c JOIN de_map m ON m.id = c.id""")
def q_embed_documents(spark, sf_dir):
    """Each distinct text is embedded once and joined back to its documents."""
    from vectriage.functions.embed import embed_distinct
    from vectriage.sources.tables import read_table
    d = embed_distinct(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return (d.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
             .where(F.col("weight") > 0)
             .select("doc_id", F.col("bucket").cast("long").alias("bucket"), "weight"))


@register("embedding_coverage", O.with_ctes(DOCS_EMB) + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(de.id) AS BIGINT) AS with_embeddings,
       """ + O.rha("(CAST(count(de.id) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE))", 2) + """ AS coverage_pct
FROM documents d LEFT JOIN de ON de.id = d.doc_id""")
def q_embedding_coverage(spark, sf_dir):
    from vectriage.operators.quality import embedding_coverage
    return embedding_coverage(_docs_embedded(spark, sf_dir))


@register("embedding_stats", O.with_ctes(TK) + f"""
SELECT 'Embedding Statistics' AS metric_type, CAST(count(*) AS BIGINT) AS total_embeddings,
       avg(len(embedding)) AS avg_dimensions, CAST(min(len(embedding)) AS BIGINT) AS min_dimensions,
       CAST(max(len(embedding)) AS BIGINT) AS max_dimensions,
       {O.rha('avg(embedding[1])', 9)} AS avg_first_dim, {O.rha('stddev_samp(embedding[1])', 9)} AS stddev_first_dim
FROM tickets WHERE embedding IS NOT NULL""")
def q_embedding_stats(spark, sf_dir):
    from vectriage.operators.quality import embedding_stats
    return embedding_stats(_tickets(spark, sf_dir), digits=9)


@register("embedding_issues", """
SELECT o.o_orderkey AS ticket_id, CAST(len(e.embedding) AS BIGINT) AS embedding_dims,
       CASE WHEN e.embedding IS NULL THEN 'Missing embedding'
            WHEN len(e.embedding) <> 64 THEN 'Wrong dimensions' ELSE 'OK' END AS embedding_status
FROM orders o LEFT JOIN embeddings e ON e.vec_id = o.o_orderkey
WHERE e.embedding IS NULL OR len(e.embedding) <> 64""")
def q_embedding_issues(spark, sf_dir):
    """Orders whose vector is missing or not 64 wide (vectors merged by id)."""
    from vectriage.operators.quality import embedding_issues
    from vectriage.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"))
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ticket_id"), "embedding")
    return embedding_issues(o.join(e, "ticket_id", "left"), "ticket_id", 64)


@register("embedding_sample", O.with_ctes(TK) + """
SELECT ticket_id, CAST(len(embedding) AS BIGINT) AS dimensions,
       array_to_string(list_transform(embedding[1:5], lambda x: printf('%.6f', x)), ',') AS first_values
FROM tickets""")
def q_embedding_sample(spark, sf_dir):
    from vectriage.operators.quality import embedding_sample
    return embedding_sample(_tickets(spark, sf_dir), "ticket_id", fmt="%.6f")


REVIEW_PAYLOAD = ["product_id", "score", "summary", "text", "helpfulness_ratio", "sentiment_category"]
TEXT_SEARCH_CTES = O.with_ctes(O.RAW_REVIEWS, O.REVIEWS, O.hash_embed_cte("re", "reviews", "review_id", "combined_text"),
                               O.hash_embed_cte("qe", "benchmark", "item_id", "text"),
                               O.topk_cte("nn", "re", "id", "qe", "id", 10))


@register("text_search", TEXT_SEARCH_CTES + f"""
SELECT nn.query_id, nn.rank, r.review_id, {', '.join('r.' + c for c in REVIEW_PAYLOAD)},
       {O.rha('nn.distance', 6)} AS distance, {O.sim('nn.distance', 2)} AS similarity_pct
FROM nn JOIN reviews r ON r.review_id = nn.neighbor_id""")
def q_text_search(spark, sf_dir):
    from vectriage.operators.search import search, similarity_pct
    res = search(_reviews_embedded(spark, sf_dir), _benchmark_queries(spark, sf_dir), 10,
                 id_col="review_id", payload=REVIEW_PAYLOAD, dim=DEFAULT_DIM)
    return res.select("query_id", "rank", "review_id", *REVIEW_PAYLOAD, _r6(),
                      similarity_pct(F.col("distance")).alias("similarity_pct"))


KEYWORD = "thing"


@register("keyword_search", REVIEWS_WITH + f"""
SELECT review_id FROM reviews WHERE text LIKE '%{KEYWORD}%'""")
def q_keyword_search(spark, sf_dir):
    from vectriage.operators.search import keyword_search
    return keyword_search(reviews(spark, sf_dir), "text", KEYWORD, "review_id")


@register("keyword_vs_semantic", TEXT_SEARCH_CTES + """,
kw AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS BIGINT) AS position, keyword
       FROM (SELECT item_id AS query_id, word AS keyword, min(spot) AS first_at
             FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word,
                          generate_subscripts(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 1) AS spot FROM benchmark)
             WHERE length(word) >= 1 GROUP BY item_id, word)),
words AS (SELECT b.item_id AS query_id, coalesce(kw.position, 1) AS position, kw.keyword FROM benchmark b LEFT JOIN kw ON kw.query_id = b.item_id),
rt AS (SELECT DISTINCT review_id, unnest(regexp_split_to_array(lower(combined_text), '[^\\p{L}\\p{N}]+')) AS tok
       FROM reviews),
kc AS (SELECT tok, count(*) AS n FROM rt GROUP BY tok),
sh AS (SELECT query_id, neighbor_id AS review_id FROM nn),
sc AS (SELECT query_id, count(*) AS n FROM sh GROUP BY query_id),
ov AS (SELECT sh.query_id, rt.tok, count(*) AS n FROM sh JOIN rt ON rt.review_id = sh.review_id GROUP BY sh.query_id, rt.tok)
SELECT w.query_id, w.position, w.keyword, CAST(coalesce(kc.n, 0) AS BIGINT) AS keyword_hits,
       CAST(coalesce(sc.n, 0) AS BIGINT) AS semantic_hits, CAST(coalesce(ov.n, 0) AS BIGINT) AS overlap
FROM words w LEFT JOIN kc ON kc.tok = w.keyword LEFT JOIN sc ON sc.query_id = w.query_id
     LEFT JOIN ov ON ov.query_id = w.query_id AND ov.tok = w.keyword""")
def q_keyword_vs_semantic(spark, sf_dir):
    """Every word of every query: reviews that hold it, semantic hits, and both."""
    from vectriage.operators.search import keyword_vs_semantic
    return keyword_vs_semantic(_reviews_embedded(spark, sf_dir), _benchmark_queries(spark, sf_dir), "review_id", "combined_text", 10,
                               dim=DEFAULT_DIM)


@register("duplicate_detection", O.with_ctes(DOCS_EMB, O.topk_cte("nn", "de", "id", "de", "id", 10)) + f"""
SELECT query_id, rank, neighbor_id AS doc_id, {O.rha('distance', 6)} AS distance,
       {O.sim('distance', 1)} AS similarity_pct,
       CASE WHEN distance < 0.05 THEN 'Very Likely Duplicate' WHEN distance < 0.10 THEN 'Likely Duplicate'
            WHEN distance < 0.20 THEN 'Possibly Related' ELSE 'Different Issue' END AS duplicate_assessment
FROM nn WHERE distance < 0.20 AND neighbor_id <> query_id""")
def q_duplicate_detection(spark, sf_dir):
    from vectriage.operators.blocks import kept
    from vectriage.operators.search import duplicate_detection
    d = kept(_docs_embedded(spark, sf_dir).select("doc_id", "embedding"))
    q = d.select(F.col("doc_id").alias("query_id"), "embedding")
    res = duplicate_detection(d, q, 10, 0.20, payload=(), exclude_self=True,
                              id_col="doc_id", dim=DEFAULT_DIM)
    return res.select("query_id", "rank", "doc_id", _r6(), "similarity_pct", "duplicate_assessment")


@register("duplicate_detection_ring", ORACLE["duplicate_detection"])
def q_duplicate_detection_ring(spark, sf_dir):
    """Duplicate detection by the search that leaves out pairs beyond the cut (the one used when the queries are too many to broadcast)."""
    from vectriage.operators.blocks import kept
    from vectriage.operators.search import duplicate_detection
    d = kept(_docs_embedded(spark, sf_dir).select("doc_id", "embedding"))
    q = d.select(F.col("doc_id").alias("query_id"), "embedding")
    res = duplicate_detection(d, q, 10, 0.20, payload=(), exclude_self=True,
                              id_col="doc_id", dim=DEFAULT_DIM, strategy="ring")
    return res.select("query_id", "rank", "doc_id", _r6(), "similarity_pct", "duplicate_assessment")


# ---------------------------------------------------------------- reviews: filters, statistics

@register("product_reviews", REVIEWS_WITH + """
SELECT review_id, score, summary, text, helpfulness_ratio, sentiment_category, profile_name, review_date
FROM reviews WHERE product_id = 'P3' AND score >= 4
ORDER BY helpfulness_ratio DESC, score DESC, review_id LIMIT 20""")
def q_product_reviews(spark, sf_dir):
    from vectriage.operators.reviews import product_reviews
    return product_reviews(reviews(spark, sf_dir), "P3", 4)


@register("helpful_reviews", REVIEWS_WITH + """
SELECT review_id, product_id, score, summary, helpfulness_numerator, helpfulness_ratio
FROM reviews WHERE score >= 4 AND helpfulness_ratio >= 0.8 AND helpfulness_denominator >= 10
ORDER BY helpfulness_numerator DESC, helpfulness_ratio DESC, review_id LIMIT 20""")
def q_helpful_reviews(spark, sf_dir):
    from vectriage.operators.reviews import helpful_reviews
    return helpful_reviews(reviews(spark, sf_dir))


@register("custom_review_filter", REVIEWS_WITH + """
SELECT review_id, product_id, score, helpfulness_numerator, helpfulness_ratio
FROM reviews WHERE score >= 4 AND helpfulness_ratio >= 0.8 AND helpfulness_denominator >= 10 AND is_helpful
ORDER BY helpfulness_numerator DESC, review_id LIMIT 100""")
def q_custom_review_filter(spark, sf_dir):
    from vectriage.operators.reviews import custom_review_filter
    return custom_review_filter(reviews(spark, sf_dir))


@register("review_statistics", REVIEWS_WITH + f"""
SELECT CAST(count(*) AS BIGINT) AS total_reviews, CAST(count(DISTINCT product_id) AS BIGINT) AS unique_products,
       CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users,
       strftime(min(review_date), '%Y-%m-%d') AS date_start, strftime(max(review_date), '%Y-%m-%d') AS date_end,
       CAST(sum(CAST(is_helpful AS BIGINT)) AS BIGINT) AS helpful_reviews,
       {O.rha('avg(helpfulness_ratio)', 9)} AS avg_helpfulness_ratio, {O.rha('avg(text_length)', 9)} AS avg_text_length
FROM reviews""")
def q_review_statistics(spark, sf_dir):
    from vectriage.operators.reviews import review_statistics
    return review_statistics(reviews(spark, sf_dir), digits=9)


@register("score_distribution", REVIEWS_WITH + f"""
SELECT score, review_count, {O.rha('(CAST(review_count AS DOUBLE) * 100.0 / CAST(sum(review_count) OVER () AS DOUBLE))', 2)} AS pct
FROM (SELECT score, CAST(count(*) AS BIGINT) AS review_count FROM reviews GROUP BY score)""")
def q_score_distribution(spark, sf_dir):
    from vectriage.operators.reviews import score_distribution
    return score_distribution(reviews(spark, sf_dir))


@register("review_preview", REVIEWS_WITH + f"""
SELECT review_id, repeat('⭐', score) AS stars,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text_preview,
       printf('%d%%', CAST({O.rha('(helpfulness_ratio * 100.0)', 0)} AS BIGINT)) AS helpful_pct
FROM reviews""")
def q_review_preview(spark, sf_dir):
    from vectriage.operators.reviews import review_preview
    return review_preview(reviews(spark, sf_dir))


@register("sample_fixed_n", REVIEWS_WITH + """
SELECT * FROM reviews ORDER BY md5('42' || review_id), review_id LIMIT 100""")
def q_sample_fixed_n(spark, sf_dir):
    from vectriage.operators.reviews import sample_fixed_n
    return sample_fixed_n(reviews(spark, sf_dir), 100, 42)


# ---------------------------------------------------------------- ticket table operations

@register("tickets_enforce_schema", O.with_ctes(O.ALL_TICKETS) + """
SELECT ticket_id, created_at, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS resolved_at,
       title, description, category, priority, status, resolution, resolution_time_hours,
       CAST(customer_id AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS customer_tier,
       CAST(NULL AS VARCHAR) AS assigned_agent_id, CAST(NULL AS VARCHAR) AS assigned_team,
       CAST(satisfaction_score AS BIGINT) AS satisfaction_score, CAST(0 AS BIGINT) AS reopened_count,
       title || ' ' || description AS combined_text, array_to_string(tags, '|') AS tags,
       CAST(NULL AS VARCHAR) AS source_channel, 'en' AS language
FROM tickets""")
def q_tickets_enforce_schema(spark, sf_dir):
    from vectriage.operators.tickets import combined_text, enforce_schema
    t = tickets_fx(spark, sf_dir, searchable=False).withColumn("combined_text", combined_text())
    return enforce_schema(t).withColumn("tags", F.array_join("tags", "|"))


@register("tickets_combined_text", O.with_ctes(O.ALL_TICKETS) + """
SELECT ticket_id, title || ' ' || description AS combined_text,
       coalesce(title, '') || ' ' || coalesce(resolution, '') AS title_resolution_text
FROM tickets""")
def q_tickets_combined_text(spark, sf_dir):
    from vectriage.operators.tickets import combined_text
    t = tickets_fx(spark, sf_dir, searchable=False)
    return t.select("ticket_id", combined_text().alias("combined_text"),
                    combined_text("title", "resolution", missing_as_empty=True).alias("title_resolution_text"))


def _count_sql():
    from vectriage.sources.tables import TABLES
    parts = [f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLES]
    return "\nUNION ALL ".join(parts)


@register("row_count", _count_sql())
def q_row_count(spark, sf_dir):
    from functools import reduce
    from vectriage.sources.tables import TABLES, read_table
    parts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("tickets_by_category", O.with_ctes(O.ALL_TICKETS) + """
SELECT category, CAST(count(*) AS BIGINT) AS ticket_count FROM tickets GROUP BY category""")
def q_tickets_by_category(spark, sf_dir):
    from vectriage.operators.tickets import tickets_by_category
    return tickets_by_category(tickets_fx(spark, sf_dir, searchable=False))


@register("status_share", O.with_ctes(O.ALL_TICKETS) + f"""
SELECT status, count, {O.rha('(CAST(count AS DOUBLE) * 100.0 / CAST(sum(count) OVER () AS DOUBLE))', 2)} AS percentage
FROM (SELECT status, CAST(count(*) AS BIGINT) AS count FROM tickets GROUP BY status)""")
def q_status_share(spark, sf_dir):
    from vectriage.operators.tickets import status_share
    return status_share(tickets_fx(spark, sf_dir, searchable=False))


@register("ticket_summary", O.with_ctes(O.ALL_TICKETS) + """
SELECT CAST(count(*) AS BIGINT) AS total_tickets, CAST(count(DISTINCT category) AS BIGINT) AS categories,
       CAST(count_if(status = 'resolved') AS BIGINT) AS resolved, CAST(count(resolution) AS BIGINT) AS with_solution,
       CAST(count_if(status = 'open') AS BIGINT) AS open, CAST(count_if(status = 'in_progress') AS BIGINT) AS in_progress
FROM tickets""")
def q_ticket_summary(spark, sf_dir):
    from vectriage.operators.tickets import ticket_summary
    return ticket_summary(tickets_fx(spark, sf_dir, searchable=False))


@register("merge_embeddings", """
SELECT o.o_orderkey AS ticket_id, CAST(len(e.embedding) AS BIGINT) AS embedding_dims,
       CAST(e.embedding[1] AS DOUBLE) AS first_value
FROM orders o LEFT JOIN embeddings e ON e.vec_id = o.o_orderkey""")
def q_merge_embeddings(spark, sf_dir):
    from vectriage.sources.sinks import merge_matched
    from vectriage.sources.tables import read_table
    target = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"),
                                                        F.lit(None).cast("array<double>").alias("embedding"))
    source = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    merged = merge_matched(target, source, "ticket_id", ["embedding"])
    return merged.select("ticket_id", F.size("embedding").cast("long").alias("embedding_dims"),
                         F.get("embedding", 0).alias("first_value")).withColumn(
        "embedding_dims", F.when(F.col("first_value").isNotNull(), F.col("embedding_dims")))


def _shared(spark, name):
    import uuid
    from vectriage.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("reviews_csv_roundtrip", REVIEWS_WITH + "SELECT * FROM reviews")
def q_reviews_csv_roundtrip(spark, sf_dir):
    """The raw reviews written as CSV, read back by splits and enriched."""
    from vectriage.operators.reviews import RAW_REVIEW_SCHEMA, enrich_reviews, read_reviews_csv
    path = _shared(spark, "reviews-csv")
    raw = raw_reviews_fx(spark, sf_dir).select(*RAW_REVIEW_SCHEMA.fieldNames())
    (raw.write.option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return enrich_reviews(read_reviews_csv(spark, path))


LITERAL_TICKET = (-1, "Literal issue", "cat1", "high")


@register("ticket_table_lifecycle", O.with_ctes(O.ALL_TICKETS) + """
SELECT ticket_id, title, category, priority, CAST(NULL AS VARCHAR) AS note FROM tickets
UNION ALL SELECT -1, 'Literal issue', 'cat1', 'high', 'inserted'""")
def q_ticket_table_lifecycle(spark, sf_dir):
    """Write a table, insert a literal row, add a column, update it by a merge and replace the table by the result."""
    from vectriage.sources.sinks import add_column_if_missing, merge_matched, read_table_version, replace_table, write_table
    path = _shared(spark, "tickets")
    cols = ["ticket_id", "title", "category", "priority"]
    tickets = tickets_fx(spark, sf_dir, searchable=False).select(*cols)
    write_table(tickets, f"{path}/plain", "WRITE_EMPTY")
    literal = spark.createDataFrame([LITERAL_TICKET], "ticket_id long, title string, category string, priority string")
    write_table(literal.select(*[F.col(c).cast(tickets.schema[c].dataType) for c in cols]), f"{path}/plain", "WRITE_APPEND")
    replace_table(spark.read.parquet(f"{path}/plain"), f"{path}/table")
    noted = add_column_if_missing(read_table_version(spark, f"{path}/table"), "note", "string")
    source = literal.select(F.col("ticket_id").cast(tickets.schema["ticket_id"].dataType).alias("ticket_id"), F.lit("inserted").alias("note"))
    replace_table(merge_matched(noted, source, "ticket_id", ["note"]), f"{path}/table")
    return read_table_version(spark, f"{path}/table")


@register("find_similar_string_ids", O.with_ctes(TK, O.tickets_knn(5)) + f"""
SELECT 'TKT-' || nn.query_id AS query_id, nn.rank, 'TKT-' || b.ticket_id AS ticket_id, b.title, {O.rha('nn.distance', 6)} AS distance
FROM nn JOIN tickets b ON b.ticket_id = nn.neighbor_id""")
def q_find_similar_string_ids(spark, sf_dir):
    """Similar tickets of a ticket table with string ids, through its enforced schema; no two vectors are equal, so ids break no ties."""
    from vectriage.operators.search import find_similar
    from vectriage.operators.tickets import combined_text, enforce_schema
    t = _tickets(spark, sf_dir).withColumn("ticket_id", F.concat(F.lit("TKT-"), F.col("ticket_id"))).withColumn("combined_text", combined_text())
    t = enforce_schema(t).join(t.select("ticket_id", "embedding"), "ticket_id")
    return find_similar(t, ticket_queries(t), 5, payload=["title"]).select("query_id", "rank", "ticket_id", "title", _r6())


@register("incremental_embed", O.with_ctes(
    "stored AS (SELECT d.doc_id FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id)",
    "todo AS (SELECT d.* FROM documents d ANTI JOIN stored s ON s.doc_id = d.doc_id)",
    O.hash_embed_cte("ne", "todo", "doc_id", "text")) + """
SELECT t.doc_id, sha256(t.text) AS text_hash, CAST(count(c.bucket) AS BIGINT) AS nonzero_buckets
FROM todo t LEFT JOIN ne_cnt c ON c.id = t.doc_id GROUP BY t.doc_id, t.text""")
def q_incremental_embed(spark, sf_dir):
    from vectriage.sources.tables import read_table
    from vectriage.streaming.incremental import incremental_embed
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    # the vectors already stored: documents that carry a label
    stored = (docs.join(labels, "doc_id", "left_semi")
                  .select("doc_id", F.sha2("text", 256).alias("text_hash")))
    new = incremental_embed(docs, stored, "doc_id", "text")
    return new.select("doc_id", "text_hash",
                      F.coalesce(F.size(F.filter("embedding", lambda x: x > 0)), F.lit(0))
                       .cast("long").alias("nonzero_buckets"))


# ---------------------------------------------------------------- vector index

def _ivf(spark, sf_dir, method="kmeans"):
    """Build the index, write it (rows partitioned by list_id) to the shared
    checkpoint folder and search the written copy."""
    import uuid
    from vectriage.operators.ivf import build_ivf, load_ivf, save_ivf
    from vectriage.session import ensure_checkpoint_dir
    t = _tickets(spark, sf_dir).select("ticket_id", "embedding")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ivf-{uuid.uuid4().hex}"
    save_ivf(build_ivf(t, "ticket_id", "embedding", method=method), path)
    return t, load_ivf(spark, path, "ticket_id")


_EXACT10 = O.with_ctes(TK, O.tickets_knn(10)) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM nn"""


@register("ivf_search", _EXACT10)
def q_ivf_search(spark, sf_dir):
    """IVF search probing every list: must equal the exact search."""
    from vectriage.operators.ivf import ivf_search
    t, idx = _ivf(spark, sf_dir)
    res = ivf_search(idx, ticket_queries(t), 10, fraction=1.0)
    return res.select("query_id", "neighbor_id", "rank", _r6())


@register("tree_search", _EXACT10)
def q_tree_search(spark, sf_dir):
    """Tree-partitioned (bisecting k-means) index probing every leaf."""
    from vectriage.operators.ivf import ivf_search
    t, idx = _ivf(spark, sf_dir, "tree")
    res = ivf_search(idx, ticket_queries(t), 10, fraction=1.0)
    return res.select("query_id", "neighbor_id", "rank", _r6())


@register("knn_block", _EXACT10)
def q_knn_block(spark, sf_dir):
    """The block strategy (used when the query matrix is too large to
    broadcast), forced here with small blocks so several block pairs meet."""
    t = _tickets(spark, sf_dir).select("ticket_id", "embedding")
    res = knn_mod.knn(t, ticket_queries(t), 10, base_id="ticket_id", strategy="block", block_bytes=64 << 10)
    return res.select("query_id", "neighbor_id", "rank", _r6())


@register("ivf_filtered_search", O.with_ctes(TK, O.tickets_knn(10, base_where=_FILTER_SQL)) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM nn""")
def q_ivf_filtered_search(spark, sf_dir):
    """Pre-filtered IVF search over every list: equals the exact filtered
    search (the widening at smaller fractions is covered by the tests)."""
    from vectriage.operators.ivf import ivf_search
    from vectriage.operators.search import filter_condition
    full = _tickets(spark, sf_dir)
    t, idx = _ivf(spark, sf_dir)
    idx.rows = idx.rows.join(full.select("ticket_id", "status", "category"), "ticket_id")
    res = ivf_search(idx, ticket_queries(t), 10, fraction=1.0, filters=filter_condition(full, FILTERS))
    return res.select("query_id", "neighbor_id", "rank", _r6())


@register("ivf_lists")
def q_ivf_lists(spark, sf_dir):
    """Rows per k-means list (ceil(sqrt(N)) lists)."""
    from vectriage.operators.ivf import list_sizes
    _, idx = _ivf(spark, sf_dir)
    return list_sizes(idx)


@register("tree_lists")
def q_tree_lists(spark, sf_dir):
    """Rows per bisecting k-means leaf (max leaf size 100)."""
    from vectriage.operators.ivf import list_sizes
    _, idx = _ivf(spark, sf_dir, "tree")
    return list_sizes(idx)


EXACT_VS_IVF_FRACTIONS = (0.1, 0.25, 0.5, 1.0)


@register("exact_vs_ivf")
def q_exact_vs_ivf(spark, sf_dir):
    """Recall@10 of the IVF search against the exact search, per fraction of lists probed."""
    from functools import reduce
    from vectriage.operators.ivf import ivf_search, recall_at_k
    t, idx = _ivf(spark, sf_dir)
    q = ticket_queries(t)
    path = _shared(spark, "exact")             # searched once, compared with each fraction
    knn_mod.knn(t, q, 10, base_id="ticket_id").write.parquet(path)
    exact = spark.read.parquet(path)
    parts = []
    for f in EXACT_VS_IVF_FRACTIONS:
        rec = recall_at_k(exact, ivf_search(idx, q, 10, fraction=f))
        parts.append(rec.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("avg_recall"),
                             F.min("recall").alias("min_recall"))
                        .select(F.lit(f).alias("fraction_lists_to_search"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("index_coverage", O.with_ctes(TK) + """
SELECT CAST(count(*) AS BIGINT) AS base_rows, CAST(count(*) AS BIGINT) AS indexed_rows,
       CASE WHEN count(*) > 0 THEN 100.0::DOUBLE END AS coverage_pct
FROM tickets WHERE embedding IS NOT NULL""")
def q_index_coverage(spark, sf_dir):
    from vectriage.operators.ivf import index_coverage
    t, idx = _ivf(spark, sf_dir)
    return index_coverage(idx, t)


# Lists given by the caller: the mean vector of each (category, priority).
GIVEN_CTES = """
gm AS (SELECT category, priority, i, avg(v) AS m
       FROM (SELECT category, priority, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM tickets) GROUP BY category, priority, i),
gc AS (SELECT CAST(row_number() OVER (ORDER BY category, priority) - 1 AS BIGINT) AS list_id, list(m ORDER BY i) AS embedding
       FROM gm GROUP BY category, priority)"""


def _given_sql(k, fraction, base_where="TRUE", filtered=False):
    """Top-k within the nearest ``fraction`` of the given lists; with a filter, within as many as hold k rows."""
    lists = "ranked AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS lists FROM lr_rank)"
    held = f"held AS (SELECT a.list_id, count(*) AS n FROM assigned a JOIN tickets b ON b.ticket_id = a.ticket_id WHERE {base_where} GROUP BY a.list_id)"
    reach = ("before < " + str(k) + " OR " if filtered else "") + f"rank <= ceil({fraction} * lists)"
    return O.with_ctes(TK, GIVEN_CTES, O.topk_cte("an", "gc", "list_id", "tickets", "ticket_id", 1),
                       "assigned AS (SELECT query_id AS ticket_id, neighbor_id AS list_id FROM an)",
                       O.topk_cte("lr", "gc", "list_id", "tickets", "ticket_id", 1_000_000),
                       "lr_rank AS (SELECT query_id, neighbor_id AS list_id, rank FROM lr)", lists, held, f"""
probes AS (SELECT query_id, list_id FROM (
             SELECT r.query_id, r.list_id, r.rank, r.lists,
                    coalesce(sum(coalesce(h.n, 0)) OVER (PARTITION BY r.query_id ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM ranked r LEFT JOIN held h ON h.list_id = r.list_id) WHERE {reach}),
gp AS (SELECT p.query_id, b.ticket_id AS neighbor_id, {O.distance_sql('cosine', 'q.embedding', 'b.embedding')} AS distance
       FROM probes p JOIN assigned a ON a.list_id = p.list_id JOIN tickets b ON b.ticket_id = a.ticket_id JOIN tickets q ON q.ticket_id = p.query_id
       WHERE {base_where}),
gn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS BIGINT) AS rank
       FROM gp QUALIFY rank <= {k})""")


def _given_index(spark, sf_dir):
    """The written index of the tickets over the mean vectors of their (category, priority)."""
    from pyspark.sql import Window
    from vectriage.operators.ivf import build_ivf, load_ivf, save_ivf
    t = _tickets(spark, sf_dir).select("ticket_id", "category", "priority", "status", "embedding")
    means = (t.select("category", "priority", F.posexplode("embedding").alias("i", "v")).groupBy("category", "priority", "i").agg(F.avg("v").alias("m"))
             .groupBy("category", "priority").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")))
    given = means.select((F.row_number().over(Window.orderBy("category", "priority")) - 1).alias("list_id"), F.transform("c", lambda x: x["m"]).alias("centroid"))
    path = _shared(spark, "ivf-given")
    save_ivf(build_ivf(t, "ticket_id", "embedding", centroids=given), path)
    return t, load_ivf(spark, path, "ticket_id")


@register("ivf_probe_search", _given_sql(10, 0.1) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM gn""")
def q_ivf_probe_search(spark, sf_dir):
    """A tenth of the lists per query, read from their folders; the nearest list's k-th row rules further lists out."""
    from vectriage.operators.ivf import ivf_search
    t, idx = _given_index(spark, sf_dir)
    return ivf_search(idx, ticket_queries(t), 10, fraction=0.1, bound=True).select("query_id", "neighbor_id", "rank", _r6())


@register("ivf_filtered_probe", _given_sql(10, 0.1, _FILTER_SQL, True) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM gn""")
def q_ivf_filtered_probe(spark, sf_dir):
    """Filtered search in one pass: a tenth of the lists, and further ones until those probed hold ten rows that pass."""
    from vectriage.operators.ivf import ivf_search
    from vectriage.operators.search import filter_condition
    t, idx = _given_index(spark, sf_dir)
    idx.rows = idx.rows.join(t.select("ticket_id", "status", "category"), "ticket_id")
    return ivf_search(idx, ticket_queries(t), 10, fraction=0.1, filters=filter_condition(t, FILTERS)).select("query_id", "neighbor_id", "rank", _r6())


def _given_recall_sql():
    parts = []
    for f in EXACT_VS_IVF_FRACTIONS:
        parts.append(f"""SELECT {f}::DOUBLE AS fraction_lists_to_search, CAST(count(DISTINCT query_id) AS BIGINT) AS queries, CAST(sum(hit) AS BIGINT) AS hits FROM (
  WITH {_given_sql(10, f).strip()[4:]}, {O.tickets_knn(10)}
  SELECT nn.query_id, CASE WHEN gn.query_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM nn LEFT JOIN gn ON gn.query_id = nn.query_id AND gn.neighbor_id = nn.neighbor_id)""")
    return "\nUNION ALL ".join(parts)


@register("exact_vs_given_lists", _given_recall_sql())
def q_exact_vs_given_lists(spark, sf_dir):
    """Rows of the exact top ten that the index finds over given lists, per fraction of lists probed; one exact search, one probe ranking."""
    from functools import reduce
    from vectriage.operators.ivf import ivf_search
    t, idx = _given_index(spark, sf_dir)
    q = ticket_queries(t)
    path = _shared(spark, "exact")
    knn_mod.knn(t, q, 10, base_id="ticket_id").write.parquet(path)
    exact = spark.read.parquet(path).select("query_id", "neighbor_id")
    parts = []
    for f in EXACT_VS_IVF_FRACTIONS:
        got = ivf_search(idx, q, 10, fraction=f).select("query_id", "neighbor_id", F.lit(1).alias("_hit"))
        parts.append(exact.join(got, ["query_id", "neighbor_id"], "left").agg(
            F.lit(f).alias("fraction_lists_to_search"), F.count_distinct("query_id").alias("queries"), F.count("_hit").alias("hits")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("ivf_list_check", O.with_ctes(TK) + """
SELECT CAST(count(*) AS BIGINT) AS indexed_rows, CAST(count(*) AS BIGINT) AS in_nearest_list, CAST(count(*) AS BIGINT) AS counted_in_lists
FROM tickets WHERE embedding IS NOT NULL""")
def q_ivf_list_check(spark, sf_dir):
    """The learnt lists hold every row, each in the list whose centroid is nearest by the exact search."""
    t, idx = _ivf(spark, sf_dir)
    near = knn_mod.knn(idx.centroids.select("list_id", F.col("centroid").alias("embedding")), ticket_queries(t), 1, base_id="list_id")
    right = idx.rows.join(near.select(F.col("query_id").alias("ticket_id"), "neighbor_id"), "ticket_id")
    rows = right.agg(F.count("*").alias("indexed_rows"), F.count_if(F.col("list_id") == F.col("neighbor_id")).alias("in_nearest_list"))
    return rows.join(idx.sizes.agg(F.sum("n_rows").alias("counted_in_lists")))


@register("tree_list_check", O.with_ctes(TK) + """
SELECT CAST(count(*) AS BIGINT) AS indexed_rows, CAST(0 AS BIGINT) AS leaves_over_limit, count(*) = 0 AS no_leaf
FROM tickets WHERE embedding IS NOT NULL""")
def q_tree_list_check(spark, sf_dir):
    """The leaves of the tree hold every row, none more than 100 of them."""
    from vectriage.operators.ivf import list_sizes
    _, idx = _ivf(spark, sf_dir, "tree")
    return list_sizes(idx).agg(F.sum("n_rows").alias("indexed_rows"), F.count_if(F.col("n_rows") > 100).alias("leaves_over_limit"),
                               (F.count("*") == 0).alias("no_leaf"))


@register("index_maintenance", O.with_ctes(TK, """
kept AS (SELECT * EXCLUDE (embedding), CASE WHEN category = 'cat1' THEN list_reverse(embedding) ELSE embedding END AS embedding
         FROM tickets WHERE priority <> 'low')""", O.topk_cte("nn", "kept", "ticket_id", "tickets", "ticket_id", 5)) + f"""
SELECT query_id, neighbor_id, rank, {O.rha('distance', 6)} AS distance FROM nn""")
def q_index_maintenance(spark, sf_dir):
    """An index of the resolved tickets; the others come in one batch, changed vectors in the next, and the last takes tickets out."""
    from vectriage.operators.index_store import append_rows, open_index, remove_rows
    from vectriage.operators.ivf import build_ivf, ivf_search, save_ivf
    t = _tickets(spark, sf_dir).select("ticket_id", "category", "priority", "status", "embedding")
    path = _shared(spark, "ivf-kept")
    save_ivf(build_ivf(t.where("status = 'resolved'"), "ticket_id", "embedding"), path)
    append_rows(spark, path, t.where("status <> 'resolved'"), "ticket_id")
    append_rows(spark, path, t.where("category = 'cat1'").withColumn("embedding", F.reverse("embedding")), "ticket_id")
    remove_rows(spark, path, t.where("priority = 'low'"), "ticket_id")
    idx = open_index(spark, path, "ticket_id")
    return ivf_search(idx, ticket_queries(t), 5, fraction=1.0).select("query_id", "neighbor_id", "rank", _r6())


# ---------------------------------------------------------------- pipeline and streaming

@register("pipeline_end_to_end", O.with_ctes(O.RAW_REVIEWS, O.REVIEWS,
                                             O.hash_embed_cte("re", "reviews", "review_id", "combined_text")) + """
SELECT r.review_id, r.score, r.sentiment_category, CAST(count(c.bucket) AS BIGINT) AS nonzero_buckets
FROM reviews r LEFT JOIN re_cnt c ON c.id = r.review_id
GROUP BY r.review_id, r.score, r.sentiment_category""")
def q_pipeline_end_to_end(spark, sf_dir):
    """Load, enrich, embed, write, read back and index the review corpus."""
    import uuid
    from vectriage.plans.corpus import build_corpus, corpus_summary
    from vectriage.session import ensure_checkpoint_dir
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    corpus = build_corpus(spark, raw_reviews_fx(spark, sf_dir), out)
    return corpus_summary(corpus)


@register("pipeline_index_and_statistics", O.with_ctes(O.RAW_REVIEWS, O.REVIEWS,
                                                      O.hash_embed_cte("re", "reviews", "review_id", "combined_text")) + f"""
SELECT CAST(count(*) AS BIGINT) AS total_reviews, CAST(count(DISTINCT product_id) AS BIGINT) AS unique_products,
       CAST(sum(CAST(is_helpful AS BIGINT)) AS BIGINT) AS helpful_reviews, {O.rha('avg(text_length)', 9)} AS avg_text_length,
       CAST((SELECT count(*) FROM re) AS BIGINT) AS indexed_rows, CAST((SELECT count(*) FROM re) AS BIGINT) AS rows_in_lists
FROM reviews""")
def q_pipeline_index_and_statistics(spark, sf_dir):
    """Statistics and index of the built corpus, as written."""
    from vectriage.plans.corpus import build_corpus
    corpus = build_corpus(spark, raw_reviews_fx(spark, sf_dir), _shared(spark, "corpus"))
    stats = corpus.statistics.select("total_reviews", "unique_products", "helpful_reviews", round_half_away("avg_text_length", 9).alias("avg_text_length"))
    return (stats.join(corpus.index.rows.agg(F.count("*").alias("indexed_rows")))
            .join(corpus.index.sizes.agg(F.sum("n_rows").alias("rows_in_lists"))))


@register("streaming_triage", _TRIAGE_SQL + "SELECT * FROM tri")
def q_streaming_triage(spark, sf_dir):
    """Every vector of ``embeddings`` arrives as a stream of new tickets and
    is triaged against the ticket base, one micro-batch per file."""
    from vectriage.streaming.triage_stream import triage_files
    from vectriage.sources.tables import read_table
    table = read_table(spark, sf_dir, "embeddings")
    base = _tickets(spark, sf_dir)
    # the table is one file, or a folder of part files
    single = [f.rstrip("/").rsplit("/", 1)[-1] for f in table.inputFiles()] == ["embeddings.parquet"]
    folder, files = (sf_dir, "embeddings.parquet") if single else (f"{sf_dir.rstrip('/')}/embeddings.parquet", "*")
    out = triage_files(spark, folder, files, table.schema, base, "vec_id")
    return out.select("query_id", "similar_ids", "category", "category_confidence", "priority", "solution",
                      "confidence", "similar_ticket_count", "error")


@register("trending_issues_ivf", ORACLE["trending_issues"])
def q_trending_issues_ivf(spark, sf_dir):
    """Trending issues through the IVF index (the at-scale path for the
    per-row search); probing every list it equals the exact result."""
    from vectriage.operators.trends import trending
    t, idx = _ivf(spark, sf_dir)
    full = _tickets(spark, sf_dir)
    res = trending(full, TICKETS_AS_OF, TREND_DAYS, 3, 0.70, 10, 10, index=idx, fraction=1.0)
    return res.withColumn("similar_issues", F.array_join("similar_issues", "|"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solution recommendation for every ticket (the smoke entry)."""
    return QUERIES["recommend_solution"](spark, sf_dir)

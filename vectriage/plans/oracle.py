"""DuckDB SQL for the cross-engine check of every registered query.

Each string runs on views named after the shared tables.  The ticket and
review views and the hashing embedder are spelled out once here as CTEs.
Conventions shared with the Spark side:

* ROUND is half away from zero on doubles (``rha``);
* top-k order is the distance rounded to nine decimals, then the id;
* counts, ranks and integer sums are BIGINT;
* null order is written out (Spark: nulls first ascending).
"""

from __future__ import annotations

from vectriage.functions.embed import DEFAULT_DIM
from vectriage.operators.knn import RANK_DECIMALS, distance_sql
from vectriage.sources.fixtures import TICKETS_AS_OF

AS_OF = f"TIMESTAMP '{TICKETS_AS_OF:%Y-%m-%d %H:%M:%S}'"


def rha(expr: str, digits: int) -> str:
    """ROUND half away from zero, the way ``round_half_away`` computes it."""
    s = f"{float(10 ** digits)}"
    return f"(sign({expr}) * (floor(abs({expr}) * {s} + 0.5) / {s}))"


_STATUS = ("CASE o.o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' "
           "ELSE 'in_progress' END")

def _tickets(join: str) -> str:
    return f"""tickets AS (
  SELECT o.o_orderkey AS ticket_id, o.o_orderdate AS created_at,
    'Issue ' || CAST(o.o_orderkey % 30 AS VARCHAR) AS title,
    'Order ' || CAST(o.o_orderkey AS VARCHAR) || ' for customer ' || CAST(o.o_custkey AS VARCHAR) AS description,
    'cat' || CAST(coalesce(e.label, o.o_custkey % 10) AS VARCHAR) AS category,
    lower(substr(o.o_orderpriority, 3)) AS priority,
    {_STATUS} AS status,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 13 <> 0
         THEN 'fix-' || CAST(o.o_orderkey % 12 AS VARCHAR) END AS resolution,
    CASE WHEN o.o_orderstatus = 'F' THEN CAST(3 + o.o_custkey % 3 AS INTEGER) END AS satisfaction_score,
    CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 <> 0
         THEN o.o_totalprice / CAST(10000 AS DOUBLE) END AS resolution_time_hours,
    o.o_custkey AS customer_id,
    [lower(substr(o.o_orderpriority, 3)), {_STATUS}] AS tags,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM orders o {join} embeddings e ON e.vec_id = o.o_orderkey)"""


TICKETS, ALL_TICKETS = _tickets("JOIN"), _tickets("LEFT JOIN")

RAW_REVIEWS = """raw_reviews AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS "Id",
    'P' || CAST(o.o_custkey % 20 AS VARCHAR) AS "ProductId",
    'U' || CAST(o.o_custkey AS VARCHAR) AS "UserId",
    CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE c.c_name END AS "ProfileName",
    CAST(floor((o.o_orderkey % 40) * (o.o_custkey % 11) / CAST(10 AS DOUBLE)) AS BIGINT) AS "HelpfulnessNumerator",
    o.o_orderkey % 40 AS "HelpfulnessDenominator",
    CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS "Score",
    CAST(epoch(o.o_orderdate) AS BIGINT) AS "Time",
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE ' about ' || d.source || ' ' END AS "Summary",
    d.text AS "Text"
  FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)"""

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


_RATIO = ('CASE WHEN "HelpfulnessDenominator" > 0 THEN CAST("HelpfulnessNumerator" AS DOUBLE) '
          '/ CAST("HelpfulnessDenominator" AS DOUBLE) ELSE 0.0 END')
_REVIEW_DATE = 'make_timestamp(CAST("Time" AS BIGINT) * 1000000)'

REVIEWS = f"""reviews AS (
  SELECT CAST("Id" AS VARCHAR) AS review_id, "ProductId" AS product_id, "UserId" AS user_id,
    coalesce("ProfileName", 'Anonymous') AS profile_name,
    CAST("HelpfulnessNumerator" AS BIGINT) AS helpfulness_numerator,
    CAST("HelpfulnessDenominator" AS BIGINT) AS helpfulness_denominator,
    CAST("Score" AS INTEGER) AS score, CAST("Time" AS BIGINT) AS time_unix,
    coalesce("Summary", '') AS summary, coalesce("Text", '') AS text,
    {_REVIEW_DATE} AS review_date,
    {_RATIO} AS helpfulness_ratio,
    {_strip(_strip("coalesce(\"Summary\", '')") + " || '. ' || " + _strip("coalesce(\"Text\", '')"))} AS combined_text,
    CASE "Score" WHEN 1 THEN 'Very Negative' WHEN 2 THEN 'Negative' WHEN 3 THEN 'Neutral'
         WHEN 4 THEN 'Positive' WHEN 5 THEN 'Very Positive' END AS sentiment_category,
    ({_RATIO} >= 0.7 AND "HelpfulnessDenominator" >= 5) AS is_helpful,
    CAST(length(coalesce("Text", '')) AS INTEGER) AS text_length,
    CAST(length(coalesce("Summary", '')) AS INTEGER) AS summary_length,
    {_REVIEW_DATE} AS created_at, {_REVIEW_DATE} AS updated_at
  FROM raw_reviews)"""


def hash_embed_cte(name: str, source: str, id_col: str, text_col: str, dim: int = DEFAULT_DIM) -> str:
    """The hashing embedder in SQL: ``name(id, embedding DOUBLE[])``; no-token texts get no row."""
    return f"""{name}_tok AS (
  SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS tok
  FROM {source}),
{name}_cnt AS (
  SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS cnt
  FROM {name}_tok WHERE tok <> '' GROUP BY id, bucket),
{name}_map AS (
  SELECT id, map_from_entries(list((bucket, CAST(cnt AS DOUBLE)))) AS m,
         sqrt(sum(CAST(cnt * cnt AS DOUBLE))) AS nrm
  FROM {name}_cnt GROUP BY id),
{name} AS (
  SELECT id, list_transform(range({dim}), lambda i: coalesce(m[i], 0.0) / nrm) AS embedding
  FROM {name}_map)"""


def topk_cte(name: str, base: str, base_id: str, queries: str, query_id: str, k: int,
             metric: str = "cosine", base_where: str = "TRUE") -> str:
    """Exact top-k pairs ``name(query_id, neighbor_id, distance, rank)`` by brute force."""
    d = distance_sql(metric, "q.embedding", "b.embedding")
    return f"""{name}_pairs AS (
  SELECT q.{query_id} AS query_id, b.{base_id} AS neighbor_id, {d} AS distance
  FROM {queries} q, {base} b
  WHERE q.embedding IS NOT NULL AND b.embedding IS NOT NULL AND ({base_where})),
{name} AS (
  SELECT query_id, neighbor_id, distance,
         CAST(row_number() OVER (PARTITION BY query_id
              ORDER BY round(distance, {RANK_DECIMALS}), neighbor_id) AS BIGINT) AS rank
  FROM {name}_pairs QUALIFY rank <= {k})"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sim(expr_distance: str = "distance", digits: int = 2) -> str:
    return rha(f"((1.0 - {expr_distance}) * 100.0)", digits)


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def units(expr_distance: str, digits: int) -> str:
    """similarity percent * 10^digits as an exact BIGINT (mirrors ``_pct_units``)."""
    x = f"((1.0 - {expr_distance}) * 100.0)"
    return f"CAST(sign({x}) * floor(abs({x}) * {float(10 ** digits)} + 0.5) AS BIGINT)"


def avg_units(col: str, digits: int) -> str:
    return f"(CAST(sum({col}) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * {float(10 ** digits)}))"


def recommend_ctes(nn: str, k: int, max_distance=0.30, weights=(0.3, 15.0, 0.5), sim_digits: int = 2,
                   avg_digits: int = 2, top_n: int = 1, n_examples: int = 3, min_satisfaction: int = 4,
                   prefix: str = "r") -> str:
    """CTEs ``{prefix}_out(query_id, solution_rank, resolution, frequency, avg_*,
    confidence_score, example_ids)`` with one row per ticket query."""
    w1, w2, w3 = weights
    cut = f" AND nn.distance < {max_distance}" if max_distance is not None else ""
    return f"""{prefix}_sim AS (
  SELECT nn.query_id, b.ticket_id, b.title, b.resolution, b.satisfaction_score, b.resolution_time_hours,
         nn.distance, {sim('nn.distance', sim_digits)} AS similarity_pct, {units('nn.distance', sim_digits)} AS units
  FROM {nn} nn JOIN tickets b ON b.ticket_id = nn.neighbor_id
  WHERE nn.rank <= {k} AND b.status = 'resolved' AND b.resolution IS NOT NULL
    AND b.satisfaction_score >= {min_satisfaction}{cut}),
{prefix}_g AS (
  SELECT query_id, resolution, count(*) AS frequency,
         CAST(sum(satisfaction_score) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_sat,
         avg(resolution_time_hours) AS avg_time, {avg_units('units', sim_digits)} AS avg_sim
  FROM {prefix}_sim GROUP BY query_id, resolution),
{prefix}_s AS (
  SELECT query_id, resolution, frequency, {rha('avg_sat', avg_digits)} AS avg_satisfaction,
         {rha('avg_time', avg_digits)} AS avg_resolution_hours, {rha('avg_sim', avg_digits)} AS avg_similarity_pct,
         CASE WHEN avg_time IS NOT NULL THEN {rha(f"((CAST(frequency AS DOUBLE) * {dbl(w1)} + avg_sat * {dbl(w2)} + avg_sim * {dbl(w3)}) / (greatest(avg_time, {dbl(1.0)}) * {dbl(0.1)}))", 2)} END AS confidence_score
  FROM {prefix}_g),
{prefix}_best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY confidence_score DESC NULLS LAST, frequency DESC, resolution) AS solution_rank
  FROM {prefix}_s QUALIFY solution_rank <= {top_n}),
{prefix}_ev AS (
  SELECT query_id, resolution, string_agg(CAST(ticket_id AS VARCHAR), ',' ORDER BY pos) AS example_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, resolution
                                     ORDER BY similarity_pct DESC, ticket_id) AS pos FROM {prefix}_sim)
  WHERE pos <= {n_examples} GROUP BY query_id, resolution),
{prefix}_out AS (
  SELECT q.ticket_id AS query_id, CAST(coalesce(x.solution_rank, 1) AS BIGINT) AS solution_rank, x.resolution,
         CAST(coalesce(x.frequency, 0) AS BIGINT) AS frequency, x.avg_satisfaction, x.avg_resolution_hours,
         x.avg_similarity_pct,
         CASE WHEN x.resolution IS NULL THEN 0.0 ELSE x.confidence_score END AS confidence_score,
         coalesce(ev.example_ids, '') AS example_ids
  FROM tickets q LEFT JOIN {prefix}_best x ON x.query_id = q.ticket_id
       LEFT JOIN {prefix}_ev ev ON ev.query_id = x.query_id AND ev.resolution = x.resolution)"""


def categorize_ctes(nn: str, k: int, prefix: str = "c") -> str:
    """CTE ``{prefix}_out`` with the categorisation columns, one row per ticket query."""
    return f"""{prefix}_s AS (
  SELECT nn.query_id, b.category, b.priority, {units('nn.distance', 2)} AS units
  FROM {nn} nn JOIN tickets b ON b.ticket_id = nn.neighbor_id WHERE nn.rank <= {k}),
{prefix}_c AS (
  SELECT query_id, category, count(*) AS votes, {avg_units('units', 2)} AS a FROM {prefix}_s GROUP BY query_id, category),
{prefix}_cb AS (
  SELECT query_id, category, votes, {rha('a', 2)} AS category_similarity,
         {rha("(CAST(votes AS DOUBLE) * 100.0 / CAST(sum(votes) OVER (PARTITION BY query_id) AS DOUBLE))", 2)} AS category_confidence
  FROM {prefix}_c
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, {rha('a', 2)} DESC, category) = 1),
{prefix}_p AS (
  SELECT query_id, priority, count(*) AS votes, {avg_units('units', 2)} AS a FROM {prefix}_s GROUP BY query_id, priority),
{prefix}_pb AS (
  SELECT query_id, priority, votes, {rha('a', 2)} AS priority_similarity FROM {prefix}_p
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, {rha('a', 2)} DESC, priority) = 1),
{prefix}_out AS (
  SELECT q.ticket_id AS query_id, coalesce(cb.category, 'Unknown') AS category,
         CAST(coalesce(cb.votes, 0) AS BIGINT) AS category_votes,
         coalesce(cb.category_similarity, 0.0) AS category_similarity,
         coalesce(cb.category_confidence, 0.0) AS category_confidence,
         coalesce(pb.priority, 'medium') AS priority, CAST(coalesce(pb.votes, 0) AS BIGINT) AS priority_votes,
         coalesce(pb.priority_similarity, 0.0) AS priority_similarity
  FROM tickets q LEFT JOIN {prefix}_cb cb ON cb.query_id = q.ticket_id
       LEFT JOIN {prefix}_pb pb ON pb.query_id = q.ticket_id)"""


def tickets_knn(k: int, name: str = "nn", metric: str = "cosine", base_where: str = "TRUE",
                anchors: str = "tickets") -> str:
    return topk_cte(name, "tickets", "ticket_id", anchors, "ticket_id", k, metric, base_where)

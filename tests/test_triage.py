import datetime as dt

from pyspark.sql import functions as F

from vectriage.operators.triage import categorize, recommend, triage

TICKETS = "ticket_id long, title string, category string, priority string, status string, resolution string, " \
          "satisfaction_score int, resolution_time_hours double, created_at timestamp_ntz, embedding array<double>"


def _base(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (1, "a", "Billing", "high", "resolved", "refund", 5, 2.0, t0, [1.0, 0.0]),
        (2, "b", "Billing", "high", "resolved", "refund", 4, 4.0, t0, [0.99, 0.01]),
        (3, "c", "Billing", "low", "resolved", "reset", 5, None, t0, [0.98, 0.02]),
        (4, "d", "Tech", "low", "open", None, None, None, t0, [0.0, 1.0]),
        (5, "e", "Tech", "medium", "resolved", "patch", 2, 1.0, t0, [0.97, 0.03]),
    ]
    return spark.createDataFrame(rows, TICKETS)


def test_recommend_by_hand(spark):
    base = _base(spark)
    q = spark.createDataFrame([(100, [1.0, 0.0]), (101, [-1.0, 0.0])], "query_id long, embedding array<double>")
    res = {r.query_id: r for r in recommend(base, q, 5, max_distance=0.30).collect()}
    r = res[100]
    # refund: tickets 1 and 2 (satisfaction 5, 4; 2h and 4h); reset: ticket 3 with no time -> null score
    assert r.resolution == "refund" and r.frequency == 2
    assert r.avg_satisfaction == 4.5 and r.avg_resolution_hours == 3.0
    sims = sorted(round((1 - d) * 100, 2) for d in [0.0, 1 - 0.99 / (0.99 ** 2 + 0.01 ** 2) ** 0.5])
    avg_sim = sum(sims) / 2
    exp = (2 * 0.3 + 4.5 * 15 + avg_sim * 0.5) / (3.0 * 0.1)
    assert abs(r.confidence_score - round(exp, 2)) < 0.006
    assert [e.ticket_id for e in r.example_tickets] == [1, 2]
    # nothing similar and resolved: the documented empty answer
    e = res[101]
    assert e.resolution is None and e.confidence_score == 0.0 and e.frequency == 0 and e.example_tickets == []


def test_null_time_scores_null_and_sorts_last(spark):
    base = _base(spark).where(F.col("ticket_id") == 3)
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, embedding array<double>")
    r = recommend(base, q, 5, max_distance=None).first()
    assert r.resolution == "reset" and r.confidence_score is None


def test_categorize_and_defaults(spark):
    base = _base(spark)
    q = spark.createDataFrame([(100, [1.0, 0.0]), (102, None)], "query_id long, embedding array<double>")
    res = {r.query_id: r for r in categorize(base, q, 4).collect()}
    assert res[100].category == "Billing" and res[100].category_votes == 3
    assert res[100].category_confidence == 75.0
    assert res[100].priority == "high" and res[100].priority_votes == 2
    assert res[102].category == "Unknown" and res[102].priority == "medium"
    top_k = {r.query_id: r for r in categorize(base, q, 10, denominator="top_k").collect()}
    assert top_k[100].category_confidence == 30.0   # 3 votes / k=10, the fixed-denominator form


def test_triage_one_row_per_query(spark):
    base = _base(spark)
    q = spark.createDataFrame([(100, [1.0, 0.0]), (101, [0.0, 1.0]), (102, None)],
                              "query_id long, embedding array<double>")
    res = {r.query_id: r for r in triage(base, q).collect()}
    assert set(res) == {100, 101, 102}
    assert len(res[100].similar_tickets) == 5
    assert res[102].error is not None and res[102].similar_tickets == []


def test_enforce_schema_modes(spark):
    import pytest as _pytest
    from vectriage.operators.tickets import TICKET_COLUMNS, enforce_schema
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "t", "d", "c", "high", "open", "t d", None),
         (2, None, "t", "d", "c", "high", "open", "t d", 3)],
        "ticket_id long, created_at timestamp_ntz, title string, description string, category string, "
        "priority string, status string, combined_text string, reopened_count long")
    out = enforce_schema(df).collect()
    assert [r.ticket_id for r in out] == [1]
    assert out[0].reopened_count == 0 and out[0].language == "en" and out[0].customer_tier is None
    assert len(out[0]) == len(TICKET_COLUMNS)
    flagged = {r.ticket_id: r._violation for r in enforce_schema(df, on_violation="flag").collect()}
    assert flagged == {1: False, 2: True}
    with _pytest.raises(Exception):
        enforce_schema(df, on_violation="fail").collect()

import datetime as dt

from vectriage.operators.reviews import enrich_reviews, read_reviews_csv, RAW_REVIEW_SCHEMA, sample_fixed_n


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW_REVIEW_SCHEMA)


def test_enrich_edge_cases(spark):
    rows = [
        (1, "P1", "U1", None, 4, 5, 5, 0, "  Great\t", "\n tasty \n"),   # null name, whitespace
        (2, "P1", "U2", "Bo", 3, 0, 9, 86400, None, None),               # zero votes, score outside 1..5
        (3, "P2", "U3", "Al", 7, 10, 1, 60, "", "text"),                  # empty summary
    ]
    out = {r.review_id: r for r in enrich_reviews(_raw(spark, rows)).collect()}
    a, b, c = out["1"], out["2"], out["3"]
    assert a.profile_name == "Anonymous"
    assert a.combined_text == "Great. tasty"
    assert a.helpfulness_ratio == 0.8 and a.is_helpful is True
    assert a.sentiment_category == "Very Positive"
    assert a.review_date == dt.datetime(1970, 1, 1) and a.created_at == a.updated_at == a.review_date
    assert b.helpfulness_ratio == 0.0 and b.is_helpful is False
    assert b.sentiment_category is None
    assert b.summary == "" and b.text == "" and b.combined_text == "."
    assert b.review_date == dt.datetime(1970, 1, 2)
    assert c.combined_text == ". text"                  # empty summary keeps the separator
    assert c.text_length == 4 and c.summary_length == 0
    assert c.helpfulness_ratio == 0.7 and c.is_helpful is True   # >= 0.7, not > 0.7
    assert len(enrich_reviews(_raw(spark, rows)).columns) == 19


def test_csv_reader_null_tokens_and_multiline(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(
        "Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text\n"
        '1,P1,U1,NA,1,2,5,100,"Good, really","line one\nline ""two"""\n'
        "2,P2,U2,null,0,0,3,200,,N/A\n")
    rows = {r.Id: r for r in read_reviews_csv(spark, str(p)).collect()}
    assert rows[1].ProfileName is None and rows[2].ProfileName is None
    assert rows[1].Summary == "Good, really"
    assert rows[1].Text == 'line one\nline "two"'
    assert rows[2].Summary is None and rows[2].Text is None


def test_sample_fixed_n_is_deterministic(spark):
    rows = [(i, "P", "U", "n", 0, 0, 3, 0, "s", "t") for i in range(50)]
    df = enrich_reviews(_raw(spark, rows))
    a = [r.review_id for r in sample_fixed_n(df, 10).collect()]
    b = [r.review_id for r in sample_fixed_n(df.repartition(7), 10).collect()]
    assert len(a) == 10 and sorted(a) == sorted(b)
    assert sample_fixed_n(df, 0).count() == 50

from plenum.sources import synthetic


def test_same_rows_in_every_run_and_shares_near_the_weights(spark):
    df = synthetic.hearing_comments(spark, 4000)
    again = synthetic.hearing_comments(spark, 4000).repartition(7)
    assert df.exceptAll(again).count() == 0
    shares = {r["role"]: r["count"] / 4000 for r in df.groupBy("role").count().collect()}
    assert set(shares) == {v for v, _ in synthetic.ROLES}
    assert all(abs(shares[v] - w / 100) < 0.03 for v, w in synthetic.ROLES)
    assert 0.05 < df.where("comment_text LIKE '%@example.org%'").count() / 4000 < 0.12
    facts = synthetic.fixture_facts(df, key="respondent_id", column="comment_text").first()
    assert facts["ids_unique"] and not facts["has_blanks"]
    assert synthetic.hearing_comments(spark, 0).count() == 0

"""Stored state: campaigns and feed dates; a filter without a query."""

from shelfspark.operators import filters
from shelfspark.streaming import jobs as streams


def test_campaign_takes_each_key_once(spark, tmp_path):
    pending = spark.range(5).withColumnRenamed("id", "k")
    tried = str(tmp_path / "tried")
    seen = [sorted(r.k for r in streams.campaign_batch(spark, pending, tried, "k", 2).collect()) for _ in range(4)]
    assert seen == [[0, 1], [2, 3], [4], []]


def test_feed_dates_are_compared_then_stored(spark, tmp_path):
    table = str(tmp_path / "state")
    def verdict(date):
        df = spark.createDataFrame([("loans", date)], "feed string, file_date string")
        return streams.record_freshness(spark, df, table).collect()[0].freshness
    assert [verdict(d) for d in ("2026-01-02", "2026-01-02", "2026-01-01", "2026-01-03")] == ["first", "same", "older", "newer"]


def test_missing_series_volume(spark):
    df = spark.createDataFrame([("97", "LIVRE", None, None), ("CB:1", "LIVRE", None, None), ("98", "LIVRE", "s", None), ("99", "CD", None, None)],
                               "i string, k string, s string, v string")
    assert [r.i for r in filters.missing_series_volume(df, "i", "k", "s", "v").collect()] == ["97"]

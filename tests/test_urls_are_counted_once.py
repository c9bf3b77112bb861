"""The URLs of mails are taken from their texts once to be scored, though features and n-grams both read them."""

from pyspark.sql import functions as F

from hookline.plans import scoring as SC


class Model:
    def score(self, df, key, url, keep):
        self.plan = df._jdf.queryExecution().optimizedPlan().toString()
        return df.select(key, *keep, F.length(url).cast("double").alias("probability"))


def test_scored_urls_are_read_from_a_table(spark):
    exploded = spark.createDataFrame([(1, 0, "http://a"), (1, 1, "http://bc"), (2, 0, "http://a"), (3, None, None)], "id long, pos int, url string")
    model = Model()
    got = SC.score_distinct_urls(exploded, model, "id").select("id", "pos", "url", "probability").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "http://a", 8.0), (1, 1, "http://bc", 9.0), (2, 0, "http://a", 8.0), (3, None, None, None)]
    assert "Aggregate" not in model.plan

"""The sample of texts from which the field of p2 is trained."""

from pyspark.sql import functions as F

from clauseweave.llm import query_language as Q


def test_sample_sorts_few_texts(spark, monkeypatch):
    d = spark.range(20_000).select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("x" * 28), F.col("id").cast("string")).alias("text"))
    long = d.where("length(text) > 30").withColumn("h", F.xxhash64("record_id", F.length("text")))
    for most in (50, 19_000, 50_000):
        monkeypatch.setattr(Q, "SAMPLE_ROWS", most)
        got = Q.sample_of(d)
        assert [r.text for r in got.collect()] == [r.text for r in long.orderBy("h").limit(most).collect()]
        assert got.columns == ["text", "lang"]
        if most == 50:
            assert "shiftright" in got._jdf.queryExecution().optimizedPlan().toString()

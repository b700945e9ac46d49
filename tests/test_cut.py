"""Checkpoints in loops."""

from pyspark.sql import functions as F

from clauseweave.llm.components import contract
from clauseweave.plans.session import cut


def estimate(df):
    return df._jdf.queryExecution().analyzed().stats().sizeInBytes()


def test_estimates_stay_bounded_over_rounds(spark):
    d = spark.range(100).withColumn("b", (F.col("id") + 1) % 100)
    for _ in range(6):
        d = cut(d.join(d.select(F.col("id").alias("b"), F.col("b").alias("c")), "b").select("id", F.col("c").alias("b")))
        assert estimate(d) <= 1 << 63
    assert {(r.id, r.b) for r in d.collect()} == {(i, (i + 2**6) % 100) for i in range(100)}


def test_contraction_keeps_its_estimate_bounded(spark):
    got = contract(spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert {(r.id, r.group_id) for r in got.collect()} == {(i, 0) for i in range(501)}

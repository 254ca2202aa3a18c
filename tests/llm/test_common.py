from pyspark.sql import functions as F

from defectlens.llm.common import may_hold


def test_no_hash_is_missed_and_few_others_are_taken(spark):
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("_at"), F.lit("x").alias("_bucket"))
    for every, others in ((10, 36_000), (40_000, 39_999)):
        told = may_hold(rows, F.col("_at"), rows.where(F.col("id") % every == 0).select("_at"), "hit")
        assert told.columns == ["id", "_at", "_bucket", "hit"]
        assert told.where(F.col("id") % every == 0).where("NOT hit").count() == 0
        assert told.where("hit").where(F.col("id") % every != 0).count() < others / 10
    assert may_hold(rows, F.col("_at"), rows.where("false").select("_at"), "hit").where("hit").count() == 0

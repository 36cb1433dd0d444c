from pyspark.sql import functions as F

from graphdrift.plans.runtime import cut


def test_large_cut_frames_are_not_broadcast_by_estimate(spark):
    wide = lambda n: cut(spark.range(n).withColumn("x", F.md5(F.col("id").cast("string"))))
    joined = wide(300_000).join(wide(400_000).withColumnRenamed("x", "y"), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("x = y").count() == 300_000
    small = cut(spark.range(10))
    assert "Broadcast" in wide(300_000).join(small, "id")._jdf.queryExecution().executedPlan().toString()

"""The skew-proof lookup joins the same rows whichever way heavy keys are found."""

from pyspark.sql import functions as F

from quillstrata.plans.skew import lookup


def test_counts_known_already_give_the_same_rows(spark):
    facts = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row"))
    facts = facts.unionByName(spark.createDataFrame([(None, 1000), (99, 1001)], "k bigint, row bigint"))
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    counted = facts.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    twice = counted.unionByName(counted.withColumn("_n", F.lit(1).cast("bigint")))
    expected = sorted(map(tuple, facts.join(table, "k", "left").select("k", "row", "v").collect()), key=repr)
    for known in (None, counted, twice):
        found = lookup(facts, table, ["k"], "row", 402, heavy_rows=20, counted=known)
        assert sorted(map(tuple, found.select("k", "row", "v").collect()), key=repr) == expected

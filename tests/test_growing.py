"""Clusters that grow by batches against one run over everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstrata.operators.clusters import cluster_ids
from quillstrata.operators.growing import GrowingClusters
from test_setjoin import made


def whole(df):
    return {r.k: r.cluster_id for r in cluster_ids(df.withColumn("t", F.coalesce("t", F.lit(""))), "t", "k").collect()}


@pytest.mark.parametrize("seed, heavy_rows", [(1, 1_000_000), (2, 5)])
def test_batches_give_the_clusters_of_a_full_run(spark, tmp_path, seed, heavy_rows):
    rows = made(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, t string")
    held = GrowingClusters(spark, str(tmp_path / "held"), heavy_rows=heavy_rows)
    cuts = [0, 7, 20, len(rows)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert held.add(spark.createDataFrame(rows[a:b], "k bigint, t string"), "t", "k") == number
        so_far = spark.createDataFrame(rows[:b], "k bigint, t string")
        assert {r.k: r.cluster_id for r in held.clusters("k").collect()} == whole(so_far)
    # Another object over the same folder goes on, a batch given twice adds nothing.
    again = GrowingClusters(spark, str(tmp_path / "held"))
    assert again.add(df, "t", "k") == 3 and {r.k: r.cluster_id for r in again.clusters("k").collect()} == whole(df)


def test_a_late_text_joins_old_clusters_and_a_cut_off_batch_is_written_anew(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    held = GrowingClusters(spark, str(tmp_path), key_type="string")
    kind = "k string, t string, root string"
    assert held.clusters().collect() == []
    held.add(spark.createDataFrame([("m", text, ""), ("z", "another text", "")], kind), "t", "k")
    # Written, but not committed.
    spark.createDataFrame([("x", "x")], "key string, root string").write.parquet(f"{tmp_path}/labels/batch=1")
    assert held.batches() == 1 and held.clusters().count() == 2
    held.add(spark.createDataFrame([("b", text, ""), ("b", text, ""), ("y", "another  text", "")], kind), "t", "k")
    held.add(spark.createDataFrame([], kind), "t", "k")
    held.add(spark.createDataFrame([("a", text, None), ("n", None, None)], kind), "t", "k")
    got = {r.key: r.cluster_id for r in held.clusters().collect()}
    assert got == {"m": "a", "b": "a", "a": "a", "z": "y", "y": "y", "n": "n"}
    plan = held.clusters()._jdf.queryExecution().executedPlan().toString()
    read = {c.split("#")[0] for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) for c in scan.split(",")}
    assert read == {"key", "root", "now"}

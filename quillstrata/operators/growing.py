"""Near-duplicate clusters of a table that grows: a batch costs its own texts, not those of the table.

Four tables lie under a folder that all executors reach.

- ``labels/batch=N``: (key, root), the root that a row's component had when the batch came;
- ``anchors/batch=N``: (bucket, root), one row for every bucket ever seen, since all rows of a bucket are in one component;
- ``merges/batch=N``: (root, now), every root that has been merged into a smaller one, with the smallest now;
- ``commits``: the numbers of finished batches. Readers look at those only, and a batch that was cut off is written anew.

A new batch is hashed, linked inside, and linked to the stored roots of its buckets, one link per bucket. Components of these links say which
new rows belong together and which old roots merge. Texts and signatures of old rows are never read.

The clusters are those of ``cluster_ids`` over all rows at once, named by their smallest key, in whatever batches the rows came.

Cases: a key that is stored already is left out, so a batch may be given twice; within a batch the first of equal keys counts (the
smallest text); null texts are taken as empty; an empty batch is a batch; before the first one there are no rows. Columns other than
key and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators.clusters import bucket_edges, connected_components
from quillstrata.operators.neardup import DEFAULT_PERMUTATIONS, DEFAULT_THRESHOLD, lsh_bands
from quillstrata.plans.skew import HEAVY_ROWS, lookup
from quillstrata.session import cut_lineage


class GrowingClusters:
    """The stored clusters under ``folder``. One writer at a time; threshold and permutations must stay the same."""

    def __init__(
        self, spark: SparkSession, folder: str, key_type: str = "bigint", threshold: float = DEFAULT_THRESHOLD,
        num_perm: int = DEFAULT_PERMUTATIONS, heavy_rows: int = HEAVY_ROWS,
    ):
        self.spark, self.folder, self.key_type = spark, folder, key_type
        self.threshold, self.num_perm, self.heavy_rows = threshold, num_perm, heavy_rows
        # Makes the table known before the first batch.
        spark.createDataFrame([], "batch int").write.mode("append").parquet(f"{folder}/commits")

    def batches(self) -> int:
        """How many batches are stored."""
        last = self.spark.read.schema("batch int").parquet(f"{self.folder}/commits").agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def _read(self, table: str, schema: str, numbers: range) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _labels(self, batches: int) -> DataFrame:
        return self._read("labels", f"key {self.key_type}, root {self.key_type}", range(batches))

    def _merges(self, batches: int) -> DataFrame:
        return self._read("merges", f"root {self.key_type}, now {self.key_type}", range(max(0, batches - 1), batches))

    def _now(self, rows: DataFrame, merges: DataFrame, spread_by: str) -> DataFrame:
        """``rows`` with ``root`` brought up to date; a root of very many rows is dealt to many tasks."""
        found = lookup(rows, merges, ["root"], spread_by, rows.count(), self.heavy_rows)
        return found.withColumn("root", F.coalesce("now", "root")).drop("now")

    def add(self, df: DataFrame, text_col: str, key: str) -> int:
        """Store a batch and return its number."""
        number = self.batches()
        known = self._labels(number).select("key")
        body = F.coalesce(F.col(text_col), F.lit("")).alias("text")
        fresh = df.select(F.col(key).cast(self.key_type).alias("key"), body).join(known, "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
        bands = cut_lineage(lsh_bands(fresh, "text", "key", self.threshold, self.num_perm))
        keys = cut_lineage(bands.select("key").distinct())
        firsts = bands.groupBy("bucket").agg(F.min("key").alias("first"))
        anchors = self._read("anchors", f"bucket binary, root {self.key_type}", range(number))
        # One row per bucket on either side.
        buckets = cut_lineage(firsts.join(anchors, "bucket", "left"))
        met = buckets.where(F.col("root").isNotNull()).select("first", "root")
        merges = self._merges(number)
        links = cut_lineage(self._now(met, merges, "first").distinct())
        both = links.select(F.greatest("first", "root").alias("src"), F.least("first", "root").alias("dst"))
        inside = bucket_edges(bands, "key").select("src", "dst")
        moved = cut_lineage(connected_components(inside.unionByName(both.where(F.col("src") != F.col("dst")))).select(F.col("id").alias("key"), F.col("root").alias("to")))

        labels = keys.join(moved, "key", "left").select("key", F.coalesce("to", "key").alias("root"))
        labels = cut_lineage(labels)
        old_roots = links.select(F.col("root").alias("key")).distinct()
        merged = moved.join(old_roots, "key", "left_semi").select(F.col("key").alias("root"), F.col("to").alias("now"))
        # What was merged before may have been merged again.
        again = merged.select(F.col("root").alias("now"), F.col("now").alias("to"))
        earlier = lookup(merges, again, ["now"], "root", merges.count(), self.heavy_rows).select("root", F.coalesce("to", "now").alias("now"))
        unseen = buckets.where(F.col("root").isNull()).select("bucket", F.col("first").alias("key"))
        new_anchors = lookup(unseen, labels, ["key"], "bucket", unseen.count(), self.heavy_rows).select("bucket", "root")
        for table, rows in (("anchors", new_anchors), ("merges", earlier.unionByName(merged)), ("labels", labels)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={number}")
        self.spark.createDataFrame([(number,)], "batch int").write.mode("append").parquet(f"{self.folder}/commits")
        return number

    def add_all(self, batches: list[DataFrame], text_col: str, key: str) -> DataFrame:
        """Store several batches and return the clusters."""
        reduce(lambda _, df: self.add(df, text_col, key), batches, 0)
        return self.clusters(key)

    def clusters(self, key: str = "key") -> DataFrame:
        """(key, cluster_id) of every stored row: the smallest key of its cluster."""
        stored = self.batches()
        now = self._now(self._labels(stored), self._merges(stored), "key")
        return now.select(F.col("key").alias(key), F.col("root").alias("cluster_id"))

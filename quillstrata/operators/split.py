"""Cluster-grouped splitting, sampling and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.hashing import order_key
from quillstrata.operators.clusters import cluster_sizes
from quillstrata.operators.profile import percent
from quillstrata.plans.ordered_fill import fill_steps, in_steps
from quillstrata.plans.skew import HEAVY_ROWS, lookup
from quillstrata.session import cut_lineage

SPLITS = ["train", "val", "test"]


def seeded_cluster_order(clustered: DataFrame, seed: int = 42) -> DataFrame:
    """(cluster_id, size, key, position): clusters in seeded order, positions from 0.

    Keys are uniform md5 values, so rows are ranked inside the 65,536 even groups of their four leading digits and shifted
    by the counts of the groups before: those with the same two digits by a running sum, the others by their totals.
    """
    sizes = cluster_sizes(clustered).withColumn("key", order_key(seed, F.col("cluster_id")))
    headed = sizes.withColumn("head", F.substring("key", 1, 4))
    counts = headed.groupBy("head").agg(F.count(F.lit(1)).alias("n")).withColumn("lead", F.substring("head", 1, 2))
    # At most 256 totals, which fit one row.
    totals = counts.groupBy("lead").agg(F.sum("n").alias("n"))
    listed = totals.agg(F.collect_list(F.struct("lead", "n")).alias("totals")).scalar()
    earlier = F.aggregate(
        "totals", F.lit(0).cast("bigint"), lambda acc, t: acc + F.when(t["lead"] < F.col("lead"), t["n"]).otherwise(0)
    )
    near = F.sum("n").over(Window.partitionBy("lead").orderBy("head")) - F.col("n")
    offsets = counts.withColumn("totals", listed).select("head", (earlier + near).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("head").orderBy("key", "cluster_id")) - 1
    ranked = headed.withColumn("inside", inside).join(F.broadcast(offsets), "head")
    return ranked.select("cluster_id", "size", "key", (F.col("offset") + F.col("inside")).alias("position"))


def _check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {ratios}")


def assign_clusters(
    clusters: DataFrame, total_rows: int, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """(cluster_id, size, split): in seeded order into train if it fits, else into val if it fits, else into test."""
    items = cut_lineage(
        clusters.select("cluster_id", "size", order_key(seed, F.col("cluster_id")).alias("key"))
    )
    key, size = F.col("key"), F.col("size")
    in_train = in_steps(fill_steps(items, int(total_rows * train_ratio)), key, size)
    refused = items.where(~in_train)
    in_val = in_steps(fill_steps(refused, int(total_rows * val_ratio)), key, size)
    split = F.when(in_train, "train").when(in_val, "val").otherwise("test")
    return items.select("cluster_id", "size", split.alias("split"))


def assign_split(
    clustered: DataFrame, clusters: DataFrame, key: str, total_rows: int, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Carry ``split`` from clusters to rows; a cluster with a large share of the rows is dealt to many tasks."""
    return lookup(clustered, clusters.select("cluster_id", "split"), ["cluster_id"], key, total_rows, heavy_rows)


def grouped_split(
    clustered: DataFrame,
    key: str,
    train_ratio: float = 0.80,
    val_ratio: float = 0.10,
    test_ratio: float = 0.10,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` so that no cluster is in two splits. ``clustered`` should be materialized."""
    _check_ratios(train_ratio, val_ratio, test_ratio)
    total = clustered.count()
    clusters = assign_clusters(cluster_sizes(clustered), total, train_ratio, val_ratio, seed)
    return assign_split(clustered, clusters, key, total)


def split_audit(df: DataFrame) -> DataFrame:
    """One row: rows and clusters per split, clusters shared by each pair of splits, and the verdict."""
    per_cluster = df.groupBy("cluster_id").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])

    def both(a: str, b: str) -> Column:
        return F.count_if((F.col(a) > 0) & (F.col(b) > 0))

    overlaps = {
        "train_val_overlap": both("train", "val"),
        "train_test_overlap": both("train", "test"),
        "val_test_overlap": both("val", "test"),
    }
    leaked = sum(overlaps.values(), F.lit(0).cast("bigint"))
    return per_cluster.agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_rows") for s in SPLITS],
        *[F.count_if(F.col(s) > 0).alias(f"{s}_clusters") for s in SPLITS],
        *[c.alias(name) for name, c in overlaps.items()],
        leaked.alias("leakage_overlap"),
        (leaked == 0).alias("is_leakage_free"),
    )


def require_leak_free(audit: DataFrame) -> dict:
    """The audit as a dict; raises when any cluster is in two splits."""
    row = audit.first().asDict()
    if not row["is_leakage_free"]:
        raise ValueError(f"leakage between splits: {row}")
    return row


def split_shares(df: DataFrame) -> DataFrame:
    """(split, rows, percentage, clusters)."""
    cells = df.groupBy("split", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    shares = cells.groupBy("split").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    total = shares.agg(F.sum("rows").alias("n")).scalar()
    return shares.select("split", "rows", percent(F.col("rows"), total).alias("percentage"), "clusters")


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows without replacement, the same ones every time: a top-k by hash."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def naive_random_split(df: DataFrame, key: str, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``split`` (train/test) by a seeded shuffle of rows, clusters ignored.

    ``key`` should tell rows apart. Rows that share one cannot be: they go to train together if all of them fit, else to test.
    """
    hashed = df.select(order_key(seed, F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key"))
    keys = cut_lineage(hashed.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    total, most = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    steps = fill_steps(keys, int(total * train_ratio))
    name = order_key(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    if most == 1:
        return df.withColumn("split", F.when(in_steps(steps, name, F.lit(1)), "train").otherwise("test"))
    # Group sizes are needed beside the rows; a large group is one row of the table looked up.
    placed = keys.select(F.col("key").alias("_key"), F.when(in_steps(steps, F.col("key"), F.col("size")), "train").otherwise("test").alias("split"))
    rows = df.withColumn("_key", name)
    return lookup(rows, placed, ["_key"], key, total).drop("_key")


def hash_split(df: DataFrame, key: str, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split`` by where the row's hash falls in 0...1: no shuffle, and a row keeps its split as the table grows.

    With the cluster number as ``key`` clusters stay whole. Shares are met on average only.
    """
    _check_ratios(train_ratio, val_ratio, 1 - train_ratio - val_ratio)
    place = F.conv(F.substring(order_key(seed, F.col(key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    split = F.when(place < train_ratio, "train").when(place < train_ratio + val_ratio, "val").otherwise("test")
    return df.withColumn("split", split)


def leakage_share(df: DataFrame) -> DataFrame:
    """(test_rows, leaked_rows, leaked_percentage): test rows whose cluster also has rows in train."""
    per_cluster = df.groupBy("cluster_id").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )
    test = F.coalesce(F.sum("test"), F.lit(0))
    leaked = F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("test"))), F.lit(0))
    return per_cluster.agg(
        test.alias("test_rows"), leaked.alias("leaked_rows"), percent(leaked, test).alias("leaked_percentage")
    )

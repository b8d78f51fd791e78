"""Grouped splitting with the same label shares in every split.

A cluster belongs to the label most of its rows have (ties: the smallest label). Within a label, clusters stand in seeded order, those
with over a hundredth of the label's rows first, and each goes to the split in which the middle of its stretch of rows lies.

Bound: a split's share of a label's rows is off its target by no more than half of the cluster at each of its borders, a two-hundredth
per border unless the large clusters alone reach beyond the border, plus the rows that have another label than their cluster.
``label_balance`` measures what came out.

The order is never taken in one task: keys are uniform, so clusters are ranked within the groups of their leading digits and shifted by
the sums of the groups before.

Cases: null labels are one label, the empty text; null clusters are one cluster; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.hashing import order_key
from quillstrata.operators.split import SPLITS, _check_ratios
from quillstrata.plans.skew import lookup
from quillstrata.session import cut_lineage

# A cluster is large when it has more than one part in this many of its label's rows.
LARGE_PART = 100


def label_profiles(clustered: DataFrame, label_col: str) -> DataFrame:
    """(cluster_id, label, size): every cluster with its most frequent label. Counted map-side, so a hot cluster is as cheap as any."""
    label = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    cells = clustered.groupBy("cluster_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("less"), "label"))
    return cells.groupBy("cluster_id").agg(most["label"].alias("label"), F.sum("n").alias("size"))


def balanced_clusters(
    clustered: DataFrame, label_col: str, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """(cluster_id, label, size, split): where the middle of each cluster lies within its label."""
    sizes = cut_lineage(label_profiles(clustered, label_col))
    totals = sizes.groupBy("label").agg(F.sum("size").alias("total"))
    sized = lookup(sizes, totals, ["label"], "cluster_id", sizes.count())
    name = order_key(seed, F.coalesce(F.col("cluster_id").cast("string"), F.lit("")))
    place = F.concat(F.when(F.col("size") * LARGE_PART > F.col("total"), "0").otherwise("1"), name)
    headed = cut_lineage(sized.withColumn("place", place).withColumn("head", F.substring("place", 1, 5)))
    # At most 131,072 groups of each label.
    groups = headed.groupBy("label", "head").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("label").orderBy("head")) - F.col("held")
    offsets = groups.select("label", "head", before.alias("before"))
    earlier = Window.partitionBy("label", "head").orderBy("place", "cluster_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = headed.withColumn("upto", F.sum("size").over(earlier)).join(offsets, ["label", "head"])
    # Twice the middle of the cluster, a whole number.
    middle = (F.col("before") + F.col("upto")) * 2 - F.col("size")
    split = (
        F.when(middle <= F.col("total") * F.lit(2 * train_ratio), "train")
        .when(middle <= F.col("total") * F.lit(2 * (train_ratio + val_ratio)), "val")
        .otherwise("test")
    )
    return ranked.select("cluster_id", "label", "size", split.alias("split"))


def balanced_split(
    clustered: DataFrame,
    key: str,
    label_col: str,
    train_ratio: float = 0.80,
    val_ratio: float = 0.10,
    test_ratio: float = 0.10,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: no cluster is in two splits, and every label has about the same share of each. ``clustered`` should be materialized."""
    _check_ratios(train_ratio, val_ratio, test_ratio)
    placed = cut_lineage(balanced_clusters(clustered, label_col, train_ratio, val_ratio, seed).select("cluster_id", "split"))
    held = placed.where(F.col("cluster_id").isNotNull())
    rows = lookup(clustered, held, ["cluster_id"], key, clustered.count())
    # A join never meets a null; its cluster, if there is one, is one row.
    null_split = placed.where(F.col("cluster_id").isNull()).agg(F.max("split").alias("split")).scalar()
    return rows.withColumn("split", F.coalesce("split", null_split))


def label_balance(
    df: DataFrame, label_col: str, train_ratio: float = 0.80, val_ratio: float = 0.10, test_ratio: float = 0.10
) -> DataFrame:
    """(label, split, rows, share, target, deviation) of every label and split, those without rows too; shares to six decimals."""
    targets = dict(zip(SPLITS, (train_ratio, val_ratio, test_ratio)))
    label = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])

    def cell(split: str):
        share = F.col(split) / F.col("total")
        return F.struct(
            F.lit(split).alias("split"), F.col(split).alias("rows"), F.round(share, 6).alias("share"),
            F.lit(float(targets[split])).alias("target"), F.round(F.abs(share - F.lit(float(targets[split]))), 6).alias("deviation"),
        )

    return counts.select("label", F.inline(F.array(*[cell(s) for s in SPLITS])))

"""Grouped splitting by label: whole clusters, shares within the stated bound, the walk of a plain loop."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstrata.operators.balanced import balanced_split, label_balance, label_profiles
from quillstrata.operators.split import split_audit

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def made(seed, rows=3000, mixed=0.0):
    draw = random.Random(seed)
    out, cluster = [], 0
    while len(out) < rows:
        label = draw.choice(["a"] * 6 + ["b"] * 3 + ["c", None])
        for _ in range(draw.choice([1, 1, 1, 2, 5, 40])):
            other = draw.choice(["a", "b", "c"]) if draw.random() < mixed else label
            out.append((len(out), cluster, other))
        cluster += 1
    return out


def walk(rows, seed=42):
    cells = defaultdict(Counter)
    for _, cluster, label in rows:
        cells[cluster][label or ""] += 1
    by_label = defaultdict(list)
    for cluster, counts in cells.items():
        main = min(counts, key=lambda c: (-counts[c], c))
        by_label[main].append((cluster, sum(counts.values())))
    split = {}
    for members in by_label.values():
        total, before = sum(s for _, s in members), 0
        for cluster, size in sorted(members, key=lambda m: (m[1] * 100 <= total, hashlib.md5(f"{seed}:{m[0]}".encode()).hexdigest())):
            middle = 2 * before + size
            split[cluster] = "train" if middle <= total * 1.6 else "val" if middle <= total * 1.8 else "test"
            before += size
    return split


@pytest.mark.parametrize("seed, mixed", [(1, 0.0), (2, 0.1), (3, 0.4)])
def test_split_is_the_walk_and_keeps_clusters(spark, seed, mixed):
    rows = made(seed, mixed=mixed)
    df = spark.createDataFrame(rows, "k bigint, cluster_id bigint, label string").repartition(3)
    out = balanced_split(df, "k", "label").cache()
    expected = walk(rows)
    assert {(r.k, r.split) for r in out.collect()} == {(k, expected[c]) for k, c, _ in rows}
    assert split_audit(out).first().is_leakage_free


def test_shares_are_within_the_bound(spark):
    rows = made(5, rows=6000, mixed=0.05)
    df = spark.createDataFrame(rows, "k bigint, cluster_id bigint, label string")
    main = {r.cluster_id: r.label for r in label_profiles(df, "label").collect()}
    sizes, strange, totals = Counter(c for _, c, _ in rows), Counter(), Counter(label or "" for _, _, label in rows)
    for _, cluster, label in rows:
        if main[cluster] != (label or ""):
            strange[label or ""] += 1
            strange[main[cluster]] += 1
    largest = {label: max(s for c, s in sizes.items() if main[c] == label) for label in totals}
    cells = label_balance(balanced_split(df, "k", "label"), "label").collect()
    assert len(cells) == 3 * len(totals) and sum(r.rows for r in cells) == len(rows)
    for r in cells:
        assert r.target == RATIOS[r.split] and abs(abs(r.share - r.target) - r.deviation) < 2e-6
        assert r.deviation * totals[r.label] <= largest[r.label] + strange[r.label] + 1


def test_a_cluster_with_a_third_of_the_rows_and_null_clusters(spark):
    rows = [(i, 0, "a") for i in range(1000)] + [(i, i, "a" if i % 2 else "b") for i in range(1000, 2900)] + [(i, None, "b") for i in range(2900, 3000)]
    df = spark.createDataFrame(rows, "k bigint, cluster_id bigint, label string")
    out = balanced_split(df, "k", "label")
    assert out.where("split is null").count() == 0 and out.count() == 3000
    assert out.where("cluster_id = 0").select("split").distinct().collect()[0].split == "train"
    assert out.where("cluster_id is null").select("split").distinct().count() == 1
    assert label_balance(out, "label").agg(F.max("deviation")).first()[0] < 0.06


def test_empty_table_and_wrong_ratios(spark):
    df = spark.createDataFrame([], "k bigint, cluster_id bigint, label string")
    assert balanced_split(df, "k", "label").collect() == [] and label_balance(df.withColumn("split", F.lit("train")), "label").collect() == []
    with pytest.raises(ValueError):
        balanced_split(df, "k", "label", 0.5, 0.1, 0.1)

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import split as S
from quillstrata.operators.clusters import cluster_size_histogram
from quillstrata.plans import ordered_fill
from quillstrata.plans.ordered_fill import fill_steps, in_steps


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_split(sizes, total, train, val, seed=42):
    out, filled = {}, {"train": 0, "val": 0}
    limits = {"train": int(total * train), "val": int(total * val)}
    for c in sorted(sizes, key=lambda c: md5(f"{seed}:{c}")):
        for name in ("train", "val"):
            if filled[name] + sizes[c] <= limits[name]:
                filled[name] += sizes[c]
                out[c] = name
                break
        else:
            out[c] = "test"
    return out


def clustered(spark, sizes):
    rows = [(c * 1000 + i, c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id long, cluster_id long")


@pytest.mark.parametrize("seed", range(4))
def test_grouped_split_matches_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    sizes = {c: rng.choice([1, 1, 1, 2, 5, 40, 90]) for c in range(rng.randrange(5, 120))}
    df = clustered(spark, sizes)
    got = S.grouped_split(df, "id", 0.6, 0.3, 0.1)
    expected = plain_split(sizes, sum(sizes.values()), 0.6, 0.3)
    rows = got.collect()
    assert len(rows) == sum(sizes.values())
    assert all(r.split == expected[r.cluster_id] for r in rows)
    assert S.require_leak_free(S.split_audit(got))["is_leakage_free"]
    moved = {r.id: r.split for r in S.grouped_split(df.repartition(7), "id", 0.6, 0.3, 0.1).collect()}
    assert moved == {r.id: r.split for r in rows}


def test_fill_descends_digit_by_digit(spark, monkeypatch):
    monkeypatch.setattr(ordered_fill, "GROUPS", 2)
    rng = random.Random(9)
    items = [(md5(str(i)), rng.randrange(1, 30)) for i in range(500)]
    df = spark.createDataFrame(items, "key string, size long").cache()
    for room in (0, 1, 777, 3000, 10**6):
        steps = fill_steps(df, room)
        left, expected = room, set()
        for k, s in sorted(items):
            if s <= left:
                left -= s
                expected.add(k)
        got = {r.key for r in df.where(in_steps(steps, F.col("key"), F.col("size"))).collect()}
        assert got == expected


def test_oversized_cluster_and_empty_input(spark):
    got = S.grouped_split(clustered(spark, {1: 90, 2: 5, 3: 5}), "id")
    assert {r.cluster_id: r.split for r in got.collect()}[1] == "test"
    empty = clustered(spark, {1: 1}).where("false")
    assert S.grouped_split(empty, "id").count() == 0
    assert S.split_audit(S.grouped_split(empty, "id")).first().train_rows == 0
    with pytest.raises(ValueError):
        S.grouped_split(empty, "id", 0.5, 0.1, 0.1)


def test_audit_reports_and_raises(spark):
    df = spark.createDataFrame([(1, 1, "train"), (2, 1, "test"), (3, 2, "val")], "id long, cluster_id long, split string")
    row = S.split_audit(df).first()
    assert (row.train_test_overlap, row.train_val_overlap, row.leakage_overlap, row.is_leakage_free) == (1, 0, 1, False)
    with pytest.raises(ValueError):
        S.require_leak_free(S.split_audit(df))
    leak = S.leakage_share(df).first()
    assert (leak.test_rows, leak.leaked_rows, leak.leaked_percentage) == (1, 1, 100.0)


def test_order_positions(spark):
    df = clustered(spark, {c: 1 + c % 3 for c in range(300)})
    rows = S.seeded_cluster_order(df).collect()
    expected = sorted(range(300), key=lambda c: md5(f"42:{c}"))
    assert [r.cluster_id for r in sorted(rows, key=lambda r: r.position)] == expected
    assert [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(300))
    assert {r["size"]: r.clusters for r in cluster_size_histogram(df).collect()} == {1: 100, 2: 100, 3: 100}


def test_many_rows_of_one_key_end(spark):
    df = spark.range(6000).select(F.lit(7).alias("id")).union(spark.range(100, 140).select(F.col("id").cast("int")))
    rows = S.naive_random_split(df, "id", 0.5).groupBy("id", "split").count().collect()
    by_key = {r.id: (r.split, r["count"]) for r in rows}
    assert by_key[7] == ("test", 6000) and len(by_key) == 41
    assert all(split == "train" for key, (split, _) in by_key.items() if key != 7)
    same = spark.range(5000).select(F.lit(md5("x")).alias("key"), F.lit(1).cast("bigint").alias("size"))
    assert fill_steps(same, 10)[0].before == md5("x")


def test_hash_split_is_stateless(spark):
    df = spark.range(4000)
    first = {r.id: r.split for r in S.hash_split(df, "id", 0.6, 0.3).collect()}
    again = {r.id: r.split for r in S.hash_split(spark.range(6000), "id", 0.6, 0.3).collect()}
    assert all(again[i] == s for i, s in first.items())
    assert abs(sum(s == "train" for s in first.values()) - 2400) < 120 and set(first.values()) == {"train", "val", "test"}


def test_samples_and_naive_split(spark):
    df = spark.range(997).select(F.col("id"))
    first = [r.id for r in S.fixed_sample(df, 50, "id").collect()]
    assert first == [r.id for r in S.fixed_sample(df.repartition(9), 50, "id").collect()] and len(set(first)) == 50
    assert S.fixed_sample(df, 5000, "id").count() == 997
    naive = S.naive_random_split(df, "id", 0.8).collect()
    train = {r.id for r in naive if r.split == "train"}
    assert train == set(sorted(range(997), key=lambda i: md5(f"42:{i}"))[:797])
    shares = {r.split: r.rows for r in S.split_shares(S.naive_random_split(df, "id").withColumn("cluster_id", F.col("id"))).collect()}
    assert shares == {"train": 797, "test": 200}

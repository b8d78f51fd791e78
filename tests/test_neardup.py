import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quillstrata.functions.hashing import MERSENNE_31, band_shape, permutations, word_weights
from quillstrata.operators import clusters as C
from quillstrata.operators import neardup as N
from quillstrata.plans.skew import lookup
from quillstrata.session import cut_lineage


def bands_frame(spark, buckets):
    rows = [(i, bytes(b)) for b, ids in buckets.items() for i in ids]
    return spark.createDataFrame(rows, "doc_id long, bucket binary")


def random_buckets(seed, nodes, count, largest=4):
    rng = random.Random(seed)
    return {(k // 256, k % 256): rng.sample(range(nodes), rng.randrange(1, largest)) for k in range(count)}


def plain_components(nodes, buckets):
    parent = list(range(nodes))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in buckets.values():
        for other in ids[1:]:
            a, b = find(ids[0]), find(other)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(nodes)}


def plain_star(nodes, buckets):
    near = defaultdict(set)
    for ids in buckets.values():
        for i in ids:
            near[i].update(ids)
    cluster = {}
    for i in range(nodes):
        if i in cluster:
            continue
        for j in near[i] | {i}:
            cluster.setdefault(j, i)
    return cluster


@pytest.mark.parametrize("seed,nodes,count,parts", [(1, 60, 40, 4096), (2, 200, 150, 3), (3, 50, 90, 1), (4, 300, 140, 7)])
def test_components_match_union_find(spark, seed, nodes, count, parts):
    buckets = random_buckets(seed, nodes, count)
    edges = C.bucket_edges(bands_frame(spark, buckets), "doc_id", parts)
    got = {r.id: r.root for r in C.connected_components(edges).collect()}
    expected = plain_components(nodes, buckets)
    assert {x: got.get(x, x) for x in range(nodes)} == expected


def test_components_of_a_long_chain_with_heavy_keys(spark):
    buckets = {(0, k): [k, k + 1] for k in range(60)} | {(1, 0): list(range(100, 160)) + [59]}
    edges = C.bucket_edges(bands_frame(spark, buckets), "doc_id", 2)
    got = {r.id: r.root for r in C.connected_components(edges, heavy_rows=5).collect()}
    assert set(got.values()) == {0} and len(got) == 120


@pytest.mark.parametrize("seed,nodes,count,heavy", [(1, 40, 30, 10**6), (2, 80, 80, 10**6), (3, 60, 50, 3)])
def test_star_matches_the_sequential_walk(spark, seed, nodes, count, heavy):
    buckets = random_buckets(seed, nodes, count, 5)
    got = {r.id: r.root for r in C.star_clusters(bands_frame(spark, buckets), "doc_id", heavy_rows=heavy).collect()}
    assert {x: got.get(x, x) for x in range(nodes)} == plain_star(nodes, buckets)


def test_star_in_hash_order_matches_the_walk_in_that_order(spark):
    import hashlib

    buckets = random_buckets(6, 60, 60, 5)
    place = {i: hashlib.md5(f"3:{i}".encode()).hexdigest() for i in range(60)}
    rank = {i: k for k, i in enumerate(sorted(place, key=place.get))}
    back = {k: i for i, k in rank.items()}
    expected = plain_star(60, {b: [rank[i] for i in ids] for b, ids in buckets.items()})
    got = {r.id: r.root for r in C.star_clusters(bands_frame(spark, buckets), "doc_id", seed=3).collect()}
    assert {x: got.get(x, x) for x in range(60)} == {back[a]: back[b] for a, b in expected.items()}


def test_chain_parts_under_star_only(spark):
    bands = bands_frame(spark, {(0, 1): [0, 1], (0, 2): [1, 2]})
    assert {r.id: r.root for r in C.star_clusters(bands, "doc_id").collect()} == {0: 0, 1: 0, 2: 2}
    roots = C.connected_components(C.bucket_edges(bands, "doc_id"))
    assert {r.id: r.root for r in roots.collect()} == {1: 0, 2: 0}


def test_one_hot_bucket_stays_linear(spark):
    n = 3000
    bands = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(b"hot").alias("bucket"))
    edges = C.bucket_edges(bands, "doc_id", parts=16)
    assert edges.count() == n - 1
    assert {r.root for r in C.connected_components(edges).collect()} == {0}
    anchors = N.near_dup_candidates(bands, "doc_id", heavy_rows=100)
    assert anchors.count() == n - 1 and anchors.select("anchor_id").distinct().count() == 1


def test_signature_matches_a_plain_loop(spark):
    import hashlib

    texts = ["", "x", " ".join(["long"] * 40_000), "one", "one two", "a b c d e f", "a b c a b c a b c", "A  B\tC d", *[" ".join(map(str, range(k, k + 90))) for k in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    draws, weights = permutations(16), word_weights()

    def base(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    for r in N.minhash_signature(df.repartition(2), "t", "id", 16).collect():
        words = texts[r.id].lower().split()
        if len(words) < 3:
            hashes = [base(" ".join(words))]
        else:
            hashes = [sum(base(w) * c for w, c in zip(words[i:], weights)) % MERSENNE_31 for i in range(len(words) - 2)]
        assert r.signature == [min((a * h + b) % MERSENNE_31 for h in hashes) for a, b in draws]


def test_band_shapes():
    assert [band_shape(0.8, 64), band_shape(0.8, 128), band_shape(0.7, 64)] == [(5, 11), (9, 13), (8, 8)]


def test_clusters_of_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(10, base), (3, base + " tail"), (7, "quite another text about nothing"), (8, ""), (9, None), (11, base.upper())]
    df = spark.createDataFrame(rows, "id long, t string")
    for mode in ("components", "star"):
        got = {r.id: r.cluster_id for r in C.cluster_ids(df, "t", "id", mode=mode).collect()}
        assert got == {3: 3, 10: 3, 11: 3, 7: 7, 8: 8, 9: 8}
    again = {r.id: r.cluster_id for r in C.cluster_ids(df.repartition(5), "t", "id").collect()}
    assert again == got
    queries = spark.createDataFrame([(1, base), (2, "unseen words here only")], "q long, t string")
    found = N.near_dup_lookup(queries.union(queries), "t", "q", df, "t", "id").collect()
    assert {tuple(r) for r in found} == {(1, 2, 3, 1), (1, 2, 10, 2)}
    links = spark.createDataFrame([(10, 3), (11, 3), (7, 3), (9, 8)], "id long, anchor_id long")
    kept = {(r.id, r.anchor_id): (r.shared, r.total) for r in N.jaccard_verify(links, df, "t", "id").collect()}
    assert kept == {(10, 3): (58, 59), (11, 3): (58, 59), (9, 8): (1, 1)}
    ordered = {r.id: r.cluster_id for r in C.cluster_ids(df, "t", "id", mode="star", star_seed=7).collect()}
    assert ordered[3] == ordered[10] == ordered[11] and ordered[8] == ordered[9] and ordered[7] == 7
    with pytest.raises(ValueError):
        C.cluster_ids(df, "t", "id", mode="other")


def test_lookup_splits_heavy_keys_without_loss(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    table = spark.createDataFrame([(1, "hot"), (800, "cold"), (5000, "none")], "k long, v string")
    got = lookup(facts, table, ["k"], "id", 1000, heavy_rows=50)
    assert got.count() == 1000
    counts = {r.v: r["count"] for r in got.groupBy("v").count().collect()}
    assert counts == {"hot": 700, "cold": 1, None: 299}


def test_verified_links_lose_no_connection(spark):
    def jaccard(a, b):
        return len(a & b) / len(a | b)

    # 1 is far from all; 2 and 3 are alike; 4 is like 3 but not like 2; 6 is a copy of 5, alone; 7 to 30 are a template.
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[k : k + 50]) for k in (0, 4, 8)]
    template = [" ".join([f"t{i}" for i in range(50)] + [f"x{k}"]) for k in range(24)]
    texts = ["far from all of them", *chain, "alone with a copy", "alone  with a COPY", *template]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string")
    bands = df.select("id", F.lit(b"hot").alias("bucket"))
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.lower().split()) for i, t in enumerate(texts, 1))}
    real = {(b, a) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert (3, 2) in real and (4, 3) in real and (4, 2) not in real
    for pair_rows in (1000, 4):
        found = {(r.id, r.anchor_id): r.jaccard for r in C.verified_links(bands, df, "t", "id", pair_rows=pair_rows).collect()}
        assert set(found) <= real and all(abs(v - jaccard(sets[b], sets[a])) < 1e-5 for (b, a), v in found.items())

        def groups(pairs):
            root = {i: i for i in sets}
            for _ in root:
                for b, a in pairs:
                    root[b] = root[a] = min(root[b], root[a])
            return root

        assert groups(found) == groups(real)
        assert len(found) < len(real) / 2
    star = N.near_dup_candidates(bands, "id")
    assert N.jaccard_verify(star, df, "t", "id").count() == 0


def test_lookup_groups_have_their_members(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(10, base), (3, base + " tail"), (7, "quite another text about nothing"), (11, base.upper()), (12, base)]
    df = spark.createDataFrame(rows, "id long, t string")
    for options in ({}, {"heavy_rows": 2}):
        members = {r.id: r.first for r in N.signature_members(df, "t", "id", **options).collect()}
        assert members == {3: 3, 7: 7, 10: 10, 11: 10, 12: 10}


def test_members_rebuild_the_sizes_of_a_lookup(spark, sf_dir):
    found = queries()["near_dup_lookup"](spark, sf_dir).collect()
    members = queries()["near_dup_members"](spark, sf_dir).collect()
    sizes = Counter((r.side, r.first) for r in members)
    assert len({(r.side, r.key) for r in members}) == len(members)
    assert all(sizes["query", r.query_first] == r.query_size and sizes["corpus", str(r.corpus_first)] == r.corpus_size for r in found)
    assert {r.key for r in members if r.side == "corpus"} == {str(r.doc_id) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_rounds_of_joins_keep_the_estimate_of_their_size_bounded(spark):
    table = cut_lineage(spark.createDataFrame([(i, "a") for i in range(3)], "id bigint, text string"))
    for _ in range(8):
        table = cut_lineage(table.join(table.select("id", F.col("text").alias("other")), "id").select("id", F.col("other").alias("text")))
    # Squared in every round, it had thousands of digits; no plan may depend on them.
    assert table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 130
    assert sorted(tuple(r) for r in table.collect()) == [(i, "a") for i in range(3)]


def test_pairs_that_sketches_rule_out_are_not_listed(spark, monkeypatch):
    # Forty texts of one bucket: every two share two thirds of their words, two of them nearly all.
    shared = [f"s{i}" for i in range(80)]
    texts = [" ".join(shared + [f"x{k}.{i}" for i in range(40)]) for k in range(40)] + [" ".join(shared + [f"x7.{i}" for i in range(38)])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    bands = cut_lineage(df.select("id", F.lit(b"hot").alias("bucket")))
    listed = []

    def verify(links, *args, **named):
        listed.append(links.count())
        return N.verify_sets(links, *args, **named)

    monkeypatch.setattr(C, "verify_sets", verify)
    assert [(r.id, r.anchor_id) for r in C.verified_links(bands, df, "t", "id", pair_rows=10).collect()] == [(40, 7)]
    assert sum(listed) <= 5


def test_sketches_never_rule_out_a_similar_pair(spark):
    draw = random.Random(3)
    pairs = []
    for _ in range(300):
        size = draw.choice([1, 3, 40, 700, 5000])
        one = [draw.getrandbits(63) - 2**62 for _ in range(size)]
        other = one[draw.randint(0, size // 5 + 1) :] + [draw.getrandbits(63) for _ in range(draw.randint(0, size // 5 + 1))]
        pairs.append((one, other or one))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").withColumns({"sa": N.set_sketch("a"), "sb": N.set_sketch("b")})
    for threshold in (0.5, 0.8, 1.0):
        judged = df.select("a", "b", N.may_reach(F.size("a"), F.size("b"), F.col("sa"), F.col("sb"), threshold).alias("may")).collect()
        real = [len(set(r.a) & set(r.b)) >= threshold * len(set(r.a) | set(r.b)) for r in judged]
        assert all(r.may for r, alike in zip(judged, real) if alike) and sum(r.may for r in judged) < 300

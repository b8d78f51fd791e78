"""The exact set-similarity join against all pairs."""

import math
import random
from collections import defaultdict

import pytest

from quillstrata.operators import setjoin
from quillstrata.operators.neardup import jaccard_verify, lsh_bands, near_dup_candidates
from quillstrata.session import cut_lineage


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {" ".join(words)}


def classes_of(rows, threshold):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in root}


def made(seed, families=12):
    """Families of texts with more and more words changed, a passage that all share, copies, short, empty and null texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "one two"), (6, "ONE  two")]
    for _ in range(families):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(3, 60))] + passage
        for _ in range(draw.randint(1, 9)):
            rows.append((len(rows) + 1, " ".join(words)))
            if draw.random() < 0.7:
                words = list(words)
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
    return rows


@pytest.mark.parametrize("seed, threshold, part", [(1, 0.8, 500), (2, 0.8, 3), (3, 0.6, 5), (4, 1.0, 4)])
def test_classes_are_those_of_all_pairs(spark, seed, threshold, part):
    rows = made(seed)
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(3)
    links = cut_lineage(setjoin.similar_links(df, "t", "k", threshold, part))
    sets = {k: shingles(t) for k, t in rows}
    for r in links.collect():
        shared = len(sets[r.k] & sets[r.anchor_id])
        assert (r.shared, r.total) == (shared, len(sets[r.k] | sets[r.anchor_id])) and shared >= threshold * r.total and r.anchor_id < r.k
    got = {r.k: r.class_id for r in setjoin.similar_classes(df, "t", "k", links).collect()}
    assert got == classes_of(rows, threshold)


def test_string_keys_and_an_empty_table(spark):
    rows = [("a", "x y z u"), ("b", "x y z u"), ("c", "p q r s")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {r.k: r.class_id for r in setjoin.similar_classes(df, "t", "k", setjoin.similar_links(df, "t", "k")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert setjoin.similar_links(df.where("false"), "t", "k").count() == 0


def test_recall_counts_exact_links_that_bands_connect(spark):
    df = spark.createDataFrame(made(7), "k bigint, t string")
    exact = cut_lineage(setjoin.similar_links(df, "t", "k"))
    whole = setjoin.band_recall(exact, exact, "k").first()
    assert whole.links == whole.found == exact.count() and whole.recall == 1.0
    bands = cut_lineage(lsh_bands(df, "t", "k"))
    some = jaccard_verify(cut_lineage(near_dup_candidates(bands, "k")), df, "t", "k")
    part = setjoin.band_recall(exact, some, "k").first()
    assert 0 < part.recall <= 1.0 and part.links == whole.links
    groups = defaultdict(set)
    for r in setjoin.similar_classes(df, "t", "k", some).collect():
        groups[r.class_id].add(r.k)
    inside = sum(any({r.k, r.anchor_id} <= g for g in groups.values()) for r in exact.collect())
    assert part.found == inside


def test_full_sets_go_only_to_pairs_that_sketches_allow(spark, monkeypatch):
    # All share a rare passage in their prefixes and are unlike otherwise, but for the last one.
    passage = " ".join(f"p{i}" for i in range(8))
    rows = [(k, passage + " " + " ".join(f"x{k}.{i}" for i in range(9))) for k in range(30)] + [(30, passage + " " + " ".join(f"x4.{i}" for i in range(8)))]
    listed = []

    def verify(links, *args, **named):
        listed.append(links.count())
        return verify_sets(links, *args, **named)

    verify_sets = setjoin.verify_sets
    monkeypatch.setattr(setjoin, "verify_sets", verify)
    df = spark.createDataFrame(rows, "k bigint, t string")
    assert [(r.k, r.anchor_id) for r in setjoin.similar_links(df, "t", "k", threshold=0.5, part_postings=3).collect()] == [(30, 4)]
    assert sum(listed) <= 3


def test_places_are_those_of_the_whole_order(spark):
    sets = [(1, [5, 6, 7, 8, 9]), (2, [5, 9, 20, 21, 22]), (3, [9, 5, 6, 30]), (4, [40])]
    often = {h: sum(h in s for _, s in sets) for _, s in sets for h in s}
    df = spark.createDataFrame(sets, "_id bigint, _set array<bigint>")
    for threshold in (0.2, 0.5, 0.8):
        got = {(r.id, r.shingle): (r.size, r.place) for r in setjoin.prefixes(df, threshold).collect()}
        want = {}
        for k, s in sets:
            order = sorted(s, key=lambda h: (often[h], h))[: len(s) - math.ceil(threshold * len(s) - 1e-6) + 1]
            want |= {(k, h): (len(s), i) for i, h in enumerate(order) if often[h] > 1}
        assert got == want

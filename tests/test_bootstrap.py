"""Bootstrap intervals against a plain loop, under any partitioning."""

import hashlib
import math
import random
from collections import Counter

import pytest

from quillstrata.operators.bootstrap import bootstrap_intervals, poisson_steps, replicate_pairs
from quillstrata.operators.metrics import classification_summary


def weight(key, replicate, seed):
    digest = hashlib.md5(f"{seed}:{key}:{replicate // 4}".encode()).hexdigest()
    draw = int(digest[8 * (replicate % 4) : 8 * (replicate % 4) + 8], 16)
    return sum(draw >= step for step in poisson_steps())


def scores(cells):
    support, called, hits = Counter(), Counter(), Counter()
    for (truth, guess), n in cells.items():
        support[truth] += n
        called[guess] += n
        hits[truth] += n * (truth == guess)
    labels, total = {k for k in set(support) | set(called)}, sum(support.values())
    f1 = {k: 2 * hits[k] / (support[k] + called[k]) for k in labels}
    return {
        "accuracy": sum(hits.values()) / total,
        "macro_f1": sum(f1.values()) / len(f1),
        "weighted_f1": sum(f1[k] * support[k] for k in labels) / total,
    }


def made(n=300):
    draw = random.Random(3)
    return [(i, t, t if draw.random() < 0.7 else draw.choice("abc")) for i, t in enumerate(draw.choices("abcd", [5, 3, 2, 0.1], k=n))]


@pytest.mark.parametrize("replicates, level", [(40, 0.9), (41, 0.95), (3, 0.5)])
def test_interval_is_that_of_a_plain_loop(spark, replicates, level):
    rows = made()
    drawn = []
    for replicate in range(replicates):
        cells = Counter()
        for key, truth, guess in rows:
            cells[truth, guess] += weight(key, replicate, 7)
        drawn.append(scores(+cells))
    df = spark.createDataFrame(rows, "k bigint, y_true string, y_pred string")
    got = {r.metric: r for r in bootstrap_intervals(df, "k", replicates=replicates, level=level, seed=7).collect()}
    plain = scores(Counter((t, p) for _, t, p in rows))
    tail = (1 - level) / 2
    for metric, r in got.items():
        values = sorted(d[metric] for d in drawn)
        low, high = math.floor(round((replicates - 1) * tail, 9)), math.ceil(round((replicates - 1) * (1 - tail), 9))
        expected = (plain[metric], values[low], values[high])
        assert (r.estimate, r.low, r.high) == pytest.approx(expected, abs=6e-5) and r.replicates == replicates
    assert set(got) == {"accuracy", "macro_f1", "weighted_f1"}


def test_partitioning_and_order_do_not_matter(spark):
    df = spark.createDataFrame(made(), "k bigint, y_true string, y_pred string")
    results = [sorted(bootstrap_intervals(d, "k").collect()) for d in (df.repartition(1), df.repartition(7), df.orderBy("y_pred", "k"))]
    assert results[0] == results[1] == results[2]
    summary = classification_summary(df).first()
    assert {r.metric: r.estimate for r in results[0]} == {m: summary[m] for m in ("accuracy", "macro_f1", "weighted_f1")}


def test_weights_are_poisson(spark):
    df = spark.createDataFrame([(i, "a", "a") for i in range(2000)], "k bigint, y_true string, y_pred string")
    sums = [r.n for r in replicate_pairs(df, "k", replicates=100).where("replicate >= 0").collect()]
    assert len(sums) == 100 and abs(sum(sums) / 100 - 2000) < 20
    assert 1200 < sum((s - 2000) ** 2 for s in sums) / 100 < 3200


def test_awkward_rows(spark):
    kind = "k string, y_true string, y_pred string, replicate string, n string"
    empty = bootstrap_intervals(spark.createDataFrame([], kind), "k").collect()
    assert [(r.estimate, r.low, r.high, r.replicates) for r in empty] == [(None, None, None, 0)] * 3
    one = spark.createDataFrame([(None, "a", "a", "x", "y"), (None, "a", "b", "x", "y")], kind)
    # Rows of one key go in and out together, and an empty draw is no replicate.
    for r in bootstrap_intervals(one, "k").collect():
        assert r.low == r.high == r.estimate and 0 < r.replicates < 200
    with pytest.raises(ValueError):
        bootstrap_intervals(one, "k", level=1.0)

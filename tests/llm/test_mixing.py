"""Raking, calibration and drawing against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrata.llm import mixing
from quillstrata.llm.queries import QUERIES


def plain_rake(tokens, goals, rounds=200):
    w = {c: t / sum(tokens.values()) for c, t in tokens.items()}
    for _ in range(rounds):
        for i, goal in enumerate(goals):
            sums = {}
            for c, x in w.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            w = {c: x * goal[c[i]] / sums[c[i]] for c, x in w.items()}
    return w


def test_query_meets_targets(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op5_mixing"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    tokens, odds = {}, {}
    for r in rows:
        c = (r.source, r.lang, r.topic)
        tokens[c] = tokens.get(c, 0) + r.n_tokens
        odds[c] = r.probability
    goals = []
    for i in range(3):
        sums = {}
        for c, t in tokens.items():
            sums[c[i]] = sums.get(c[i], 0) + t
        whole = sum(s**0.7 for s in sums.values())
        goals.append({v: s**0.7 / whole for v, s in sums.items()})
    weights = plain_rake(tokens, goals)
    total = sum(tokens.values())
    scale = 0.0
    for _ in range(200):
        full = {c for c in tokens if weights[c] / tokens[c] * scale >= 1}
        scale = (total / 2 - sum(tokens[c] for c in full)) / sum(w for c, w in weights.items() if c not in full)
    for c in tokens:
        assert odds[c] == pytest.approx(min(1.0, weights[c] / tokens[c] * scale), rel=1e-3)
    assert sum(odds[c] * tokens[c] for c in tokens) == pytest.approx(total / 2, rel=1e-6)
    drawn = sum(r.n_tokens for r in rows if r.sampled)
    assert drawn == pytest.approx(total / 2, rel=0.2)
    again = {r.doc_id for r in QUERIES["op5_mixing"](spark, d).collect() if r.sampled}
    assert again == {r.doc_id for r in rows if r.sampled}


def test_given_targets_nulls_and_unknown_values(spark):
    rows = [(i, "w " * (1 + i % 5), ["a", "b", None][i % 3], ["x", "y"][i % 2], "p") for i in range(120)] + [(None, None, "a", "x", "q"), (500, "", None, None, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, probability string")
    share = "value string, share double"
    targets = {
        "source": spark.createDataFrame([("a", 0.6), ("b", 0.2), ("(none)", 0.2), ("ghost", 0.5)], share).withColumnRenamed("value", "source"),
        "lang": spark.createDataFrame([("x", 0.3), ("y", 0.7)], share).withColumnRenamed("value", "lang"),
        "topic": spark.createDataFrame([("t", 1.0)], share).withColumnRenamed("value", "topic"),
    }
    mixed = mixing.mix(df, F.lit("t"), targets=targets, fraction=0.3)
    assert mixed.columns == [*df.columns, "mix"]
    found = mixed.collect()
    assert len(found) == len(rows)
    expected = {}
    for r in found:
        expected[r.mix.source] = expected.get(r.mix.source, 0) + r.mix.n_tokens * r.mix.probability
    whole = sum(expected.values())
    assert {k: round(v / whole, 4) for k, v in expected.items()} == {"a": 0.6, "b": 0.2, "(none)": 0.2}
    assert not [r for r in found if r.doc_id == 500 and r.mix.sampled]


def test_contradicting_targets_end(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens bigint")
    goal = {
        "source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"),
        "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, share double"),
    }
    raked, apart = mixing.rake(cells, goal)
    assert raked.count() == 2 and apart > 0.1


def test_calibrate_caps_at_one(spark):
    cells = spark.createDataFrame([("a", 10, 0.9), ("b", 90, 0.1)], "source string, tokens bigint, weight double")
    odds = {r.source: r.probability for r in mixing.calibrate(cells, 55.0).collect()}
    assert odds == {"a": 1.0, "b": pytest.approx(0.5)}
    assert np.allclose([r.probability for r in mixing.calibrate(cells, 1000.0).collect()], 1.0)


def test_slow_fits_reach_their_targets_and_the_deviation_is_returned(spark):
    names = "source string, lang string, tokens bigint"
    cells = spark.createDataFrame([("a", "x", 10**6), ("b", "y", 10**6), ("a", "y", 1)], names)
    goal = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"),
        "lang": spark.createDataFrame([("x", 0.45), ("y", 0.55)], "lang string, share double"),
    }
    raked, apart = mixing.rake(cells, goal)
    weights = {(r.source, r.lang): r.weight for r in raked.collect()}
    assert apart <= 1e-6
    assert weights == {("a", "x"): pytest.approx(0.45), ("b", "y"): pytest.approx(0.5), ("a", "y"): pytest.approx(0.05, rel=1e-4)}
    near = spark.createDataFrame([("a", "x", 5), ("b", "y", 7), ("a", "y", 2), ("b", "x", 3)], names)
    both = [{(r.source, r.lang): r.weight for r in mixing.rake(near, goal, held_cells=n)[0].collect()} for n in (0, 100)]
    assert both[0] == pytest.approx(both[1], rel=1e-9)
    rows = [(i, "w " * 5, s, g) for i, (s, g) in enumerate([("a", "x"), ("b", "y")] * 10)]
    contrary = {
        "source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"),
        "lang": goal["lang"],
        "topic": spark.createDataFrame([("t", 1.0)], "topic string, share double"),
    }
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"), F.lit("t"), targets=contrary)
    assert {round(r.mix.deviation, 3) for r in mixed.collect()} == {4.5}

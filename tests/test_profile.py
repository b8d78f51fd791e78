import json
import random
import re
from pathlib import Path

import numpy as np

from quillstrata.operators import profile as P
from quillstrata.sources.sinks import write_profile


def test_percentiles_match_numpy(spark):
    rng = random.Random(3)
    groups = {f"m{k}": [rng.choice([rng.randrange(9), rng.randrange(10**6), -rng.randrange(300)]) for _ in range(n)]
              for k, n in enumerate([1, 2, 3, 7, 20, 41, 101, 350, 1000])}
    df = spark.createDataFrame([(m, v) for m, vs in groups.items() for v in vs], "metric string, value long")
    for r in P.percentile_stats(df).collect():
        a = np.array(groups[r.metric])
        expected = (a.min(), int(np.percentile(a, 25)), int(np.median(a)), int(np.percentile(a, 95)),
                    int(np.percentile(a, 99)), a.max())
        assert (r["min"], r.p25, r.median, r.p95, r.p99, r["max"]) == expected, r.metric
        assert abs(r.mean - a.mean()) <= 0.0051


def test_percentiles_of_values_that_spread_far(spark):
    rng = random.Random(8)
    groups = {"wide": [rng.randrange(-(10**12), 10**12) for _ in range(800)], "whole": [-(2**63), 2**63 - 1, 0], "one": [5] * 7, "edge": [0, 4095, 4096, 4097, 2**24]}
    df = spark.createDataFrame([(m, v) for m, vs in groups.items() for v in vs if m != "whole"], "metric string, value long")
    stats = P.percentile_stats(df)
    for r in stats.collect():
        a = sorted(groups[r.metric])
        at = (len(a) - 1) * 0.25
        low, high = a[int(at)], a[min(int(at) + 1, len(a) - 1)]
        assert (r["min"], r["max"]) == (a[0], a[-1]) and abs(r.p25 - (low + (high - low) * (at - int(at)))) <= 1
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(metric" in plan.replace("#", "@").replace(" ", "") or "Window" in plan
    for window in re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert len(window.split(",")) >= 2, window


def test_lengths(spark, records):
    stats = {r.metric: r for r in P.length_stats(records).collect()}
    assert stats["instruction_words"]["max"] == 5 and stats["instruction_words"]["min"] == 0
    assert stats["response_chars"]["min"] == 3
    empty = {r.metric: r for r in P.length_stats(records.where("false")).collect()}
    assert len(empty) == 4 and empty["response_words"].mean == 0.0 and empty["response_words"]["max"] == 0


def test_distribution_ties_and_empty(spark, records):
    rows = [tuple(r) for r in P.class_distribution(records, "intent").collect()]
    assert rows[0] == ("get_refund", 2, 33.33)
    assert [r[0] for r in rows[1:]] == ["TRACK_ORDER", "cancel_order", "track_order", "x"]
    assert P.class_distribution(records.where("false"), "intent").count() == 0


def test_duplicates(spark, records):
    r = P.dedup_stats(records).first()
    assert (r.total_rows, r.unique_instructions, r.exact_duplicate_instructions) == (6, 5, 1)
    assert (r.instruction_duplicate_rate, r.unique_instruction_response_pairs, r.duplicate_pairs) == (16.67, 6, 0)
    copies = P.exact_duplicates(records, "instruction", "record_id").collect()
    assert [(c.copies, c.first_id) for c in copies] == [(2, 0)]
    assert P.dedup_stats(records.where("false")).first().instruction_duplicate_rate == 0.0


def test_slots(spark, records):
    r = P.placeholder_stats(records).first()
    assert (r.instruction_count, r.response_count) == (3, 2)
    assert r.unique_placeholders == ["Amount", "City", "Date", "Order Number"]
    nested = spark.createDataFrame([("{{{{Account Type}} {{x", "{{a}} {{a}}")], "instruction string, response string")
    names = {x.name: x.occurrences for x in P.placeholder_frequency(nested).collect()}
    assert names == {"{{Account Type": 1, "a": 2}


def test_tokens_with_a_given_tokenizer(spark, records):
    split = P.pandas_tokenizer(lambda t: len(t.split()))
    stats = {r.metric: r for r in P.token_length_stats(records, split).collect()}
    assert stats["instruction_tokens"]["max"] == 5
    # The row without a response has no total.
    cut = P.truncation_rate(records, 8, split).first()
    assert (cut.total_rows, cut.truncated_rows) == (6, 2)


def test_report_is_nested_json(spark, records, tmp_path):
    report, tables = P.profile_report(records, lists=True)
    write_profile(report, str(tmp_path / "p"), tables)
    text = "".join(p.read_text() for p in Path(tmp_path / "p" / "report").glob("*.json"))
    data = json.loads(text)
    assert data["total_records"] == 6
    assert data["intents"][0] == {"label": "get_refund", "count": 2, "percentage": 33.33}
    assert set(data["text_lengths"]) == set(P.LENGTH_METRICS) and set(data["token_lengths"]) == set(P.TOKEN_METRICS)
    assert data["placeholders"]["unique_placeholders"] == ["Amount", "City", "Date", "Order Number"]
    plain, tables = P.profile_report(records)
    assert "categories" not in plain.columns and "unique_placeholders" not in plain.schema["placeholders"].dataType.fieldNames()
    assert spark.read.json(str(tmp_path / "p" / "placeholders")).count() == 4
    long = P.full_profile(records)
    assert sorted(map(repr, P.report_table(plain, tables).collect())) == sorted(map(repr, long.collect()))
    assert long.where("section = 'duplicates' and metric = 'total_rows'").first().value == 6.0

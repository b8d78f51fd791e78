import json
from pathlib import Path

from pyspark.sql import functions as F

from quillstrata.operators import validation as V
from quillstrata.sources.sinks import write_quarantine

GOOD = dict(flags="B", instruction="a question", category="order", intent="ASK", response="an answer")


def frame(spark, *changes):
    rows = [tuple({**GOOD, **c}.values()) + (i,) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "flags string, instruction string, category string, intent string, "
                                       "response string, record_id long")


def reasons(spark, *changes):
    return [r.reason for r in V.validate_reason(frame(spark, *changes)).orderBy("record_id").collect()]


def test_messages_and_bounds(spark):
    got = reasons(
        spark, {}, {"flags": ""}, {"flags": None}, {"instruction": " \n\t "}, {"instruction": "x" * 1000},
        {"instruction": "x" * 1001}, {"response": "y" * 5001}, {"category": "  "}, {"intent": " \x1f"},
        {"flags": "", "instruction": "ab", "response": None},
    )
    assert got == [
        None,
        "flags: String should have at least 1 character",
        "flags: Input should be a valid string",
        "instruction: Value error, Field cannot be empty or pure whitespace.",
        None,
        "instruction: String should have at most 1000 characters",
        "response: String should have at most 5000 characters",
        "category: Value error, Category cannot be empty.",
        "intent: Value error, Intent cannot be empty.",
        "flags: String should have at least 1 character; instruction: String should have at least 3 characters; "
        "response: Input should be a valid string",
    ]


def test_canonical_form_drops_extras_and_does_not_recheck(spark):
    df = frame(spark, {"instruction": "  z  ", "category": " Order ", "intent": " Track "}).withColumn("extra", F.lit(1))
    row = V.canonicalize_record(df, "record_id").first().asDict()
    assert row == {"record_id": 0, "flags": "B", "instruction": "z", "category": "ORDER", "intent": "track",
                   "response": "an answer"}


def test_missing_and_non_text_columns(spark):
    df = frame(spark, {}).drop("response").withColumn("intent", F.lit(3))
    assert V.validate_reason(df).first().reason == "intent: Input should be a valid string; response: Field required"
    assert V.canonicalize_record(df).columns == ["flags", "instruction", "category", "intent", "response"]
    assert V.canonicalize_record(df).count() == 0


def test_routing_keeps_every_row(spark, records, tmp_path):
    valid, bad, summary = V.quarantine_split(records, "record_id")
    s = summary.first()
    assert (s.total_processed, s.valid_count, s.quarantined_count, s.quarantine_rate) == (6, 2, 4, 66.67)
    assert {r.record_id for r in valid.collect()} == {0, 3}
    assert {r.row_index for r in bad.collect()} == {1, 2, 4, 5}
    path = str(tmp_path / "q")
    write_quarantine(bad, path)
    lines = [json.loads(line) for p in Path(path).glob("*.json") for line in p.read_text().splitlines()]
    assert len(lines) == 4
    assert [x["raw_record"]["flags"] for x in lines if x["row_index"] == 5] == [None]
    assert "flags" in next(x for x in lines if x["row_index"] == 1)["quarantine_reason"]


def test_empty_table(spark, tmp_path):
    empty = frame(spark, {}).where("false")
    assert V.validation_summary(empty).first().quarantine_rate == 0.0
    write_quarantine(V.quarantined_records(empty, "record_id"), str(tmp_path / "q"))
    assert (tmp_path / "q").exists()

"""Damaged chat lines and payloads are routed, none is lost."""

import json
from collections import Counter

from pyspark.sql import functions as F

from quillstrata.operators.chat import payload_fault, payload_validity
from quillstrata.sources.records import read_sft_lines
from quillstrata.sources.sinks import write_quarantine


def record(roles=("system", "user", "assistant"), content="x"):
    return json.dumps({"messages": [{"role": r, "content": content} for r in roles]}, ensure_ascii=False)


LINES = {
    record(): None,
    record(content="é \" \\ {}"): None,
    json.dumps({**json.loads(record()), "note": 1}): None,
    "": "blank line",
    "   ": "blank line",
    "{": "not JSON",
    record()[:-1]: "not JSON",
    record() + " x": "not JSON",
    record() + record(): "not JSON",
    "1] [2": "not JSON",
    "1} {": "not JSON",
    "null": "not an object",
    "[]": "not an object",
    "3": "not an object",
    "{}": "no messages",
    '{"messages": "x"}': "messages of another type",
    '{"messages": {"role": "user"}}': "messages of another type",
    '{"messages": []}': "wrong roles",
    record(("user", "assistant")): "wrong roles",
    record(("system", "assistant", "user")): "wrong roles",
    '{"messages": [{"content": "x"}, {"role": "user"}, {"role": "assistant"}]}': "wrong roles",
    record(content=None): "no content",
}


def test_every_line_is_in_one_output(spark, tmp_path):
    lines = [line for line in LINES for _ in range(3)]
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.jsonl").write_text("".join(line + "\n" for line in lines[part::2]), encoding="utf-8")
    good, bad = read_sft_lines(spark, str(tmp_path / "in"))
    assert Counter((r.line, r.reason) for r in bad.collect()) == Counter((line, LINES[line]) for line in lines if LINES[line])
    said = Counter(tuple((m.role, m.content) for m in r.messages) for r in good.collect())
    expected = Counter(tuple((m["role"], m["content"]) for m in json.loads(line)["messages"]) for line in lines if LINES[line] is None)
    assert said == expected and bad.select("file").distinct().count() == 2
    write_quarantine(bad, str(tmp_path / "out"))
    assert spark.read.schema(bad.schema).json(str(tmp_path / "out")).count() == bad.count()


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    good, bad = read_sft_lines(spark, str(tmp_path / "x.jsonl"))
    assert good.count() == bad.count() == 0


PAYLOADS = {
    None: "empty",
    "": "empty",
    " ": "empty",
    "I cannot answer": "not JSON",
    '{"category": "A", "intent": "b", "response": "c"': "not JSON",
    '"A"': "not an object",
    "null": "not an object",
    '[{"category": "A"}]': "not an object",
    "{}": "no category",
    '{"category": null, "intent": "b", "response": "c"}': "no category",
    '{"category": 1, "intent": "b", "response": "c"}': "category not text",
    '{"category": {"a": "A"}, "intent": "b", "response": "c"}': "category not text",
    '{"category": " ", "intent": "b", "response": "c"}': "category blank",
    '{"category": "Z", "intent": "b", "response": "c"}': "category unknown",
    '{"category": "A", "response": "c"}': "no intent",
    '{"category": "A", "intent": true, "response": "c"}': "intent not text",
    '{"category": "A", "intent": "b", "response": ""}': "response blank",
    '{"category": "A", "intent": "b", "response": "c", "more": [1]}': None,
}


def test_first_fault_of_every_payload(spark):
    df = spark.createDataFrame([(p, f) for p, f in PAYLOADS.items()], "text string, expected string")
    for r in df.withColumn("fault", payload_fault(F.col("text"), {"category": ["A"]})).collect():
        assert r.fault == r.expected, r.text
    got = {r.fault: (r.rows, r.percentage) for r in payload_validity(df, "text", {"category": ["A"]}).collect()}
    expected = Counter(f or "valid" for f in PAYLOADS.values())
    assert got == {f: (n, round(n / len(PAYLOADS) * 100, 2)) for f, n in expected.items()}
    assert payload_validity(df.where("false"), "text").collect() == []

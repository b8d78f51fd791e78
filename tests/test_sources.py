import hashlib
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quillstrata.operators.chat import format_sft, sft_roundtrip, sft_step_budget
from quillstrata.schema import RECORD_SCHEMA
from quillstrata.sources import provenance, records as R, sinks

TRICKY = [
    (1, "B", 'quote " and, comma', "line\nbreak", "back\\slash", "\r\nboth"),
    (2, "", None, " lead", "trail ", '""'),
    (3, None, "", "\ttab", "\\", '\\"'),
    (4, "#", "a\rb", "\r", "'", "N/A\n"),
    (5, "\x00", None, "\x00\x00", "", "null"),
]


def test_raw_copies_round_trip(spark, tmp_path):
    df = spark.createDataFrame(TRICKY, RECORD_SCHEMA)
    paths = R.ingest_raw(df, str(tmp_path))
    kept = sorted(R.load_records(spark, paths["parquet"]).collect())
    assert [tuple(r) for r in kept] == TRICKY
    back = sorted(R.read_raw_csv(spark, paths["csv"], df.schema).collect())
    assert [tuple(r) for r in back] == TRICKY


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        R.load_records(spark, str(tmp_path / "none"))


def test_checksums_and_manifest(spark, records, tmp_path):
    data = b"some bytes" * 1000
    (tmp_path / "f.bin").write_bytes(data)
    files = provenance.file_sha256(spark, str(tmp_path / "f.bin"))
    row = files.first()
    assert (row.sha256, row.size_bytes) == (hashlib.sha256(data).hexdigest(), len(data))
    listed = provenance.artifact_table(files, str(tmp_path))
    manifest = provenance.dataset_manifest(records, listed, "name", "url", "rev", "lic")
    provenance.write_manifest(manifest, str(tmp_path / "m"), listed)
    text = "".join(p.read_text() for p in Path(tmp_path / "m" / "manifest").glob("*.json"))
    size = len(data)
    data = json.loads(text)
    assert data["row_count"] == 6 and data["column_count"] == 6 and data["columns"][0] == "record_id"
    assert (data["file_count"], data["total_bytes"]) == (1, size)
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "m" / "artifacts")).select("artifact", "sha256").collect()] == [("f.bin", row.sha256)]
    assert data["download_timestamp_utc"].endswith("+00:00")


def test_digest_reads_in_chunks(spark, tmp_path):
    contents = {"a": b"y", "b": b"x" * 10, "c": bytes(range(256)) * 40}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = provenance.file_sha256(spark, str(tmp_path), chunk_bytes=7).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.sha256, r.size_bytes) for r in rows} == {
        n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items()
    }


def test_manifest_of_a_split_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, ["train", "val", "test"][i % 3]) for i in range(9)], "id long, split string").coalesce(1)
    path = str(tmp_path / "s")
    sinks.write_split_parquet(df, path)
    for root in (path, f"file://{path}", f"{path}/"):
        files = provenance.artifact_table(provenance.file_sha256(spark, path), root)
        names = {r.artifact for r in files.collect()}
        kept = {n for n in names if n.endswith(".parquet")}
        assert {n.split("/")[0] for n in kept} == {"split=train", "split=val", "split=test"}
        assert len({n.split("/")[1] for n in kept}) == 1
    manifest = provenance.dataset_manifest(df, files, "n", "u", "r", "l")
    assert manifest.first().file_count == len(names)
    assert "collect_list" not in manifest._jdf.queryExecution().executedPlan().toString()


def test_pairs_take_the_next_turn_in_order(spark, monkeypatch):
    monkeypatch.setattr(R, "TURN_BLOCK", 4)
    rows = [(1, 0, "user", "q0"), (1, 5, "assistant", "a5"), (1, 1000, "user", "q1000"), (1, 1001, "assistant", "a1001"), (2, 0, "user", "p0"), (2, 1, "user", "p1"), (2, 9, "assistant", None), (3, 0, "user", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in R.conversation_pairs(turns).collect())
    assert got == [("1:0", "q0", "a5"), ("1:1000", "q1000", "a1001"), ("2:1", "p1", None)]
    many = [(c, t, ["user", "assistant"][t % 2], str(t)) for c in range(3) for t in range(2200)]
    keys = [r.record_id for r in R.conversation_pairs(spark.createDataFrame(many, turns.schema)).collect()]
    assert len(keys) == len(set(keys)) == 3300


def test_fingerprint_ignores_layout_only(spark, records):
    a = provenance.dataset_fingerprint(records).first()
    assert a == provenance.dataset_fingerprint(records.repartition(5)).first()
    assert a != provenance.dataset_fingerprint(records.union(records.limit(1))).first()
    assert a != provenance.dataset_fingerprint(records.fillna("", ["response"])).first()
    assert provenance.dataset_fingerprint(records.where("false")).first().row_count == 0


def test_chat_round_trip(spark, records, tmp_path):
    path = str(tmp_path / "chat")
    assert sinks.write_sft_jsonl(records, path) == 6
    lines = [json.loads(x) for p in Path(path).glob("*.json") for x in p.read_text().splitlines()]
    assert all([m["role"] for m in x["messages"]] == ["system", "user", "assistant"] for x in lines)
    payload = [json.loads(x["messages"][2]["content"]) for x in lines]
    assert {"category": "order", "intent": "TRACK_ORDER", "response": "It left on {{Date}} from {{City}}."} in payload
    back = R.read_sft_jsonl(spark, path)
    check = sft_roundtrip(back).first()
    assert (check.records, check.bad_shape, check.bad_payload) == (6, 0, 0)
    broken = back.selectExpr("slice(messages, 1, 2) as messages")
    assert sft_roundtrip(broken).first().bad_shape == 6


def test_chat_keeps_other_scripts_and_prompt(spark):
    df = spark.createDataFrame([("  hé́  x ", "C", "i", "grüße\n你")], "instruction string, category string, intent string, response string")
    m = format_sft(df, system_prompt="P").first().messages
    assert m[0].content == "P" and json.loads(m[2].content)["response"] == "grüße 你"
    assert "\\u" not in m[2].content


def test_step_budget(spark):
    row = sft_step_budget(spark.range(100), 4, 4, 3).first()
    assert (row.train_rows, row.effective_batch, row.total_steps) == (100, 16, 18)


def test_split_parquet_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, split string")
    sinks.write_split_parquet(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).where("split = 'val'")
    assert [r.id for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()


def test_file_queries_take_files_beyond_the_row_limit(spark, sf_dir):
    path = Path(f"{sf_dir}/documents.parquet")
    whole = spark.read.format("binaryFile").load(str(path)).select("path", F.sha2("content", 256), "length").collect()
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1000")
    try:
        assert [tuple(r) for r in queries()["file_digests"](spark, sf_dir).collect()] == [tuple(r) for r in whole]
        assert tuple(queries()["file_sha256"](spark, sf_dir).first()) == (True, True)
    finally:
        spark.conf.unset(limit)

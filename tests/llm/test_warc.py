"""Archives: exact round trip, framing errors, revisits against plain Python."""

import hashlib
import io

import pytest

from quillstrata.llm import warc

PAGES = "page_id bigint, url string, html string, page string, payload string"
BIG = "x" * 999 + "é"


def test_reader_round_trip_and_errors():
    payloads = [b"", b"a\r\n\r\nb", "é".encode() * 50_000, b"WARC/1.1\r\n"]
    records = [
        warc.record_bytes(str(i), f"http://h/{i} \n", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)
    ]
    data = b"".join(map(warc.gzip_member, records))
    found = list(warc.ArchiveReader(io.BytesIO(data), keep_payload=True))
    assert [r.payload for r in found] == payloads and all(r.verified for r in found)
    assert [r.payload_sha1 for r in found] == [hashlib.sha1(p).hexdigest() for p in payloads]
    assert found[1].header["warc-target-uri"] == "http://h/1%20%0A"
    with pytest.raises(ValueError, match="inside a record|shorter"):
        list(warc.ArchiveReader(io.BytesIO(data[:-20])))
    broken = records[1].replace(b"a\r\n\r\nb", b"a\r\n\r\nc")
    assert [r.verified for r in warc.ArchiveReader(io.BytesIO(warc.gzip_member(broken)))] == [False]
    with pytest.raises(ValueError, match="content length"):
        list(warc.ArchiveReader(io.BytesIO(warc.gzip_member(records[0] + b"more"))))


def expected_of(rows):
    groups = {}
    for k, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and k is not None:
            groups[raw] = max(k, groups.get(raw, k))
    out = []
    for k, _, html, *_ in rows:
        raw = (html or "").encode()
        top = groups.get(raw) if len(raw) >= 1000 else None
        revisit = top is not None and k != top
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None, True))
    return sorted(out, key=repr)


def test_pages(spark, sf_dir):
    rows = [(1, "u", BIG), (5, None, BIG), (3, "u", BIG), (5, "v", BIG), (None, "u", BIG), (7, "u", "small"), (8, "u", "small"), (9, None, None), (10, "", "")]
    rows += [(None, "u", "n" * 2000), (None, "u", "n" * 2000), (11, "u", "long " * 400_000), (12, "w", "long " * 400_000), (11, "other", "z" * 1500)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    found = warc.archive_round_trip(df).collect()
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == expected_of(rows)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    found = warc.archive_round_trip(pages).collect()
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == expected_of(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_keys_of_any_characters(spark):
    rows = [("a\r\nWARC-Type: x", "u", BIG), ("é> <%41 ", "u", BIG), ("", "u", "small")]
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    top = max(rows[0][0], rows[1][0])
    assert {r.page_id for r in found} >= {rows[0][0], rows[1][0]} and all(r.verified for r in found)
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {top}


def test_archives_roll_over_and_keep_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_TASKS", 2)
    df = spark.createDataFrame([(i, "u", f"{i} " * 3000) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives", max_file_bytes=500)
    assert manifest.count() > 2
    assert warc.read_archives(manifest).rdd.getNumPartitions() == 2
    back = {int(r.page): r.payload.decode() for r in warc.read_archives(manifest, keep_payload=True).collect()}
    assert back == {i: f"{i} " * 3000 for i in range(20)}

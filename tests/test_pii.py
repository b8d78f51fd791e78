import pytest
from pyspark.sql import functions as F

from quillstrata.functions import pii
from quillstrata.operators.pii import pii_hits, pii_scan

ALL = pii.CONFIGURED_ENTITIES

CASES = [
    ("Write to ann@mail.test or 555-987-6543.", "Write to <EMAIL> or <PHONE>.", ["EMAIL_ADDRESS", "PHONE_NUMBER"]),
    ("Card 4532-0000-0000-0009.", "Card <CARD>.", ["CREDIT_CARD"]),
    ("Card 4532-0000-0000-0008.", "Card 4532-0000-0000-0008.", []),
    ("94532000000000000000000009", "94532000000000000000000009", []),
    ("Stop {{Order Number}} and tell {{Email Address}}.", "Stop {{Order Number}} and tell {{Email Address}}.", []),
    ("{{Order}} of jo.do@real.mail.org, thanks", "{{Order}} of <EMAIL>, thanks", ["EMAIL_ADDRESS"]),
    ("Ring 800-555-0199 now", "Ring <PHONE> now", ["PHONE_NUMBER"]),
    ("x{{a}}4532000000000009{{b}}y", "x{{a}}<CARD>{{b}}y", ["CREDIT_CARD"]),
    ("{{a@b.org}} a@b.org {{a@b.org}}", "{{a@b.org}} <EMAIL> {{a@b.org}}", ["EMAIL_ADDRESS"]),
    ("{{open a@b.org", "{{open <EMAIL>", ["EMAIL_ADDRESS"]),
    ("{{{{x}}  a@b.org ", "{{{{x}}  <EMAIL> ", ["EMAIL_ADDRESS"]),
    (" ".join(f"{{{{s{i}}}}}" for i in range(15)) + " 1@2.org", " ".join(f"{{{{s{i}}}}}" for i in range(15)) + " <EMAIL>",
     ["EMAIL_ADDRESS"]),
    ("", "", []),
    ("   ", "   ", []),
    ("How do I change my address?", "How do I change my address?", []),
]

EXTRA = [
    ("pay DE89 3704 0044 0532 0130 00 from 10.0.0.255", "pay <IBAN_CODE> from <IP_ADDRESS>"),
    ("pay DE88 3704 0044 0532 0130 00 from 10.0.0.256", "pay DE88 3704 0044 0532 0130 00 from 10.0.0.256"),
    ("to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "to <CRYPTO>"),
    ("+44 20 7946 0958 and +1 (743) 555-3824", "<PHONE> and <PHONE>"),
]


def test_default_entities(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    out = df.select("i", pii.sanitize_text(F.col("t")).alias("s"), pii.detect_pii(F.col("t")).alias("d")).collect()
    for r in out:
        assert r.s == CASES[r.i][1]
        assert sorted(r.d) == CASES[r.i][2]


def test_configured_entities_and_idempotence(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(EXTRA)], "i int, t string")
    once = df.withColumn("s", pii.sanitize_text(F.col("t"), ALL)).withColumn("twice", pii.sanitize_text(F.col("s"), ALL))
    for r in once.collect():
        assert r.s == EXTRA[r.i][1] and r.twice == r.s


def test_null_text_and_unknown_entity(spark):
    r = spark.sql("select cast(null as string) t").select(
        pii.sanitize_text(F.col("t")).alias("s"), pii.detect_pii(F.col("t")).alias("d")
    ).first()
    assert r.s is None and r.d == []
    with pytest.raises(ValueError):
        pii.redact(F.col("t"), ["NOPE"])


def test_scan(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    row = pii_scan(df, "t").first()
    assert row.rows_checked == len(CASES) and row.rows_changed == sum(a != b for a, b, _ in CASES)
    hits = {r.entity: r.hits for r in pii_hits(df, "t").collect()}
    assert hits["EMAIL_ADDRESS"] == 6 and hits["CREDIT_CARD"] == 2

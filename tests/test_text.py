import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillstrata.functions import text as X
from quillstrata.operators.projection import head_n, normalize_records, null_counts

ALPHABET = ["a", "B", "e", "́", "̧", "é", "ḍ", "̇", " ", "\t", "\n", " ", "\x1f", "\x85",
            " ", "　", "7", "_", "-", "ß", "Å", "ᄀ", "ᅡ", "क", "़", ".", "\U0001f600", "\U0001d54f"]


def python_normalize(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


def samples(n=400, longest=30):
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(n)]
    signs = ["\U0001f600", "ab\U0001f600cd", "\U0001f600a b c", "one \U0001f600two three four", "one two three \U0001f600"]
    return ["", " ", "one", "one two", "one two three", "a a a a a", *signs, *made]


def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(samples())], "id long, t string")


def test_normalize_matches_python(spark):
    for r in table(spark).select("t", X.normalize_text(F.col("t")).alias("n")).collect():
        assert r.n == python_normalize(r.t), ascii(r.t)


def test_normalize_is_idempotent_and_keeps_null(spark):
    df = table(spark).withColumn("once", X.normalize_text(F.col("t")))
    assert df.where(X.normalize_text(F.col("once")) != F.col("once")).count() == 0
    assert spark.sql("select cast(null as string) t").select(X.normalize_text(F.col("t")).alias("n")).first().n is None


def test_every_code_point_that_can_change_is_suspect(spark):
    changing = []
    seconds = set()
    for code in range(1, 0x110000):
        sign = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.category(sign) == "Cn":
            continue
        if unicodedata.combining(sign) or unicodedata.normalize("NFC", sign) != sign:
            changing.append(sign)
        parts = unicodedata.normalize("NFD", sign)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == sign:
            seconds.update(parts[1:])
    df = spark.createDataFrame([(c,) for c in {*changing, *seconds}], "c string")
    missed = df.where(~F.col("c").rlike(X.NFC_SUSPECT)).collect()
    assert missed == []


def test_counts_match_python(spark):
    df = table(spark).select("t", X.word_count(F.col("t")).alias("w"), X.char_count(F.col("t")).alias("c"),
                             X.strip(F.col("t")).alias("s"))
    for r in df.collect():
        assert (r.w, r.c, r.s) == (len(r.t.split()), len(r.t), r.t.strip())


def test_shingles_match_a_plain_loop(spark):
    df = table(spark).select("t", X.word_shingles(F.col("t")).alias("s"))
    for r in df.collect():
        clean = python_normalize(r.t).lower()
        words = clean.split()
        expected = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {clean}
        assert set(r.s) == expected and len(r.s) == len(expected)


def test_ngrams_match_plain_loops(spark):
    df = table(spark).select("t", X.word_ngrams("t").alias("w"), X.char_ngrams("t").alias("c"))
    for r in df.collect():
        low = r.t.lower()
        words = re.findall(r"[^\W]{2,}", low)
        assert r.w == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        flat = re.sub(r"\s\s+", " ", low)
        assert r.c == [flat[i : i + n] for n in (3, 4, 5) for i in range(len(flat) - n + 1)]


def test_projection_operators(spark, records):
    clean = normalize_records(records).collect()
    assert clean[2].instruction_clean == "" and clean[2].instruction == "  \n\t "
    nulls = {r.column: r.null_count for r in null_counts(records).collect()}
    assert nulls == {"record_id": 0, "flags": 1, "instruction": 0, "category": 0, "intent": 0, "response": 1}
    assert [r.record_id for r in head_n(records.repartition(3), 2, "record_id").collect()] == [0, 1]

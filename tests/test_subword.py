"""Subword counts against merges made one by one."""

import os

import pytest
import regex
from pyspark.sql import functions as F

from quillstrata.functions.subword import SPLIT_PATTERN, read_ranks, subword_counter
from quillstrata.operators import profile

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")

TEXTS = ["", "a", "Where is my parcel?", "  two  spaces\n\nand lines\t", "déjà vu \U0001f600 中文字", "don't we'll 12345 x" * 20, "z" * 300, "{{Order Number}} --- ...", "\x1f\xa0 \x85"]


def plain_count(text, ranks):
    """Merge the neighbours of the lowest rank, leftmost first, until none has one."""
    total = 0
    for piece in regex.findall(SPLIT_PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        total += len(parts)
    return total


def test_counts_are_those_of_a_plain_loop(spark, sf_dir):
    ranks, count = read_ranks(VOCABULARY), subword_counter(VOCABULARY)
    texts = TEXTS + [r.text[:600] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(3)
    got = {r.i: r.n for r in df.select("i", count(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else plain_count(t, ranks) for i, t in enumerate([*texts, None])}


def test_statistics_of_both_texts(records):
    ranks = read_ranks(VOCABULARY)
    stats = {r.metric: r for r in profile.token_length_stats(records, subword_counter(VOCABULARY)).collect()}
    asked = [plain_count(r.instruction, ranks) for r in records.collect()]
    assert stats["instruction_tokens"].max == max(asked) and stats["instruction_tokens"].min == min(asked)

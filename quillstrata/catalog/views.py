"""Whole driver tables in the shapes the operators take.

Texts there have no slots, odd whitespace or decomposed accents, and records have no labels; each view adds them to
every row by a rule on the row's own content, and the SQL side states the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators.chat import assistant_payload, format_sft
from quillstrata.sources.records import conversation_pairs, load_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_records(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt by key for text work over a few large row groups."""
    return table(spark, sf_dir, "documents").repartition("doc_id")


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with characters beyond U+FFFF before, inside and after the text."""
    sign = chr(0x1F600)
    text = F.regexp_replace("text", " th", f" {sign}th")
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit(sign), text, F.lit(f" {sign}a {sign}")).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled records: the text on both sides, language as category, source as intent."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("record_id"),
        F.lit("B").alias("flags"),
        F.col("text").alias("instruction"),
        F.col("lang").alias("category"),
        F.col("source").alias("intent"),
        F.col("text").alias("response"),
    )


def untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed accents, unusual whitespace around every text and a tab inside."""
    text = F.regexp_replace("text", chr(0xE9), "e" + chr(0x301))
    text = F.regexp_replace(text, r"\. ", "." + chr(0x85) + chr(9) + " ")
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("  " + chr(0xA0) + chr(10)), text, F.lit(chr(0x1F) + "  ")).alias("text")
    )


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots before, after and around the texts, by language; German ones stay without."""
    lang, text = F.col("lang"), F.col("text")
    slot = F.concat(F.lit("{{"), F.col("source"), F.lit("}}"))
    mixed = (
        F.when(lang == "en", F.concat(text, F.lit(" {{Order Number}}")))
        .when(lang == "fr", F.concat(slot, text, F.lit(" {{Email Address}} {{{{Account Type}} {{open")))
        .when(lang == "es", F.concat(F.lit("a@b.org{{x}}+1 (743) 555-3824"), slot, F.lit("4532-0000-0000-0009 "), text))
        .otherwise(text)
    )
    return documents(spark, sf_dir).select("doc_id", "lang", "source", mixed.alias("text"))


def slotted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs with slots on one side, the other, or both, by the length of the answer."""
    size = F.length("response")
    return pairs(spark, sf_dir).withColumns(
        {
            "instruction": F.when(size % 2 == 0, F.concat("instruction", F.lit(" {{Order Number}} {{a}}"))).otherwise(
                F.col("instruction")
            ),
            "response": F.when(size % 3 == 0, F.concat("response", F.lit(" {{a}} {{{{Account Type}}"))).otherwise(
                F.col("response")
            ),
        }
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns as records. Labels come from text lengths, some of them invalid on purpose."""
    base = conversation_pairs(table(spark, sf_dir, "conversations"))
    asked, answered = F.length("instruction"), F.length("response")
    return base.select(
        "record_id",
        F.when(answered % 13 == 0, F.lit("")).when(answered % 17 == 0, F.lit(None)).otherwise("B").alias("flags"),
        "instruction",
        F.when(asked % 7 == 0, "X").when(asked % 11 == 0, "   ").when(asked % 2 == 0, " order ").otherwise("Refund")
        .alias("category"),
        F.when(answered % 5 == 0, " Track_Order\n").otherwise("get_refund").alias("intent"),
        F.when(asked % 19 == 0, chr(9) + chr(160) + "    ").when(asked % 23 == 0, "No.").otherwise(F.col("response"))
        .alias("response"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule as the prediction; "2" is never true."""
    facts = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    prediction = F.when(F.col("lang") == "de", "2").when(F.col("n_chars") > 400, "1").otherwise("0")
    return table(spark, sf_dir, "labels").join(facts, "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("y_true"), prediction.alias("y_pred")
    )


def edited(df: DataFrame) -> DataFrame:
    """Documents with some texts changed, some rows left out, some added and some repeated, by their length."""
    size = F.col("n_chars")
    kept = df.where(size % 40 != 0)
    changed = kept.withColumn("text", F.when(size % 50 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = df.where(size % 60 == 2).withColumn("doc_id", -1 - F.col("doc_id"))
    return changed.unionByName(added).unionByName(kept.where(size % 70 == 3))


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): chat records as JSON lines, some of them damaged by the length of the question."""
    kind = F.length("instruction") % 9
    said = format_sft(pairs(spark, sf_dir)).withColumn("kind", kind)
    last = F.element_at("messages", 3).withField("content", F.lit(None).cast("string"))
    wrong = F.when(F.col("kind") == 6, F.reverse("messages")).when(F.col("kind") == 7, F.concat(F.slice("messages", 1, 2), F.array(last)))
    line = F.to_json(F.struct(F.coalesce(wrong, F.col("messages")).alias("messages")))
    damaged = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.substring(line, 1, 40))
        .when(F.col("kind") == 3, "[1, 2]")
        .when(F.col("kind") == 4, '{"turns": []}')
        .when(F.col("kind") == 5, '{"messages": "none"}')
        .otherwise(line)
    )
    return said.select(damaged.alias("line"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text): assistant payloads, some of them damaged by the length of the question."""
    kind = F.length("instruction") % 13
    good = assistant_payload(F.col("category"), F.col("intent"), F.col("response"))
    text = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "  ")
        .when(kind == 2, F.substring(good, 1, 15))
        .when(kind == 3, '"Refund"')
        .when(kind == 4, '{"category": "Refund", "response": "a"}')
        .when(kind == 5, '{"category": 7, "intent": "b", "response": "a"}')
        .when(kind == 6, '{"category": "Refund", "intent": " ", "response": "a"}')
        .when(kind == 7, '{"category": "Refund", "intent": null, "response": "a"}')
        .when(kind == 8, '{"category": "Refund", "intent": "b", "response": ["a"]}')
        .otherwise(good)
    )
    return pairs(spark, sf_dir).select(text.alias("text"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item and event numbers in long form, as whole numbers."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.inline(
            F.array(
                F.struct(F.lit("quantity").alias("metric"), F.col("l_quantity").cast("bigint").alias("value")),
                F.struct(F.lit("price").alias("metric"), F.floor("l_extendedprice").cast("bigint").alias("value")),
            )
        )
    )
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event_"), F.col("event_type")).alias("metric"), F.floor("value").cast("bigint").alias("value")
    )
    return lines.unionByName(events)

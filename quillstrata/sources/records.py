"""Readers: record tables, preserved raw copies, chat-format files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.text import whole_json
from quillstrata.schema import MESSAGES_SCHEMA, ROLES
from quillstrata.session import cut_lineage


# Line breaks, quotes and outer blanks survive. Nulls are told by a flag column of their own, so any text may look like a marker.
CSV_EXACT = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
}
NULL_MARK = "\x00"
NULL_FLAGS = "null_flags"


def load_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a Parquet table; a missing path raises Spark's PATH_NOT_FOUND."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def ingest_raw(df: DataFrame, output_dir: str) -> dict[str, str]:
    """Keep an untouched copy as Parquet and as CSV; returns the two paths.

    The source runs once: the CSV copy is made from the Parquet one. It has a last column of 0 and 1 per field, 1 for null.
    """
    paths = {"parquet": f"{output_dir}/raw_parquet", "csv": f"{output_dir}/raw_csv"}
    df.write.mode("overwrite").parquet(paths["parquet"])
    kept = df.sparkSession.read.schema(df.schema).parquet(paths["parquet"])
    flags = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in kept.columns])
    kept.withColumn(NULL_FLAGS, flags).write.mode("overwrite").options(header=True, **CSV_EXACT).csv(paths["csv"])
    return paths


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read the CSV copy back without loss.

    A text field that is read as null was the null marker itself unless its flag says null.
    """
    flagged = T.StructType([*schema.fields, T.StructField(NULL_FLAGS, T.StringType())])
    rows = spark.read.schema(flagged).options(header=True, multiLine=True, nullValue=NULL_MARK, **CSV_EXACT).csv(path)

    def value(place: int, field: T.StructField):
        there = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            there = F.coalesce(there, F.lit(NULL_MARK))
        return F.when(F.substring(NULL_FLAGS, place + 1, 1) == "0", there).alias(field.name)

    return rows.select(*[value(i, f) for i, f in enumerate(schema.fields)])


def read_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chat-format lines: one ``messages`` array per row."""
    return spark.read.schema(MESSAGES_SCHEMA).json(path)


def sft_line_reason(line: Column, roles: list[str] = ROLES) -> Column:
    """Why a line is no chat record, by the first rule it breaks; null for a good line."""
    parsed = F.from_json(line, MESSAGES_SCHEMA, {"mode": "PERMISSIVE"})
    said, held = parsed["messages"], whole_json(line)
    has = F.try_variant_get(held, "$.messages", "variant")
    return (
        F.when(F.trim(line) == "", "blank line")
        .when(held.isNull(), "not JSON")
        .when(~F.schema_of_variant(held).startswith("OBJECT"), "not an object")
        .when(has.isNull(), "no messages")
        .when(~F.schema_of_variant(has).startswith("ARRAY") | said.isNull(), "messages of another type")
        .when(~F.coalesce(F.transform(said, lambda m: m["role"]) == F.array(*[F.lit(r) for r in roles]), F.lit(False)), "wrong roles")
        .when(F.exists(said, lambda m: m["content"].isNull()), "no content")
    )


def read_sft_lines(spark: SparkSession, path: str, roles: list[str] = ROLES) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of chat-format files, where ``read_sft_jsonl`` gives null for what it cannot read.

    Every line is in exactly one of the two, repeated and blank ones as often as they occur: ``good`` has ``messages``, ``bad`` has
    ``file``, ``line`` (the text as it is) and ``reason``. The files are read once; both results read a stored table.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    told = cut_lineage(lines.select("file", "line", sft_line_reason(F.col("line"), roles).alias("reason")))
    parsed = F.from_json("line", MESSAGES_SCHEMA)
    good = told.where(F.col("reason").isNull()).select(parsed["messages"].alias("messages"))
    return good, told.where(F.col("reason").isNotNull())


# Neighbouring turns that one running order covers.
TURN_BLOCK = 4096


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that comes next, keyed by the text "conversation:turn".

    Turns may have gaps. Order is taken inside blocks of ``TURN_BLOCK`` turn numbers, and among the first turns of the blocks, so no
    task orders a whole conversation.
    """
    block, ids = F.floor(F.col("turn") / TURN_BLOCK).alias("block"), ["conv_id", "block"]
    turns = conversations.select("conv_id", "turn", block, F.struct("role", "text").alias("said"))
    inside = Window.partitionBy(*ids).orderBy("turn")
    near = turns.withColumn("next", F.lead("said").over(inside))
    firsts = turns.groupBy(*ids).agg(F.min_by("said", "turn").alias("first"))
    later = firsts.select(*ids, F.lead("first").over(Window.partitionBy("conv_id").orderBy("block")).alias("later"))
    joined = near.join(later, ids).select("conv_id", "turn", "said", F.coalesce("next", "later").alias("next"))
    asked = joined.where((F.col("said.role") == "user") & (F.col("next.role") == "assistant"))
    return asked.select(
        F.concat_ws(":", "conv_id", "turn").alias("record_id"),
        F.col("said.text").alias("instruction"),
        F.col("next.text").alias("response"),
    )

"""Chat-format export: system, user and assistant messages with a JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions.text import normalize_text, whole_json
from quillstrata.operators.profile import percent
from quillstrata.schema import ROLES

DEFAULT_SYSTEM_PROMPT = (
    "You sort customer requests. Name the category and the intent of the request, then answer it politely."
)
PAYLOAD_FIELDS = ["category", "intent", "response"]
PAYLOAD_SCHEMA = "category string, intent string, response string"


def assistant_payload(category: Column, intent: Column, response: Column) -> Column:
    """JSON of label pair and normalized response; non-ASCII text is kept as it is, nulls are written out."""
    return F.to_json(
        F.struct(
            category.alias("category"),
            intent.alias("intent"),
            F.coalesce(normalize_text(response), F.lit("")).alias("response"),
        ),
        {"ignoreNullFields": "false"},
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def format_sft(
    df: DataFrame,
    instruction_col: str = "instruction",
    category_col: str = "category",
    intent_col: str = "intent",
    response_col: str = "response",
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
) -> DataFrame:
    """Add ``messages``, an array of three (role, content) structs."""
    payload = assistant_payload(F.col(category_col), F.col(intent_col), F.col(response_col))
    contents = [F.lit(system_prompt), F.coalesce(normalize_text(F.col(instruction_col)), F.lit("")), payload]
    return df.withColumn("messages", F.array(*[_message(r, c) for r, c in zip(ROLES, contents)]))


def sft_roundtrip(chat: DataFrame) -> DataFrame:
    """(records, bad_shape, bad_payload): three messages in role order, and a payload that parses."""
    roles = F.transform("messages", lambda m: m["role"])
    payload = F.from_json(F.element_at("messages", -1)["content"], PAYLOAD_SCHEMA, {"mode": "PERMISSIVE"})
    shape_ok = F.coalesce(roles == F.array(*[F.lit(r) for r in ROLES]), F.lit(False))
    payload_ok = payload["category"].isNotNull() & payload["intent"].isNotNull() & payload["response"].isNotNull()
    return chat.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~shape_ok).alias("bad_shape"),
        F.count_if(~F.coalesce(payload_ok, F.lit(False))).alias("bad_payload"),
    )


def payload_fault(text: Column, labels: dict[str, list[str]] | None = None) -> Column:
    """The first thing wrong with a generated payload, null for a valid one.

    In this order: ``empty`` (null or blank), ``not JSON``, ``not an object``, then field by field ``no <field>`` (absent or JSON null) and
    ``<field> not text``, ``<field> blank``, and ``<field> unknown`` if ``labels`` lists the field's values.
    """
    value = whole_json(text)
    fault = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(value.isNull(), "not JSON")
    fault = fault.when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    for name in PAYLOAD_FIELDS:
        part = F.try_variant_get(value, f"$.{name}", "variant")
        said = F.try_variant_get(value, f"$.{name}", "string")
        fault = fault.when(part.isNull() | F.is_variant_null(part), f"no {name}").when(F.schema_of_variant(part) != "STRING", f"{name} not text")
        fault = fault.when(F.trim(said) == "", f"{name} blank")
        if name in (labels or {}):
            fault = fault.when(~said.isin(labels[name]), f"{name} unknown")
    return fault


def payload_validity(df: DataFrame, text_col: str, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(fault, rows, percentage): generated payloads by their first fault, ``valid`` among them; empty for an empty table."""
    fault = F.coalesce(payload_fault(F.col(text_col), labels), F.lit("valid"))
    counts = df.groupBy(fault.alias("fault")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("n")).scalar()
    return counts.select("fault", "rows", percent(F.col("rows"), total).alias("percentage"))


def sft_step_budget(df: DataFrame, batch_size: int, accumulation: int, epochs: int) -> DataFrame:
    """(train_rows, effective_batch, total_steps): whole optimizer steps over all epochs."""
    effective = batch_size * accumulation
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("train_rows"),
        F.lit(effective).cast("bigint").alias("effective_batch"),
        (F.floor(rows / effective) * epochs).cast("bigint").alias("total_steps"),
    )

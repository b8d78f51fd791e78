"""The support-record schema and the rule table that validation is generated from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORD_FIELDS = ["flags", "instruction", "category", "intent", "response"]

RECORD_SCHEMA = T.StructType(
    [T.StructField("record_id", T.LongType(), False)]
    + [T.StructField(name, T.StringType(), True) for name in RECORD_FIELDS]
)

# Roles of a chat record, in order.
ROLES = ["system", "user", "assistant"]

MESSAGES_SCHEMA = T.StructType(
    [
        T.StructField(
            "messages",
            T.ArrayType(
                T.StructType(
                    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
                )
            ),
        )
    ]
)


@dataclass(frozen=True)
class FieldRule:
    """Length bounds are in code points and apply to the text as it came in."""

    field: str
    min_length: int
    max_length: int | None
    blank_message: str | None
    canonical_case: str | None = None


# Bounds and messages of the record schema.
RULES = [
    FieldRule("flags", 1, None, None),
    FieldRule("instruction", 3, 1000, "Field cannot be empty or pure whitespace."),
    FieldRule("category", 2, 64, "Category cannot be empty.", "upper"),
    FieldRule("intent", 2, 64, "Intent cannot be empty.", "lower"),
    FieldRule("response", 5, 5000, "Field cannot be empty or pure whitespace."),
]

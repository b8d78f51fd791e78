"""Rule-table validation, canonical form, and quarantine routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.text import WS, strip
from quillstrata.schema import RULES, FieldRule
from quillstrata.session import cut_lineage


def _characters(n: int) -> str:
    return f"{n} character" if n == 1 else f"{n} characters"


def _rule_error(rule: FieldRule, schema: T.StructType) -> Column:
    """The failure message of one field, or null. Lengths come first, blankness only after them."""
    if rule.field not in schema.fieldNames():
        return F.lit(f"{rule.field}: Field required")
    not_text = F.lit(f"{rule.field}: Input should be a valid string")
    if not isinstance(schema[rule.field].dataType, T.StringType):
        return not_text
    value = F.col(rule.field)
    error = F.when(value.isNull(), not_text).when(
        F.length(value) < rule.min_length,
        F.lit(f"{rule.field}: String should have at least {_characters(rule.min_length)}"),
    )
    if rule.max_length is not None:
        error = error.when(
            F.length(value) > rule.max_length,
            F.lit(f"{rule.field}: String should have at most {_characters(rule.max_length)}"),
        )
    if rule.blank_message is not None:
        error = error.when(
            ~value.rlike(rf"[^{WS}]"), F.lit(f"{rule.field}: Value error, {rule.blank_message}")
        )
    return error


def validate_rules(df: DataFrame, rules: list[FieldRule] = RULES) -> DataFrame:
    """Add ``errors``: every failed rule, in field order; an empty array means valid."""
    return df.withColumn("errors", F.array_compact(F.array(*[_rule_error(r, df.schema) for r in rules])))


def validate_reason(df: DataFrame, rules: list[FieldRule] = RULES) -> DataFrame:
    """Add ``reason``: the failures joined by "; ", null for valid rows."""
    checked = validate_rules(df, rules)
    reason = F.when(F.size("errors") > 0, F.array_join("errors", "; "))
    return checked.withColumn("reason", reason).drop("errors")


def _canonical(rule: FieldRule) -> Column:
    value = F.col(rule.field)
    if rule.blank_message is None:
        return value
    value = strip(value)
    if rule.canonical_case == "upper":
        value = F.upper(value)
    elif rule.canonical_case == "lower":
        value = F.lower(value)
    return value


def canonicalize_record(df: DataFrame, key: str | None = None, rules: list[FieldRule] = RULES) -> DataFrame:
    """Valid rows in canonical form: declared fields only (and the key), lengths not checked again."""
    return _canonical_rows(validate_rules(df, rules), key, rules)


def _canonical_rows(checked: DataFrame, key: str | None, rules: list[FieldRule]) -> DataFrame:
    kept = [] if key is None else [F.col(key)]
    # With a field missing no row is valid; its typed null only keeps the result's schema fixed.
    present = {
        r.field: _canonical(r) if r.field in checked.columns else F.lit(None).cast("string") for r in rules
    }
    valid = checked.where(F.size("errors") == 0)
    return valid.select(*kept, *[column.alias(name) for name, column in present.items()])


def quarantined_records(df: DataFrame, key: str, rules: list[FieldRule] = RULES) -> DataFrame:
    """Bad rows as (row_index, raw_record, quarantine_reason); the key tells the row."""
    return _quarantined_rows(validate_rules(df, rules), key)


def _quarantined_rows(checked: DataFrame, key: str) -> DataFrame:
    raw = F.struct(*[F.col(c) for c in checked.columns if c not in (key, "errors")])
    return (
        checked.where(F.size("errors") > 0)
        .select(
            F.col(key).alias("row_index"),
            raw.alias("raw_record"),
            F.array_join("errors", "; ").alias("quarantine_reason"),
        )
    )


def quarantine_split(
    df: DataFrame, key: str, rules: list[FieldRule] = RULES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, quarantined, summary). Rows are routed, never dropped.

    The rules run once: rows are stored with their errors, and all three results read that table.
    """
    checked = cut_lineage(validate_rules(df, rules))
    return _canonical_rows(checked, key, rules), _quarantined_rows(checked, key), _summary(checked)


def validation_summary(df: DataFrame, rules: list[FieldRule] = RULES) -> DataFrame:
    """One row of totals; the rate is 0.0 for an empty table."""
    return _summary(validate_rules(df, rules))


def _summary(tagged: DataFrame) -> DataFrame:
    checked = tagged.select((F.size("errors") > 0).alias("bad"))
    total, bad = F.count(F.lit(1)), F.count_if("bad")
    rate = F.round(F.coalesce(F.try_divide(bad, total), F.lit(0.0)) * 100, 2)
    return checked.agg(
        total.alias("total_processed"),
        (total - bad).alias("valid_count"),
        bad.alias("quarantined_count"),
        rate.alias("quarantine_rate"),
    )

"""Table-level masking and its scan report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import pii


def sanitize_records(
    df: DataFrame, columns: Sequence[str], entities: Sequence[str] = pii.DEFAULT_ENTITIES
) -> DataFrame:
    """Mask the named text columns in place, slots left alone."""
    return df.withColumns({c: pii.sanitize_text(F.col(c), entities) for c in columns})


def detect_records(
    df: DataFrame, column: str, entities: Sequence[str] = pii.DEFAULT_ENTITIES, output: str = "entities"
) -> DataFrame:
    return df.withColumn(output, pii.detect_pii(F.col(column), entities))


def pii_scan(df: DataFrame, column: str, entities: Sequence[str] = pii.DEFAULT_ENTITIES) -> DataFrame:
    """(rows_checked, rows_changed): how many rows masking would alter."""
    changed = pii.sanitize_text(F.col(column), entities) != F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(changed).alias("rows_changed")
    )


def pii_hits(df: DataFrame, column: str, entities: Sequence[str] = pii.DEFAULT_ENTITIES) -> DataFrame:
    """(entity, hits) over the whole column."""
    found = df.select(F.explode(pii.detect_pii(F.col(column), entities)).alias("entity"))
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("hits"))

"""Writers. Each is one job over the data it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillstrata.operators.chat import format_sft


def write_split_parquet(df: DataFrame, path: str, split_col: str = "split") -> None:
    """All splits in one write; reading one back prunes the other folders."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_sft_jsonl(df: DataFrame, path: str, partition_by: str | None = None, **names: str) -> int:
    """Write chat-format JSON lines and return the row count, observed during the write itself."""
    seen = Observation()
    kept = [] if partition_by is None else [partition_by]
    lines = format_sft(df, **names).select("messages", *kept).observe(seen, F.count(F.lit(1)).alias("n"))
    writer = lines.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.json(path)
    return seen.get["n"]


def write_quarantine(quarantined: DataFrame, path: str) -> None:
    """JSON lines of bad rows, null fields kept; the folder exists even when nothing failed."""
    quarantined.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_profile(report: DataFrame, path: str, tables: dict[str, DataFrame] | None = None) -> None:
    """The one-row nested report as JSON under ``path``/report, and each table beside it as JSON lines."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/report")
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")

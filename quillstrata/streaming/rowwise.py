"""Structured Streaming entry points.

Validation, masking, normalization and chat formatting are pure column expressions, so they need no state and no
watermark: the batch operators run on a streaming table as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstrata.operators.chat import format_sft
from quillstrata.operators.pii import sanitize_records
from quillstrata.operators.validation import canonicalize_record, quarantined_records
from quillstrata.schema import RECORD_SCHEMA


def stream_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Parquet files of records as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_chat(
    records: DataFrame, output: str, quarantine: str, checkpoint: str, key: str = "record_id", trigger: dict | None = None
) -> StreamingQuery:
    """Route each micro-batch: bad rows to quarantine, the rest masked and formatted as chat lines.

    A repeated batch overwrites its own folder, so a restart leaves no doubled rows. A batch is read once and kept while both results are
    written. ``trigger`` is passed on, by default everything that is there and then an end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            quarantined_records(batch, key).write.mode("overwrite").option("ignoreNullFields", False).json(
                f"{quarantine}/batch={batch_id}"
            )
            clean = sanitize_records(canonicalize_record(batch, key), ["instruction", "response"])
            format_sft(clean).select("messages").write.mode("overwrite").json(f"{output}/batch={batch_id}")
        finally:
            batch.unpersist()

    stream = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()

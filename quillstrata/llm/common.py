"""Shared pieces of the training-data operators: stored intermediate tables, Arrow row blocks, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.session import ensure_checkpoint_dir

# Rows handled at a time inside a task; Python objects of one block live at once.
BLOCK_ROWS = 256
# ASCII whitespace as the contracts define it: space and \x09-\x0D. bytes.split() without arguments cuts at these alone.
SPACES = b" \t\n\x0b\x0c\r"
# Lowers A-Z; letters, digits and all bytes of other code points stay, every other ASCII byte becomes a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors. ``options`` are those of the writer."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_blocks(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Apply ``work`` to blocks of at most ``rows`` rows; nothing is kept between blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                yield work(batch.slice(first, rows))

    return df.mapInArrow(run, schema)


def utf8(text: Column) -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b"").cast("binary"))


def remainder(key: Column, divisor: int) -> Column:
    """crc32(key as text) mod divisor: the fold rule of the labelled operators. A null key belongs to no fold."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart. Null and empty differ from each other."""
    return F.coalesce(F.xxhash64(text), F.lit(0)) + F.when(text.isNull(), 1).otherwise(0)



def drawn(share: float, *columns: str) -> Column:
    """True for this share of the rows, by 53 bits of a hash of the columns: no share is too small to draw."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit("sample")), 11) < F.lit(share * (1 << 53))

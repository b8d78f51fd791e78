"""A lookup join that holds when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it has more rows than this and more than a fixed share of the table.
HEAVY_ROWS = 1_000_000
HEAVY_SHARE = 5_000


def heavy_limit(total_rows: int, heavy_rows: int = HEAVY_ROWS) -> int:
    return max(heavy_rows, total_rows // HEAVY_SHARE)


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: str,
    total_rows: int,
    heavy_rows: int = HEAVY_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left join ``facts`` to ``table``, which has one row per key, without sending a heavy key to one task.

    No key can be heavy in a table of ``heavy_rows`` rows or fewer: a plain equi-join then. Otherwise the
    heavy keys are counted (map-side first). All their counts together stay within ``total_rows``, so there are at most
    ``HEAVY_SHARE`` of them and broadcasting that list is safe at any size. Their rows are dealt to numbered parts by a
    hash of ``spread_by``, and the one matching table row is repeated once per part. ``counted`` spares the counting: it has the
    rows ``_n`` of each key, a key in several rows counting as the largest of them.
    """
    limit = heavy_limit(total_rows, heavy_rows)
    if total_rows <= limit:
        return facts.join(table, on, "left")
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")) if counted is None else counted
    if counted is not None:
        counts = counts.where(F.col("_n") > limit).groupBy(*on).agg(F.max("_n").alias("_n"))
    heavy = (
        counts.where(F.col("_n") > limit)
        .select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = facts.join(F.broadcast(heavy), on, "left").select(
        *facts.columns, F.pmod(F.xxhash64(spread_by), parts).cast("int").alias("_part")
    )
    repeated = table.join(F.broadcast(heavy), on, "left").select(
        *table.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")
    )
    return dealt.join(repeated, [*on, "_part"], "left").drop("_part")

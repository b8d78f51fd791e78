"""Which rows differ between two versions of a table: a stored tree of digests, compared from the top.

Rows are dealt to branches by the first two hex digits (or ``branch_digits``) of the md5 of their key, and to twigs by the first four. ``branches`` holds
up to 256 sums of row digests, ``twigs`` up to 65,536, ``leaves`` a digest per row. Versions with equal sums are equal there; only twigs of
differing branches, and leaves of differing branches and twigs are read, by partition pruning. Sums do not depend on the order of rows.

Cases: a null key is a key of its own, not the empty text; several rows of one key are compared as a whole with their number, so copies
count; columns are compared by name in the order of the first version's ``columns``; two empty tables do not differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.sources.provenance import row_digest

BRANCH_DIGITS, TWIG_DIGITS = 2, 4
_SUMS = "rows bigint, sum decimal(38,0)"


def write_digest_tree(df: DataFrame, key: str, folder: str, columns: list[str] | None = None, branch_digits: int = BRANCH_DIGITS) -> None:
    """Store the tree of a version under ``folder``: one pass over the rows, sums come from the stored leaves.

    Versions are compared if they have the same ``branch_digits``, at most 4.
    """
    name = F.col(key).cast("string")
    place = F.md5(F.coalesce(F.concat(F.lit("="), name), F.lit("")))
    rows = df.select(
        name.alias("key"),
        row_digest(columns or df.columns, "md5").alias("digest"),
        F.substring(place, 1, TWIG_DIGITS).alias("twig"),
        F.substring(place, 1, branch_digits).alias("branch"),
    )
    # Twigs are even, so the files of a branch can be written by several tasks.
    leaves = rows.repartition("twig").sortWithinPartitions("branch", "twig")
    leaves.write.mode("overwrite").partitionBy("branch").parquet(f"{folder}/leaves")
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(28,0)")
    stored = _read(df.sparkSession, folder, "leaves", "key string, digest string, twig string")
    twigs = stored.groupBy("branch", "twig").agg(F.count(F.lit(1)).alias("rows"), F.sum(number).alias("sum"))
    twigs.write.mode("overwrite").partitionBy("branch").parquet(f"{folder}/twigs")
    summed = _read(df.sparkSession, folder, "twigs", f"twig string, {_SUMS}")
    branches = summed.groupBy("branch").agg(F.sum("rows").alias("rows"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
    branches.coalesce(1).write.mode("overwrite").parquet(f"{folder}/branches")


def _read(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, branch string").parquet(f"{folder}/{table}")


def _differing(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The groups whose number or sum of rows differ, those of one side only among them."""
    both = old.join(new.select(*on, F.col("rows").alias("new_rows"), F.col("sum").alias("new_sum")), on, "full")
    same = F.col("rows").eqNullSafe(F.col("new_rows")) & F.col("sum").eqNullSafe(F.col("new_sum"))
    return both.where(~same).select(*on)


def differing_branches(spark: SparkSession, old: str, new: str) -> list[str]:
    """Names of the branches that differ, 256 at most."""
    sides = [_read(spark, folder, "branches", _SUMS) for folder in (old, new)]
    return sorted(r["branch"] for r in _differing(*sides, ["branch"]).collect())


def changed_rows(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(key, change, old_rows, new_rows) of the keys whose rows differ: ``added``, ``removed`` or ``changed``."""
    branches = differing_branches(spark, old, new)
    inside = F.col("branch").isin(branches) if branches else F.lit(False)
    twigs = [_read(spark, folder, "twigs", f"twig string, {_SUMS}").where(inside) for folder in (old, new)]
    # At most 65,536 names of four digits.
    open_twigs = F.broadcast(_differing(*twigs, ["branch", "twig"]))

    def leaves(folder: str, side: str) -> DataFrame:
        rows = _read(spark, folder, "leaves", "key string, digest string, twig string").where(inside)
        return rows.join(open_twigs, ["branch", "twig"], "left_semi").select("key", "digest", F.lit(side).alias("side"))

    rows = leaves(old, "old").unionByName(leaves(new, "new"))
    # Counted map-side: a key with very many rows is as many rows as it has different ones.
    counted = rows.groupBy("key", "digest").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("old", "new")])
    keys = counted.groupBy("key").agg(
        F.sum("old").alias("old_rows"), F.sum("new").alias("new_rows"), F.bool_or(F.col("old") != F.col("new")).alias("differs")
    )
    change = F.when(F.col("old_rows") == 0, "added").when(F.col("new_rows") == 0, "removed").otherwise("changed")
    return keys.where("differs").select("key", change.alias("change"), "old_rows", "new_rows")

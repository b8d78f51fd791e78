"""Bootstrap intervals of classification metrics.

Every row gets a Poisson(1) weight per replicate, drawn by a hash of seed, key and replicate: the same under any partitioning, and
without a draw of rows. The weights are summed per confusion cell in one pass, map-side first, so what is shuffled grows with
cells and replicates, not with rows. The metrics of all replicates follow from those sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators.metrics import summary_of_pairs

METRICS = ["accuracy", "macro_f1", "weighted_f1"]
# An md5 value holds four draws of 32 bits.
DRAWS = 4


def poisson_steps() -> list[int]:
    """Bounds in 32-bit steps: a draw at or above k of them stands for the weight k of a Poisson variable of mean 1."""
    steps, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(int(total * 2**32))
    return steps


def _weight(digest: Column, part: int) -> Column:
    draw = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint")
    return sum(((draw >= step).cast("int") for step in poisson_steps()), F.lit(0))


def replicate_pairs(
    df: DataFrame, key: str, truth: str = "y_true", prediction: str = "y_pred", replicates: int = 200, seed: int = 42
) -> DataFrame:
    """(replicate, y_true, y_pred, n): resampled confusion cells, numbered from 0, and the plain ones as replicate -1."""
    blocks = math.ceil(replicates / DRAWS)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(
        F.col(truth).alias("y_true"), F.col(prediction).alias("y_pred"), name.alias("_name"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    hashed = rows.select("y_true", "y_pred", "block", F.md5(F.concat(F.lit(f"{seed}:"), "_name", F.lit(":"), F.col("block").cast("string"))).alias("digest"))
    sums = hashed.groupBy("y_true", "y_pred", "block").agg(
        F.count(F.lit(1)).alias("plain"), *[F.sum(_weight(F.col("digest"), p)).alias(f"n{p}") for p in range(DRAWS)]
    )
    drawn = [F.struct((F.col("block") * DRAWS + p).alias("replicate"), F.col(f"n{p}").alias("n")) for p in range(DRAWS)]
    plain = F.struct(F.lit(-1).alias("replicate"), F.when(F.col("block") == 0, F.col("plain")).otherwise(0).alias("n"))
    cells = sums.select("y_true", "y_pred", F.inline(F.array(plain, *drawn)))
    # A label that a replicate does not hold is none of its labels.
    return cells.where((F.col("n") > 0) & (F.col("replicate") < replicates)).select("replicate", "y_true", "y_pred", "n")


def bootstrap_intervals(
    df: DataFrame,
    key: str,
    truth: str = "y_true",
    prediction: str = "y_pred",
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """(metric, estimate, low, high, replicates): the metric of all rows and the interval that holds ``level`` of the replicates.

    The ends are replicates themselves, the nearest ranks outside the level. Rows with one key have one weight and are resampled together;
    a null key counts as empty. A replicate that draws no row has no metrics and is not counted. An empty table gives three rows of
    nulls with no replicates.
    """
    if not 0 < level < 1 or replicates < 1:
        raise ValueError(f"level {level} must lie between 0 and 1, replicates {replicates} must be positive")
    scores = summary_of_pairs(replicate_pairs(df, key, truth, prediction, replicates, seed), ("replicate",))
    long = scores.select("replicate", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    drawn, tail = F.col("replicate") >= 0, (1 - level) / 2
    # At most ``replicates`` numbers per metric.
    found = long.groupBy("metric").agg(
        F.max(F.when(~drawn, F.col("value"))).alias("estimate"), F.sort_array(F.collect_list(F.when(drawn, F.col("value")))).alias("values")
    )
    names = df.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    size = F.coalesce(F.size("values"), F.lit(0))
    # Rounded first: the tail of 0.95 is not exactly 0.025.
    low = F.floor(F.round((size - 1) * F.lit(tail), 9)).cast("int")
    high = F.ceil(F.round((size - 1) * F.lit(1 - tail), 9)).cast("int")
    return names.join(F.broadcast(found), "metric", "left").select(
        "metric", "estimate", F.get("values", low).alias("low"), F.get("values", high).alias("high"),
        F.greatest(size, F.lit(0)).cast("bigint").alias("replicates"),
    )

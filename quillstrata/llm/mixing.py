"""Source mixing by iterative proportional fitting.

Token sums per (source, language, topic) cell are raked to the target shares of the three margins: each step scales the cells of
one margin's value so that their sum meets its target. The fitted weights give each cell a sampling probability, and
documents are drawn by a hash of their key, so the draw is the same under any partitioning.

Cases: null margins are a value of their own, ``(none)``; null and empty texts have no tokens and are drawn with their cell's
probability, 0 where no text of the cell has tokens; repeated rows are drawn alike; a target for a value that no row has is spread over the others; a value
without a target gets none; an empty table gives no rows. Other columns pass through;
one named ``mix`` is replaced, and names that begin with ``_odds`` are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import stored, text_key

MARGINS = ("source", "lang", "topic")
# A table of that many cells (a few MB) is broadcast, and raked on the driver; a larger one is joined by shuffle.
BROADCAST_CELLS = 20_000
# Weights, which add up to 1, no longer move when a round shifts less than this.
STILL = 1e-10


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def form_topic(text: Column) -> Column:
    """A topic by the form of a text, where a table has none: what it is made of decides."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains(" | "), "table")
        .when(~body.rlike(r"\p{Ll}{3}"), "capitals")
        .when(body.rlike(r"[#$%&*]{3}"), "markup")
        .when(body.rlike(r"[0-9]{4}"), "figures")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """(margin, share): shares in proportion to tokens ** exponent, which lifts small values."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)
    total = sums.agg(F.sum(F.pow("tokens", F.lit(exponent)))).first()[0]
    return sums.select(margin, (F.pow("tokens", F.lit(exponent)) / F.lit(total or 1.0)).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, held_cells: int = BROADCAST_CELLS
) -> tuple[DataFrame, float]:
    """Cells with ``weight`` (sum 1) fitted to the targets, and the largest relative deviation of a margin left.

    ``cells`` has a row per cell with ``tokens`` > 0. One round scales each margin in turn. Rounds end at the tolerance, or when the weights
    no longer move (targets that contradict empty cells have no exact fit). At most ``held_cells`` cells are fitted on the driver.
    """
    margins = list(targets)
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    kept = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for m in margins:
        # Only values that occur can be met; their shares are scaled to 1.
        there = targets[m].where(F.col("share") > 0).join(cells.select(m).distinct(), m, "left_semi")
        whole = there.agg(F.sum("share")).first()[0] or 1.0
        goals[m] = stored(there.select(m, (F.col("share") / F.lit(whole)).alias("goal")), f"goal-{m}")
        kept = kept.join(goals[m].select(m), m, "left_semi")
    kept = stored(kept, "cells")
    if kept.count() <= held_cells:
        return _rake_held(kept, goals, tolerance)
    while True:
        kept = kept.withColumn("before", F.col("weight"))
        for m in margins:
            sums = kept.groupBy(m).agg(F.sum("weight").alias("now"))
            scale = sums.join(goals[m], m).select(m, (F.col("goal") / F.col("now")).alias("scale"))
            kept = kept.join(scale, m).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        kept = stored(kept, "raked")
        apart = 0.0
        for m in margins[:-1]:
            sums = kept.groupBy(m).agg(F.sum("weight").alias("now")).join(goals[m], m)
            worst = sums.agg(F.max(F.abs(F.col("now") / F.col("goal") - 1))).first()[0]
            apart = max(apart, worst or 0.0)
        moved = kept.agg(F.sum(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
        kept = kept.drop("before")
        if apart <= tolerance or moved <= STILL:
            return kept, apart


def _rake_held(kept: DataFrame, goals: dict[str, DataFrame], tolerance: float) -> tuple[DataFrame, float]:
    """The rounds of ``rake`` over a small table of cells, in a fixed order."""
    rows = sorted(kept.collect(), key=repr)
    weight = np.array([r["weight"] for r in rows])
    margins = []
    for m, table in goals.items():
        names = sorted({r[m] for r in rows})
        place = {v: i for i, v in enumerate(names)}
        # Only values of these cells, of which there are few.
        shares = {r[m]: r["goal"] for r in table.join(kept.select(m).distinct(), m, "left_semi").collect()}
        margins.append((np.array([place[r[m]] for r in rows], dtype=int), np.array([shares[v] for v in names])))
    apart = 0.0
    while rows:
        before = weight
        for at, goal in margins:
            now = np.bincount(at, weight, len(goal))
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        apart = max((float(np.abs(np.bincount(at, weight, len(goal)) / goal - 1).max()) for at, goal in margins[:-1]), default=0.0)
        if apart <= tolerance or np.abs(weight - before).sum() <= STILL:
            break
    fitted = [(*(r[c] for c in kept.columns if c != "weight"), float(w)) for r, w in zip(rows, weight)]
    others = [c for c in kept.columns if c != "weight"]
    made = kept.sparkSession.createDataFrame(fitted, kept.select(*others, "weight").schema)
    return made.select(*kept.columns), apart


def calibrate(weighted: DataFrame, budget: float) -> DataFrame:
    """Cells with ``probability``: min(1, scale * weight / tokens), the scale chosen so that the expected tokens meet the budget.

    Cells at probability 1 give all they have; the rest share what is missing in proportion to their weights.
    """
    scale = 0.0
    rate = F.col("weight") / F.col("tokens")
    while True:
        full = rate * F.lit(scale) >= 1
        held, left = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if left <= 0 or held >= budget:
            break
        better = (budget - held) / left
        if better <= scale * (1 + 1e-12):
            break
        scale = better
    return weighted.withColumn("probability", F.least(F.lit(1.0), rate * F.lit(scale)))


def mix(
    df: DataFrame,
    topic: Column,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    targets: dict[str, DataFrame] | None = None,
    exponent: float = 0.7,
    fraction: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Every column of ``df`` and a struct ``mix`` (source, lang, topic, n_tokens, probability, sampled, deviation).

    ``fraction`` of all tokens is expected in the sample. ``targets`` has (value, share) tables by margin; tempered shares by default.
    ``deviation`` is the largest relative deviation of the fitted weights from a margin's targets, equal in all rows.
    """
    facts = df.withColumn(
        "mix",
        F.struct(
            F.coalesce(F.col(source).cast("string"), F.lit("(none)")).alias("source"),
            F.coalesce(F.col(lang).cast("string"), F.lit("(none)")).alias("lang"),
            F.coalesce(topic, F.lit("(none)")).alias("topic"),
            token_count(F.col(text)).alias("n_tokens"),
        ),
    )
    sums = facts.groupBy(*[F.col(f"mix.{m}").alias(m) for m in MARGINS]).agg(F.sum("mix.n_tokens").alias("tokens"))
    cells = stored(sums.where(F.col("tokens") > 0), "cell-sums")
    goals = targets or {m: tempered_targets(cells, m, exponent) for m in MARGINS}
    weighted, apart = rake(cells, goals)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    odds = stored(calibrate(weighted, fraction * total).select(*[F.col(m).alias(f"_odds_{m}") for m in MARGINS], F.col("probability").alias("_odds")), "odds")
    if odds.count() <= BROADCAST_CELLS:
        odds = F.broadcast(odds)
    here = [F.col(f"mix.{m}") == F.col(f"_odds_{m}") for m in MARGINS]
    # 53 bits of the hash, as a number from 0 to 1.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), text_key(F.col(text))), 11) / F.lit(float(1 << 53))
    chance = F.coalesce("_odds", F.lit(0.0))
    placed = facts.join(odds, here, "left").withColumn(
        "mix", F.col("mix").withField("probability", chance).withField("sampled", draw < chance).withField("deviation", F.lit(apart))
    )
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != "mix"], "mix")

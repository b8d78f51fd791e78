"""Profiling aggregates: label shares, length percentiles, duplicates, slots, token counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.slots import slot_names
from quillstrata.functions.text import char_count, pre_token_count, word_count
from quillstrata.session import cut_lineage

STATS = ["min", "p25", "median", "mean", "p95", "p99", "max"]


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded share of ``whole``; 0.0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, digits)


def class_distribution(df: DataFrame, label_col: str, digits: int = 2) -> DataFrame:
    """(label, count, percentage), most frequent first, ties by label."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # The total of the counts: the same shuffle serves both, the table is read once.
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.withColumn("percentage", percent(F.col("count"), total, digits)).orderBy(
        F.desc("count"), "label"
    )


# Bits of one level of the value tree: a running count covers at most 2^LEVEL_BITS rows, whatever the values.
LEVEL_BITS = 12
QUANTILES = {"p25": 0.25, "median": 0.5, "p95": 0.95, "p99": 0.99}


def _ranked(counted: DataFrame, metric_col: str, value_col: str, span: int) -> DataFrame:
    """``counted`` (metric, value, n, min) with ``upto``, the number of rows up to the value.

    Values above the metric's minimum are read as digits of LEVEL_BITS bits. Each level counts what lies before a digit among its
    siblings, so a window holds siblings only; the counts of all levels add up to the rank.
    """
    levels = max(1, -(-span.bit_length() // LEVEL_BITS))
    offset = (F.col(value_col) - F.col("min")).cast("bigint")
    rows = counted.withColumn("path", offset)
    before = None
    for level in range(levels - 1, -1, -1):
        shift = LEVEL_BITS * level
        at, parent = F.shiftright("path", shift), F.shiftright("path", shift + LEVEL_BITS) if shift + LEVEL_BITS < 64 else F.lit(0)
        sums = rows.groupBy(metric_col, at.alias("at"), parent.cast("bigint").alias("parent")).agg(F.sum("n").alias("n"))
        siblings = Window.partitionBy(metric_col, "parent").orderBy("at")
        placed = sums.withColumn("before", F.sum("n").over(siblings) - F.col("n"))
        if before is not None:
            above = before.select(metric_col, F.col("at").alias("parent"), F.col("before").alias("above"))
            placed = placed.join(above, [metric_col, "parent"]).withColumn("before", F.col("before") + F.col("above"))
        before = placed.select(metric_col, "at", "before")
    found = before.withColumnRenamed("at", "path")
    return rows.join(found, [metric_col, "path"]).withColumn("upto", F.col("before") + F.col("n"))


def percentile_stats(values: DataFrame, metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """min ... max per metric of a long (metric, value) table of whole numbers.

    Equal values are counted first (on the map side) and stored; exact ranks come from a tree of counts, so no task ranks all
    values of a metric, however far they spread. Quantiles interpolate linearly between neighbouring ranks, from the nearer one, and are
    cut to integers.
    """
    value = F.col(value_col)
    counted = cut_lineage(values.where(value.isNotNull()).groupBy(metric_col, value_col).agg(F.count(F.lit(1)).alias("n")))
    ends = counted.groupBy(metric_col).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum("n").alias("rows"), F.sum(value * F.col("n")).alias("total")
    )
    span = ends.agg(F.max(F.col("max").cast("decimal(20,0)") - F.col("min").cast("decimal(20,0)"))).first()[0]
    ranked = _ranked(counted.join(ends, metric_col), metric_col, value_col, int(span or 0))
    positions = {name: (F.col("rows") - 1) * F.lit(q) for name, q in QUANTILES.items()}

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, value))

    ends = ranked.groupBy(metric_col, "min", "total", "rows", "max").agg(
        *[at_rank(F.floor(position)).alias(f"{name}_low") for name, position in positions.items()],
        *[at_rank(F.ceil(position)).alias(f"{name}_high") for name, position in positions.items()],
    )

    def between(name: str) -> Column:
        low, high, position = F.col(f"{name}_low"), F.col(f"{name}_high"), positions[name]
        share = position - F.floor(position)
        nearer_high = high - (high - low) * (1 - share)
        return F.when(share >= 0.5, nearer_high).otherwise(low + (high - low) * share).cast("bigint").alias(name)

    return ends.select(
        metric_col,
        F.col("min").cast("bigint"),
        between("p25"),
        between("median"),
        F.round(F.col("total") / F.col("rows"), 2).alias("mean"),
        between("p95"),
        between("p99"),
        F.col("max").cast("bigint"),
    )


def zero_filled(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """All named metrics, with zeros where there was no value to look at."""
    wanted = stats.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    filled = wanted.join(stats, "metric", "left")
    zeros = {c: (0.0 if c == "mean" else 0) for c in STATS}
    return filled.fillna(zeros)


def _long(df: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(name).alias("metric"), number.alias("value")) for name, number in numbers.items()]
    )
    return df.select(F.inline(pairs))


def length_values(df: DataFrame, instruction_col: str = "instruction", response_col: str = "response") -> DataFrame:
    return _long(
        df,
        {
            "instruction_chars": char_count(F.col(instruction_col)),
            "instruction_words": word_count(F.col(instruction_col)),
            "response_chars": char_count(F.col(response_col)),
            "response_words": word_count(F.col(response_col)),
        },
    )


LENGTH_METRICS = ["instruction_chars", "instruction_words", "response_chars", "response_words"]
TOKEN_METRICS = ["instruction_tokens", "response_tokens", "total_tokens"]


def length_stats(df: DataFrame, instruction_col: str = "instruction", response_col: str = "response") -> DataFrame:
    """Character and word counts of both texts; zeros when there is nothing to count."""
    return zero_filled(percentile_stats(length_values(df, instruction_col, response_col)), LENGTH_METRICS)


def pandas_tokenizer(count_tokens: Callable[[str], int]) -> Callable[[Column], Column]:
    """Wrap a plain text -> token count function for use as a ``tokenizer`` (runs in Arrow batches)."""

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else count_tokens(t)).astype("Int64")

    return lambda text: counts(text)


def token_values(
    df: DataFrame,
    tokenizer: Callable[[Column], Column] = pre_token_count,
    instruction_col: str = "instruction",
    response_col: str = "response",
) -> DataFrame:
    counted = df.select(
        tokenizer(F.col(instruction_col)).alias("i"), tokenizer(F.col(response_col)).alias("r")
    )
    return _long(
        counted,
        {
            "instruction_tokens": F.col("i"),
            "response_tokens": F.col("r"),
            "total_tokens": F.col("i") + F.col("r"),
        },
    )


def token_length_stats(
    df: DataFrame,
    tokenizer: Callable[[Column], Column] = pre_token_count,
    instruction_col: str = "instruction",
    response_col: str = "response",
) -> DataFrame:
    """Token counts of both texts and of their sum. ``tokenizer`` maps a text column to an integer column."""
    values = token_values(df, tokenizer, instruction_col, response_col)
    return zero_filled(percentile_stats(values), TOKEN_METRICS)


def truncation_rate(
    df: DataFrame,
    max_seq_length: int = 512,
    tokenizer: Callable[[Column], Column] = pre_token_count,
    instruction_col: str = "instruction",
    response_col: str = "response",
) -> DataFrame:
    """(total_rows, truncated_rows, truncated_percentage) at a sequence limit."""
    tokens = tokenizer(F.col(instruction_col)) + tokenizer(F.col(response_col))
    over = df.select((tokens > max_seq_length).alias("over"))
    total, cut = F.count(F.lit(1)), F.count_if("over")
    return over.agg(
        total.alias("total_rows"), cut.alias("truncated_rows"), percent(cut, total).alias("truncated_percentage")
    )


def _digest(*columns: str) -> Column:
    # 16 bytes instead of the text go through the shuffle; null and "" stay apart.
    return F.unhex(F.md5(F.concat_ws(":", *[F.coalesce(F.md5(F.col(c)), F.lit("null")) for c in columns])))


def dedup_stats(df: DataFrame, instruction_col: str = "instruction", response_col: str = "response") -> DataFrame:
    """One row: total, distinct instructions, exact duplicates, rate, distinct pairs, duplicate pairs."""
    return _dedup(df.select(_digest(instruction_col).alias("i"), _digest(response_col).alias("r")))


def _dedup(digests: DataFrame) -> DataFrame:
    pairs = digests.groupBy("i", "r").agg(F.count(F.lit(1)).alias("n"))
    per_instruction = pairs.groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    total, unique, unique_pairs = (
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count(F.lit(1)),
        F.coalesce(F.sum("pairs"), F.lit(0)),
    )
    return per_instruction.agg(
        total.alias("total_rows"),
        unique.alias("unique_instructions"),
        (total - unique).alias("exact_duplicate_instructions"),
        percent(total - unique, total).alias("instruction_duplicate_rate"),
        unique_pairs.alias("unique_instruction_response_pairs"),
        (total - unique_pairs).alias("duplicate_pairs"),
    )


def exact_duplicates(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(text_md5, copies, first_id) of every text that occurs more than once."""
    return (
        df.groupBy(F.md5(F.col(text_col)).alias("text_md5"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"))
        .where(F.col("copies") > 1)
    )


def _slots_per_side(df: DataFrame, instruction_col: str, response_col: str) -> DataFrame:
    return df.select(
        slot_names(F.col(instruction_col)).alias("instruction_slots"), slot_names(F.col(response_col)).alias("response_slots")
    )


def placeholder_stats(
    df: DataFrame, instruction_col: str = "instruction", response_col: str = "response"
) -> DataFrame:
    """One row: rows with a slot per side, their shares, and the sorted slot names of both sides.

    The names are a report field and make one row; :func:`placeholder_frequency` has them as a table.
    """
    return _slot_stats(_slots_per_side(df, instruction_col, response_col), names=True)


def placeholder_frequency(
    df: DataFrame, instruction_col: str = "instruction", response_col: str = "response"
) -> DataFrame:
    """(name, occurrences) of every slot over both texts."""
    return _slot_frequency(_slots_per_side(df, instruction_col, response_col))


def _slot_frequency(sides: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("instruction_slots", none), F.coalesce("response_slots", none))
    return sides.select(F.explode(both).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("occurrences"))


def _slot_stats(sides: DataFrame, names: bool = False) -> DataFrame:
    total = F.count(F.lit(1))
    left, right = F.count_if(F.size("instruction_slots") > 0), F.count_if(F.size("response_slots") > 0)
    stats = sides.agg(
        left.alias("instruction_count"),
        percent(left, total).alias("instruction_percentage"),
        right.alias("response_count"),
        percent(right, total).alias("response_percentage"),
    )
    if not names:
        return stats
    # Asked for as one field: the only place where all names meet in a row.
    listed = _slot_frequency(sides).agg(F.sort_array(F.collect_list("name")).alias("names")).scalar()
    return stats.withColumn("unique_placeholders", listed)


def profile_facts(df: DataFrame, tokenizer: Callable[[Column], Column] = pre_token_count) -> DataFrame:
    """What the profile needs of each row: labels, counts, slot names and digests, but no text."""
    instruction, response = F.col("instruction"), F.col("response")
    counted = df.select(
        "category",
        "intent",
        char_count(instruction).alias("instruction_chars"),
        word_count(instruction).alias("instruction_words"),
        char_count(response).alias("response_chars"),
        word_count(response).alias("response_words"),
        tokenizer(instruction).alias("instruction_tokens"),
        tokenizer(response).alias("response_tokens"),
        slot_names(instruction).alias("instruction_slots"),
        slot_names(response).alias("response_slots"),
        _digest("instruction").alias("i"),
        _digest("response").alias("r"),
    )
    return counted.withColumn("total_tokens", F.col("instruction_tokens") + F.col("response_tokens"))


def _count_stats(facts: DataFrame, metrics: list[str]) -> DataFrame:
    return zero_filled(percentile_stats(_long(facts, {m: F.col(m) for m in metrics})), metrics)


def _section(df: DataFrame, section: str, metric: Column, label: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        metric.alias("metric"),
        label.alias("label"),
        value.cast("double").alias("value"),
    )


def _unpivot(df: DataFrame, section: str, label: Column, columns: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    opened = df.select(label.alias("label"), F.explode(pairs).alias("p"))
    return _section(opened, section, F.col("p.metric"), F.col("label"), F.col("p.value"))


def full_profile(df: DataFrame, tokenizer: Callable[[Column], Column] = pre_token_count) -> DataFrame:
    """All profile numbers as one long table (section, metric, label, value).

    The texts are read once, for the narrow facts; every aggregate runs over those.
    """
    facts = cut_lineage(profile_facts(df, tokenizer))
    nothing = F.lit(None).cast("string")
    parts = []
    for column, section in [("category", "categories"), ("intent", "intents")]:
        parts.append(_unpivot(class_distribution(facts, column), section, F.col("label"), ["count", "percentage"]))
    parts.append(_unpivot(_count_stats(facts, LENGTH_METRICS + TOKEN_METRICS), "lengths", F.col("metric"), STATS))
    counts = ["instruction_count", "instruction_percentage", "response_count", "response_percentage"]
    parts.append(_unpivot(_slot_stats(facts), "placeholders", nothing, counts))
    names = _slot_frequency(facts)
    parts.append(_section(names, "placeholders", F.lit("occurrences"), F.col("name"), F.col("occurrences")))
    duplicates = _dedup(facts)
    parts.append(_unpivot(duplicates, "duplicates", nothing, duplicates.columns))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def profile_report(
    df: DataFrame, tokenizer: Callable[[Column], Column] = pre_token_count, lists: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, tables): the nested one-row report of totals, length and token maps, slots and duplicates, and the tables beside it.

    Label shares and slot names are tables, one row each: ``categories``, ``intents``, ``placeholders``. With ``lists`` the
    report holds them as well, for label sets known to be small.
    """
    facts = cut_lineage(profile_facts(df, tokenizer))
    tables = {
        "categories": class_distribution(facts, "category"),
        "intents": class_distribution(facts, "intent"),
        "placeholders": _slot_frequency(facts),
    }

    def shares(column: str) -> Column:
        # One element per label; sorting on the negated count puts the most frequent first.
        ranked = class_distribution(facts, column).select((-F.col("count")).alias("rank"), "label", "count", "percentage")
        listed = ranked.agg(F.sort_array(F.collect_list(F.struct(*ranked.columns))).alias("rows"))
        plain = F.transform(
            "rows",
            lambda r: F.struct(*[r[c].alias(c) for c in ["label", "count", "percentage"]]),
        )
        return listed.select(plain.alias("rows")).scalar()

    def metric_map(stats: DataFrame) -> Column:
        entries = F.collect_list(F.struct("metric", F.struct(*STATS).alias("stats")))
        return stats.agg(F.map_from_entries(entries).alias("m")).scalar()

    duplicates = _dedup(facts)
    slots = _slot_stats(facts, lists)
    report = duplicates.select(
        F.col("total_rows").alias("total_records"),
        *([shares("category").alias("categories"), shares("intent").alias("intents")] if lists else []),
        metric_map(_count_stats(facts, LENGTH_METRICS)).alias("text_lengths"),
        metric_map(_count_stats(facts, TOKEN_METRICS)).alias("token_lengths"),
        slots.select(F.struct(*slots.columns).alias("s")).scalar().alias("placeholders"),
        F.struct(*duplicates.columns).alias("duplicates"),
    )
    return report, tables


def report_table(report: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A report and its tables, as written and read back, in the long form of :func:`full_profile`."""
    nothing = F.lit(None).cast("string")
    parts = [_unpivot(tables[section], section, F.col("label"), ["count", "percentage"]) for section in ("categories", "intents")]
    for field in ("text_lengths", "token_lengths"):
        stats = report.select(F.explode(field).alias("metric", "stats")).select("metric", "stats.*")
        parts.append(_unpivot(stats, "lengths", F.col("metric"), STATS))
    counts = ["instruction_count", "instruction_percentage", "response_count", "response_percentage"]
    parts.append(_unpivot(report.select("placeholders.*"), "placeholders", nothing, counts))
    parts.append(_section(tables["placeholders"], "placeholders", F.lit("occurrences"), F.col("name"), F.col("occurrences")))
    duplicates = report.select("duplicates.*")
    parts.append(_unpivot(duplicates, "duplicates", nothing, duplicates.columns))
    return reduce(DataFrame.unionByName, parts)

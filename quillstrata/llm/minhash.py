"""MinHash near-duplicates by tensored banding: table keys are pairs of two small collections of tuples.

Each distinct shingle set gets two collections of ``tuples`` tuples of ``rows`` minhashes. Every pair of a tuple of the first and one of the
second collection keys a table, so ``tuples`` squared tables of 2 ``rows`` minhashes each take only 2 * ``tuples`` * ``rows`` of them. Two sets of
similarity s meet in a table with probability (1 - (1 - s^rows)^tuples)^2; with 3 and 20, all but about one in a million pairs at 0.8
meet, and of closer pairs fewer are missed.

Two sets share a table key only if they share both its tuples. So tuples of one set only make no keys, and tuples of a set that have the same
members (told by their number and two sums over their hashes) make the same tables and count once. What is left, of a lone pair one table,
is linked as stars; links are verified on full sets and joined to components. What is left are pairs of different components, and those
of a table all share a tuple of the first collection. The members of such a tuple are dealt to units of bounded size. A pair is
plausible there if the sets share at least ``LEAST_TUPLES`` of their tuples (at 0.8 all but one in ten million do) and this tuple
is the one with the most members that they share, so each pair is met once. Only members with a plausible partner get their full
sets compared, and only a spanning forest comes back. So every pair that meets is decided on full sets, and no group is listed as pairs.

Cases: a text without words, or null, has an empty set and is linked with nothing; a text with fewer words than a shingle is one shingle;
equal sets are one node, so copies cost nothing; repeated rows share the result; a row with a null key gets the smallest key of
its component, null if there is none; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from quillstrata.llm.common import map_blocks, stored, text_key, utf8
from quillstrata.llm.decontam import combine
from quillstrata.operators.clusters import connected_components
from quillstrata.plans.skew import HEAVY_ROWS, lookup

SHINGLE = 2
ROWS = 3
TUPLES = 20
# Links need this many hundredths of the union in the intersection.
PERCENT = 80
# Members, and shingles of theirs, in one part of a table whose members are compared with each other; two parts meet in a unit.
PART_MEMBERS = 256
PART_SHINGLES = 1 << 20
# Of 2 * TUPLES tuples, those that a pair worth comparing shares.
LEAST_TUPLES = 5
# Keys of texts whose sets are needed again are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_KEYS = 200_000
# Shingles whose minhashes are computed together.
_AT_ONCE = 2048


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    words = [raw.lower().split() for raw in texts]
    one = np.fromiter((xxh3_64_intdigest(w) for text in words for w in text), np.uint64)
    sets, at = [], 0
    for text in words:
        mine = one[at : at + len(text)]
        at += len(text)
        sets.append(np.unique(combine(mine, min(size, len(mine)))) if len(mine) else mine)
    return sets


class Sketcher:
    """Tuples of minhashes of a set; the low bit of a tuple tells its collection."""

    def __init__(self, rows: int, tuples: int, seed: int = 42) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.rows, self.tuples = rows, tuples
        self.flips, self.factors = draw.integers(0, 1 << 64, (2, 2 * tuples * rows), np.uint64) | np.uint64(1)
        self.slots = np.arange(2 * tuples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flips), ~np.uint64(0))
        for first in range(0, len(shingles), _AT_ONCE):
            block = (shingles[first : first + _AT_ONCE, None] ^ self.flips) * self.factors
            np.minimum(least, block.min(axis=0), out=least)
        out = self.slots.copy()
        for column in least.reshape(-1, self.rows).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        side = np.arange(len(out), dtype=np.uint64) >= self.tuples
        return (out & ~np.uint64(1)) | side


def sketches(df: DataFrame, key: str, text: str, rows: int, tuples: int, shingle: int) -> DataFrame:
    """(key, text_key, n_shingles, id, tuples), one row per row. ``id`` is a 128-bit digest of the set, null for an empty one."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sketcher = Sketcher(rows, tuples)
        sets = shingle_sets(part["utf8"].to_pylist(), shingle)
        ids = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        found = [sketcher.sketch(s).view(np.int64) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                part["key"],
                part["text_key"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array(found, pa.list_(pa.int64())),
            ],
            ["key", "text_key", "n_shingles", "id", "tuples"],
        )

    texts = df.select(F.col(f"`{key}`").alias("key"), text_key(F.col(f"`{text}`")).alias("text_key"), utf8(F.col(f"`{text}`")).alias("utf8"))
    return map_blocks(texts, work, f"key {dict(texts.dtypes)['key']}, text_key bigint, n_shingles bigint, id binary, tuples array<bigint>")


def _members(id_column: str) -> list:
    """Aggregates that tell a set of members: their number and two sums over their hashes."""
    return [F.count(F.lit(1)).alias("members"), *[F.bit_xor(F.xxhash64(id_column, F.lit(n))).alias(f"sum{n}") for n in (1, 2)]]


def table_keys(nodes: DataFrame, total_tuples: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(id, size, first, tuples, tables) of every set that shares a tuple of both collections with others.

    ``tuples`` are its shared tuples, ``first`` the different groups of members behind those of the first collection, named by numbers that are the
    lower the more members there are, ``tables`` its distinct tables.
    """
    listed = nodes.select("id", F.col("n_shingles").alias("size"), F.explode("tuples").alias("tuple"))
    shared = listed.groupBy("tuple").agg(*_members("id")).where(F.col("members") > 1)
    rank = F.shiftleft((1 << 20) - F.least("members", F.lit(1 << 20)), 42)
    shared = shared.select("tuple", (rank + F.shiftrightunsigned(F.xxhash64("members", "sum1", "sum2"), 22)).alias("same"))
    met = lookup(listed, shared, ["tuple"], "id", total_tuples, heavy_rows).where(F.col("same").isNotNull())
    second = F.col("tuple").bitwiseAND(1) == 1
    sides = met.groupBy("id", "size").agg(
        F.collect_set(F.when(~second, F.col("same"))).alias("first"),
        F.collect_set(F.when(second, F.col("same"))).alias("second"),
        F.collect_list("tuple").alias("tuples"),
    )
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    return sides.where((F.size("first") > 0) & (F.size("second") > 0)).select("id", "size", "first", "tuples", pairs.alias("tables"))


def _similar(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (left + right - shared)


def full_sets(df: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, set): the sets of the wanted (id, key, text_key) as packed hashes, made again from their texts."""
    texts = df.select(F.col(f"`{key}`").alias("key"), text_key(F.col(f"`{text}`")).alias("text_key"), utf8(F.col(f"`{text}`")).alias("utf8")).alias("t")
    asked = (F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted).alias("w")
    same = F.col("t.key").eqNullSafe(F.col("w.key")) & (F.col("t.text_key") == F.col("w.text_key"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in shingle_sets(part["utf8"].to_pylist(), shingle)]
        return pa.RecordBatch.from_arrays([part["id"], pa.array(packed, pa.binary())], ["id", "set"])

    found = map_blocks(texts.join(asked, same).select("w.id", "t.utf8"), work, "id binary, set binary")
    # A row may be there many times.
    return found.groupBy("id").agg(F.first("set").alias("set"))


def verified(links: DataFrame, sets: DataFrame, percent: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The links (src, dst) whose full sets are similar enough."""
    left = links.join(sets.select(F.col("id").alias("src"), F.col("set").alias("left")), "src")
    both = lookup(left, sets.select(F.col("id").alias("dst"), F.col("set").alias("right")), ["dst"], "src", links.count(), heavy_rows)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for a, b in zip(part["left"], part["right"]):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            shared = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
            kept.append(bool(_similar(shared, len(a), len(b), percent)))
        return part.select(["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    return map_blocks(both.select("src", "dst", "left", "right"), work, "src binary, dst binary")


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many numbers every two lists have in common; no list has one twice."""
    n = len(lists)
    values, column = np.unique(np.concatenate(lists), return_inverse=True)
    member = np.repeat(np.arange(n), [len(v) for v in lists])
    # Only numbers of several lists count; they are taken in blocks of columns.
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    kept = often[column]
    member, column = member[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    shared, width = np.zeros((n, n), np.float32), 4096
    for first in range(0, int(often.sum()), width):
        low, high = np.searchsorted(column, [first, first + width])
        there = np.zeros((n, width), np.float32)
        there[member[low:high], column[low:high] - first] = 1
        shared += there @ there.T
    return np.rint(shared).astype(np.int64)


def _numbers(roots: list[bytes]) -> np.ndarray:
    place = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([place[r] for r in roots], np.int64)


def plausible(name: int, sizes: np.ndarray, roots: list[bytes], firsts: list[np.ndarray], tuples: list[np.ndarray], percent: int) -> np.ndarray:
    """The members of group ``name`` that have a partner to be compared with in this group."""
    root = _numbers(roots)
    near = (_common(tuples) >= LEAST_TUPLES) & (root[:, None] != root[None, :])
    near &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    wanted = np.zeros(len(sizes), bool)
    lower = [f[f < name] for f in firsts]
    # A pair that has a lower group in common is met there.
    met_before = _common(lower) > 0 if any(len(f) for f in lower) else np.zeros_like(near)
    wanted[np.nonzero((near & ~met_before).any(axis=1))[0]] = True
    return wanted


def unit_forest(sets: list[np.ndarray], roots: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that join, with what the roots have joined already, all members whose sets are similar enough."""
    sizes, group = np.array([len(s) for s in sets], np.int64), _numbers(roots)
    near = _similar(_common(sets), sizes[:, None], sizes[None, :], percent)
    found = []
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        if group[a] != group[b]:
            group[group == group[b]] = group[a]
            found.append((a, b))
    return found


def compared(tables: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, part_members: int = PART_MEMBERS) -> DataFrame:
    """(src, dst): similar sets that share a tuple and are in different components, as a spanning forest of each unit."""
    placed = tables.drop("tables").join(roots.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    listed = placed.select("id", "root", "size", "first", "tuples", F.explode("first").alias("name"))
    by_root = listed.groupBy("name", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes"))
    counted = by_root.groupBy("name").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("members"), F.sum("sizes").alias("sizes"),
        F.count(F.lit(1)).alias("roots"),
    )
    parts = F.greatest(F.ceil(F.col("members") / part_members), F.ceil(F.col("sizes") / PART_SHINGLES)).cast("int")
    rest = F.ceil((F.col("members") - F.col("most")) / part_members).cast("int")
    several = counted.where(F.col("roots") > 1).select("name", "largest", parts.alias("parts"), F.least(rest, parts).alias("rest"))
    # Of two members with different roots one is outside the largest component: part a of those meets part b of all in unit (a, b).
    mine = [F.pmod(F.xxhash64("id", "name"), F.col(c)).cast("int") for c in ("rest", "parts")]
    as_any = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda a: F.struct(a.alias("a"), mine[1].alias("b")))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.struct(mine[0].alias("a"), b.alias("b")))
    units = F.when(F.col("root") == F.col("largest"), as_any).otherwise(F.array_distinct(F.concat(as_any, as_rest)))
    met = listed.join(several, "name").select("*", F.inline(units))

    def choose(group: pa.Table) -> pa.Table:
        arrays = {c: [v.values.to_numpy() for v in group[c]] for c in ("first", "tuples")}
        wanted = plausible(
            group["name"][0].as_py(), group["size"].to_numpy(), group["root"].to_pylist(), arrays["first"], arrays["tuples"], percent
        )
        return group.select(["name", "a", "b", "id", "root"]).filter(pa.array(wanted))

    def work(group: pa.Table) -> pa.Table:
        ids = group["id"].to_pylist()
        found = unit_forest([np.frombuffer(v, np.uint64) for v in group["set"].to_pylist()], group["root"].to_pylist(), percent)
        return pa.table({"src": pa.array([ids[a] for a, _ in found], pa.binary()), "dst": pa.array([ids[b] for _, b in found], pa.binary())})

    chosen = met.select("name", "a", "b", "id", "root", "size", "first", "tuples").groupBy("name", "a", "b")
    left = stored(chosen.applyInArrow(choose, "name bigint, a int, b int, id binary, root binary"), "compared")
    return left.join(sets, "id").groupBy("name", "a", "b").applyInArrow(work, "src binary, dst binary").distinct()


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    rows: int = ROWS,
    tuples: int = TUPLES,
    heavy_rows: int = HEAVY_ROWS,
    part_members: int = PART_MEMBERS,
) -> DataFrame:
    """(key, text_key, n_shingles, id, component, component_id), one row per row.

    ``id`` names the set, ``component`` is the smallest id of the component, ``component_id`` its smallest key. For an empty set the first
    two are null and ``component_id`` is the row's own key.
    """
    table = stored(sketches(df, key, text, rows, tuples, shingle), "sketches")
    order = F.struct(F.col("key").isNull().alias("unnamed"), "key", "text_key")
    # Equal sets have equal sketches: any of them stands for all.
    named = table.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(order).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("tuples").alias("tuples"))
    nodes = stored(named.select("id", "first.key", "first.text_key", "n_shingles", "tuples"), "nodes")
    tables = stored(table_keys(nodes, nodes.count() * 2 * tuples, heavy_rows), "tables")
    wanted = stored(nodes.select("id", "key", "text_key").join(tables.select("id"), "id", "left_semi"), "wanted")
    sets = stored(full_sets(df, wanted, key, text, shingle), "sets")

    listed = tables.select("id", F.explode("tables").alias("table"))
    low = listed.groupBy("table").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).select("table", "dst")
    total = tables.agg(F.sum(F.size("tables"))).first()[0] or 0
    star = lookup(listed, low, ["table"], "id", total, heavy_rows).where(F.col("dst") < F.col("id")).select(F.col("id").alias("src"), "dst")
    links = stored(verified(stored(star.distinct(), "stars"), sets, percent, heavy_rows), "links")
    roots = connected_components(links, heavy_rows)
    more = stored(_downward(compared(tables, roots, sets, percent, part_members)), "more-links")
    # The first components are stars to their roots by now.
    joined = connected_components(roots.select(F.col("id").alias("src"), F.col("root").alias("dst")).unionByName(more), heavy_rows)

    placed = nodes.select("id", "key").join(joined, "id", "left").select("id", "key", F.coalesce("root", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("key").alias("component_id"))
    components = placed.select("id", "component").join(least, "component")
    # A group of copies may hold a third of the rows: beyond a size its rows are dealt to many tasks.
    # Empty sets have no id to look up; they would be one heavy key.
    base = table.select("key", "text_key", "n_shingles", "id")
    linked = lookup(base.where(F.col("id").isNotNull()), components, ["id"], "key", base.count(), heavy_rows)
    alone = base.where(F.col("id").isNull()).withColumns({"component": F.lit(None).cast("binary"), "component_id": F.col("key")})
    both = linked.select(*alone.columns).unionByName(alone)
    return both.withColumnRenamed("key", key)

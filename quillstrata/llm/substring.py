"""Exact substring deduplication with a compressed FM-index per shard.

A window is ``window`` consecutive words of one document; a word goes if a window over it also occurs in a document with a smaller key.

1. Identical texts form a class; only its smallest document is searched further.
2. Each window has a unit: the smallest hash of its 4-word runs, so equal windows share it whatever surrounds them. Units of two
   documents or more are found from distinct (unit, document) pairs; pairs already met twice inside a task stay out of the shuffle but for one notice.
3. The runs of windows of such units, with the words they cover, are the contexts. Equal contexts are one row with the smallest
   and largest document, so a passage in a third of all documents is as small as any other.
4. A shard is a set of whole units. Its task builds an FM-index over the contexts (wavelet matrix with bit-packed ranks over the Burrows-Wheeler
   transform) and streams them through backward search, all windows at a time. A window's suffix interval holds its
   occurrences in the shard, which are all there are; the smallest document in it decides.
5. A unit with more than UNIT_CONTEXTS contexts is dealt to several shards by a second hash, that of the window: each context is cut where
   the shard of its windows changes, equal pieces are one row again, and the same index and search decide.
6. Windows that began in a smaller document mark their words; the intervals they cover are the ``spans``.

Cases: null and empty texts have no words; texts shorter than a window keep all; a null key counts as larger than any other, and so does
2^63 - 1, which stands for it; rows of one key neither hide each other nor themselves; repeated rows share their result; empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from quillstrata.llm.common import map_blocks, stored, text_key, utf8
from quillstrata.llm.decontam import combine
from quillstrata.plans.skew import HEAVY_ROWS, lookup

GRAM = 4
NO_KEY = (1 << 63) - 1
NOTICE = -(1 << 63)
# The seed of Spark's xxhash64.
CONTEXT_SEED = 42
# Distinct (unit, document) pairs that a task looks at together, and the pairs of one bucket.
PAIRS_AT_ONCE = 1_000_000
# Windows of one context at most: longer runs, as of one repeated word, are cut.
CONTEXT_WINDOWS = 64
# Words of one shard, and contexts of a unit beyond which it is dealt to several shards.
SHARD_WORDS = 1_000_000
UNIT_CONTEXTS = 2_000
# Tasks that bring the pairs of units and documents together: a task takes several buckets one by one on larger tables.
PAIR_TASKS = 20_000


# --- units and contexts


def window_units(words: list[bytes], window: int) -> np.ndarray:
    """The unit of each window: the least hash of the 4-word runs inside it."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    least = combine(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), min(GRAM, window))
    left, span = window - min(GRAM, window) + 1, 1
    while 2 * span <= left:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < left:
        least = np.minimum(least[: len(least) - (left - span)], least[left - span :])
    return least


def unit_runs(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of the runs of equal units, none longer than CONTEXT_WINDOWS."""
    if not len(units):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1])
    sizes = np.diff(np.concatenate([first, [len(units)]]))
    if sizes.max() > CONTEXT_WINDOWS:
        first = np.concatenate([np.arange(f, f + s, CONTEXT_WINDOWS) for f, s in zip(first, sizes)])
        sizes = np.diff(np.concatenate([first, [len(units)]]))
    return first, sizes


def _pairs_by_bucket(units: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, direct, units, keys) of distinct pairs: shared units stay direct and send one notice, single ones go to their bucket."""
    order = np.lexsort((keys, units))
    units, keys = units[order], keys[order]
    fresh = np.concatenate([[True], (units[1:] != units[:-1]) | (keys[1:] != keys[:-1])])
    units, keys = units[fresh], keys[fresh]
    start = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
    sizes = np.diff(np.concatenate([start, [len(units)]]))
    shared = np.repeat(sizes > 1, sizes)
    if shared.any():
        yield int(units[0] % np.uint64(buckets)), True, units[shared], keys[shared]
    notice = units[start[sizes > 1]]
    out_units = np.concatenate([units[~shared], notice])
    out_keys = np.concatenate([keys[~shared], np.full(len(notice), NOTICE)])
    place = (out_units * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    place = (place % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[b] : cuts[b + 1]]
        yield int(b), False, out_units[mine], out_keys[mine]


_PAIRS = "bucket int, direct boolean, units binary, keys binary"


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, direct, units, keys = zip(*rows) if rows else ((), (), (), ())
    packed = [pa.array([v.tobytes() for v in part], pa.binary()) for part in (units, keys)]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(direct, pa.bool_()), *packed], ["bucket", "direct", "units", "keys"])


def shared_units(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc, unit): the units of each document that some other document has too, and maybe a few more of its own."""

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, keys, held = [], [], 0
        for batch in batches:
            for raw, key in zip((x.as_py() for x in batch["utf8"]), batch["doc"].to_pylist()):
                mine = np.unique(window_units(raw.split(), window))
                units.append(mine)
                keys.append(np.full(len(mine), key))
                held += len(mine)
                if held >= PAIRS_AT_ONCE:
                    yield _pair_batch(list(_pairs_by_bucket(np.concatenate(units), np.concatenate(keys), buckets)))
                    units, keys, held = [], [], 0
        if held:
            yield _pair_batch(list(_pairs_by_bucket(np.concatenate(units), np.concatenate(keys), buckets)))

    def pairs_of(units: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(units.view(np.int64))], ["doc", "unit"])

    def meet(units: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        unit, key = np.concatenate(units), np.concatenate(keys)
        order = np.lexsort((key, unit))
        unit, key = unit[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        last = np.concatenate([start[1:], [len(unit)]]) - 1
        several = np.repeat(key[start] != key[last], last - start + 1) & (key != NOTICE)
        return pairs_of(unit[several], key[several])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, units, keys = None, [], []
        for batch in batches:
            for bucket, direct, u, k in zip(*[batch[n] for n in ("bucket", "direct", "units", "keys")]):
                unit, key = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(k.as_py(), np.int64)
                if direct.as_py():
                    yield pairs_of(unit, key)
                    continue
                if bucket.as_py() != now and units:
                    yield meet(units, keys)
                    units, keys = [], []
                now = bucket.as_py()
                units.append(unit)
                keys.append(key)
        if units:
            yield meet(units, keys)

    pairs = texts.select("doc", "utf8").mapInArrow(pair_up, _PAIRS)
    gathered = pairs.repartition(min(buckets, PAIR_TASKS), "bucket").sortWithinPartitions("bucket")
    return gathered.mapInArrow(decide, "doc bigint, unit bigint")


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = zip(*rows) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values())], list(kinds))


def with_runs(listed: DataFrame, window: int) -> DataFrame:
    """(key, text_key, utf8, runs): the runs of windows whose unit is in ``units``, as arrays of unit, hash of the words, first window, windows."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        ends, found = [0], ([], [], [], [])
        for raw, wanted in zip((x.as_py() for x in part["utf8"]), part["units"]):
            words = raw.split()
            units = window_units(words, window)
            first, sizes = unit_runs(units)
            if len(first):
                mine = np.isin(units[first], wanted.values.to_numpy().view(np.uint64))
                first, sizes = first[mine], sizes[mine]
            texts = (b" ".join(words[f : f + n + window - 1]) for f, n in zip(first.tolist(), sizes.tolist()))
            names = np.fromiter((xxh64_intdigest(t, CONTEXT_SEED) for t in texts), np.uint64, len(first))
            for kept, values in zip(found, (units[first].view(np.int64), names.view(np.int64), first.astype(np.int32), sizes.astype(np.int32))):
                kept.append(values)
            ends.append(ends[-1] + len(first))
        kinds = (np.int64, np.int64, np.int32, np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, k), *v]))) for k, v in zip(kinds, found)]
        return pa.RecordBatch.from_arrays([part["key"], part["text_key"], part["utf8"], *lists], ["key", "text_key", "utf8", "unit", "context_key", "start", "n"])

    schema = "key bigint, text_key bigint, utf8 binary, unit array<bigint>, context_key array<bigint>, start array<int>, n array<int>"
    return map_blocks(listed.select("key", "text_key", "utf8", "units"), cut, schema)


def contexts(candidates: DataFrame, window: int) -> DataFrame:
    """(unit, context, n, key): the runs with the words they cover."""
    kinds = {"unit": pa.int64(), "context": pa.binary(), "n": pa.int32(), "key": pa.int64()}

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, key, *runs in zip((x.as_py() for x in part["utf8"]), *[part[c].to_pylist() for c in ("key", "unit", "start", "n")]):
            words = raw.split()
            out += [(u, b" ".join(words[f : f + n + window - 1]), n, key) for u, f, n in zip(*runs)]
        return _columns(out, kinds)

    return map_blocks(candidates.select("utf8", "key", "unit", "start", "n"), cut, "unit bigint, context binary, n int, key bigint")


def context_places(candidates: DataFrame) -> DataFrame:
    """(unit, context_key, key, text_key, start): where the runs begin; texts are not read."""
    runs = candidates.select("key", "text_key", F.explode(F.arrays_zip("unit", "context_key", "start")).alias("run"))
    return runs.select("run.unit", "run.context_key", "key", "text_key", "run.start")


# --- the index


# Patterns searched at a time: the working arrays stay in the processor cache.
SEARCH_CHUNK = 1 << 14
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank over a sequence of small numbers: per bit a packed bit vector with a running count per 64 bits."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        largest = int(values.max(initial=1))
        self.bits = max(1, largest.bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((packed, before, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        # Where each symbol's own run begins behind the last level.
        every = np.arange(largest + 1)
        self.first = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & _BELOW[at & 63])
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search over a text of numbers for patterns of at most ``depth`` symbols; number 0 parts the documents.

    Suffixes are sorted by their first ``depth`` symbols or more, which is all that intervals of such patterns depend on.
    """

    def __init__(self, text: np.ndarray, depth: int):
        rank = text.astype(np.int64)
        span = 1
        order = np.argsort(rank)
        while span < depth:
            shifted = np.zeros_like(rank)
            shifted[:-span] = rank[span:] + 1
            pair = rank * (len(rank) + int(rank.max()) + 2) + shifted
            order = np.argsort(pair)
            ranked = pair[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            span *= 2
        self.suffixes = order
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.transform = WaveletMatrix(text[order - 1])

    def search(self, text: np.ndarray, ends: np.ndarray, length: int, until_single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns of ``length`` symbols that end at the positions ``ends`` of a text (inclusive).

        With ``until_single`` a pattern is followed only while its interval holds more than one suffix: the last one left is the
        pattern's own place if the text is the indexed one.
        """
        lows, highs = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
        for start in range(0, len(ends), SEARCH_CHUNK):
            end = ends[start : start + SEARCH_CHUNK]
            low, high = self.smaller[text[end]], self.smaller[text[end] + 1]
            live = np.arange(len(end))
            for back in range(1, length):
                if until_single:
                    live = live[high[live] - low[live] > 1]
                symbol = text[end[live] - back]
                ranks = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
                low[live] = self.smaller[symbol] + ranks[: len(live)]
                high[live] = self.smaller[symbol] + ranks[len(live) :]
            lows[start : start + len(end)], highs[start : start + len(end)] = low, high
        return lows, highs


def earliest(found: list[bytes], counts: np.ndarray, keys: np.ndarray, window: int) -> np.ndarray:
    """For every window of every context in turn: the smallest key of a context that holds it."""
    numbers: dict[bytes, int] = {}
    split = [c.split(b" ") for c in found]
    sizes = np.array([len(w) for w in split])
    text = np.zeros(int(sizes.sum()) + len(found), np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    inside = np.ones(len(text), bool)
    inside[firsts + sizes] = False
    text[inside] = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for words in split for w in words), np.int64, int(sizes.sum()))
    index = FMIndex(text, window)
    owner = keys[np.repeat(np.arange(len(found)), sizes + 1)][index.suffixes]
    offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    low, high = index.search(text, np.repeat(firsts, counts) + offsets + window - 1, window, until_single=True)
    # Intervals of different windows are disjoint, and one left at a single suffix is in no other: each is reduced once.
    at, which = np.unique(low, return_inverse=True)
    stop = np.zeros(len(at), np.int64)
    stop[which] = high
    cuts = np.column_stack([at, stop]).ravel()
    least = np.minimum.reduceat(np.append(owner, NO_KEY), cuts)[::2]
    return least[which]


def search_shards(distinct: DataFrame, window: int) -> DataFrame:
    """(unit, context_key, earliest array<bigint>) of the contexts with a window that began before their largest document."""

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        unit, ck, context, n, low, high = zip(*rows) if rows else ((),) * 6
        counts = np.array(n, np.int64)
        out = ([], [], [])
        if rows:
            least = earliest(list(context), counts, np.array(low, np.int64), window)
            for u, c, top, mine in zip(unit, ck, high, np.split(least, np.cumsum(counts)[:-1])):
                if mine.min() < top:
                    out[0].append(u), out[1].append(c), out[2].append(mine.tolist())
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["unit", "context_key", "earliest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, unit = [], 0, []
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("unit", "context_key", "context", "n", "low", "high")]):
                if unit and row[0] != unit[-1][0]:
                    if words >= SHARD_WORDS:
                        yield answer(rows)
                        rows, words = [], 0
                    words += keep(unit, rows)
                    unit = []
                unit.append(row)
        if unit:
            keep(unit, rows)
        yield answer(rows)

    def keep(unit: list[tuple], rows: list[tuple]) -> int:
        """Add a unit to the shard unless one document has it all; returns its words."""
        if min(r[4] for r in unit) == max(r[5] for r in unit):
            return 0
        rows += unit
        return sum(r[3] + window for r in unit)

    dealt = distinct.repartition("unit").sortWithinPartitions("unit")
    columns = dealt.select("unit", "context_key", "context", "n", "low", "high")
    return columns.mapInArrow(run, "unit bigint, context_key bigint, earliest array<bigint>")


def search_large(large: DataFrame, window: int, heavy_rows: int) -> DataFrame:
    """(unit, context_key, at, earliest): what ``search_shards`` finds in units of several shards, by pieces that begin ``at`` a window.

    ``large`` has the ``parts`` of each unit. The second hash is that of the whole window, so equal windows share a shard.
    """
    kinds = {"unit": pa.int64(), "part": pa.int64(), "piece": pa.binary(), "n": pa.int32(), "context_key": pa.int64(), "at": pa.int32()}
    kinds |= {"low": pa.int64(), "high": pa.int64()}
    columns = ["unit", "parts", "context", "context_key", "low", "high"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for unit, parts, context, ck, low, high in zip(*[batch[c].to_pylist() for c in columns]):
            words = context.split(b" ")
            hashes = combine(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), window)
            part = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
            first, sizes = unit_runs(part)
            for p, f, n in zip(part[first].tolist(), first.tolist(), sizes.tolist()):
                out.append((unit, p, b" ".join(words[f : f + n + window - 1]), n, ck, f, low, high))
        return _columns(out, kinds)

    cuts = map_blocks(
        large.select(*columns), cut, "unit bigint, part bigint, piece binary, n int, context_key bigint, at int, low bigint, high bigint"
    )
    cuts = stored(cuts.withColumns({"shard": F.xxhash64("unit", "part"), "piece_key": F.xxhash64("piece")}), "pieces", compression="zstd")
    merged = cuts.groupBy("shard", "piece", "piece_key", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shards = merged.select(F.col("shard").alias("unit"), F.col("piece").alias("context"), F.col("piece_key").alias("context_key"), "n", "low", "high")
    found = search_shards(shards, window).select(F.col("unit").alias("shard"), F.col("context_key").alias("piece_key"), "earliest")
    # A piece may be in any number of contexts.
    answers = lookup(cuts.drop("piece", "part", "n", "low"), found, ["shard", "piece_key"], "context_key", cuts.count(), heavy_rows)
    return answers.where(F.array_min("earliest") < F.col("high")).select("unit", "context_key", "at", "earliest")


# --- the operator


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, keep_text: bool = False, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key, text_key, n_words, n_removed, kept_sha256[, kept, spans]), one row per row.

    ``keep_text`` adds the kept words joined by spaces (null where nothing is taken out) and the intervals of words taken out (first, end exclusive).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.trim(F.regexp_replace(body, r"[ \t-\r]+", " "))
    n_words = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    sort_key = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY))
    base = stored(
        df.select(
            F.col(key).alias("name"),
            sort_key.alias("key"),
            text_key(F.col(text)).alias("text_key"),
            F.unhex(F.sha2(body, 256)).alias("content"),
            n_words.cast("bigint").alias("n_words"),
            F.sha2(words, 256).alias("whole"),
        ),
        "texts",
    )
    classes = base.groupBy("content").agg(F.min("key").alias("first"))
    # A group of copies may hold a third of the rows: beyond a size its rows are dealt to many tasks.
    rows = stored(lookup(base, classes, ["content"], "key", base.count(), heavy_rows).drop("content"), "classes")
    total = rows.where(F.col("key") == F.col("first")).agg(F.sum("n_words")).first()[0] or 0
    # A fifth of the words begin a unit, about.
    buckets = max(1, -(-total // (5 * PAIRS_AT_ONCE // 2)))

    # Rows without a key of their own are told apart by their text, so that no list of units holds them all.
    doc = F.when(F.col("key").isin(NO_KEY, NOTICE), F.col("text_key")).otherwise(F.col("key"))
    texts = df.select(sort_key.alias("key"), text_key(F.col(text)).alias("text_key"), utf8(F.col(text)).alias("utf8"))
    listed = shared_units(texts.withColumn("doc", doc), window, int(buckets)).groupBy("doc").agg(F.collect_list("unit").alias("units"))
    heads = rows.where((F.col("key") == F.col("first")) & (F.col("n_words") >= window)).select("key", "text_key").distinct()
    wanted = stored(heads.withColumn("doc", doc).join(listed, "doc").drop("doc"), "wanted")
    if _repeated(heads, rows):
        texts = texts.dropDuplicates(["key", "text_key"])
    candidates = stored(with_runs(texts.join(wanted, ["key", "text_key"]), window), "candidates", compression="zstd")

    alike = [F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("_n")]
    distinct = contexts(candidates, window).groupBy("unit", "context", "n").agg(*alike)
    distinct = stored(distinct.withColumn("context_key", F.xxhash64("context")), "contexts", compression="zstd")
    sizes = distinct.groupBy("unit").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > UNIT_CONTEXTS)
    large = stored(sizes.select("unit", F.ceil(F.col("rows") / UNIT_CONTEXTS).alias("parts")), "large-units")
    pieces = F.collect_list(F.struct("at", "earliest")).alias("pieces")
    whole = F.array(F.struct(F.lit(0).alias("at"), "earliest")).alias("pieces")
    if large.limit(1).count():
        small = search_shards(distinct.join(large, "unit", "left_anti"), window).select("unit", "context_key", whole)
        dealt = search_large(distinct.join(large, "unit"), window, heavy_rows)
        found = small.unionByName(dealt.groupBy("unit", "context_key").agg(pieces))
    else:
        # No unit is too large: the contexts are shuffled once, into their shards.
        found = search_shards(distinct, window).select("unit", "context_key", whole)
    found = stored(found, "found", compression="zstd")
    # A context may begin in a third of all documents; how often each does is known from the contexts.
    places = context_places(candidates)
    total = distinct.agg(F.sum("_n")).first()[0] or 0
    places = lookup(places, found, ["unit", "context_key"], "key", total, heavy_rows, distinct.select("unit", "context_key", "_n"))
    began = F.transform("pieces", lambda p: F.transform(p.earliest, lambda e, i: F.when(e < F.col("key"), F.col("start") + p.at + i)))
    gone = F.filter(F.flatten(began), lambda p: p.isNotNull())
    marks = places.where(F.col("pieces").isNotNull()).select("key", "text_key", gone.alias("starts")).where(F.size("starts") > 0)
    marks = marks.groupBy("key", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    interval = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def strip(part: pa.RecordBatch) -> pa.RecordBatch:
        removed, digest, kept, spans = [], [], [], []
        for raw, starts in zip((x.as_py() for x in part["utf8"]), part["starts"]):
            words = raw.split()
            covers = np.zeros(len(words) + 1, np.int64)
            at = np.unique(starts.values.to_numpy())
            np.add.at(covers, at, 1)
            np.add.at(covers, at + window, -1)
            out = np.cumsum(covers[:-1]) > 0
            rest = b" ".join([w for w, o in zip(words, out.tolist()) if not o])
            removed.append(int(out.sum())), digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace") if keep_text else None)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]))).reshape(-1, 2)
            spans.append([{"first": f, "end": e} for f, e in edges.tolist()] if keep_text else None)
        arrays = [pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()), pa.array(spans, interval)]
        names = ["key", "text_key", "n_removed", "kept_sha256", "kept", "spans"]
        return pa.RecordBatch.from_arrays([part["key"], part["text_key"], *arrays], names)

    stripped = map_blocks(
        candidates.select("key", "text_key", "utf8").join(marks, ["key", "text_key"]),
        strip,
        "key bigint, text_key bigint, n_removed bigint, kept_sha256 string, kept string, spans array<struct<first:int,end:int>>",
    )
    everything = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))
    copy = (F.col("key") > F.col("first")) & (F.col("n_words") >= window)
    result = rows.join(stripped, ["key", "text_key"], "left").select(
        F.col("name").alias(key),
        "text_key",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
        *([F.when(copy, everything).otherwise(F.coalesce("spans", F.array())).alias("spans")] if keep_text else []),
    )
    return result


def _repeated(heads: DataFrame, rows: DataFrame) -> bool:
    """Whether some searched row is there twice; only then are its texts made distinct."""
    searched = rows.join(heads, ["key", "text_key"], "left_semi")
    return searched.groupBy("key", "text_key").count().where("count > 1").limit(1).count() > 0

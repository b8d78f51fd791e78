"""Benchmark decontamination: a prefix-filtered set join of item windows against whole documents.

Every window of an item (``window`` consecutive words; a shorter item is one window) is a set of word shingles. Containment of the whole
window needs every one of its shingles, so its rarest one in the corpus is a necessary prefix token: only that is
joined. A match at position p of a shingle at offset o puts the window at p - o, which must lie inside the document; the words there
are then compared with the window itself.

Cases: null and word-free texts have no words and no hits; word-free items have no windows; an item of fewer words than the window
is one window of its own size; repeated rows each get the result of their text; equal item texts count as items of their own; null item keys are left out
of the item list but their windows still hit; an empty table on either side gives no hits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillstrata.llm.common import ALNUM, map_blocks, stored, text_key, utf8

SHINGLE = 3
# Bits of the bitmap that spares the documents' other shingles the shuffle. Fixed: 2 MB at any benchmark size; a full one
# only lets more through to the exact join.
BITMAP_BITS = 24


def bare_words(raw: bytes) -> list[bytes]:
    """Lowered runs of ASCII letters and digits and of all other code points."""
    return raw.translate(ALNUM).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return combine(one, size)


def combine(one: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs from hashes of words; order matters, and so does the size."""
    n = len(one) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item, words, size): the distinct windows of every item, words joined by one space."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, raw in zip(part["item"].to_pylist(), part["utf8"].to_pylist()):
            words = bare_words(raw)
            size = min(window, len(words))
            if size:
                cuts = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
                rows += [(item, w.decode("utf-8", "replace"), size) for w in sorted(cuts)]
        item, words, size = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.string()), pa.array(words, pa.string()), pa.array(size, pa.int32())], ["item", "words", "size"]
        )

    texts = items.select(F.col(key).cast("string").alias("item"), utf8(F.col(text)).alias("utf8"))
    return map_blocks(texts, cut, "item string, words string, size int")


def window_shingles(windows: DataFrame) -> DataFrame:
    """(words, size, offset, hash): each shingle of each distinct window."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"words": [], "size": [], "offset": [], "hash": []}
        for words, size in zip(part["words"].to_pylist(), part["size"].to_pylist()):
            hashes = shingle_hashes(words.encode().split(b" "), min(SHINGLE, size)).view(np.int64)
            out["words"] += [words] * len(hashes)
            out["size"] += [size] * len(hashes)
            out["offset"] += range(len(hashes))
            out["hash"] += hashes.tolist()
        kinds = {"words": pa.string(), "size": pa.int32(), "offset": pa.int32(), "hash": pa.int64()}
        return pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in out.items()})

    return map_blocks(windows, cut, "words string, size int, offset int, hash bigint")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """One bit per low part of a hash: a bool array of 2^BITMAP_BITS, built from at most 2^BITMAP_BITS / 32768 rows."""
    low = F.col("hash").bitwiseAND((1 << BITMAP_BITS) - 1) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(low).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits"))
    found = np.zeros(1 << BITMAP_BITS, bool)
    for row in rows.collect():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        first = (row["at"] - 1) * len(bits)
        found[first : first + len(bits)] = bits[: len(found) - first]
    return found


def _hits(words: list[bytes], sizes: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the shingles that the bitmap lets through."""
    if not words or not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    low = np.uint64((1 << BITMAP_BITS) - 1)
    at, found = [], []
    for size in sizes:
        hashes = combine(one, size)
        hit = np.flatnonzero(bitmap[hashes & low])
        at.append(hit)
        found.append(hashes[hit].view(np.int64))
    return np.concatenate(at), np.concatenate(found)


def rarest_shingles(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """(words, size, offset, hash): the shingle of each window that the corpus holds least often, of those windows that can occur."""
    sizes = sorted({min(SHINGLE, r["size"]) for r in shingles.select("size").distinct().collect()})
    bitmap = bitmap_of(shingles)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [_hits(bare_words(raw), sizes, bitmap)[1] for raw in part["utf8"].to_pylist()]
        hashes, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_pydict({"hash": hashes, "n": times})

    counts = map_blocks(texts.select("utf8"), count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counts, "hash", "left").groupBy("words", "size").agg(
        F.min_by(F.struct("offset", "hash"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("best"),
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
    )
    # A window with a shingle that no document has cannot occur.
    return ranked.where(F.col("least") > 0).select("words", "size", "best.offset", "best.hash")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 13,
) -> DataFrame:
    """(key, text_key, n_words, n_hit, n_items, items, contaminated), one row per document row.

    ``items`` lists the keys, as strings in order, of the items with a window in the document. A document is contaminated when
    at least a twentieth of its words lies inside windows.
    """
    windows = stored(item_windows(items, item_key, item_text, window), "windows")
    distinct = windows.select("words", "size").distinct()
    shingles = stored(window_shingles(distinct), "window-shingles")
    texts = docs.select(F.col(key).alias("key"), text_key(F.col(text)).alias("text_key"), utf8(F.col(text)).alias("utf8"))
    tokens = stored(rarest_shingles(texts, shingles), "prefix-tokens")
    sizes = sorted({min(SHINGLE, r["size"]) for r in tokens.select("size").distinct().collect()})
    bitmap = bitmap_of(tokens)
    reach = window - 1

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        n_words, places = [], []
        for raw in part["utf8"].to_pylist():
            words = bare_words(raw)
            at, hashes = _hits(words, sizes, bitmap)
            n_words.append(len(words))
            places.append(
                [
                    # The words around, which hold every window through this shingle.
                    {
                        "pos": p,
                        "hash": h,
                        "first": max(0, p - reach),
                        "context": b" ".join(words[max(0, p - reach) : p + window]).decode("utf-8", "replace"),
                    }
                    for p, h in zip(at.tolist(), hashes.tolist())
                ]
            )
        place = pa.struct([("pos", pa.int32()), ("hash", pa.int64()), ("first", pa.int32()), ("context", pa.string())])
        return pa.RecordBatch.from_arrays(
            [part["key"], part["text_key"], pa.array(n_words, pa.int64()), pa.array(places, pa.list_(place))],
            ["key", "text_key", "n_words", "places"],
        )

    kind = dict(docs.dtypes)[key]
    found = stored(
        map_blocks(
            texts,
            find,
            f"key {kind}, text_key bigint, n_words bigint, places array<struct<pos:int,hash:bigint,first:int,context:string>>",
        ),
        "places",
    )
    places = found.where(F.size("places") > 0).select("key", "text_key", "n_words", F.inline("places"))
    aligned = places.join(tokens, "hash").withColumn("start", F.col("pos") - F.col("offset"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("context", " "), F.col("start") - F.col("first") + 1, F.col("size")), " ")
    exact = aligned.where(inside).where(there == F.col("words"))
    hits = stored(exact.select("key", "text_key", "start", (F.col("start") + F.col("size")).alias("end"), "words", "size").distinct(), "hits")

    by_start = Window.partitionBy("key", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(by_start), F.lit(0)))
    covered = (
        hits.select("key", "text_key", "start", "end").distinct()
        .withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("key", "text_key")
        .agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    )
    listed = (
        hits.select("key", "text_key", "words", "size")
        .join(windows.where(F.col("item").isNotNull()), ["words", "size"])
        .groupBy("key", "text_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    covered, listed = covered.alias("c"), listed.alias("l")
    base = found.select("key", "text_key", "n_words").alias("b")

    def row_is(side: str):
        return F.expr(f"b.key <=> {side}.key and b.text_key = {side}.text_key")

    n_hit, names = F.coalesce("c.n_hit", F.lit(0)), F.coalesce("l.items", F.array().cast("array<string>"))
    return base.join(covered, row_is("c"), "left").join(listed, row_is("l"), "left").select(
        F.col("b.key").alias(key),
        F.col("b.text_key").alias("text_key"),
        F.col("b.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        names.alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("b.n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = decontaminate(docs, items, key, text, **options).where("contaminated").select(F.col(key).alias("key"), "text_key").distinct()
    d, b = docs.withColumn("_text_key", text_key(F.col(text))).alias("d"), stored(bad, "contaminated").alias("b")
    same = F.col(f"d.{key}").eqNullSafe(F.col("b.key")) & (F.col("d._text_key") == F.col("b.text_key"))
    return d.join(b, same, "left_anti").drop("_text_key")

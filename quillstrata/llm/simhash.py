"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes at equal positions, and so at least 3 in one half.
The index lists fingerprints under each three positional bytes of a half (8 lists per fingerprint; a list of one byte
would hold a 256th of the corpus). Inside a list the shared positional bytes of each pair are tallied, pairs with fewer
than 5 are dropped, the rest verified by their bits; only a spanning forest of the verified links leaves the task. Long lists
are cut into parts and every two parts meet in a unit of their own, so neither memory nor output grows with a list's square.

Cases: a text without words has fingerprint 0 and is linked like any other; equal fingerprints are one node, so copies cost
nothing; repeated rows share the result; a row with a null key gets the smallest key of its component, null if there is none;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstrata.llm.common import map_blocks, stored, text_key, utf8
from quillstrata.operators.clusters import connected_components
from quillstrata.plans.skew import HEAVY_ROWS, lookup

SHINGLE = 3
DISTANCE = 3
SHARED_BYTES = 8 - DISTANCE
# Members of a list that meet in one unit at most, about; two such parts share a unit.
PART_MEMBERS = 1024
_HASHES_AT_ONCE = 1 << 15


def fingerprint(raw: bytes) -> int:
    """SimHash over the 3-word shingles of the lowered words; a bit is set when over half the hashes have it."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(s), 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), _HASHES_AT_ONCE):
        block = hashes[first : first + _HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_key, fingerprint bigint), one row per row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(raw) for raw in part["utf8"].to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({key: part[key], "text_key": part["text_key"], "fingerprint": values})

    texts = df.select(F.col(key), text_key(F.col(text)).alias("text_key"), utf8(F.col(text)).alias("utf8"))
    return map_blocks(texts, work, f"`{key}` {dict(df.dtypes)[key]}, text_key bigint, fingerprint bigint")


def _list_masks() -> list[int]:
    """Three of the four bytes of each half, as signed 64-bit masks."""
    masks = []
    for half in range(2):
        for left_out in range(4):
            bytes_on = [b for b in range(4 * half, 4 * half + 4) if b != 4 * half + left_out]
            mask = sum(0xFF << (8 * b) for b in bytes_on)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def verified_forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) links that span the components of the members within DISTANCE bits; members are distinct uint64."""
    label = np.arange(len(members))
    left, right = [], []
    for first in range(0, len(members), 512):
        apart = members[first : first + 512, None] ^ members[None, :]
        tally = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(tally >= SHARED_BYTES)
        close = (np.bitwise_count(apart[i, j]) <= DISTANCE) & (i + first < j)
        left.append(i[close] + first)
        right.append(j[close])
    left, right = np.concatenate(left), np.concatenate(right)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(src, dst), dst < src: links that connect all distinct fingerprints within DISTANCE bits, directly or through others."""
    lists = F.array(*[F.struct(F.lit(n).alias("slot"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bytes")) for n, m in enumerate(_list_masks())])
    index = nodes.select("fingerprint", F.inline(lists))
    sizes = index.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    listed = index.join(sizes, ["slot", "bytes"])
    parts = F.ceil(F.col("n") / PART_MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint", "slot"), parts).cast("int")
    dealt = listed.select("slot", "bytes", "fingerprint", parts.alias("parts"), mine.alias("mine"))
    # Part a meets every other part b in unit (a, b); a list of one part is a unit.
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("mine"))
    )
    met = dealt.withColumn("other", F.explode(others)).select(
        "slot", "bytes", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fingerprint"
    )
    units = met.groupBy("slot", "bytes", "low", "high").agg(F.collect_list("fingerprint").alias("members"))

    def link(part: pa.RecordBatch) -> pa.RecordBatch:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in part["members"]:
            node, root = verified_forest(members.values.to_numpy().view(np.uint64))
            node, root = node.view(np.int64), root.view(np.int64)
            src.append(np.maximum(node, root))
            dst.append(np.minimum(node, root))
        return pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return map_blocks(units.select("members"), link, "src bigint, dst bigint").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key, text_key, fingerprint bigint, component bigint, component_id), one row per row.

    ``component`` is the smallest fingerprint of the component, ``component_id`` its smallest key.
    """
    table = stored(fingerprints(df, key, text), "fingerprints")
    nodes = stored(table.groupBy("fingerprint").agg(F.min(key).alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes)).select(F.col("id").alias("fingerprint"), "root")
    placed = nodes.join(roots, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    components = placed.join(named, "root").select("fingerprint", F.col("root").alias("component"), "component_id")
    # A group of copies may hold a third of the rows: beyond a size its rows are dealt to many tasks.
    return lookup(table, components, ["fingerprint"], key, table.count(), heavy_rows).select(key, "text_key", "fingerprint", "component", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row stays, with the smallest key."""
    found = near_duplicates(df, key, text)
    order = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), "text_key")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.key", "first.text_key")
    d, f = df.withColumn("_text_key", text_key(F.col(text))).alias("d"), stored(first, "survivors").alias("f")
    kept = d.join(f, F.col(f"d.{key}").eqNullSafe(F.col("f.key")) & (F.col("d._text_key") == F.col("f.text_key")), "left_semi")
    if found.groupBy(key, "text_key").count().where("count > 1").limit(1).count():
        # Rows repeated with key and text: one of them.
        kept = kept.dropDuplicates([key, "_text_key"])
    return kept.drop("_text_key")

"""MinHash signatures, banding, and candidates by shared bucket."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.hashing import band_shape, minhash, shingle_sources
from quillstrata.functions.text import clustering_text, word_shingles
from quillstrata.plans.skew import lookup
from quillstrata.session import cut_lineage

DEFAULT_THRESHOLD = 0.80
DEFAULT_PERMUTATIONS = 64
# A lookup's query side is broadcast only up to this many band rows.
BROADCAST_BANDS = 200_000
# Links up to which their ends are broadcast, so that only sets they need are shuffled.
BROADCAST_LINKS = 100_000
# Bits of a set's sketch, a multiple of 64.
SKETCH_BITS = 2048
# Sets sketched at a time.
_SKETCH_ROWS = 256


def shingle_table(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, shingle): the shingle set of every text, one row per member."""
    return df.select(key, F.explode(word_shingles(F.col(text_col))).alias("shingle"))


def minhash_signature(
    df: DataFrame, text_col: str, key: str, num_perm: int = DEFAULT_PERMUTATIONS
) -> DataFrame:
    """(key, signature), row by row. Minima ignore repeats, so shingles are not made distinct first."""
    sources = shingle_sources(clustering_text(F.col(text_col)))
    return df.select(key, minhash(sources, num_perm).alias("signature"))


def band_table(signatures: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    """(key, band, bucket): ``bucket`` is the 16-byte digest of the band number and its slice of the signature."""
    hashed = [
        F.struct(
            F.lit(i).alias("band"),
            F.unhex(
                F.md5(
                    F.concat_ws(",", F.lit(str(i)), *[F.col("signature")[i * rows + j].cast("string") for j in range(rows)])
                )
            ).alias("bucket"),
        )
        for i in range(bands)
    ]
    return signatures.select(key, F.inline(F.array(*hashed)))


def lsh_bands(
    df: DataFrame,
    text_col: str,
    key: str,
    threshold: float = DEFAULT_THRESHOLD,
    num_perm: int = DEFAULT_PERMUTATIONS,
) -> DataFrame:
    """Band rows of every text for a similarity threshold."""
    bands, rows = band_shape(threshold, num_perm)
    return band_table(minhash_signature(df, text_col, key, num_perm), key, bands, rows)


def near_dup_candidates(bands: DataFrame, key: str, heavy_rows: int | None = None) -> DataFrame:
    """(key, anchor_id): each text that shares a bucket, next to the smallest key of that bucket.

    A star per bucket instead of all its pairs: as many rows as members, and the same connected groups.
    ``bands`` should be materialized; it is read to count it, to find the shared buckets, and to link.
    """
    shared = (
        bands.groupBy("bucket")
        .agg(F.min(key).alias("anchor_id"), F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1)
        .select("bucket", "anchor_id")
    )
    options = {} if heavy_rows is None else {"heavy_rows": heavy_rows}
    linked = lookup(bands.select(key, "bucket"), shared, ["bucket"], key, bands.count(), **options)
    return linked.where(F.col("anchor_id") < F.col(key)).select(key, "anchor_id").distinct()


def _signature_groups(df: DataFrame, text: str, key: str, num_perm: int, name: str) -> DataFrame:
    """(first, size, signature): equal signatures as one row with the smallest key, so copies cost nothing further on."""
    signed = minhash_signature(df, text, key, num_perm)
    return signed.groupBy("signature").agg(F.min(key).alias(f"{name}_first"), F.count(F.lit(1)).alias(f"{name}_size"))


def signature_members(df: DataFrame, text: str, key: str, num_perm: int = DEFAULT_PERMUTATIONS, heavy_rows: int | None = None) -> DataFrame:
    """(key, first), one row per row of ``df``: the smallest key among the rows of equal signature, which names the group in ``near_dup_lookup``."""
    signed = cut_lineage(minhash_signature(df, text, key, num_perm))
    firsts = signed.groupBy("signature").agg(F.min(key).alias("first"))
    options = {} if heavy_rows is None else {"heavy_rows": heavy_rows}
    return lookup(signed, firsts, ["signature"], key, signed.count(), **options).select(key, "first")


def near_dup_lookup(
    queries: DataFrame,
    query_text: str,
    query_key: str,
    corpus: DataFrame,
    corpus_text: str,
    corpus_key: str,
    threshold: float = DEFAULT_THRESHOLD,
    num_perm: int = DEFAULT_PERMUTATIONS,
) -> DataFrame:
    """(query_first, query_size, corpus_first, corpus_size): groups of equal signatures on both sides that share a bucket.

    A group is named by its smallest key and stands for ``size`` rows, so a bucket full of copies asked for by many copies is one row.
    ``signature_members`` has the rows of each group.
    The query bands are stored once; they are broadcast after their number has been checked, beyond that both sides are
    shuffled on the bucket and adaptive execution splits an uneven one.
    """
    bands, rows = band_shape(threshold, num_perm)

    def banded(df: DataFrame, text: str, key: str, name: str) -> DataFrame:
        groups = _signature_groups(df, text, key, num_perm, name)
        out = groups.select(F.struct(f"{name}_first", f"{name}_size").alias(name), "signature")
        return band_table(out, name, bands, rows).select(name, "bucket")

    asked = cut_lineage(banded(queries, query_text, query_key, "query"))
    held = banded(corpus, corpus_text, corpus_key, "corpus")
    if asked.count() <= BROADCAST_BANDS:
        asked = F.broadcast(asked)
    return held.join(asked, "bucket").select("query.*", "corpus.*").distinct()


def jaccard_verify(
    links: DataFrame, df: DataFrame, text_col: str, key: str, other: str = "anchor_id", threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """The rows of ``links`` (key, other) with ``shared``, ``total`` and ``jaccard`` of their shingle sets, at the threshold or above.

    Shingle sets are joined to each end by key, as one array per text: the table of shingles is never shuffled by shingle, and
    links are stars, so there is about one per text. An anchor of many texts is one row on the side looked up. Sets hold 64-bit hashes.
    """
    return verify_sets(links, shingle_sets(df, text_col, key), key, other, threshold)


def shingle_sets(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """(_id, _set): the shingle set of every text as an array of 64-bit hashes, stored once."""
    return cut_lineage(df.select(F.col(key).alias("_id"), F.transform(word_shingles(F.col(text_col)), lambda s: F.xxhash64(s)).alias("_set")))


@F.arrow_udf(T.ArrayType(T.LongType()))
def set_sketch(sets: pa.Array) -> pa.Array:
    """Bit i tells whether an odd number of the set's hashes is i modulo ``SKETCH_BITS``. Two sets differ in at least as many members as their sketches in bits."""
    words = [np.empty(0, np.int64)]
    for first in range(0, len(sets), _SKETCH_ROWS):
        part = sets.slice(first, _SKETCH_ROWS)
        hashes = part.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
        counts = np.bincount(rows * SKETCH_BITS + (hashes & (SKETCH_BITS - 1)), minlength=len(part) * SKETCH_BITS)
        words.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64))
    flat = np.concatenate(words)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(flat))


def may_reach(size: Column, other_size: Column, sketch: Column, other_sketch: Column, threshold: float) -> Column:
    """False only for pairs of sets that cannot have a Jaccard similarity of ``threshold``, judged by sizes and sketches."""
    apart = reduce(add, [F.bit_count(sketch[i].bitwiseXOR(other_sketch[i])) for i in range(SKETCH_BITS // 64)])
    sizes = (size + other_size).cast("bigint")
    # Shared members at most: both sizes together hold each of them twice, and the differing ones once.
    shared = F.least((sizes - apart) / 2, F.least(size, other_size).cast("double"))
    # A little less than the threshold, so that rounding drops no pair.
    return shared >= (sizes - shared) * F.lit(threshold - 1e-9)


def verify_sets(
    links: DataFrame, sets: DataFrame, key: str, other: str = "anchor_id", threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """``jaccard_verify`` over stored ``shingle_sets``."""
    total = links.count()
    if total <= BROADCAST_LINKS:
        ends = links.select(F.explode(F.array(key, other)).alias("_id")).distinct()
        sets = sets.join(F.broadcast(ends), "_id", "left_semi")
    first = links.join(sets.select(F.col("_id").alias(key), F.col("_set").alias("_left")), key)
    both = lookup(first, sets.select(F.col("_id").alias(other), F.col("_set").alias("_right")), [other], key, total)
    shared = F.size(F.array_intersect("_left", "_right")).cast("bigint")
    whole = (F.size("_left") + F.size("_right")).cast("bigint") - F.col("shared")
    scored = both.withColumn("shared", shared).withColumn("total", whole)
    kept = scored.withColumn("jaccard", F.round(F.col("shared") / F.col("total"), 6)).where(
        F.col("shared") >= F.col("total") * F.lit(threshold)
    )
    return kept.select(*links.columns, "shared", "total", "jaccard")

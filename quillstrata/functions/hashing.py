"""Deterministic hash values that any SQL engine with md5 can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.text import let

MERSENNE_31 = 2**31 - 1


def order_key(seed: int, value: Column) -> Column:
    """A uniformly spread sort key: the same seed gives the same order under any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def base_hash(text: Column) -> Column:
    """The leading 32 bits of md5, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _draw(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest(), 16)


def permutations(num_perm: int) -> list[tuple[int, int]]:
    """(a, b) of each hash permutation (a*h + b) mod (2^31 - 1), drawn by rule from md5.

    h < 2^32 and a, b < 2^31 keep a*h + b below 2^63.
    """
    return [
        (1 + _draw(f"slope:{i}") % (MERSENNE_31 - 1), _draw(f"offset:{i}") % MERSENNE_31)
        for i in range(num_perm)
    ]


SHINGLE_WORDS = 3


def word_weights() -> list[int]:
    """The factor of each word's hash in a shingle's hash, the weighted sum modulo 2^31 - 1."""
    return [1 + _draw(f"word:{i}") % (MERSENNE_31 - 1) for i in range(SHINGLE_WORDS)]


def shingle_sources(clean: Column) -> Column:
    """The base hashes a signature is made of: one per word, or the one of the whole text below three words.

    Each word is hashed once, where it would be hashed three times as a part of three shingle texts.
    """

    def hashed(text: Column) -> Column:
        words = F.split(text, " ")
        return F.when(F.size(words) < SHINGLE_WORDS, F.array(base_hash(text))).otherwise(
            F.transform(words, base_hash)
        )

    return let(clean, hashed)


def _remainder(values: np.ndarray) -> np.ndarray:
    """values mod (2^31 - 1): twice folding the high bits over the low 31, then one subtraction at most."""
    values = (values & MERSENNE_31) + (values >> 31)
    values = (values & MERSENNE_31) + (values >> 31)
    values[values >= MERSENNE_31] -= MERSENNE_31
    return values


def _shingle_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first position of each row) from the sources of whole rows."""
    lengths = np.diff(bounds)
    mixed = values.copy()
    if len(values) >= SHINGLE_WORDS:
        tail = SHINGLE_WORDS - 1
        total = sum(
            _remainder(values[k : len(values) - tail + k] * weight) for k, weight in enumerate(word_weights())
        )
        mixed[: len(values) - tail] = _remainder(total)
    # A row of one source is a short text, whose hash stands as it is.
    short = lengths == 1
    mixed[bounds[:-1][short]] = values[bounds[:-1][short]]
    # The last two positions of a longer row start no shingle of their own.
    keep = np.ones(len(values), dtype=bool)
    ends = bounds[1:][~short]
    keep[ends - 1] = False
    keep[ends - 2] = False
    counts = np.where(short, 1, lengths - (SHINGLE_WORDS - 1))
    return mixed[keep], np.concatenate(([0], np.cumsum(counts)[:-1]))


# Sources handled at a time: small enough for the working arrays to stay in the processor cache.
_BLOCK = 32_768


def minhash(sources: Column, num_perm: int) -> Column:
    """Minimum of each permutation over the shingles of :func:`shingle_sources`, as array<bigint>.

    Row-wise, so it needs neither an exploded table nor a shuffle. The arithmetic is vectorized over Arrow batches.
    """
    draws = permutations(num_perm)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def minima(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.list_(pa.int64()))
        values = batch.flatten().to_numpy(zero_copy_only=False)
        bounds = batch.offsets.to_numpy().astype(np.int64) - batch.offsets[0].as_py()
        signed = np.empty((len(batch), num_perm), dtype=np.int64)
        first = 0
        while first < len(batch):
            # As many whole rows as fit a block, one at least.
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BLOCK, side="right")) - 1)
            block = values[bounds[first] : bounds[last]]
            hashes, starts = _shingle_hashes(block, bounds[first : last + 1] - bounds[first])
            for i, (slope, offset) in enumerate(draws):
                signed[first:last, i] = np.minimum.reduceat(_remainder(hashes * slope + offset), starts)
            first = last
        offsets = np.arange(0, signed.size + 1, num_perm, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed.ravel()))

    return minima(sources)


def band_shape(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) that minimize the evenly weighted false-positive and false-negative areas."""
    step = 1e-3
    below = np.arange(step / 2, threshold, step)
    above = np.arange(threshold + step / 2, 1.0, step)
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_pos = (1 - (1 - below**rows) ** bands).sum() * step
            false_neg = ((1 - above**rows) ** bands).sum() * step
            error = 0.5 * false_pos + 0.5 * false_neg
            if best is None or error < best[0]:
                best = (error, bands, rows)
    return best[1], best[2]

"""Subword token counts by byte-pair merges of a public vocabulary file."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how texts are cut before merging, a published pattern of byte-level vocabularies.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# One encoder per vocabulary and worker process: building it takes far longer than a text.
_ENCODERS: dict[tuple[int, str], object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(packed: bytes, pattern: str):
    name = (zlib.crc32(packed), pattern)
    if name not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, zlib.decompress(packed).splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("subword", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def subword_counter(path: str, pattern: str = SPLIT_PATTERN) -> Callable[[Column], Column]:
    """A ``tokenizer`` that counts subword tokens, without special ones. A null text has a null count, an empty one 0.

    The file is read once, here; tasks get its content (a vocabulary, so of bounded size) and need no file of their own.
    """
    with open(path, "rb") as file:
        packed = zlib.compress(file.read())

    @F.pandas_udf(T.LongType())
    def counts(texts: pd.Series) -> pd.Series:
        encoder = _encoder(packed, pattern)
        return texts.map(lambda t: None if t is None else len(encoder.encode_ordinary(t))).astype("Int64")

    return lambda text: counts(text)

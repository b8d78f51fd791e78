"""Fill-in-middle transformation: token cuts located by content-defined chunks whose summaries are remembered.

A token is a run of other characters with the white space before it; white space at the end of a text is a token of its own. A rolling
hash over the last 32 bytes ends a chunk wherever its top bits are zero, so passages that texts share fall into the same chunks
wherever they stand. Each chunk has a boundary summary: tokens that end inside it, whether it starts with white space, whether it ends
without, and its code points. A task remembers summaries by a hash of the chunk and reuses one only after comparing the chunk with
the content it was made from. Summaries of neighbours combine: a token ends at their border iff the left one ends without white space and
the right one starts with it (or nothing follows). Running sums of token ends place a cut in one chunk; only that chunk is looked into.

All work is row-local: no shuffle, and no key can be hot. The memory of a task is bounded in bytes and starts anew when full, which changes no result.

Cases: a null text is the empty text, form plain with 0 tokens; a text with a sentinel in it is plain; a null key is drawn like an empty one
(``42:``); repeated rows and rows of equal keys each get the result of their own text; an empty table gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillstrata.llm.common import utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Bytes the rolling hash sees: one is shifted out of 32 bits after so many steps.
REACH = 32
# A chunk ends after every 2^8 bytes on average, and after LONGEST ones at the latest.
CHUNK_BITS = 8
LONGEST = 4096
# Bytes of remembered chunks in a task, with about as much again for their places in the table.
REMEMBERED = 32 << 20
# Texts of a block are hashed together; a longer text is hashed by itself.
BLOCK_BYTES = 1 << 20

_GEAR = np.frombuffer(b"".join(hashlib.md5(bytes([b])).digest()[:4] for b in range(256)), "<u4")
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_ENDS = re.compile(rb"[^\x20\x09-\x0D]+")

Summary = tuple[int, bool, bool, int]


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """The hash of the last REACH bytes at every byte: gear values, each shifted by its distance."""
    rolled = _GEAR[raw]
    step = 1
    while step < REACH:
        moved = rolled.copy()
        moved[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = moved, step * 2
    return rolled


def chunk_ends(raw: bytes, hit: np.ndarray) -> list[int]:
    """Ends of the chunks of one text from the places where the hash says so; never inside a code point."""
    ends, last = [], 0
    for at in [*(hit + 1).tolist(), len(raw)]:
        while at - last > LONGEST:
            cut = last + LONGEST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if at > last and (at == len(raw) or raw[at] & 0xC0 != 0x80):
            ends.append(at)
            last = at
    return ends


def chunk_places(texts: list[bytes]) -> Iterator[list[int]]:
    """The chunk ends of every text. The texts are hashed in one go, REACH zero bytes apart so that none sees its neighbour."""
    gap = b"\0" * REACH
    starts, at = [], 0
    for raw in texts:
        starts.append(at)
        at += len(raw) + REACH
    rolled = rolling_hash(np.frombuffer(gap.join(texts) + gap, np.uint8))
    hits = np.flatnonzero(rolled & np.uint32(((1 << CHUNK_BITS) - 1) << (REACH - CHUNK_BITS)) == 0)
    bounds = np.searchsorted(hits, [[s, s + len(raw)] for s, raw in zip(starts, texts)])
    for raw, start, (low, high) in zip(texts, starts, bounds.tolist()):
        yield chunk_ends(raw, hits[low:high] - start)


def summarize(chunk: bytes) -> Summary:
    """(tokens that end inside, starts with white space, ends without, code points)."""
    solid = chunk[-1] not in _SPACE
    return len(chunk.split()) - solid, chunk[0] in _SPACE, solid, len(chunk.decode())


class ChunkMemory:
    """Summaries by hash of the chunk, each with the content it was made from."""

    def __init__(self, limit: int = REMEMBERED, digest=xxh3_64_intdigest) -> None:
        self.limit, self.digest = limit, digest
        self.held: dict[int, tuple[bytes, Summary]] = {}
        self.size = self.reused = self.made = 0

    def summary(self, chunk: bytes) -> Summary:
        name = self.digest(chunk)
        known = self.held.get(name)
        if known is not None and known[0] == chunk:
            self.reused += 1
            return known[1]
        self.made += 1
        found = summarize(chunk)
        if known is None:
            if self.size + len(chunk) > self.limit:
                self.held.clear()
                self.size = 0
            self.held[name] = (chunk, found)
            self.size += len(chunk)
        return found


class Outline:
    """A text as its chunks' summaries: the number of tokens, and the place of any cut."""

    def __init__(self, raw: bytes, ends: list[int], memory: ChunkMemory) -> None:
        self.raw, self.ends = raw, ends
        parts = [memory.summary(raw[a:b]) for a, b in zip([0, *ends], ends)]
        follows = [p[1] for p in parts[1:]] + [True]
        self.closed = list(accumulate(p[0] + (p[2] and f) for p, f in zip(parts, follows)))
        self.points = list(accumulate(p[3] for p in parts))
        self.trailing = bool(raw) and raw[-1] in _SPACE
        self.tokens = (self.closed[-1] if parts else 0) + self.trailing

    def cut(self, tokens: int) -> tuple[int, int]:
        """(bytes, code points) up to the end of so many tokens."""
        if tokens == 0:
            return 0, 0
        if tokens == self.tokens:
            return len(self.raw), self.points[-1]
        k = bisect_left(self.closed, tokens)
        start, end = self.ends[k - 1] if k else 0, self.ends[k]
        wanted = tokens - (self.closed[k - 1] if k else 0)
        chunk = self.raw[start:end]
        for number, match in enumerate(_ENDS.finditer(chunk), 1):
            if number == wanted:
                chunk = chunk[: match.end()]
                break
        return start + len(chunk), (self.points[k - 1] if k else 0) + len(chunk.decode())


def draws(key: object, seed: int) -> list[int]:
    """Four numbers from the key alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(raw: bytes, form: str, first: int, second: int) -> bytes:
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    if form == "plain":
        return raw
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text from its rearranged form. No part has a sentinel in it, so the first one found is the one that was put there."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(keys, texts) of about BLOCK_BYTES at a time."""
    for batch in batches:
        first, texts, size = 0, [], 0
        for raw in batch["utf8"]:
            texts.append(raw.as_py())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield batch["key"].slice(first, len(texts)), texts
                first, texts, size = first + len(texts), [], 0
        if texts:
            yield batch["key"].slice(first), texts


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, suffix_first: int = 80, remembered: int = REMEMBERED
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, restored), one row per row, output and restored as UTF-8 bytes.

    Of 100 texts ``rate`` are rearranged, and of 100 of those ``suffix_first`` start with the suffix. ``restored`` is rebuilt from output and form alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = ChunkMemory(remembered)
        for keys, texts in _blocks(batches):
            rows = []
            for name, raw, ends in zip(keys.to_pylist(), texts, chunk_places(texts)):
                outline = Outline(raw, ends, memory)
                n = outline.tokens
                h1, h2, h3, h4 = draws(name, seed)
                if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= rate:
                    rows.append((n, "plain", None, None, raw, raw))
                    continue
                form = "spm" if h4 % 100 < suffix_first else "psm"
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (first, before), (second, until) = outline.cut(low), outline.cut(high)
                output = rearrange(raw, form, first, second)
                rows.append((n, form, before, until - before, output, restore(output, form)))
            n, form, prefix, middle, output, back = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()),
                    pa.array(back, pa.binary()),
                ],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
            )

    texts = df.select(F.col(f"`{key}`").alias("key"), utf8(F.col(f"`{text}`")).alias("utf8"))
    found = texts.mapInArrow(
        run,
        f"key {dict(texts.dtypes)['key']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, restored binary",
    )
    return found.withColumnRenamed("key", key)


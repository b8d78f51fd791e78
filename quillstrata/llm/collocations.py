"""Phrase collocations by set-oriented mining: occurrence relations, extended by one word at a time.

R(k) holds the occurrences of phrases of k words that can be frequent: positions and words. Each relation is persisted, sorted by
position, in rows that hold a block of texts of one language each; pieces of text are parted by a gap in the positions. The next
relation is a semi-join of the present one with its frequent groups and a merge-join with itself on the next position of the same
piece, filtered by a group-count. A block is sorted and holds whole pieces (or the words beyond its end), so the merge-join
needs no shuffle.

A row packs its columns as bytes, so that Spark moves them without touching every word.

Most phrases are rare, so they are first counted by hash: a task sends sorted hashes with counts, five bytes for each. Only
occurrences of hashes with enough of them are persisted, and those are then counted by the phrase itself. Hashes reach tasks as a
bitmap of fixed size. What a hash or the bitmap lets through wrongly fails the exact count, so no bound on memory touches the result.
Words stand for themselves by 64-bit codes; two words of one language with the same code are found when words are counted, and
the work is then done over with other codes.

Cases: a null text has no words; a null language is ``und``; repeated rows and copies count each time; a language without candidates has
no rows, and so has an empty table; equal scores and counts are ordered by phrase. Columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillstrata.llm.common import stored, utf8
from quillstrata.llm.decontam import BITMAP_BITS, bitmap_of

# The signs and line ends that part pieces.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
# Every piece end becomes the mark, a tab becomes a space, A-Z is lowered.
_MARK = b"."
_FOLD = bytes(46 if b in PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
# Words in a row of a relation, and words that a task gathers over all languages before it hands them on.
ROW_WORDS = 1 << 18
TASK_WORDS = 1 << 19
# Occurrences that a task counts at a time, and different ones that it holds before it hands their counts on.
TALLY_ROWS = 1 << 19
HELD_ROWS = 1 << 20
# Words behind one counting task at least, when there are more tasks than cores: the larger a task, the fewer counts of the same phrase are shuffled.
COUNTED_WORDS = 1 << 25
# Occurrences whose hashes one group counts, about.
GROUP_HASHES = 1 << 21
# Small row groups and Arrow batches: a task holds a few of the long rows at a time.
PACKED = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
BATCH_BYTES = "8m"
# Candidates of a language ranked together before the last ranking.
RANKED = 8_000


def marked_words(raw: bytes) -> list[bytes]:
    """The lowered words of a text, a mark at each end of a piece."""
    return raw.translate(_FOLD).replace(_MARK, b" . ").split()


def mixed(lang: str, codes: list[np.ndarray]) -> np.ndarray:
    """One hash for the language and the codes of each phrase."""
    out = np.full(len(codes[0]), xxh3_64_intdigest(lang, len(codes)), np.uint64)
    for c in codes:
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    """The bits of the bitmap that the hashes stand for."""
    return hashes >> np.uint64(64 - BITMAP_BITS)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _code_names(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def _relation_columns(k: int) -> list[str]:
    return ["lang", "limit", "step", "code", *(f"w{i}" for i in range(k))]


def _relation_schema(k: int) -> str:
    return "lang string, limit int, step binary, code binary" + "".join(f", w{i} binary" for i in range(k))


def _row(names: list[str], lang: str, limit: int, pos: np.ndarray, *more: bytes) -> pa.RecordBatch:
    """One row of a relation. Positions are kept as distances, which compress to a bit or two."""
    packed = [np.diff(pos, prepend=0).astype(np.uint32).tobytes(), *more]
    columns = [pa.array([lang], pa.string()), pa.array([limit], pa.int32()), *(pa.array([b], pa.binary()) for b in packed)]
    return pa.RecordBatch.from_arrays(columns, names)


def _rows(batch: pa.RecordBatch, k: int) -> Iterator[tuple[str, int, np.ndarray, list[np.ndarray]]]:
    """(lang, limit, positions, codes of the k words) of each row of a relation."""
    for i in range(batch.num_rows):
        table = np.frombuffer(batch["code"][i].as_buffer(), np.uint64)
        words = [table[np.frombuffer(batch[f"w{j}"][i].as_buffer(), np.uint32)] for j in range(k)]
        steps = np.frombuffer(batch["step"][i].as_buffer(), np.uint32)
        yield batch["lang"][i].as_py(), batch["limit"][i].as_py(), np.cumsum(steps, dtype=np.int64), words


def first_relation(df: DataFrame, text: str, lang: str, reach: int, seed: int) -> DataFrame:
    """R(1): (lang, limit, step, code, w0, term, n). ``code``, ``term`` and ``n`` are the distinct words of the row, ``w0`` points into them.

    The first ``limit`` positions of a row are its own; up to ``reach`` more let phrases that start there end.
    """
    names = [*_relation_columns(1), "term", "n"]

    def rows(name: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(words), ROW_WORDS):
            block = words[first : first + ROW_WORDS + reach]
            limit = min(ROW_WORDS, len(block))
            place = {w: i for i, w in enumerate(set(block) - {_MARK})}
            terms = list(place)
            place[_MARK] = -1
            at = np.fromiter(map(place.__getitem__, block), np.int32, len(block))
            pos = np.flatnonzero(at >= 0)
            mine = np.bincount(at[pos[pos < limit]], minlength=len(terms)).astype(np.uint32)
            codes = np.fromiter((xxh3_64_intdigest(w, seed) for w in terms), np.uint64, len(terms))
            yield _row(names, name, limit, pos, codes.tobytes(), at[pos].astype(np.uint32).tobytes(), b" ".join(terms), mine.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for name, raw in zip(batch["lang"], batch["utf8"]):
                words = marked_words(raw.as_py())
                own = gathered.setdefault(name.as_py(), [])
                own += words
                own.append(_MARK)
                size += len(words) + 1
                if len(own) >= ROW_WORDS:
                    yield from rows(name.as_py(), own)
                    size -= len(own)
                    own.clear()
                if size >= TASK_WORDS:
                    for left, held in gathered.items():
                        yield from rows(left, held)
                    gathered, size = {}, 0
        for left, held in gathered.items():
            yield from rows(left, held)

    texts = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), utf8(F.col(f"`{text}`")).alias("utf8"))
    return texts.mapInArrow(run, _relation_schema(1) + ", term binary, n binary")


def extended(
    lang: str, pos: np.ndarray, codes: list[np.ndarray], frequent: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Semi-join with the frequent groups, then merge-join with the next position."""
    kept = frequent[_slots(mixed(lang, codes))]
    pos, codes = pos[kept], [c[kept] for c in codes]
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return pos[at], [*(c[at] for c in codes), codes[-1][at + 1]]


def _own_hashes(batch: pa.RecordBatch, k: int, frequent: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(hashes, how often) of the phrases of k words that start in each row; None for once each."""
    if k == 1:
        for i in range(batch.num_rows):
            codes = np.frombuffer(batch["code"][i].as_buffer(), np.uint64)
            yield mixed(batch["lang"][i].as_py(), [codes]), np.frombuffer(batch["n"][i].as_buffer(), np.uint32)
        return
    for lang, limit, pos, codes in _rows(batch, k - 1):
        pos, codes = extended(lang, pos, codes, frequent)
        yield mixed(lang, [c[: int(np.searchsorted(pos, limit))] for c in codes]), None


class Tally:
    """Sums by one or more columns of numbers, in memory bounded by TALLY_ROWS and HELD_ROWS."""

    def __init__(self) -> None:
        self.fresh: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.waiting = 0

    def add(self, columns: list[np.ndarray], n: np.ndarray | None = None) -> bool:
        """Take in more rows, once each without ``n``. True when the sums should be handed on."""
        if len(columns[0]):
            self.fresh.append((columns, np.ones(len(columns[0]), np.int64) if n is None else n.astype(np.int64)))
            self.waiting += len(columns[0])
        if self.waiting < TALLY_ROWS:
            return False
        held = self.sums()
        self.fresh, self.waiting = [held], 0
        return len(held[1]) >= HELD_ROWS

    def sums(self) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*(f[0] for f in self.fresh))]
        n = np.concatenate([f[1] for f in self.fresh])
        order = np.argsort(columns[0] if len(columns) == 1 else mixed("", columns), kind="stable")
        columns = [c[order] for c in columns]
        # Equal rows are neighbours. Others of the same hash only cut their run; the shuffle sums what is left.
        new = reduce(np.logical_or, [np.concatenate([[True], c[1:] != c[:-1]]) for c in columns])
        at = np.flatnonzero(new)
        return [c[at] for c in columns], np.add.reduceat(n[order], at)


def _counting(relation: DataFrame, occurrences: int) -> DataFrame:
    """The relation in no more tasks than give each COUNTED_WORDS, or one for each core."""
    cores = relation.sparkSession.sparkContext.defaultParallelism
    return relation.coalesce(max(cores, occurrences // COUNTED_WORDS + 1))


def frequent_hashes(relation: DataFrame, k: int, frequent: np.ndarray | None, least: int, occurrences: int) -> np.ndarray:
    """The bitmap of phrases whose hash has ``least`` occurrences or more: of R(1) itself, or of the extension of R(k-1) with ``frequent``.

    A group holds the hashes of one range: enough ranges for about ``GROUP_HASHES`` each. Counts end at 255, and ``least`` may not pass that.
    """
    if least > 255:
        raise ValueError("least must be at most 255")
    bits = max(0, (max(occurrences, 1) // GROUP_HASHES).bit_length())

    def packed(tally: Tally) -> pa.RecordBatch:
        (hashes,), n = tally.sums()
        ranges = (hashes >> np.uint64(32)).astype(np.int32)
        at = np.flatnonzero(np.diff(ranges, prepend=-1))
        ends = np.append(at[1:], len(hashes))
        low, n = hashes.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        parts = [low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(at, ends)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[at]), pa.array(parts, pa.binary())], ["part", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for hashes, times in _own_hashes(batch, k, frequent):
                if tally.add([hashes >> np.uint64(32 - bits)], times):
                    yield packed(tally)
                    tally = Tally()
        if tally.fresh:
            yield packed(tally)

    def enough(group: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(raw, np.uint32, len(raw) // 5), np.frombuffer(raw, np.uint8)[len(raw) // 5 * 4 :]) for raw in group["packed"].to_pylist()]
        hashes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]))
        whole = hashes[n >= least].astype(np.uint64) + (np.uint64(group["part"][0].as_py()) << np.uint64(32))
        return pa.table({"hash": np.unique(whole >> np.uint64(32 + bits - BITMAP_BITS)).astype(np.int64)})

    columns = ["lang", "code", "n"] if k == 1 else _relation_columns(k - 1)
    parts = _counting(relation.select(*columns), occurrences).mapInArrow(count, "part int, packed binary")
    return bitmap_of(parts.groupBy("part").applyInArrow(enough, "hash bigint"))


def next_relation(relation: DataFrame, k: int, frequent: np.ndarray, hashes: np.ndarray) -> DataFrame:
    """R(k) from R(k-1): its extension, of which the phrases with frequent hashes are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, limit, pos, codes in _rows(batch, k - 1):
                pos, codes = extended(lang, pos, codes, frequent)
                kept = hashes[_slots(mixed(lang, codes))]
                if kept.any():
                    table, words = np.unique(np.concatenate([c[kept] for c in codes]), return_inverse=True)
                    places = [w.tobytes() for w in words.astype(np.uint32).reshape(k, -1)]
                    yield _row(_relation_columns(k), lang, limit, pos[kept], table.tobytes(), *places)

    return relation.select(*_relation_columns(k - 1)).mapInArrow(run, _relation_schema(k))


def group_counts(relation: DataFrame, k: int, least: int, occurrences: int) -> DataFrame:
    """(lang, c0..., f): the phrases of R(k) with ``least`` occurrences or more. Each task counts its own before the shuffle."""
    names = _code_names(k)

    def rows(lang: str, tally: Tally) -> pa.RecordBatch:
        codes, n = tally.sums()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *map(_longs, codes), pa.array(n)], ["lang", *names, "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tally] = {}
        for batch in batches:
            for lang, limit, pos, codes in _rows(batch, k):
                own = int(np.searchsorted(pos, limit))
                if held.setdefault(lang, Tally()).add([c[:own] for c in codes]):
                    yield rows(lang, held.pop(lang))
                if sum(t.waiting for t in held.values()) > 4 * TALLY_ROWS:
                    yield from (rows(name, tally) for name, tally in held.items() if tally.fresh)
                    held = {}
        yield from (rows(name, tally) for name, tally in held.items() if tally.fresh)

    schema = "lang string, " + "".join(f"{c} bigint, " for c in names) + "f bigint"
    parts = _counting(relation.select(*_relation_columns(k)), occurrences).mapInArrow(run, schema)
    return parts.groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def word_counts(relation: DataFrame, hashes: np.ndarray, occurrences: int) -> DataFrame:
    """(lang, c0, word, f) of the words of R(1) with frequent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch["lang"][i].as_py()
                codes, n = np.frombuffer(batch["code"][i].as_buffer(), np.uint64), np.frombuffer(batch["n"][i].as_buffer(), np.uint32)
                kept = np.flatnonzero(hashes[_slots(mixed(lang, [codes]))] & (n > 0))
                terms = batch["term"][i].as_py().decode().split(" ")
                columns = [pa.array([lang] * len(kept), pa.string()), _longs(codes[kept]), pa.array([terms[j] for j in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[kept].astype(np.int64))], ["lang", "c0", "word", "f"])

    found = _counting(relation.select("lang", "code", "term", "n"), occurrences).mapInArrow(run, "lang string, c0 bigint, word string, f bigint")
    return found.groupBy("lang", "c0", "word").agg(F.sum("f").alias("f"))


def _sizes(relation: DataFrame) -> DataFrame:
    """(lang, n): the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(v.as_buffer(), np.uint32).sum()) for v in batch["n"]]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(n, pa.int64())], ["lang", "n"])

    return relation.select("lang", "n").mapInArrow(run, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES meanwhile, whatever the number of their rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _matched(left: DataFrame, table: DataFrame, codes: list[str], value: str) -> DataFrame:
    """``left`` with ``f`` of the phrase that the named code columns form, as ``value``."""
    renamed = table.select("lang", *[F.col(o).alias(n) for o, n in zip(_code_names(len(codes)), codes)], F.col("f").alias(value))
    return left.join(renamed, ["lang", *codes])


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    over = (whole[0] * whole[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (whole[1] * whole[2]).cast("decimal(38,0)"))


def mine_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10
) -> tuple[list[DataFrame], DataFrame]:
    """([frequent phrases of 1, 2, ... words], sizes): the former with (lang, c0..., f), the first one also with ``word``; sizes has (lang, n)."""
    with _small_batches(df.sparkSession):
        seed = 0
        while True:
            relation = stored(first_relation(df, text, lang, max_words - 1, seed), "occurrences-1", **PACKED)
            sizes = stored(_sizes(relation), "sizes")
            occurrences = sizes.agg(F.sum("n")).first()[0] or 0
            hashes = frequent_hashes(relation, 1, None, least, occurrences)
            words = stored(word_counts(relation, hashes, occurrences), "words")
            if not words.groupBy("lang", "c0").count().where("count > 1").limit(1).count():
                break
            # Two words share a code: others are drawn.
            seed += 1
        frequent = [words.where(F.col("f") >= least)]
        for k in range(2, max_words + 1):
            known, hashes = hashes, frequent_hashes(relation, k, hashes, least, occurrences)
            relation = stored(next_relation(relation, k, known, hashes), f"occurrences-{k}", **PACKED)
            frequent.append(stored(group_counts(relation, k, least, occurrences), f"frequent-{k}"))
    return frequent, sizes


def _scored(frequent: list[DataFrame], k: int) -> DataFrame:
    """(lang, c0..., a, l, r, score) of the phrases of k words, by the cut with the lowest score and the smallest first part."""
    names = _code_names(k)
    found = frequent[k - 1].select("lang", *names, F.col("f").alias("a"))
    cuts = []
    for cut in range(1, k):
        found = _matched(found, frequent[cut - 1], names[:cut], f"l{cut}")
        found = _matched(found, frequent[k - cut - 1], names[cut:], f"r{cut}")
        left, right = F.col(f"l{cut}"), F.col(f"r{cut}")
        cuts.append(F.struct(score(F.col("a"), left, right).alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return found.withColumn("best", best).select("lang", *names, "a", "best.l", "best.r", "best.score")


def _longest_holder(frequent: list[DataFrame], k: int) -> DataFrame:
    """(lang, c0..., held): the most occurrences of a longer phrase that holds the phrase of k words."""
    parts = []
    for longer in range(k + 1, len(frequent) + 1):
        for first in range(longer - k + 1):
            codes = [F.col(f"c{first + i}").alias(f"c{i}") for i in range(k)]
            parts.append(frequent[longer - 1].select("lang", *codes, F.col("f").alias("held")))
    return reduce(DataFrame.unionByName, parts).groupBy("lang", *_code_names(k)).agg(F.max("held").alias("held"))


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 3,
    least: int = 10,
    held_percent: int = 50,
    top: int = 2_000,
    ranked: int = RANKED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of 2 to ``max_words`` words is a candidate with ``least`` occurrences. One that lies inside a longer candidate with at least
    ``held_percent`` of its occurrences is left out.
    """
    frequent, sizes = mine_phrases(df, text, lang, max_words, least)
    parts = []
    for k in range(2, max_words + 1):
        names = _code_names(k)
        found = _scored(frequent, k)
        if k < max_words:
            found = found.join(_longest_holder(frequent, k), ["lang", *names], "left")
            found = found.where(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * held_percent)).drop("held")
        for i, name in enumerate(names):
            found = found.join(frequent[0].select("lang", F.col("c0").alias(name), F.col("word").alias(f"w{i}")), ["lang", name])
        phrase = F.concat_ws(" ", *[f"w{i}" for i in range(k)]).alias("phrase")
        parts.append(found.select("lang", phrase, "a", "l", "r", "score"))
    found = stored(reduce(DataFrame.unionByName, parts), "collocations")

    # A language is ranked in parts of a bounded size first: only ``top`` rows of each part meet.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    largest = found.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    if largest > ranked:
        part = F.pmod(F.xxhash64("phrase"), F.lit(-(-largest // ranked)))
        inside = Window.partitionBy("lang", "part").orderBy(*order)
        found = found.withColumn("part", part).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top).drop("part", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Quality rule: Jensen-Shannon distance of a document's histograms to those of its language.

Two histograms per document: character classes and common words. Their language references are the sums over every
document of the language, so they grow with the corpus. A document far from its reference in either is dropped.

Cases: a null text has no words and fails the base rule; a null language, and one whose reference has fewer than
``min_reference_words`` words, gives no verdict; a text under the minimum lengths gets no verdict of its own; an
empty table gives no rows. Repeated rows are judged one by one. Only the key, text and language columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import ALNUM, BLOCK_ROWS, map_blocks, stored, utf8
from quillstrata.plans.skew import HEAVY_ROWS, lookup

# Character classes of UTF-8 bytes; continuation bytes belong to none.
_CLASSES = ["vowel", "consonant", "upper", "digit", "space", "newline", "stop", "mark", "other", "two", "three", "four"]
_MARKS = b"#*$%&|<>"
# Common words that a language has at most.
KEEP_WORDS = 25
# Word lists and references of that many languages go to the tasks as a whole (a few MB); of more, they are joined by language.
HELD_LANGUAGES = 2_000


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
    table[97:123] = _CLASSES.index("consonant")
    for b in b"aeiouy":
        table[b] = _CLASSES.index("vowel")
    table[65:91] = _CLASSES.index("upper")
    table[48:58] = _CLASSES.index("digit")
    for b in b" \t\x0b\x0c\r":
        table[b] = _CLASSES.index("space")
    table[10] = _CLASSES.index("newline")
    for b in b".,;:!?":
        table[b] = _CLASSES.index("stop")
    for b in _MARKS:
        table[b] = _CLASSES.index("mark")
    table[128:192] = len(_CLASSES)
    table[192:224] = _CLASSES.index("two")
    table[224:240] = _CLASSES.index("three")
    table[240:] = _CLASSES.index("four")
    return table


def class_counts(text: bytes) -> np.ndarray:
    """How many characters of each class a UTF-8 text has."""
    counts = np.bincount(_byte_classes_table[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 1)
    return counts[: len(_CLASSES)]


_byte_classes_table = _byte_classes()


def repeated_window_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def common_words(texts: DataFrame, held: int = 200_000, keep: int = KEEP_WORDS) -> dict[str, list[bytes]]:
    """``word_table`` as group -> words."""
    return _words_of(word_table(texts, held=held, keep=keep))


def _words_of(table: DataFrame) -> dict[str, list[bytes]]:
    return {r["grp"]: [bytes(w) for w in r["words"]] for r in table.toLocalIterator()}


def word_table(texts: DataFrame, least: int = 0, held: int = 200_000, keep: int = KEEP_WORDS) -> DataFrame:
    """(grp, words): at most ``keep`` most frequent words of each group of ``least`` words or more, every word of every text counted.

    A task holds about ``held`` counters; it hands them on when there are more and starts anew, so memory is bounded and the sums are exact.
    """

    def handed_on(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for group, words in seen.items():
            yield pa.RecordBatch.from_pydict(
                {"grp": [group] * len(words), "word": list(words), "n": list(words.values())},
                schema=pa.schema([("grp", pa.string()), ("word", pa.binary()), ("n", pa.int64())]),
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                for text, group in zip(part["utf8"].to_pylist(), part["grp"].to_pylist()):
                    seen[group].update(text.translate(ALNUM).split())
                if sum(map(len, seen.values())) > held:
                    yield from handed_on(seen)
                    seen.clear()
        yield from handed_on(seen)

    counts = texts.mapInArrow(count, "grp string, word binary, n bigint").groupBy("grp", "word").agg(F.sum("n").alias("n"))
    ranked = _top(counts, keep).where(F.col("total") >= least)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    return ranked.groupBy("grp").agg(F.transform(ordered, lambda w: w["word"]).alias("words"))


def _top(counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` largest of each group and its ``total``, first inside 64 parts of it so that no task sorts a whole vocabulary."""
    order = [F.col("n").desc(), F.col("word")]
    parts = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    inner = parts.withColumns(
        {"r": F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)), "all": F.sum("n").over(Window.partitionBy("grp", "part"))}
    ).where(F.col("r") <= keep)
    # The first row of each part stands for its sum.
    total = F.sum(F.when(F.col("first"), F.col("all"))).over(Window.partitionBy("grp"))
    return (
        inner.withColumn("first", F.col("r") == 1)
        .withColumns({"r": F.row_number().over(Window.partitionBy("grp").orderBy(*order)), "total": total})
        .where(F.col("r") <= keep)
        .select("grp", "word", "n", "total")
    )


def _by_language(facts: DataFrame, table: DataFrame, column: str, rows: int, heavy_rows: int) -> DataFrame:
    """``facts`` with ``column`` of their language; rows without a language are dealt out, they match nothing."""
    dealt = facts.withColumn("_at", F.coalesce("grp", F.concat(F.lit("\0"), F.pmod(F.xxhash64("key"), F.lit(4096)))))
    return lookup(dealt, table.select(F.col("grp").alias("_at"), column), ["_at"], "key", rows, heavy_rows).drop("_at")


def _first_of(part: pa.RecordBatch, column: str) -> dict:
    """Language -> its value of a joined column, from the first row of each language of a block."""
    found = {}
    for at, group in enumerate(part["grp"].to_pylist()):
        if group is not None and group not in found and part[column][at].is_valid:
            found[group] = part[column][at].as_py()
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts p to the counts q; 0 for an empty row."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    distance = np.sqrt(np.maximum((left + right) / 2, 0))
    return np.where(p.sum(axis=1) > 0, distance, 0.0)


def quality_verdicts(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_class_distance: float = 0.09,
    max_word_distance: float = 0.03,
    class_noise: float = 1.5,
    word_noise: float = 3.4,
    min_chars: int = 200,
    min_words: int = 50,
    min_reference_words: int = 10_000,
    held_languages: int = HELD_LANGUAGES,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(key, counts, base_failed, class_distance, word_distance, kept), one row per input row.

    ``class_noise`` and ``word_noise``, divided by the root of the number of words, are added to the two limits: a short text's
    histogram is far from any reference by chance. Every language with enough words has its own word list and reference. Those of at most
    ``held_languages`` languages are held by the tasks; more are joined by language, a frequent one dealt to parts.
    """
    texts = df.select(F.col(key).alias("key"), utf8(F.col(text)).alias("utf8"), F.col(lang).alias("grp"))
    # A language with fewer words in all cannot have a reference.
    listed = stored(word_table(texts.where(F.col("grp").isNotNull()), least=min_reference_words), "words")
    few = listed.count() <= held_languages
    all_common = _words_of(listed) if few else {}
    total_rows = 0 if few else df.count()
    if not few:
        texts = _by_language(texts, listed, "words", total_rows, heavy_rows)
    wide = KEEP_WORDS + 1

    def counts(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, common = [], all_common if few else _first_of(part, "words")
        for raw, group in zip(part["utf8"].to_pylist(), part["grp"].to_pylist()):
            words, classes = raw.split(), class_counts(raw)
            plain = raw.translate(ALNUM).split()
            times = Counter(plain)
            known = [times[w] for w in common.get(group, ())]
            known += [0] * (wide - 1 - len(known)) + [len(plain) - sum(known)]
            spaces = classes[_CLASSES.index("space")] + classes[_CLASSES.index("newline")]
            rows.append(
                (
                    len(words),
                    int(classes.sum() - spaces),
                    int(classes[_CLASSES.index("mark")]),
                    repeated_lines(raw),
                    repeated_window_words(words),
                    classes.tolist(),
                    known,
                    group in common,
                )
            )
        columns = list(zip(*rows)) or [()] * 8
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common", "listed"]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.bool_()]
        arrays = {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}
        return pa.RecordBatch.from_pydict({"key": part["key"], "grp": part["grp"]} | arrays)

    kind = dict(df.dtypes)[key]
    base = f"key {kind}, grp string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    table = stored(map_blocks(texts, counts, f"{base}, classes array<bigint>, common array<bigint>, listed boolean"), "histograms")

    def distances(part: pa.RecordBatch, references: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class distance, word distance, far from the reference) of each row."""
        classes, words = _matrix(part["classes"]), _matrix(part["common"])
        names = np.array(part["grp"].to_pylist(), dtype=object)
        n_words = part["n_words"].to_numpy()
        if references is None:
            references = {g: np.array(v) for g, v in _first_of(part, "sums").items()}
        by_class, by_word, known = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names), bool)
        for group in set(names) & set(references):
            mine, reference = names == group, references[group]
            by_class[mine] = js_distance(classes[mine], reference[: len(_CLASSES)])
            by_word[mine] = js_distance(words[mine], reference[len(_CLASSES) :])
            known[mine] = reference[len(_CLASSES) :].sum() >= min_reference_words
        chance = 1 / np.sqrt(np.maximum(n_words, 1))
        far = (classes.sum(axis=1) >= min_chars) & (by_class > max_class_distance + class_noise * chance)
        far |= (n_words >= min_words) & (by_word > max_word_distance + word_noise * chance)
        return by_class, by_word, far & known

    # Histograms with their language's reference beside them, or the references as a whole.
    Judged = tuple[DataFrame, dict[str, np.ndarray] | None]

    def reference_of(judged: Judged) -> Judged:
        """Histogram sums of each language over the rows that neither the base rule nor the references given drop."""
        rows, references = judged

        def handed_on(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"grp": list(sums), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))}
            )

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                both = np.hstack([_matrix(batch["classes"]), _matrix(batch["common"])])
                names = np.array(batch["grp"].to_pylist(), dtype=object)
                near = ~distances(batch, references)[2]
                for group in set(names):
                    sums[group] = sums.get(group, 0) + both[(names == group) & near].sum(axis=0)
                if len(sums) > 20_000:
                    yield handed_on(sums)
                    sums = {}
            if sums:
                yield handed_on(sums)

        usable = rows.where(F.col("listed") & (F.col("n_words") >= 50) & (F.col("n_repeat_words") * 2 <= F.col("n_words")))
        parts = usable.mapInArrow(add_up, "grp string, sums array<bigint>")
        flat = parts.select("grp", F.posexplode("sums")).groupBy("grp", "pos").agg(F.sum("col").alias("n"))
        if not few:
            ordered = F.sort_array(F.collect_list(F.struct("pos", "n")))
            sums = stored(flat.groupBy("grp").agg(F.transform(ordered, lambda b: b["n"]).alias("sums")), "references")
            return _by_language(table, sums, "sums", total_rows, heavy_rows), None
        found: dict[str, np.ndarray] = {}
        # At most ``held_languages`` languages of a fixed number of bins.
        for row in flat.collect():
            found.setdefault(row["grp"], np.zeros(len(_CLASSES) + wide))[row["pos"]] = row["n"]
        return table, found

    # The second reference leaves out what is far from the first, so junk does not model itself.
    rows, references = reference_of(reference_of((table, {})))

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        by_class, by_word, far = distances(part, references)
        n_words, repeat = part["n_words"].to_numpy(), part["n_repeat_words"].to_numpy()
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        kept = {n: part[n] for n in ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]}
        return pa.RecordBatch.from_pydict(
            kept | {"base_failed": failed, "class_distance": by_class, "word_distance": by_word, "kept": ~failed & ~far}
        )

    out = base.replace("grp string, ", "") + ", base_failed boolean, class_distance double, word_distance double, kept boolean"
    return map_blocks(rows, judge, out, rows=4096).withColumnRenamed("key", key)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.int64)

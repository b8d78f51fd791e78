"""Unicode and whitespace handling, word and n-gram arrays."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Everything the reference language treats as whitespace. Java's \s alone misses U+0085, U+001C-1F and \p{Z}.
WS = r"\s\x1c-\x1f\x85\p{Z}"
SPACE_RUN = rf"[{WS}]+"
# A run that is anything but one plain space: single spaces, the common case, are left alone.
UNTIDY_RUN = rf" [{WS}]+|[{WS}&&[^ ]][{WS}]*"
WORD_RUN = rf"[^{WS}]+"

# Code points that can make a text differ from its NFC form: marks, medial and final jamo, and characters with a
# canonical mapping of their own. A text with none of them is already in NFC, so it stays in the JVM.
_SUSPECT_RANGES = [
    # canonical mappings of their own
    (0x374, 0x374), (0x37E, 0x37E), (0x387, 0x387), (0x958, 0x95F), (0x9DC, 0x9DF), (0xA33, 0xA5E), (0xB5C, 0xB5D),
    (0xF43, 0xFB9), (0x1F71, 0x1FFD), (0x2000, 0x2001), (0x2126, 0x212B), (0x2329, 0x232A), (0x2ADC, 0x2ADC),
    (0xF900, 0xFAFF), (0xFB1D, 0xFB4E), (0x1D15E, 0x1D1C0), (0x2F800, 0x2FA1D),
    # medial and final jamo
    (0x1161, 0x11FF),
    # scripts whose combining signs are newer than the tables of older Java runtimes
    (0x870, 0x8FF), (0x1715, 0x1715), (0x10F82, 0x10F85), (0x11070, 0x11070), (0xC3C, 0xC3C), (0x1ABF, 0x1AFF), (0x1DC0, 0x1DFF), (0x10D69, 0x10D6D), (0x10EC0, 0x10EFF),
    (0x11380, 0x113FF), (0x11F00, 0x11F5F), (0x1611E, 0x1612F), (0x16D63, 0x16D6A), (0x1E000, 0x1E8FF),
]
NFC_SUSPECT = r"[\p{M}" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in _SUSPECT_RANGES) + "]"


@F.arrow_udf(T.StringType())
def _to_nfc(texts: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize kernel decomposes whatever form it is asked for (seen in 23.0.1).
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` without repeating its expression."""
    return F.transform(F.array(value), body)[0]


def nfc(text: Column) -> Column:
    """Canonical composition. Only rows with a suspect code point are sent to the Arrow worker."""
    # The one-range test settles Latin text before the long class is tried.
    suspect = F.when(text.rlike(r"[^\x00-\x{2ff}]") & text.rlike(NFC_SUSPECT), text)
    return F.coalesce(_to_nfc(suspect), text)


def strip(text: Column) -> Column:
    """Trim the full whitespace class, not just U+0020."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def squeeze_spaces(text: Column) -> Column:
    """Every whitespace run becomes one space; outer ones go."""
    return F.trim(F.regexp_replace(text, UNTIDY_RUN, " "))


def normalize_text(text: Column) -> Column:
    """NFC, then collapsed and trimmed whitespace. Null stays null."""
    return squeeze_spaces(nfc(text))


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN)).cast("bigint")


# Default pre-token: a run of letters/digits/underscore, or a run of other visible signs.
PRE_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]+"


def pre_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PRE_TOKEN)).cast("bigint")


def clustering_text(text: Column) -> Column:
    """What near-duplicate detection looks at: normalized and lowered, null taken as empty."""
    return F.lower(normalize_text(F.coalesce(text, F.lit(""))))


# Each word looks ahead for three words, so one regex pass yields all overlapping shingles. The match takes the whole word: an
# empty one would be tried again inside a character of two UTF-16 units.
_THREE_WORDS = r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))[^ ]+"


def word_shingles(text: Column) -> Column:
    """The set of 3-word shingles of the clustering text; a text of fewer words is its own shingle."""
    return let(
        clustering_text(text),
        lambda t: F.when(
            t.rlike(r"^[^ ]+ [^ ]+ [^ ]"),
            F.array_distinct(F.regexp_extract_all(t, F.lit(_THREE_WORDS), F.lit(1))),
        ).otherwise(F.array(t)),
    )


# Maximal runs of two or more word signs, which is what a \b\w\w+\b match comes to.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_tokens_sql(column: str) -> str:
    """SQL text of the lowered words of a column, repeats kept."""
    return f"regexp_extract_all(lower(`{column}`), r'{WORD_TOKEN}', 0)"


def word_ngrams_sql(column: str, low: int = 1, high: int = 2) -> str:
    """SQL text of the word n-grams of a column: lowered, repeats kept, shortest first."""
    grams = [
        "w" if n == 1 else
        f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), i -> concat_ws(' ', slice(w, i, {n}))), "
        "cast(array() as array<string>))"
        for n in range(low, high + 1)
    ]
    return f"transform(array({word_tokens_sql(column)}), w -> flatten(array({', '.join(grams)})))[0]"


def gram_text_sql(column: str) -> str:
    """SQL text of what character n-grams are taken from: the whole lowered text, longer whitespace runs collapsed."""
    return f"regexp_replace(lower(`{column}`), r'[{WS}]{{2,}}', ' ')"


def char_ngrams_sql(column: str, low: int = 3, high: int = 5) -> str:
    """SQL text of the character n-grams of a column: the whole lowered text, longer whitespace runs collapsed.

    One look-ahead pass per length: walking the text once beats a ``substring`` per position, which has to
    find its start from the beginning of a UTF-8 string each time. Texts too short for a length have none of it.
    """
    # The match takes one code point, so the next one starts behind it whatever its UTF-16 units.
    grams = [f"regexp_extract_all(t, r'(?s)(?=(.{{{n}}})).', 1)" for n in range(low, high + 1)]
    return f"transform(array({gram_text_sql(column)}), t -> flatten(array({', '.join(grams)})))[0]"


@dataclass(frozen=True)
class WordGrams:
    """The word n-grams of a column by its words, for operators that build the grams inside their tasks."""

    column: str
    low: int = 1
    high: int = 2

    def words(self) -> Column:
        return F.expr(word_tokens_sql(self.column))


def word_ngrams(column: str, low: int = 1, high: int = 2) -> Column:
    return F.expr(word_ngrams_sql(column, low, high))


def char_ngrams(column: str, low: int = 3, high: int = 5) -> Column:
    return F.expr(char_ngrams_sql(column, low, high))


def whole_json(text: Column) -> Column:
    """The text as a VARIANT, null unless the whole of it is one JSON value: parsers stop after the first value and ignore what follows."""
    # What ends a list early does not end an object, and the other way round.
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    alone = alone & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(text))

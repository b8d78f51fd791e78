"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card numbers and international phone numbers. The field adds kinds that depend on
shape and context: national identity numbers, national phone numbers, account numbers and spelled-out addresses. It is trained by
gradient steps on a small labelled table. Decoding is Viterbi in numpy batches under two hard constraints: a number kind needs a
digit in the word, a spelled-out address a bracketed sign in the word or beside it. All other words are outside on every path, so only
the runs between them are decoded.

Cases: null and empty texts have no spans; a span of the field that touches one of a pattern is left out; repeated rows are
searched one by one; an empty table gives no rows. Other columns are kept by ``redact`` and not read by ``find_spans``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import map_blocks

# --- patterns. Kinds in the order of spans that start together.

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("masked_email", "national_id", "local_phone", "account")
KINDS = BASE_KINDS + FIELD_KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot start inside a run of digits whose start did not match, hence the look-behinds: each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of name signs before it, after the last match, and a dotted domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in code points."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# --- word shapes

# Letters become x or X, digits 9; other code points count as small letters.
_SHAPE = bytes(
    88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256)
)
_SMALL_RUN, _CAPITAL_RUN, _DIGIT_RUN = re.compile(rb"x{2,}"), re.compile(rb"X{2,}"), re.compile(rb"9{6,}")
_BRACKETED = re.compile(rb"[\[({](?:at|AT|dot|DOT)[\])}]")
PLAIN, MIXED, NUMERIC, MARKED = "~plain", "~mixed", "~numeric", "~marked"


def shapes_of(raw: bytes) -> list[bytes]:
    """The shape of each word: letter runs to one sign, digit runs by their length up to five."""
    if b"]" in raw or b")" in raw or b"}" in raw:
        # Signs no shape has otherwise stand for a bracketed "at" or "dot".
        raw = _BRACKETED.sub(lambda m: b"\x01" if m[0][1:2] in b"aA" else b"\x02", raw)
    shape = _CAPITAL_RUN.sub(b"X", _SMALL_RUN.sub(b"x", raw.translate(_SHAPE)))
    return _DIGIT_RUN.sub(b"99999", shape).split()


def coarse(shape: bytes) -> str:
    """What stands for a shape the training never saw."""
    if b"\x01" in shape or b"\x02" in shape:
        return MARKED
    if b"9" not in shape:
        return PLAIN if not shape.strip(b"xX.,;:!?'\"-|") else MIXED
    return NUMERIC


# --- the field


@dataclass
class ShapeField:
    """Label scores by the shapes of the word before, at and after a position, and label transitions."""

    shapes: dict[bytes | str, int]
    emit: np.ndarray  # (3, shapes, labels); label 0 is outside
    step: np.ndarray  # (labels, labels)

    def numbers(self, shapes: list[bytes]) -> np.ndarray:
        known, get = self.shapes, self.shapes.get
        found = np.fromiter((get(s, -1) for s in shapes), np.int32, len(shapes))
        for k in np.flatnonzero(found < 0).tolist():
            found[k] = known[coarse(shapes[k])]
        return found

    def __post_init__(self):
        names = [s.encode() if isinstance(s, str) else s for s in self.shapes]
        self.numeric = np.array([b"9" in s or s == NUMERIC.encode() for s in names])
        self.marked = np.array([b"\x01" in s or b"\x02" in s or s == MARKED.encode() for s in names])

    def decode(self, numbers: np.ndarray) -> np.ndarray:
        """The best label of every word."""
        labels = np.zeros(len(numbers), np.int64)
        digit, sign = self.numeric[numbers], np.concatenate([[False], self.marked[numbers], [False]])
        sign = sign[:-2] | sign[1:-1] | sign[2:]
        free = np.flatnonzero(digit | sign)
        if not len(free):
            return labels
        edge = self.shapes[""]
        padded = np.concatenate([[edge], numbers, [edge]])
        scores = self.emit[0][padded[free]] + self.emit[1][padded[free + 1]] + self.emit[2][padded[free + 2]]
        scores[~sign[free], 1] = -1e9
        scores[~digit[free], 2:] = -1e9
        breaks = np.flatnonzero(np.diff(free) > 1) + 1
        firsts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(free)]])
        lengths = ends - firsts
        for size in np.unique(lengths):
            at = firsts[lengths == size]
            rows = at[:, None] + np.arange(size)
            before, after = free[at] > 0, free[at] + size < len(numbers)
            labels[free[rows]] = viterbi(scores[rows], self.step, before, after)
        return labels


def viterbi(scores: np.ndarray, step: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Best paths of a batch (runs, words, labels); ``before`` and ``after`` tell whether an outside word adjoins the run."""
    runs, size, labels = scores.shape
    best = scores[:, 0] + before[:, None] * step[0]
    back = np.zeros((runs, size, labels), np.int8)
    for t in range(1, size):
        paths = best[:, :, None] + step
        back[:, t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + scores[:, t]
    best = best + after[:, None] * step[:, 0]
    out = np.zeros((runs, size), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in range(size - 1, 0, -1):
        out[:, t - 1] = back[np.arange(runs), t, out[:, t]]
    return out


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, labels): a small labelled table, drawn by rule from the sentence patterns below.

    ``#`` is a digit. A part in braces is personal data: kind number of FIELD_KINDS, then its words. The rest are look-alikes.
    """
    draw = np.random.default_rng(seed)
    frames = [
        "{0 x[at]x[dot]x}", "{0 x[at]x.x}", "{0 x (at) x (dot) x}", "{0 x [at] x [dot] x}", "{0 x.x [at] x [dot] x}", "{0 x## [at] x-x [dot] x}",
        "{1 ###-##-####}", "{1 ###-##-####}", "{1 ### ## ####}", "{1 ##.###.###-#}",
        "{2 (###) ###-####}", "{2 ###-###-####}", "{2 ###.###.####}", "{2 (###) ### ####}", "{2 0## ### ## ##}", "{2 0## ########}",
        "{3 XX## #### #### #### #### ##}", "{3 XX##XXXX##############}", "{3 XX####################}", "{3 XX## #### #### #### #### #### ##}",
        "####-##-##", "##/##/####", "##.##.####", "##:##", "##:##:##", "#.#.#", "v#.##.#", "####", "##", "#", "#,###", "#,###.##", "$##.##", "##%",
        "################", "#############", "####################", "#### ####", "#### #### ####", "##-##", "#-#", "###-###", "x-##", "x##x##x##", "##x", "X##", "X-####",
        "###.###.###.###", "+# (###) ###-####", "x.##@x#.x.x", "x = \"#x##x###x#\"", "### ### ###", "### ###", "x(#)", "(####)", "(x)", "[#]", "[x]", "#) x", "||| x |||",
        "####-####-####-####", "###, ###, ###", "#### ##", "XXX XX XXX", "X.X.", "XX", "XX## x", "X#", "#### x ####", "1. x 2. x", "###-##-#####", "####-##-####", "###-####",
    ]
    letters = np.array(list("abcdefghijklmnoprstuvwé"))

    def fill(word: str) -> str:
        word = re.sub("#", lambda _: str(draw.integers(10)), word)
        word = re.sub(r"(?<![\[(])x(?![\w])|(?<![\w])x", lambda _: "".join(draw.choice(letters, draw.integers(2, 9))), word)
        return re.sub("X", lambda _: chr(65 + draw.integers(26)), word)

    def prose() -> list[str]:
        words = ["".join(draw.choice(letters, draw.integers(1, 9))) for _ in range(draw.integers(1, 5))]
        words = [w.capitalize() if draw.random() < 0.2 else w.upper() if draw.random() < 0.05 else w for w in words]
        return [w + (draw.choice(list(".,;:!?")) if draw.random() < 0.15 else "") for w in words]

    table = []
    for k in range(rows):
        words, labels = [], []
        for frame in [frames[k % len(frames)]] + [frames[i] for i in draw.integers(20, len(frames), draw.integers(0, 2))]:
            before = prose()
            words += before
            labels += [0] * len(before)
            label = int(frame[1]) + 1 if frame[0] == "{" else 0
            inner = [fill(w) for w in (frame[3:-1] if label else frame).split()]
            if draw.random() < 0.3:
                inner[-1] += str(draw.choice(list(".,;:")))
            words += inner
            labels += [label] * len(inner)
        if draw.random() < 0.8:
            after = prose()
            words += after
            labels += [0] * len(after)
        table.append((words, labels))
    return table


def train_field(table: list[tuple[list[str], list[int]]], labels: int = len(FIELD_KINDS) + 1, steps: int = 150, rate: float = 0.3, ridge: float = 0.01) -> ShapeField:
    """Maximum likelihood with a ridge, by Adam steps on the whole table; sequences of one length form a batch."""
    shaped = [shapes_of(" ".join(words).encode()) for words, _ in table]
    keys: list[bytes | str] = ["", PLAIN, MIXED, NUMERIC, MARKED, *sorted({s for row in shaped for s in row})]
    field = ShapeField({s: k for k, s in enumerate(keys)}, np.zeros((3, len(keys), labels)), np.zeros((labels, labels)))
    batches: dict[int, list] = {}
    draw = np.random.default_rng(3)
    for row, (_, gold) in zip(shaped, table):
        assert len(row) == len(gold), (row, gold)
        # A few words under their coarse shape, so that unseen shapes have weights of their own.
        hidden = [coarse(s).encode() if draw.random() < 0.1 else s for s in row]
        numbers = [field.shapes.get(s, field.shapes.get(s.decode(errors="replace"), 0)) for s in hidden]
        batches.setdefault(len(row), []).append((numbers, gold))
    data = [(np.array([n for n, _ in b]), np.array([g for _, g in b])) for b in batches.values()]
    params = [field.emit, field.step]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for it in range(1, steps + 1):
        grad_emit, grad_step = -ridge * field.emit, -ridge * field.step
        for numbers, gold in data:
            count, size = numbers.shape
            edge = np.zeros((count, 1), int)
            padded = np.hstack([edge, numbers, edge])
            near = [padded[:, :-2], padded[:, 1:-1], padded[:, 2:]]
            scores = sum(field.emit[k][near[k]] for k in range(3))
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for t in range(1, size):
                ahead[:, t] = scores[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.step, axis=1)
            for t in range(size - 2, -1, -1):
                behind[:, t] = np.logaddexp.reduce(field.step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            pull = -np.exp(ahead + behind - total[:, None, None])
            np.put_along_axis(pull, gold[:, :, None], np.take_along_axis(pull, gold[:, :, None], 2) + 1, 2)
            for k in range(3):
                np.add.at(grad_emit[k], near[k], pull)
            for t in range(1, size):
                pair = ahead[:, t - 1, :, None] + field.step + (scores[:, t] + behind[:, t])[:, None, :]
                grad_step -= np.exp(pair - total[:, None, None]).sum(axis=0)
                np.add.at(grad_step, (gold[:, t - 1], gold[:, t]), 1)
        for p, g, m, v in zip(params, (grad_emit, grad_step), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return field


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# Least and most digits that a span of the kind has; checked after decoding, failing spans are dropped.
_DIGITS = {"national_id": (9, 11), "local_phone": (9, 12), "account": (14, 34)}


def field_spans(field: ShapeField, text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the runs of equal labels, without the punctuation around."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    spans, k = [], 0
    while k < len(labels):
        last = k
        while last + 1 < len(labels) and labels[last + 1] == labels[k]:
            last += 1
        if labels[k]:
            start, end = places[k][0], places[last][1]
            while end > start and text[end - 1] in ".,;:!?\"'":
                end -= 1
            while start < end and text[start] in "\"'":
                start += 1
            kind = FIELD_KINDS[labels[k] - 1]
            low, high = _DIGITS.get(kind, (0, end))
            if low <= len(_DIGIT.findall(text, start, end)) <= high:
                spans.append((start, len(BASE_KINDS) + int(labels[k]) - 1, end))
        k = last + 1
    return spans


def text_spans(field: ShapeField, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of all spans of each text, in order. The texts are decoded as one sequence, parted by line ends."""
    shaped = [shapes_of(t.encode("utf-8", "replace")) for t in texts]
    found = []
    for text, shapes in zip(texts, shaped):
        spans = pattern_spans(text)
        if shapes:
            labels = field.decode(field.numbers(shapes))
            if labels.any():
                taken = [(a, b) for a, _, b in spans]
                spans += [s for s in field_spans(field, text, labels) if not any(a < s[2] and s[0] < b for a, b in taken)]
        found.append(sorted(spans))
    return found


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text", field: ShapeField | None = None) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) in order of start and kind; code points, end exclusive."""
    field = field or train_field(labelled_table())

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = text_spans(field, [t or "" for t in part["text"].to_pylist()])
        named = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in spans]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays([part["key"], pa.array(named, pa.list_(kind))], ["key", "spans"])

    schema = f"key {dict(df.dtypes)[key]}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_blocks(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, schema).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", field: ShapeField | None = None) -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in angle brackets; where spans overlap, the first and longest wins."""
    field = field or train_field(labelled_table())

    def mask(value: str, spans: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2])):
            if start >= at:
                parts += [value[at:start], f"<{KINDS[kind]}>"]
                at = end
            elif end > at:
                # The rest of an overlapping span goes too.
                at = end
        return "".join([*parts, value[at:]])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values = part[text].to_pylist()
        spans = text_spans(field, [t or "" for t in values])
        masked = [v if not s else mask(v, s) for v, s in zip(values, spans)]
        columns = {n: part[n] for n in part.schema.names}
        return pa.RecordBatch.from_pydict(columns | {text: pa.array(masked, pa.string())})

    return map_blocks(df, work, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))

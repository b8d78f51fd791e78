"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean embedding of its hashed byte 3- and 4-grams. The model is linear in that mean, so prediction is a sum of
per-bucket class scores over the whole text. A temperature fitted on rows that the training left out calibrates the probability;
texts under ``reject_below`` are flagged as rejected but keep their best language.

Cases: null texts and texts without a letter are ``und`` with score 0; without a labelled row everything is ``und``; with one label
that label always wins; repeated rows are predicted one by one; null labels are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import drawn, map_blocks, text_key

BUCKET_BITS = 15
# Bytes of one text hashed at a time, so that a very long text needs no long arrays.
_CHUNK = 1 << 20


def bucket_counts(text: str) -> np.ndarray:
    """Occurrences per bucket of the byte 3-grams and 4-grams of the lowered, space-padded text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for first in range(0, max(len(raw) - 2, 0), _CHUNK):
        b = raw[first : first + _CHUNK + 3].astype(np.uint32)
        last = first + _CHUNK + 3 >= len(raw)
        three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        four = three[:-1] | (b[3:] << np.uint32(24))
        if not last:
            three = three[:_CHUNK]
            four = four[:_CHUNK]
        for grams, factor in ((three, 2654435761), (four, 2246822519)):
            total += np.bincount((grams * np.uint32(factor)) >> np.uint32(32 - BUCKET_BITS), minlength=len(total))
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: str) -> np.ndarray:
        counts = bucket_counts(text)
        logits = (counts @ self.table / max(counts.sum(), 1) + self.bias) / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def _train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dim: int, epochs: int, rate: float):
    """Stochastic gradient descent over sparse rows (bucket numbers, weights that sum to 1)."""
    draw = np.random.default_rng(7)
    embed = draw.normal(0, 0.1, (1 << BUCKET_BITS, dim))
    out, bias = np.zeros((dim, classes)), np.zeros(classes)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, weight = rows[i]
            mean = weight @ embed[at]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            speed = rate * (1 - done / steps)
            back = out @ p
            out -= speed * np.outer(mean, p)
            bias -= 0.1 * speed * p
            # Weights are small means: scaled up so that one text moves its buckets by a useful step.
            embed[at] -= speed * 20 * np.outer(weight, back)
            done += 1
    return embed, out, bias


def fit_language(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train: Column | None = None,
    max_rows: int = 4_000,
    dim: int = 16,
    epochs: int = 8,
    rate: float = 0.5,
    reject_below: float = 0.6,
) -> LanguageModel | None:
    """Fit in the driver on the packed counts of about ``max_rows`` labelled rows at most, taken by a hash of key and text; None without a labelled row."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if train is not None:
        known = known.where(train)
    share = min(1.0, max_rows / max(known.count(), 1))
    # One row for each text of a key, however often it is there: the bound holds for rows.
    known = known.withColumn("_text_key", text_key(F.col(text))).where(drawn(share, key, "_text_key"))
    known = known.groupBy(key, "_text_key").agg(F.first(text).alias(text), F.min(lang).alias(lang))

    def sparse(part: pa.RecordBatch) -> pa.RecordBatch:
        at, weight = [], []
        for t in part["text"].to_pylist():
            counts = bucket_counts(t)
            hit = np.flatnonzero(counts)
            at.append(hit.astype(np.uint16).tobytes())
            weight.append((counts[hit] / max(counts.sum(), 1)).astype(np.float32).tobytes())
        arrays = {"at": pa.array(at, pa.binary()), "weight": pa.array(weight, pa.binary())}
        return pa.RecordBatch.from_pydict({"y": part["y"]} | arrays)

    sampled = known.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("y"))
    rows = map_blocks(sampled.select("y", "text"), sparse, "y string, at binary, weight binary").collect()
    if not rows:
        return None
    # The order of arrival depends on the partitioning; the content does not.
    rows.sort(key=lambda r: (r["y"], r["at"], r["weight"]))
    names = sorted({r["y"] for r in rows})
    y = np.array([names.index(r["y"]) for r in rows])
    x = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["weight"], np.float32)) for r in rows]
    held = np.arange(len(x)) % 5 == 4
    embed, out, bias = _train([v for v, h in zip(x, held) if not h], y[~held], len(names), dim, epochs, rate)
    table = embed @ out
    temperature = 1.0
    if held.any():
        logits = np.array([w @ table[at] + bias for (at, w), h in zip(x, held) if h])
        loss = {}
        for t in np.geomspace(0.05, 20, 60):
            z = logits / t - (logits / t).max(axis=1, keepdims=True)
            loss[t] = -(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean()
        temperature = float(min(loss, key=loss.get))
    return LanguageModel(names, table, bias, temperature, reject_below)


def predict_language(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Every column of ``df`` but the text, and ``lang_pred``, ``score``, ``rejected``."""
    fields = [f for f in df.schema.fields if f.name not in (text, "lang_pred", "score", "rejected")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, rejected = [], [], []
        for t in part["_text"].to_pylist():
            if model is None or not has_letter(t):
                names.append("und"), scores.append(0.0), rejected.append(True)
                continue
            p = model.probabilities(t)
            names.append(model.names[int(p.argmax())]), scores.append(float(p.max()))
            rejected.append(scores[-1] < model.reject_below)
        columns = {f.name: part[f.name] for f in fields}
        return pa.RecordBatch.from_pydict(
            columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
        )

    kept = df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("_text"))
    return map_blocks(kept, work, schema + "lang_pred string, score double, rejected boolean")

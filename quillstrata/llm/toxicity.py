"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes look-alike letters and digit substitutions. The lexicon (whole words and word beginnings) and its weights
come from labelled rows; hits inside an exception phrase do not count; the weighted hits, normalised by length, go
through a logistic curve fitted on the same rows.

Cases: null and empty texts have no hits and get the lowest score; with no toxic or no clean labelled row the lexicon is empty and
every score is 0; repeated rows are scored one by one; a label row repeated for a key counts once, as toxic if any of them is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import BLOCK_ROWS, drawn, map_blocks, stored, text_key

# Look-alike letters of other scripts, and the digits and signs written for letters.
HOMOGLYPHS = dict(zip("авеіјкмнорѕстухԁɡοαρνϲ", "abeijkmhopsctyxdgoapvc"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SIGN_LETTERS = re.compile(r"[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")

EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "not stupid", "not worthless")


def fold(text: str) -> list[str]:
    """Lowered words with look-alikes and substitutions undone."""
    if "@" in text or "$" in text:
        text = _SIGN_LETTERS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return _WORD.findall(text.lower().translate(_FOLD))


def candidate_terms(words: set[str], low: int = 4, high: int = 8) -> set[str]:
    """Whole words and word beginnings, written with the spaces they must be found with."""
    terms = {f" {w} " for w in words if len(w) >= 3}
    for n in range(low, high + 1):
        terms.update(" " + w[:n] for w in words if len(w) > n)
    return terms


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = field(default=(0.0, 0.0, 0.0))

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            term = f" {' '.join(fold(phrase))} "
            found.add_word(term, (len(term), None))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def features(self, text: str) -> tuple[float, float]:
        """(log of the weighted hits, weighted hits per hundred words)."""
        if not self.weights:
            return 0.0, 0.0
        words = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for low, high in spared:
            for start in [s for s in best if low <= s < high]:
                del best[start]
        total = sum(best.values())
        return float(np.log1p(total)), 100.0 * total / max(len(words), 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(texts))
        x = np.array([self.features(t or "") for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, with slopes kept at 0 or above."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    free = np.array([True, True, True])
    for _ in range(2):
        w = np.where(free, w, 0.0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = np.array([1e-3, ridge, ridge])
            slope = (x.T @ (y - p) - pull * w)[free]
            curve = (x.T * (p * (1 - p))) @ x + np.diag(pull)
            w[free] += np.linalg.solve(curve[np.ix_(free, free)], slope)
        if (w[1:] >= 0).all():
            break
        free = np.concatenate([[True], w[1:] >= 0])
    return tuple(np.where(free, w, 0.0).tolist())


def fit_lexicon(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train: Column | None = None,
    max_rows: int = 20_000,
    max_terms: int = 2_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Learn terms and weights from about ``max_rows`` labelled rows at most, taken by a hash of the key.

    A term is kept when toxic rows hold it far oftener than clean ones, by chance-proof counts; its weight is the log of that ratio.
    """
    # Labels other than 0 and 1 say nothing.
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, max_rows / max(known.count(), 1))
    sample = known.where(drawn(share, key))
    # At most about max_rows keys: a proven bound for the broadcast. A key may have many rows: one of each text, thinned to the bound.
    met = df.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("_key") == F.col(key))
    met = met.withColumn("_text_key", text_key(F.col("text"))).groupBy("_key", "_text_key").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    met = stored(met, "labelled")
    rows = met.where(drawn(min(1.0, max_rows / max(met.count(), 1)), "_key", "_text_key")).select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS * 4):
                part = batch.slice(first, BLOCK_ROWS * 4)
                seen = (Counter(), Counter())
                for t, y in zip(part["text"].to_pylist(), part["y"].to_pylist()):
                    seen[y].update(candidate_terms(set(fold(t or ""))))
                    seen[y][""] += 1
                terms = sorted(set(seen[0]) | set(seen[1]))
                yield pa.RecordBatch.from_pydict(
                    {"term": terms, "clean": [seen[0][t] for t in terms], "toxic": [seen[1][t] for t in terms]},
                    schema=pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]),
                )

    counted = rows.mapInArrow(count, "term string, clean bigint, toxic bigint")
    counted = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.persist()
    sizes = counted.where(F.col("term") == "").select("clean", "toxic").first()
    n0, n1 = sizes if sizes else (0, 0)
    if not n0 or not n1:
        counted.unpersist()
        return Lexicon({}, exceptions)
    ratio = ((F.col("toxic") + 0.1) / n1) / ((F.col("clean") + 0.1) / n0)
    pooled = (F.col("toxic") + F.col("clean")) / (n0 + n1)
    sigma = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    best = (
        counted.where((F.col("term") != "") & (F.col("toxic") >= max(4, 0.004 * n1)) & (ratio >= 15))
        .orderBy(sigma.desc(), "term")
        .limit(max_terms)
        .select("term", F.log(ratio).alias("weight"))
        .collect()
    )
    counted.unpersist()
    lexicon = Lexicon({r["term"]: float(r["weight"]) for r in best}, exceptions)
    if not lexicon.weights:
        return lexicon

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        x = [lexicon.features(t or "") for t in part["text"].to_pylist()]
        return pa.RecordBatch.from_pydict({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": part["y"]})

    points = np.array(map_blocks(rows, measure, "a double, b double, y int").collect(), dtype=float).reshape(-1, 3)
    lexicon.curve = _logistic(points[:, :2], points[:, 2])
    return lexicon


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Every column of ``df`` and ``score`` (0 to 1). Only for a text column that is still a string."""
    fields = [f for f in df.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = {f.name: part[f.name] for f in fields}
        return pa.RecordBatch.from_pydict(columns | {"score": lexicon.scores(part[text].to_pylist())})

    return map_blocks(df.select(*[F.col(f"`{f.name}`") for f in fields]), work, schema)

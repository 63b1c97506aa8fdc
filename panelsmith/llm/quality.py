"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Hashed words take the indices below ``WORDS``; each statistic then has ``BINS`` of its own, and an empty text one index.
WORDS, BINS = 1 << 14, 24
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"#$%&*|!?<>{}[]()=+/\\~^_@"
_HIGH = bytes(range(128, 256))

#: Statistics of a text; each lies in [0, 1].
STATISTICS = (
    "size", "word_length", "upper", "digits", "marks", "non_ascii", "spaces", "lines", "distinct_words", "repeated_pairs",
    "top_word", "repeated_lines", "repeated_sentences", "marked_words", "long_words", "sentence_length", "size_told",
)
FEATURES = WORDS + BINS * len(STATISTICS) + 1


def statistics(text: str, data: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Structure of a non-empty text; ``n_chars`` is the length its metadata tells."""
    n, w = len(data), len(words)
    without = lambda chars: (n - len(data.translate(None, chars))) / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False))) / (w - 1) if w > 1 else 1.0
    lines, sentences = [x for x in data.split(b"\n") if x], [x for x in data.split(b". ") if x]
    return [
        min(1.0, math.log2(1 + n) / 24),
        min(1.0, (n / w if w else n) / 24),
        without(_UPPER),
        without(_DIGITS),
        without(_MARKS),
        without(_HIGH),
        min(1.0, 2 * without(b" \t\n\r")),
        min(1.0, 40 * data.count(b"\n") / n),
        len(counts) / w if w else 0.0,
        1.0 - pairs,
        max(counts.values()) / w if w else 0.0,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        1.0 - len(set(sentences)) / len(sentences) if sentences else 0.0,
        sum(x[-1] in _MARKS for x in words) / w if w else 0.0,
        float((lengths > 20).mean()) if w else 0.0,
        min(1.0, w / max(1, len(sentences)) / 64),
        0.5 if n_chars is None else min(1.0, abs(n_chars - len(text)) / (1 + len(text))),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words present with equal weights of sum of squares 1, one bin of each statistic."""
    if not text:
        return np.array([FEATURES - 1]), np.ones(1)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    hashed = np.unique(np.fromiter(map(zlib.crc32, [x.lower() for x in words]), dtype=np.int64, count=len(words)) & (WORDS - 1))
    stats = np.array(statistics(text, data, words, n_chars))
    bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)  # finer near 0
    index = np.concatenate([hashed, WORDS + BINS * np.arange(len(stats)) + bins])
    value = np.concatenate([np.full(len(hashed), 1 / math.sqrt(max(1, len(hashed)))), np.full(len(stats), 1 / math.sqrt(len(stats)))])
    return index, value


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        """bias + w.x + sum over pairs <v_i, v_j> x_i x_j, the pairs as half of (sum)^2 - sum of squares."""
        vx = self.factors[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx)))

    def score(self, text: str | None, n_chars: int | None) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.raw(*features(text, n_chars))))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 6, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5) -> FactorisationMachine:
    """Logistic loss by AdaGrad, one row at a time in a fixed shuffled order."""
    rng = np.random.default_rng(7)
    linear, factors = np.zeros(FEATURES), rng.normal(0, 0.05 if rows else 0, (FEATURES, rank))
    g_linear, g_factors = np.full(FEATURES, 1e-6), np.full((FEATURES, rank), 1e-6)
    good = sum(y for _, _, y in rows)
    bias, g_bias = math.log((good + 1) / (len(rows) - good + 1)), 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            v = factors[index]
            vx = v * value[:, None]
            total = vx.sum(axis=0)
            z = bias + linear[index] @ value + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx))
            slope = 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) - y
            g_bias += slope * slope
            bias -= rate * slope / math.sqrt(g_bias)
            d = slope * value + decay * linear[index]
            g_linear[index] += d * d
            linear[index] -= rate * d / np.sqrt(g_linear[index])
            d = slope * value[:, None] * (total - vx) + decay * v
            g_factors[index] += d * d
            factors[index] -= rate * d / np.sqrt(g_factors[index])
    return FactorisationMachine(bias, linear.astype(np.float32), factors.astype(np.float32))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def learn_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> FactorisationMachine:
    """Fit on at most ``most_rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Conflicting labels of an id count as 0 (reject); null labels and ids are not
    learnt from.  Executors make the features; the driver gets those of the bounded
    sample only.  Without labelled rows every score is 0.5.
    """
    target = labels.where(F.col("quality").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").alias("y"))
    sample = target.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("size")).join(F.broadcast(sample), "id")

    def make():
        def fn(text, size, y):
            found = [features(t, s) for t, s in zip(text, size, strict=True)]
            return [[i.astype("<u4").tobytes() for i, _ in found], [v.astype("<f4").tobytes() for _, v in found], y]

        return fn

    made = map_columns(texts.select("text", "size", "y"), make, "i binary, v binary, y int", pa.schema([("i", pa.binary()), ("v", pa.binary()), ("y", pa.int32())]))
    rows = sorted(made.dropDuplicates().orderBy("i", "v", "y").limit(most_rows).collect(), key=lambda r: (zlib.crc32(r.i), bytes(r.i), r.y))
    return fit_machine([(np.frombuffer(r.i, "<u4").astype(np.int64), np.frombuffer(r.v, "<f4").astype(np.float64), r.y) for r in rows])


def score_quality(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """(id, ``score``) of every whole text, one row per input row; 1 is best.

    Inputs are the text and the length told in ``size_col`` (null: unknown).
    Null and empty texts share one feature of their own; repeated rows give
    repeated rows; other columns are not carried.
    """

    def make():
        return lambda ids, texts, sizes: [ids, [machine.score(t, s) for t, s in zip(texts, sizes, strict=True)]]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("size"))
    return map_columns(source, make, "id long, score double", pa.schema([("id", pa.int64()), ("score", pa.float64())])).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, machine: FactorisationMachine, least: float = 0.3, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([machine.score(t, None if s is None or s != s else int(s)) for t, s in zip(texts, sizes, strict=True)], dtype="float64")

    return docs.where(score(F.col(text_col), F.col(size_col).cast("long")) >= least)

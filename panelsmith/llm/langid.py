"""Language identification by string kernels: n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

GRAMS, DIMENSIONS = (1, 2, 3), 1 << 13
UNKNOWN = "und"
#: Code points from which a text says enough to be told from all learnt languages.
LONG_ENOUGH = 100
#: An n-gram is familiar if at least this share of the learnt rows has it.
FAMILIAR = 0.01
#: A long text may have FLOOR_SLACK times the unfamiliar n-grams that all but FLOOR_QUANTILE of a language's texts stay below.
FLOOR_SLACK, FLOOR_QUANTILE, FLOOR_ROWS = 1.5, 0.001, 50
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which (hashed) n-grams of code points, n from 1 to 3, occur in a lower-cased text; its blended spectrum as a 0/1 vector."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen = np.zeros(DIMENSIONS, dtype=bool)
    for s in range(0, len(points), 1 << 18):
        p = points[max(0, s - 2) : s + (1 << 18)]
        h = np.zeros(len(p), dtype=np.uint32)
        for n in GRAMS:
            if len(p) < n:
                break
            h = (h[: len(p) - n + 1] ^ p[n - 1 :]) * np.uint32(_MULTIPLIERS[n - 1])
            h ^= h >> np.uint32(15)
            seen[h >> np.uint32(19)] = True
    return seen


def presence_matrix(texts: list[str]) -> np.ndarray:
    """Rows scaled to length 1, so that products of rows are the normalised presence kernel."""
    m = np.stack([presence(t) for t in texts]).astype(np.float32)
    return m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))


def familiar_share(bits: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each row's n-grams, the share that is common."""
    return (bits & common).sum(axis=1) / np.maximum(bits.sum(axis=1), 1)


@dataclass(frozen=True)
class KernelRidge:
    """Landmarks, Nystrom map and weights, multiplied out to one column of n-gram weights for each language.

    The kernel is linear in the presence vector, so K(x, landmarks) @ whitening @
    weights = x @ (landmarks.T @ whitening @ weights), and a batch is scored by one product.
    """

    languages: tuple[str, ...]
    columns: np.ndarray
    bias: np.ndarray
    #: N-grams that a good many of the learnt rows have, and for each language the share of familiar n-grams below which a
    #: long text is in none of them; empty: not measured.
    common: np.ndarray | None = None
    floors: tuple[float, ...] = ()

    def explains(self, texts: list[str | None]) -> list[bool]:
        """Whether a text may be in a learnt language: false for texts without a letter, and for long ones with too few familiar n-grams."""
        found = [has_letter(t) for t in texts]
        rows = [i for i, t in enumerate(texts) if found[i] and self.floors and len(t) >= LONG_ENOUGH]
        if rows:
            bits = np.stack([presence(texts[i]) for i in rows])
            best = (bits.astype(np.float32) / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1)) @ self.columns + self.bias).argmax(axis=1)
            for i, b, share in zip(rows, best, familiar_share(bits, self.common), strict=True):
                found[i] = bool(share >= self.floors[b])
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        return presence_matrix(texts) @ self.columns + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; score: the two best outputs' share, 0.5 for a tie, 1 for a clear case."""
        names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows and self.languages:
            out = self.scores([texts[i] for i in rows])
            best = out.argmax(axis=1)
            top = out[np.arange(len(rows)), best]
            out[np.arange(len(rows)), best] = -np.inf
            margin = top - out.max(axis=1) if len(self.languages) > 1 else np.ones(len(rows))
            for i, b, m in zip(rows, best, margin, strict=True):
                names[i], values[i] = self.languages[b], float(min(1.0, 0.5 + m / 2))
        return names, values


def fit_ridge(bits: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 0.05) -> KernelRidge:
    """``bits``: presence vectors of the training rows.  Landmarks are taken evenly from the languages, in row order."""
    if not langs:
        return KernelRidge((), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0, np.float32))
    phi = bits.astype(np.float32)
    phi /= np.sqrt(np.maximum(phi.sum(axis=1, keepdims=True), 1))
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs])
    place = np.zeros(len(of), dtype=np.int64)  # a row's number within its language
    for c in range(len(names)):
        place[of == c] = np.arange((of == c).sum())
    chosen = np.lexsort((of, place))[:landmarks]
    base = phi[chosen]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whitening = vectors[:, keep] / np.sqrt(values[keep])
    z = (phi @ base.T).astype(np.float64) @ whitening
    y = np.where(of[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    share = np.bincount(of, minlength=len(names)) / len(of)
    weight = (1 / share / len(names))[of][:, None]  # each language counts alike
    mean = (z * weight).sum(axis=0) / weight.sum()
    bias = (y * weight).sum(axis=0) / weight.sum()
    zc, yc = z - mean, y - bias
    solved = np.linalg.solve(zc.T @ (weight * zc) + ridge * np.eye(zc.shape[1]), zc.T @ (weight * yc))
    return KernelRidge(tuple(names), (base.T.astype(np.float64) @ whitening @ solved).astype(np.float32), (bias - mean @ solved).astype(np.float32))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(True))


def learn_languages(docs: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = 256) -> KernelRidge:
    """Fit on at most ``most_rows`` rows with a language and a letter outside the held-out fold, chosen by a hash of the id.

    Executors make the presence vectors; the driver gets those of the sample only.  Without such rows no language is learnt.
    """
    bits, langs, _ = _learnable(docs, most_rows, id_col, text_col, lang_col)
    return fit_ridge(bits, langs, landmarks)


def learn_with_floors(docs: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = 256) -> KernelRidge:
    """``learn_languages`` with the share of familiar n-grams below which a long text is in none of the languages.

    It is measured for each language on sampled rows that did not make the n-grams familiar: half of them do, the others
    are measured, and the other way round.  A language with fewer than FLOOR_ROWS long rows gets no floor.
    """
    bits, langs, sizes = _learnable(docs, most_rows, id_col, text_col, lang_col)
    model = fit_ridge(bits, langs, landmarks)
    if not model.languages:
        return model
    bits, of, odd = bits.astype(bool), np.array(langs), np.arange(len(langs)) % 2 == 1
    share = np.ones(len(langs))
    for fold in (odd, ~odd):
        if fold.any():
            share[~fold] = familiar_share(bits[~fold], bits[fold].mean(axis=0) >= FAMILIAR)
    floors = []
    for name in model.languages:
        own = share[(of == name) & (sizes >= LONG_ENOUGH)]
        floors.append(1 - FLOOR_SLACK * (1 - float(np.quantile(own, FLOOR_QUANTILE))) if len(own) >= FLOOR_ROWS else -np.inf)
    return replace(model, common=bits.mean(axis=0) >= FAMILIAR, floors=tuple(floors))


def _learnable(docs: DataFrame, most_rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Presence vectors, languages and lengths of the sampled rows, in the order they were drawn."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~held_out(F.col(id_col)))
    keys = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"))
    drawn = keys.withColumn("draw", F.xxhash64("id", "lang"))
    sample = drawn.orderBy("draw", "id", "lang").limit(most_rows)
    texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(sample.distinct()), ["id", "lang"])

    def make():
        return lambda text, lang, draw: [[np.packbits(presence(t)).tobytes() for t in text], lang, draw, [len(t) for t in text]]

    arrow = pa.schema([("bits", pa.binary()), ("lang", pa.string()), ("draw", pa.int64()), ("size", pa.int64())])
    made = map_columns(texts.select("text", "lang", "draw"), make, "bits binary, lang string, draw long, size long", arrow)
    got = made.orderBy("draw", "lang", "bits", "size").limit(most_rows).collect()
    bits = np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), axis=1) if got else np.zeros((0, DIMENSIONS), np.uint8)
    return bits, [r.lang for r in got], np.array([r.size for r in got], dtype=np.int64)


def predict_languages(docs: DataFrame, model: KernelRidge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``) of every whole text, one row per input row.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows
    give repeated rows; other columns are not carried.
    """

    def make():
        return lambda ids, texts: [ids, *model.predict(texts)]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    arrow = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return map_columns(source, make, "id long, lang_pred string, score double", arrow).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: KernelRidge, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that may be in a language of the model, with all their columns.

    Null texts and texts without a letter go, and so do texts of at least LONG_ENOUGH code points with fewer familiar n-grams
    than the floor of their best language: other scripts and languages, random letters.  Texts in several learnt languages
    are familiar and stay.  Shorter texts say too little to be refused and stay.  A model without languages can refuse nothing: all rows stay.  Repeated rows are treated alike.
    """
    if not model.languages:
        return docs

    @F.pandas_udf("boolean")
    def explained(texts: pd.Series) -> pd.Series:
        found: list[bool] = []
        for s in range(0, len(texts), 256):
            found += model.explains(texts.iloc[s : s + 256].tolist())
        return pd.Series(found, dtype="bool")

    return docs.where(explained(F.col(text_col)))

"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .simhash import spanning_links


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for two points ``distance`` apart (Datar et al.)."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2)) / 2
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class StableHash:
    """``tables`` keys of ``projections`` quantised Gaussian projections each."""

    projections: int
    tables: int
    width: float
    seed: int = 11
    drawn: dict = field(default_factory=dict, compare=False)

    @classmethod
    def for_rows(cls, rows: int, least: float, recall: float, strangers: float, width: float = 2.0) -> "StableHash":
        """As many projections as leave about ``strangers`` unrelated vectors in a bucket, as many tables as find a
        pair at the threshold with chance ``recall``; unrelated means at right angles."""
        near, far = collision(math.sqrt(2 - 2 * least), width), collision(math.sqrt(2), width)
        k = max(1, math.ceil(math.log(max(1.0, rows / strangers)) / -math.log(far)))
        return cls(k, math.ceil(math.log(1 - recall) / math.log(1 - near**k)), width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit key a row and table."""
        n = unit.shape[1]
        if n not in self.drawn:
            rng = np.random.default_rng((self.seed, n))
            m = self.projections * self.tables
            self.drawn[n] = rng.normal(size=(n, m)), rng.uniform(0, self.width, m), rng.integers(1, 1 << 62, self.projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        direction, shift, odd = self.drawn[n]
        cells = np.floor((unit @ direction + shift) / self.width).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.projections)
        mixed = (cells * odd).sum(axis=2, dtype=np.uint64) + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(``id``, ``v``): the components as bytes of ``kind``; null for vectors that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                x = np.array(v.as_py(), dtype=np.float64) if v.is_valid else np.zeros(0)
                norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
                out.append((x + 0.0).astype(kind).tobytes() if 0 < norm < np.inf else None)
            yield pa.record_batch({"id": batch.column("id"), "v": pa.array(out, pa.binary())})

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")


def unit_rows(column: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype=kind).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class BucketSearch:
    """Compares the rows of one group; holds at most two blocks of a bucket.

    A pair that shares several buckets counts in that of its first table only,
    so sums over groups count each linked pair once without listing pairs.
    """

    STEP = 512

    def __init__(self, least: float):
        self.least = least

    def compare(self, table: int, one_block: bool, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, keys: np.ndarray, unit: np.ndarray):
        """(links of each row, weighted by copies; linking edges a, b)."""
        n, links = len(ids), np.zeros(len(ids), dtype=np.int64)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for s in range(0, n, self.STEP):
            i, j = np.nonzero(unit[s : s + self.STEP] @ unit.T >= self.least)
            i += s
            chosen = (i < j) & (one_block | (side[i] != side[j]))
            i, j = i[chosen], j[chosen]
            for t in range(table):
                other = keys[i, t] != keys[j, t]
                i, j = i[other], j[other]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                a, b = spanning_links(np.concatenate([a, ids[i]]), np.concatenate([b, ids[j]]))
        return links, a, b


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.97, strangers: float = 8.0, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: (id, ``n_links``, ``component_id``, ``kept``).

    Vectors with a cosine of at least ``least`` are linked, checked in double
    precision; none below it is.  Normalised vectors are hashed to several
    tables, sized so that a pair just at the threshold is found with chance
    ``recall`` and closer pairs with more.  Equal vectors always link: they are compared once and
    counted as often as they occur.  A bucket of more than ``block_rows`` vectors
    is cut into blocks, and every pair of blocks is a group of its own, so
    nothing is dropped and no task holds more than two blocks.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different lengths don't either.  ``n_links`` counts
    other rows linked directly; ``component_id`` is the smallest id reachable, and
    ``kept`` tells whether it is the row's own.  Other columns are not carried.
    """
    # Single-precision components travel as such; all arithmetic is in double precision.
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    known = materialise(usable_vectors(vectors, id_col, vector_col, kind), "vectors")
    groups = materialise(known.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "groups")
    hashing = StableHash.for_rows(groups.count(), least, recall, strangers)

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in _keyed(batches, hashing, kind):
            n, tables = keys.shape
            yield pa.record_batch({"t": pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), "key": pa.array(keys.ravel())})

    sizes = groups.select("v").mapInArrow(light, "t int, key long").groupBy("t", "key").agg(F.count("*").alias("n"))
    crowded = materialise(sizes.where(F.col("n") > block_rows).select("t", "key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "crowded")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in _keyed(batches, hashing, kind):
            n, tables = keys.shape
            rows = pa.array(np.repeat(np.arange(n), tables))
            own = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.record_batch({
                "t": pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), "key": pa.array(keys.ravel()),
                "rep": batch.column("rep").take(rows), "copies": batch.column("copies").take(rows), "keys": own.take(rows), "v": batch.column("v").take(rows),
            })

    placed = groups.mapInArrow(place, "t int, key long, rep long, copies long, keys binary, v binary").join(crowded, ["t", "key"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cut = placed.select("*", mine.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cut = cut.select("t", "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rep", "copies", "keys", "v")
    where = ["t", "key", "low", "high"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = BucketSearch(least)
        for part in _whole_groups(batches, where):
            bounds = _bounds(part, where)
            ids, copies, side = (part.column(c).to_numpy() for c in ("rep", "copies", "side"))
            keys, vectors = part.column("keys").to_pylist(), part.column("v").to_pylist()
            tables, same = part.column("t").to_numpy(), part.column("low").to_numpy() == part.column("high").to_numpy()
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    own = np.frombuffer(b"".join(keys[s:e]), dtype=np.int64).reshape(e - s, -1)
                    links, a, b = finder.compare(int(tables[s]), bool(same[s]), ids[s:e], copies[s:e], side[s:e], own, unit_rows(vectors[s:e], kind))
                    linked = links > 0
                    out.append((ids[s:e][linked], links[linked], ids[s:e][linked]))
                    out.append((a, np.zeros(len(a), np.int64), b))
            if out:
                a, n, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch({"a": pa.array(a), "n": pa.array(n), "b": pa.array(b)})

    found = materialise(cut.repartition(*where).sortWithinPartitions(*where).mapInArrow(search, "a long, n long, b long"), "found")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("a", "b")).select(F.col("node").alias("rep"), "root")
    classes = groups.join(links.hint("merge"), "rep", "left").join(roots.hint("merge"), "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    result = known.join(classes.hint("merge"), "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _keyed(batches: Iterator[pa.RecordBatch], hashing: StableHash, kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most 1024 rows with their keys; vectors of each length are hashed together."""
    for whole in batches:
        for s in range(0, whole.num_rows, 1024):
            batch = whole.slice(s, 1024)
            raw = batch.column("v").to_pylist()
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            keys = np.zeros((len(raw), hashing.tables), dtype=np.int64)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                keys[rows] = hashing.keys(unit_rows([raw[r] for r in rows], kind))
            yield batch, keys


def _bounds(part: pa.RecordBatch, where: list[str]) -> list[int]:
    """Where groups of equal ``where`` begin in sorted rows, and the end."""
    changes = np.zeros(max(0, part.num_rows - 1), dtype=bool)
    for c in where:
        x = part.column(c).to_numpy()
        changes |= x[1:] != x[:-1]
    return [0, *(np.flatnonzero(changes) + 1).tolist(), part.num_rows] if part.num_rows else [0]


def _whole_groups(batches: Iterator[pa.RecordBatch], where: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition cut between groups only; holds what is left of one batch and one group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = _bounds(batch, where)
        joined = rest and all(rest[-1].column(c)[-1] == batch.column(c)[0] for c in where)
        first = bounds[1] if joined else 0
        if len(bounds) == 2 and joined:
            rest.append(batch)
            continue
        if rest:
            yield pa.concat_batches([*rest, batch.slice(0, first)])
        yield batch.slice(first, bounds[-2] - first)
        rest = [batch.slice(bounds[-2])]
    if rest:
        yield pa.concat_batches(rest)

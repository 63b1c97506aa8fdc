"""SimHash near-duplicates: 64-bit fingerprints, and vantage-point trees that find all pairs within a few bits."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_columns, materialise
from .components import connected_components

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a text in order, repeats included; of a text of fewer words, of all its words; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(tokens)
    size = min(shingle, len(tokens))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first))


def simhash_bits(hashes: np.ndarray, words: int = 1) -> bytes:
    """SimHash of 64-bit hashes in ``words`` * 64 bits, most significant byte first: a bit is 1 if set in over half of them.

    The first 64 bits are those of the hashes; further ones are mixed from them.
    """
    ones = np.zeros((words, BITS), dtype=np.int64)
    for s in range(0, len(hashes), 1 << 14):
        h = hashes[s : s + (1 << 14)]
        for w in range(words):
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).astype(">u8").tobytes()


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> bytes:
    """``simhash_bits`` of the shingles of a text.

    A-Z are lower-cased, words stand between ASCII blanks, repeated shingles
    count; a text of fewer words is one shingle, one without words has only 0 bits.
    """
    return simhash_bits(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """(``id``, ``fp`` binary); null and blank texts have 0 bits only."""

    def make():
        return lambda ids, texts: [ids, [fingerprint(t, shingle, words) for t in texts]]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_columns(source, make, "id long, fp binary", pa.schema([("id", pa.int64()), ("fp", pa.binary())]))


#: Words of 64 bits of the fingerprint of a set of shingles.
SET_WORDS = 16
#: Two sets of Jaccard similarity J and equal size differ in a share acos(2 J / (1 + J)) / pi of the bits: at 0.8 in 155 of 1024, with a
#: standard deviation of 11.5.  212 is five of them more; of pairs at 0.5 (274 bits) one in 100,000 is as near.
NEAR_BITS = 212
#: Smaller sets have fingerprints that spread wider and are compared as sets at once.
LEAST_SHINGLES = 64


#: Candidates by sets come from one tree for each of so many runs of fingerprint bits that a pair is within SET_REACH bits in one of them.
#: Of the pairs at 0.8 those of four and five shingles differ most, in a share 3 / 16 of the bits; of them LOST agree in none.
SET_REACH, SET_DIFFERENCE, LOST = 1, 3 / 16, 5e-6
#: Bits of a run: at least, at most, and otherwise one a level of the trees.
LEAST_WIDTH, MOST_WIDTH = 5, 14
#: Last words of a set's fingerprint, by which candidates are told where they meet, and the bits that may differ there: of pairs of
#: four and five shingles (48 bits on average) 10 in a million differ in more, of unrelated pairs (128) none are as near.
MET_WORDS, MET_BITS = 4, 75
#: Sets at home in a shard of these trees, on average, and those beyond which it is cut into blocks.
SET_SHARD_ROWS, SET_BLOCK_ROWS = 1 << 13, 1 << 15


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(``id``, ``text``, ``fp`` binary, ``size``, ``bits`` binary, ``keys`` binary) of each row's distinct shingles.

    ``fp`` is a 128-bit hash of the set, the same for texts with the same shingles however often each is
    repeated; ``size`` is the number of shingles, ``bits`` their SimHash in SET_WORDS words, ``keys`` the same, as ``candidate_links`` takes it.
    """

    def make():
        def rows(ids, texts):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            return [ids, texts, [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [len(x) for x in sets], [simhash_bits(x, SET_WORDS) for x in sets]]

        return rows

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow = pa.schema([("id", pa.int64()), ("text", pa.string()), ("fp", pa.binary()), ("size", pa.int64()), ("bits", pa.binary())])
    return map_columns(source, make, "id long, text string, fp binary, size long, bits binary", arrow).withColumn("keys", F.col("bits"))


def as_words(column: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit words, a row for each fingerprint."""
    return np.frombuffer(b"".join(column), dtype=">u8").astype(np.uint64).reshape(len(column), -1)


@dataclass(frozen=True)
class VantageTree:
    """One tree over ``width`` bits of a word from ``shift``: a vantage point and a radius for each level.

    The nodes of a level share the vantage point.  ``reach`` is how far the bits
    of this run may differ for a pair that this tree is to find.
    """

    word: int
    shift: int
    width: int
    reach: int
    points: tuple[int, ...] = ()
    radii: tuple[int, ...] = ()

    def own(self, fps: np.ndarray) -> np.ndarray:
        return (fps[:, self.word] >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def home(self, own: np.ndarray) -> np.ndarray:
        """The shard of each run of bits: the sides of the radii on which it lies."""
        home = np.zeros(own.shape, dtype=np.int64)
        for level, (point, radius) in enumerate(zip(self.points, self.radii, strict=True)):
            home |= (np.bitwise_count(own ^ np.uint64(point)) > radius).astype(np.int64) << level
        return home

    def visit(self, fps: np.ndarray, one_way: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, whether it is the row's home) of every shard that may hold a partner.

        A branch is pruned when the triangle bound keeps the ball of ``reach``
        around the row on the other side of the node's radius.

        ``one_way`` leaves to the partner what it sees as well: of two rows with
        different homes, the one inside the radius that first parts them visits the
        other.  It also prunes shards that the bounds of single levels let pass,
        but no point of a ball of 1 bit reaches.
        """
        rows, shards = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        home = np.zeros(len(fps), dtype=np.int64)
        if self.points:
            d = np.bitwise_count(self.own(fps)[:, None] ^ np.array(self.points, dtype=np.uint64)[None, :]).astype(np.int16)
            for level, radius in enumerate(self.radii):
                home |= (d[:, level] > radius).astype(np.int64) << level
                here = d[rows, level]
                near, far = here - self.reach <= radius, here + self.reach > radius
                rows, shards = np.concatenate([rows[near], rows[far]]), np.concatenate([shards[near], shards[far] | (1 << level)])
        if one_way:
            apart = home[rows] ^ shards
            keep = (apart & -apart & home[rows]) == 0
            rows, shards = rows[keep], shards[keep]
            if self.reach == 1:
                own = self.own(fps)
                reached = np.stack([home, *(self.home(own ^ np.uint64(1 << b)) for b in range(self.width))], axis=1)
                keep = (reached[rows] == shards[:, None]).any(axis=1)
                rows, shards = rows[keep], shards[keep]
        return rows, shards, home[rows] == shards


def fit_trees(sample: np.ndarray, levels: int, words: int, runs: int, reach: int, candidates: int = 192, width: int | None = None) -> list[VantageTree]:
    """One tree for each of ``runs`` equal runs of bits, or of the first ``runs`` of ``width`` bits, none of them across words.

    Vantage points come from the sample; taken are those whose median shell few
    balls cross, and whose sides tell most beside the levels before.  The sample
    decides balance only, never what is found.
    """
    width, trees = width or words * BITS // runs, []
    for run in range(runs):
        tree = VantageTree(run // (BITS // width), run % (BITS // width) * width, width, reach)
        if levels and len(sample):
            own = tree.own(sample)
            points = np.unique(own[:candidates])
            d = np.bitwise_count(points[:, None] ^ own[None, :]).astype(np.int16)
            medians = np.median(d, axis=1).astype(np.int16)[:, None]
            side = np.where(d > medians, 1.0, -1.0)
            cost = ((d > medians - reach) & (d <= medians + reach)).mean(axis=1) + np.abs(side.mean(axis=1))
            chosen: list[int] = []
            for _ in range(min(levels, len(points))):
                best = int(np.argmin(cost))
                chosen.append(best)
                cost = cost + np.abs(side @ side[best]) / side.shape[1]
                cost[best] = np.inf
            tree = replace(tree, points=tuple(int(points[i]) for i in chosen), radii=tuple(int(medians[i, 0]) for i in chosen))
        trees.append(tree)
    return trees


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node to the smallest node of its component; as connected as (a, b), one link a node at most."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def _links_in_shard(radius: int, ratio: float = 0.0):
    """Links that connect a shard's questions with the rows at home there within ``radius`` bits, and of sizes in a ratio of at least ``ratio``."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        if ratio:
            part = part.sort_values("size", kind="stable")
        fps, nodes = as_words(part["fp"].tolist()), part["node"].to_numpy()
        sizes = part["size"].to_numpy() if ratio else np.zeros(len(part), np.int64)
        asking, holding = part["asks"].to_numpy(), part["holds"].to_numpy()
        asks, holds, ask_nodes, hold_nodes, ask_sizes, hold_sizes = fps[asking], fps[holding], nodes[asking], nodes[holding], sizes[asking], sizes[holding]
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(1, (1 << (17 if ratio else 20)) // max(1, len(holds)))
        for s in range(0, len(asks), step):
            if ratio:
                least, most = ask_sizes[s] * ratio - 1e-6, ask_sizes[s : s + step][-1] / ratio + 1e-6
                start, stop = np.searchsorted(hold_sizes, least), np.searchsorted(hold_sizes, most, "right")
            else:
                start, stop = 0, len(holds)
            apart = np.zeros((len(asks[s : s + step]), stop - start), dtype=np.uint16)
            for w in range(fps.shape[1]):
                apart += np.bitwise_count(asks[s : s + step, None, w] ^ holds[None, start:stop, w])
            i, j = np.nonzero(apart <= radius)
            x, y = ask_nodes[s + i], hold_nodes[start + j]
            other = x != y
            if ratio:
                p, q = ask_sizes[s + i], hold_sizes[start + j]
                other &= np.minimum(p, q) >= ratio * np.maximum(p, q) - 1e-6
            if other.any():
                a, b = spanning_links(np.concatenate([a, x[other]]), np.concatenate([b, y[other]]))
        return pd.DataFrame({"a": a, "b": b})

    return search


def near_links(
    fps: DataFrame, radius: int = 3, words: int = 1, runs: int = 2, reach: int | None = None, shard_rows: int = 256, block_rows: int = 2048, sample_rows: int = 4096
) -> DataFrame:
    """Links (``a``, ``b``) between ``node``s that connect all fingerprints ``fp`` within ``radius`` bits, not every pair of them.

    ``fps`` holds distinct fingerprints; pass a written table.  The trees' triangle
    bounds send each fingerprint to its home shard and as a question to every
    shard its ball overlaps; a shard's questions are compared, over all bits, with the
    fingerprints at home there.  A pair within ``radius`` is within radius // runs
    in one run at least, so that ``reach``, the default, finds all; a smaller one
    finds pairs that agree better in some run.  A shard with more than
    ``block_rows`` at home, or 16 times as many questions, is cut into blocks by a hash, and every block of
    questions meets every block of homes, so that no task holds more than one of
    each.  ``sample_rows`` bounds the sample the vantage points come from.
    """
    sample, levels = _sample_and_levels(fps, words, shard_rows, sample_rows)
    trees = fit_trees(sample, levels, words, runs, radius // runs if reach is None else reach)
    return _links_of_trees(fps, trees, _links_in_shard(radius), block_rows)


def candidate_links(groups: DataFrame, jaccard: float = 0.8, sample_rows: int = 4096) -> DataFrame:
    """Links (``a``, ``b``) between ``node``s that connect the sets whose SimHash fingerprints ``keys`` are near, found by vantage-point trees.

    A tree stands over each of the first runs of bits, as many runs as let all but LOST of the
    pairs at 0.8 be within SET_REACH bits in one of them; bounds, shards and blocks are those of ``near_links``, but of two sets
    only one visits the other.  Sets that meet are linked if their last MET_WORDS words differ in at most MET_BITS bits
    and, where ``groups`` has their ``size``, sizes allow a similarity of ``jaccard``.  Pass a written table.
    """
    sample, levels = _sample_and_levels(groups.select(F.col("keys").alias("fp")), SET_WORDS, SET_SHARD_ROWS, sample_rows)
    width = min(MOST_WIDTH, max(LEAST_WIDTH, levels))
    same = 1 - SET_DIFFERENCE
    found = sum(math.comb(width, d) * SET_DIFFERENCE**d * same ** (width - d) for d in range(SET_REACH + 1))
    trees = fit_trees(sample, levels, SET_WORDS, math.ceil(math.log(LOST) / math.log(1 - found)), SET_REACH, width=width)
    sized = "size" in groups.columns
    fps = groups.select("node", F.col("keys").alias("fp"), *(["size"] if sized else []))
    return _links_of_trees(fps, trees, _links_in_shard(MET_BITS, jaccard if sized else 0.0), SET_BLOCK_ROWS, one_way=True, shown=8 * MET_WORDS)


def _sample_and_levels(fps: DataFrame, words: int, shard_rows: int, sample_rows: int) -> tuple[np.ndarray, int]:
    """Fingerprints to take vantage points from, and the levels that leave ``shard_rows`` in a shard."""
    n = fps.count()
    sample = as_words([bytes(r.fp) for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()] or [bytes(8 * words)])
    return sample, max(0, math.ceil(math.log2(max(1, n) / shard_rows)))


def _links_of_trees(fps: DataFrame, trees: list[VantageTree], search, block_rows: int, one_way: bool = False, shown: int | None = None) -> DataFrame:
    """``search`` in every shard of the trees, on the last ``shown`` bytes of ``fp`` (all by default), ``node`` and further columns."""
    others_of = [f for f in fps.schema.fields if f.name not in ("node", "fp")]
    carried = [f.name for f in others_of]

    def place(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                whole = part.column("fp").to_pylist()
                fp = as_words(whole)
                kept = pa.array([x[-shown:] for x in whole] if shown else whole, pa.binary())
                for t, tree in enumerate(trees):
                    rows, shard, home = tree.visit(fp, one_way)
                    yield pa.record_batch({
                        "tree": pa.array(np.full(len(rows), t, np.int32)), "shard": pa.array(shard), "home": pa.array(home),
                        "node": part.column("node").take(pa.array(rows)), "fp": kept.take(pa.array(rows)), **{c: part.column(c).take(pa.array(rows)) for c in carried},
                    })

    schema = ", ".join(["tree int, shard long, home boolean, node long, fp binary", *(f"{f.name} {f.dataType.simpleString()}" for f in others_of)])
    placed = fps.select("node", "fp", *carried).mapInArrow(place, schema)
    sizes = placed.groupBy("tree", "shard").agg(F.sum(F.col("home").cast("long")).alias("held"), F.count("*").alias("asked"))
    crowded = materialise(
        sizes.where((F.col("held") > block_rows) | (F.col("asked") > 16 * block_rows))
        .select("tree", "shard", F.ceil(F.col("held") / block_rows).cast("int").alias("h"), F.ceil(F.col("asked") / (16 * block_rows)).cast("int").alias("a")), "crowded"
    )
    salt = F.xxhash64(F.col("node"), F.lit(1))
    cut = placed.join(crowded, ["tree", "shard"], "left").withColumns({"holders": F.greatest(F.lit(1), "h"), "askers": F.greatest(F.lit(1), "a")})
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = (F.col("holders") == 1) & (F.col("askers") == 1)
    asks = cut.select("tree", "shard", F.pmod(salt, F.col("askers")).cast("int").alias("asker"), others("holders").alias("holder"), "node", "fp", *carried, F.lit(True).alias("asks"), (F.col("home") & whole).alias("holds"))
    holds = cut.where(F.col("home") & ~whole).select("tree", "shard", others("askers").alias("asker"), F.pmod(salt, F.col("holders")).cast("int").alias("holder"), "node", "fp", *carried, F.lit(False).alias("asks"), F.lit(True).alias("holds"))
    return asks.union(holds).groupBy("tree", "shard", "asker", "holder").applyInPandas(search, "a long, b long")


class _Block:
    """Sets of a component: those of one block, or of two whose halves are compared with each other only."""

    def __init__(self, part: pa.Table):
        self.nodes, self.sizes, self.half = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "half"))
        self.bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(len(self.nodes), -1)
        self.between = part.column("low")[0].as_py() != part.column("high")[0].as_py()
        self.label = np.arange(len(self.nodes))

    def open_to(self, i: int, jaccard: float) -> np.ndarray:
        """Later sets not yet connected to ``i`` that sizes and fingerprints allow to be as similar as ``jaccard``."""
        wanted = self.label != self.label[i]
        wanted[: i + 1] = False
        if self.between:
            wanted &= self.half != self.half[i]
        at = np.flatnonzero(wanted)
        sizes, own = self.sizes[at], self.sizes[i]
        at = at[(sizes >= jaccard * own - 1e-6) & (own >= jaccard * sizes - 1e-6)]
        if own < LEAST_SHINGLES or not len(at):
            return at
        apart = np.bitwise_count(self.bits[at] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        return at[(apart <= NEAR_BITS) | (self.sizes[at] < LEAST_SHINGLES)]

    def connect(self, i: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Links from ``i`` to one of each newly connected class."""
        labels, first = np.unique(self.label[found], return_index=True)
        self.label[np.isin(self.label, labels)] = self.label[i]
        return [(int(self.nodes[i]), int(self.nodes[j])) for j in found[first]]


def _allowed_links(part: pa.Table, jaccard: float) -> list[tuple[int, int]]:
    block = _Block(part)
    return [link for i in range(len(block.nodes)) if len(found := block.open_to(i, jaccard)) for link in block.connect(i, found)]


def _similar_links(part: pa.Table, jaccard: float) -> list[tuple[int, int]]:
    """Links that connect all sets of the block, or of its two halves, with a similarity of ``jaccard``; exact on the hashed shingles."""
    block, links = _Block(part), []
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("shingles").to_pylist()]
    for i, own in enumerate(sets):
        similar = []
        for j in block.open_to(i, jaccard):
            shared = np.intersect1d(own, sets[j], assume_unique=True).size
            if shared >= jaccard * (len(own) + len(sets[j]) - shared) - 1e-9 if len(own) else not len(sets[j]):
                similar.append(j)
        if similar:
            links += block.connect(i, np.array(similar))
    return links


def _links_in_groups(rows: DataFrame, work, jaccard: float) -> DataFrame:
    """``work`` on every (``root``, ``low``, ``high``) of ``rows``, which stream by sorted; links (``a``, ``b``)."""
    by = ["root", "low", "high"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            links = work(pa.Table.from_batches(held), jaccard)
            return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in by])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), n]
            for start, stop in pairwise(cuts):
                if held and [held[-1].column(c)[0].as_py() for c in by] != keys[:, start].tolist():
                    yield done()
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield done()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _in_blocks(roots: DataFrame, most: dict[str, int]) -> DataFrame:
    """Each set of a component in every pair of blocks that its own block has a part in: ``low``, ``high`` and which ``half`` it is."""
    parts = F.ceil(F.array_max(F.array(*[F.sum(F.lit(1) if c == "*" else F.col(c)) / n for c, n in most.items()]))).cast("int")
    sized = roots.join(materialise(roots.groupBy("root").agg(parts.alias("parts")), "parts").hint("merge"), "root")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "half": F.col("own") <= F.col("other")}).drop("own", "other", "parts")


def similar_links(known: DataFrame, groups: DataFrame, candidates: DataFrame, shingle: int, jaccard: float, block_rows: int = 256, block_shingles: int = 1 << 19) -> DataFrame:
    """Links (``a``, ``b``) between ``node``s that connect all pairs of sets with a Jaccard similarity of ``jaccard`` that ``candidates`` connect.

    Candidates only say which sets may be similar.  Those whose sizes and 1024-bit fingerprints forbid it are told apart first, on
    rows of some 150 bytes; sets with a boilerplate in common fall apart here.  What stays connected is compared exactly: texts are
    shingled again, pairs that a fingerprint forbids or that are connected already are not compared.  ``known``
    has the texts by ``row``, ``groups`` the ``size`` and ``bits`` by ``node``, the row that stands for a set; pass written tables.
    A component is cut into blocks by a hash and every block meets every other, at most ``block_rows`` sets (twice as many where
    only fingerprints are compared) or ``block_shingles`` shingles each on average.
    """
    shown = groups.select("node", "size", "bits")
    loose = materialise(connected_components(candidates).join(shown.hint("merge"), "node"), "loose")
    allowed = materialise(_links_in_groups(_in_blocks(loose, {"*": 2 * block_rows}), _allowed_links, jaccard), "allowed")
    tight = materialise(connected_components(allowed).join(shown.hint("merge"), "node"), "tight")

    def make():
        return lambda *columns: [*columns[:-1], [np.unique(shingle_hashes(t, shingle)).tobytes() for t in columns[-1]]]

    texts = tight.join(known.select(F.col("row").alias("node"), "text").hint("merge"), "node").select("node", "root", "size", "bits", "text")
    arrow = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("shingles", pa.binary())])
    sets = materialise(map_columns(texts, make, "node long, root long, size long, bits binary, shingles binary", arrow), "shingles")
    return _links_in_groups(_in_blocks(sets, {"*": block_rows, "size": block_shingles}), _similar_links, jaccard)


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, words: int = 1, runs: int = 2, reach: int | None = None,
    jaccard: float | None = None,
) -> DataFrame:
    """One row per input row: (id, ``fingerprint`` in hexadecimal, ``component_id``).

    Documents whose fingerprints of ``words`` * 64 bits differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable over links, the row's own
    included.  Equal texts share a fingerprint, so copies are compared once.
    Null, empty and blank texts have only 0 bits and are linked like any
    other; repeated rows give repeated rows; a null id takes part, but is a
    component's id only where no other is; other columns are not carried.

    With ``jaccard``, documents are linked whose sets of distinct shingles have at least that Jaccard
    similarity: the sets' own SimHash fingerprints, searched through vantage-point trees (``candidate_links``), tell candidates, which are then
    compared exactly; ``radius``, ``words``, ``runs`` and ``reach`` have no part in it, and ``fingerprint`` is a 128-bit hash of the set.  Texts without words are linked with each other.
    """
    if jaccard is None:
        known = materialise(fingerprints(docs, id_col, text_col, shingle, words), "fingerprints")
        groups = materialise(known.groupBy("fp").agg(F.min("id").alias("least_id")).withColumn("node", F.monotonically_increasing_id()), "groups")
        links = near_links(groups, radius, words, runs, reach)
    else:
        known = materialise(shingle_sets(docs, id_col, text_col, shingle).drop("keys").withColumn("row", F.monotonically_increasing_id()), "sets")
        firsts = (F.min("id").alias("least_id"), F.min("row").alias("node"), F.first("size").alias("size"), F.first("bits").alias("bits"))
        groups = materialise(known.groupBy("fp").agg(*firsts), "groups")
        links = similar_links(known, groups, candidate_links(groups.withColumn("keys", F.col("bits")), jaccard), shingle, jaccard)
    roots = connected_components(links)
    rooted = materialise(groups.join(roots.hint("merge"), "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "least_id"), "rooted")
    # Written by itself, so that a root shared by a third of the fingerprints is split in the join.
    least = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return known.join(classes.hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Five-word shingles, a Jaccard similarity of their sets of 0.8.
NEAR_COPIES = {"shingle": 5, "jaccard": 0.8}


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class of near copies, all columns kept, one row a class.

    ``how`` goes to ``simhash_classes``; by default near copies are those of
    ``NEAR_COPIES``.  Repeated rows (equal id and text) stay once; rows with a
    null id can't be told apart by it and all stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    classes = simhash_classes(named, id_col, text_col, **(how or NEAR_COPIES))
    kept = classes.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    text, row = free_name(docs, "text_hash"), free_name(docs, "row")
    order = Window.partitionBy(id_col, text).orderBy(id_col)
    stay = named.join(kept.hint("merge"), id_col, "left_semi").withColumn(text, F.xxhash64(text_col)).withColumn(row, F.row_number().over(order))
    return stay.where(F.col(row) == 1).drop(row, text).unionByName(docs.where(F.col(id_col).isNull()))

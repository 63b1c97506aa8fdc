"""A prefix trie of conversations: Z-fast tries over digests of prefixes, filled in batches in every task and merged by prefix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .ranking import powers, ranked

#: Turns of a conversation are handed on in runs of at most this many.
RUN_TURNS = 1024
#: Depths that a task's trie may hold before it is written out and begun anew.
HELD_DEPTHS = 1 << 17
#: A prefix's digest is two sums of its turns' hashes, each times a power of an odd number that tells the place.
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WORD = 16


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Node:
    """A compacted node: its edge holds the digests of depths ``top`` to ``bottom``, and the words of the turns below ``top``."""

    __slots__ = ("bottom", "edge", "least", "parent", "start", "sums", "top", "words")

    def __init__(self, start: int, top: int, edge: bytes, words: bytes, parent: _Node | None):
        self.start, self.top, self.bottom, self.edge, self.words, self.parent = start, top, top + len(words) // 4, edge, words, parent
        self.least, self.sums = None, None

    def at(self, depth: int) -> bytes:
        return self.edge[(depth - self.top) * _WORD : (depth - self.top + 1) * _WORD]

    def key(self, depth: int) -> tuple[int, bytes]:
        """A prefix among those of runs that begin at the same depth."""
        return self.start, self.at(depth)

    def handle(self) -> tuple[int, bytes]:
        return self.key(two_fattest(self.top, self.bottom))

    def ends(self, least: int, sums: tuple[int, ...]) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.sums = sums if self.sums is None else tuple(a + b for a, b in zip(self.sums, sums, strict=True))


class ZFastTrie:
    """A trie over runs of turns given by the digests of their prefixes.

    Compacted nodes are hashed by their handle, the digest of the prefix whose length is the two-fattest number of
    the node's depths.  A run's exit node is found by fat binary search: a handle that is there moves the search below
    its node, one that is not moves it above.  As equal digests are equal prefixes, an edge is compared with a run by
    one digest, and the place where they part is found by bisection.  A run that begins deeper hangs from a root of
    its own prefix.
    """

    def __init__(self) -> None:
        self.nodes: list[_Node] = []
        self.handles: dict[tuple[int, bytes], _Node] = {}
        self.firsts: dict[tuple[int, bytes], _Node] = {}
        self.roots: dict[tuple[int, bytes], _Node] = {}
        self.held = 0

    def _add(self, node: _Node) -> None:
        self.nodes.append(node)
        self.handles[node.handle()] = node
        self.firsts[node.key(node.top + 1)] = node

    def exit_node(self, run: _Node) -> tuple[_Node, _Node | None]:
        """The deepest node whose whole prefix the run has, and the node below it that the run leaves or ends in, if any."""
        matched = self.roots.setdefault(run.key(run.top), _Node(run.start, run.top, run.at(run.top), b"", None))
        low, high = run.top, run.bottom
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(run.key(depth))
            if found is None:
                high = depth - 1
            elif found.bottom <= run.bottom and found.at(found.bottom) == run.at(found.bottom):
                matched, low = found, found.bottom
            else:
                return found.parent, found
        return matched, self.firsts.get(run.key(matched.bottom + 1)) if matched.bottom < run.bottom else None

    def _parting(self, run: _Node, node: _Node) -> int:
        """The deepest depth at which the run and the node's edge agree."""
        low, high = node.top + 1, min(node.bottom, run.bottom)
        while low < high:
            middle = (low + high + 1) // 2
            if run.at(middle) == node.at(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: _Node, depth: int) -> _Node:
        """Cut the node's edge at ``depth``; the upper part is a new node."""
        cut = depth - node.top
        upper = _Node(node.start, node.top, node.edge[: (cut + 1) * _WORD], node.words[: cut * 4], node.parent)
        del self.handles[node.handle()]
        node.top, node.edge, node.words, node.parent = depth, node.edge[cut * _WORD :], node.words[cut * 4 :], upper
        self._add(upper)
        self.handles[node.handle()] = self.firsts[node.key(depth + 1)] = node
        return upper

    def insert(self, run: _Node, least: int, sums: tuple[int, ...]) -> None:
        """Add a run that ends here for ``least``, the smallest of its conversations, with the ``sums`` of them all."""
        matched, below = self.exit_node(run)
        while below is not None and matched.bottom < run.bottom:
            depth = self._parting(run, below)
            if depth < below.bottom:
                matched, below = self._split(below, depth), None
            else:
                matched = below
                below = self.firsts.get(run.key(matched.bottom + 1)) if matched.bottom < run.bottom else None
        if matched.bottom < run.bottom:
            cut = matched.bottom - run.top
            leaf = _Node(run.start, matched.bottom, run.edge[cut * _WORD :], run.words[cut * 4 :], matched)
            self._add(leaf)
            self.held += leaf.bottom - leaf.top
            matched = leaf
        matched.ends(least, sums)

    def insert_batch(self, runs: list[tuple[int, bytes, bytes, int, tuple[int, ...]]]) -> None:
        """Runs (depth at which they begin, digests, words, conversation, values); equal ones are one insertion."""
        merged: dict[tuple[int, bytes, bytes], list] = {}
        for top, edge, words, conv, values in runs:
            same = merged.setdefault((top, edge[:_WORD], edge[-_WORD:]), [edge, words, conv, values])
            if same[0] is not edge:
                same[2] = min(same[2], conv)
                same[3] = tuple(a + b for a, b in zip(same[3], values, strict=True))
        for (top, _, _), (edge, words, conv, values) in merged.items():
            self.insert(_Node(top, top, edge, words, None), conv, values)

    def expanded(self) -> Iterator[tuple[_Node, int, tuple[int, ...]]]:
        """Every compacted node with the smallest conversation and the sums of its whole subtree."""
        for node in sorted(self.nodes, key=lambda n: -n.bottom):
            yield node, node.least, node.sums
            if node.parent is not None:
                node.parent.ends(node.least, node.sums)


def _longs(edge: bytes) -> np.ndarray:
    return np.frombuffer(edge, dtype="<i8").reshape(-1, 2)


def trie_sums(runs: DataFrame, values: list[str], held_depths: int = HELD_DEPTHS) -> DataFrame:
    """Sums over each prefix's conversations: (``a``, ``b``, ``above_a``, ``above_b``, ``depth``, ``words``, ``conv``, values).

    ``a`` and ``b`` are the prefix's digest, ``above_*`` that of its parent, ``conv`` the smallest conversation.  Each
    task fills a trie, Arrow batch by Arrow batch, expands its edges to a row a depth, and begins anew once it holds
    ``held_depths`` depths; rows of the same prefix from all tries are then added up.
    """
    names = ["a", "b", "above_a", "above_b", "depth", "words", "conv", *values]

    def flush(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for node, least, sums in trie.expanded():
            rows.append((node, least, sums))
            n += node.bottom - node.top
            if n >= 1 << 14:
                yield batch_of(rows)
                rows, n = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        lengths = [n.bottom - n.top for n, _, _ in rows]
        here = np.concatenate([_longs(n.edge)[1:] for n, _, _ in rows])
        above = np.concatenate([_longs(n.edge)[:-1] for n, _, _ in rows])
        depths = np.concatenate([np.arange(n.top + 1, n.bottom + 1) for n, _, _ in rows])
        words = np.frombuffer(b"".join(n.words for n, _, _ in rows), dtype="<i4").astype(np.int64)
        totals = [np.repeat(np.array([s[i] for _, _, s in rows], dtype=np.int64), lengths) for i in range(len(values))]
        columns = [here[:, 0], here[:, 1], above[:, 0], above[:, 1], depths, words, np.repeat(np.array([x for _, x, _ in rows], dtype=np.int64), lengths), *totals]
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("top", "edge", "words", "conv", *values)]
            trie.insert_batch([(t, e, w, c, v) for t, e, w, c, *v in zip(*columns, strict=True)])
            if trie.held >= held_depths:
                yield from flush(trie)
                trie = ZFastTrie()
        yield from flush(trie)

    rows = runs.select("top", "edge", "words", "conv", *values).mapInArrow(fill, ", ".join(f"{n} long" for n in names))
    one = [F.max(c).alias(c) for c in ("above_a", "above_b", "depth", "words")]
    return rows.groupBy("a", "b").agg(*one, F.min("conv").alias("conv"), *[F.sum(v).alias(v) for v in values])


def turn_runs(turns: DataFrame) -> DataFrame:
    """(``conv``, ``top``, ``edge``, ``words``, ``bottom``, ``end_a``, ``end_b``) of consecutive turns (``conv``, ``depth``, ``a``, ``b``, ``ta``, ``tb``, ``words``), in any order of conversations.

    ``edge`` holds the digests of depths ``top`` to ``top`` + n, ``words`` the n turns' words; n is at most
    RUN_TURNS.  ``bottom`` and ``end_*`` are the last depth and its digest.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, a, b, ta, tb = (batch.column(c).to_numpy() for c in ("conv", "depth", "a", "b", "ta", "tb"))
            words = batch.column("words").to_numpy().astype("<i4")
            new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)])
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(s, e, RUN_TURNS) for s, e in zip(starts, [*starts[1:], len(conv)], strict=True)])
            ends = np.append(starts[1:], len(conv))
            here = np.stack([a, b], axis=1).astype("<i8")
            turn = np.stack([x[starts].view(np.uint64) * powers(f, depth[starts] - 1) for x, f in zip((ta, tb), _FACTORS, strict=True)], axis=1)
            above = (here[starts].view(np.uint64) - turn).astype("<u8")
            yield pa.record_batch({
                "conv": pa.array(conv[starts]), "top": pa.array(depth[starts] - 1),
                "edge": pa.array([above[i].tobytes() + here[s:e].tobytes() for i, (s, e) in enumerate(zip(starts, ends, strict=True))], pa.binary()),
                "words": pa.array([words[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                "bottom": pa.array(depth[ends - 1]), "end_a": pa.array(a[ends - 1]), "end_b": pa.array(b[ends - 1]),
            })

    return turns.select("conv", "depth", "a", "b", "ta", "tb", "words").mapInArrow(cut, "conv long, top long, edge binary, words binary, bottom long, end_a long, end_b long")


def joined_digests(ends: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``ends_sha256``): SHA-256 of each prefix's ``conv``s in numerical order, comma-joined.

    Ids are joined to texts of some kilobytes in parallel over ranges of (prefix, id); a prefix's texts then stream
    through one digest.
    """
    by = ["a", "b", "conv"]

    def join_up(batches):
        key, first, held = None, 0, []
        for batch in batches:
            rows = []
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in by), strict=True):
                if (a, b) != key or len(held) == 256:
                    if held:
                        rows.append((*key, first, ",".join(held)))
                    key, first, held = (a, b), conv, []
                held.append(str(conv))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=[*by, "text"])
        if held:
            yield pa.record_batch([pa.array([x]) for x in (*key, first, ",".join(held))], names=[*by, "text"])

    def digest(batches):
        from hashlib import sha256

        key, state = None, None
        for batch in batches:
            rows = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if (a, b) != key:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (a, b), sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "ends_sha256"])
        if key:
            yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], names=["a", "b", "ends_sha256"])

    texts = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join_up, "a long, b long, conv long, text string")
    return texts.repartition("a", "b").sortWithinPartitions(*by).mapInArrow(digest, "a long, b long, ends_sha256 string")


def turn_table(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(``conv``, ``pos`` from 0, ``ta``, ``tb``, ``words``) of every turn; rows without a conversation are left out.

    A null role or text is empty; turns are ordered by number, null first, equal numbers by a hash of what they say.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = [F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("ta"), F.xxhash64(F.lit(1), text, role).alias("tb"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")]
    rows = materialise(talks.where(F.col(conv_col).isNotNull()).select(*said).withColumn("row", F.monotonically_increasing_id()), "turns")
    return ranked(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("ta"), F.col("tb"), F.col("row")], out="pos").drop("row", "turn")


def graft(turns: DataFrame, base: Callable[[Column], Column], heads: Callable[[Column], Column], most_heads: int) -> DataFrame:
    """The turns of conversations rebuilt: (``conv``, ``kind``, ``pos``, ``ta``, ``tb``, ``words``), to be ordered by ``kind`` and ``pos``.

    Conversation c gets the first ``heads(c)`` turns (at most ``most_heads``; all if fewer, none if absent) of ``base(c)``
    in place of its own first ``heads(c)``.
    """
    rest = ["pos", "ta", "tb", "words"]
    own = turns.where(F.col("pos") >= heads(F.col("conv"))).select("conv", F.lit(1).alias("kind"), *rest)
    convs = turns.select("conv").distinct().select("conv", base(F.col("conv")).alias("base"), heads(F.col("conv")).alias("heads"))
    first = turns.where(F.col("pos") < most_heads).select(F.col("conv").alias("base"), *rest)
    lent = convs.join(first.hint("merge"), "base").where("pos < heads").select("conv", F.lit(0).alias("kind"), *rest)
    return lent.unionByName(own)


def prefix_trie(turns: DataFrame, convs: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct prefix of turns, the empty one included.

    ``turns`` (``conv``, ``ta``, ``tb``, ``words`` and the columns of ``order``, which tell a conversation's turns
    apart) are the turns, ``convs`` (``conv``) all conversations, those without turns included.

    (``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``): the smallest member, the number of turns, the parent's smallest member (null for the root), the
    members, the children, the childless nodes of the subtree, the words of the subtree's last turns times one less
    than their members, and the SHA-256 of the ids of members that end here.  Without conversations there are no rows.

    Sums over a subtree need no recursion: a node counts for the smallest of its conversations, whose nodes are then
    the deepest of its path; a subtree's sum is that of its members' sums (a second filling of the tries), less what
    its own smallest member has above it.
    """
    factors = {"a": ("ta", _FACTORS[0]), "b": ("tb", _FACTORS[1])}
    placed = ranked(materialise(turns, "rebuilt"), "conv", [F.col(c) for c in order], running=factors, out="place").withColumn("depth", F.col("place") + 1)
    runs = materialise(turn_runs(placed), "runs")
    convs = materialise(convs.select("conv").distinct(), "convs")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), none.alias("above_a"), none.alias("above_b"), zero.alias("depth"), zero.alias("words"), "conv", "n")
    found = materialise(trie_sums(runs.withColumn("n", F.lit(1).cast("long")), ["n"]).unionByName(root), "prefixes")

    marks = found.where("depth > 0").select(F.col("above_a").alias("a"), F.col("above_b").alias("b"), *[none.alias(c) for c in found.columns[2:]], F.lit(1).alias("child"))
    nodes = found.withColumn("child", F.lit(0)).unionByName(marks).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in found.columns[2:]], F.sum("child").alias("n_children"))
    nodes = nodes.withColumns({"own": (F.col("n") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long")})
    nodes = materialise(ranked(materialise(nodes, "children"), "conv", [F.col("depth")], running={"tokens_to": ("own", 1), "leaves_to": ("leaf", 1)}, out="place"), "nodes")

    of_conv = nodes.groupBy("conv").agg(F.sum("own").alias("tokens"), F.sum("leaf").alias("leaves"))
    weights = trie_sums(runs.join(of_conv.hint("merge"), "conv"), ["tokens", "leaves"]).select("a", "b", "tokens", "leaves")
    everything = nodes.agg(F.sum("own").alias("tokens"), F.sum("leaf").alias("leaves")).select(zero.alias("a"), zero.alias("b"), "tokens", "leaves")
    births = nodes.where("place = 0 and depth > 0").select("a", "b", "above_a", "above_b")
    parents = found.select(F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv").alias("parent"))
    births = births.join(parents.hint("merge"), ["above_a", "above_b"]).select("a", "b", "parent")
    last = runs.groupBy("conv").agg(F.max_by(F.struct("end_a", "end_b"), "bottom").alias("end"))
    last = convs.join(last.hint("merge"), "conv", "left").select("conv", F.coalesce("end.end_a", zero).alias("a"), F.coalesce("end.end_b", zero).alias("b"))
    nothing = F.sha2(F.lit(""), 256)
    on = ["a", "b"]
    joined = nodes.join(weights.unionByName(everything).hint("merge"), on).join(births.hint("merge"), on, "left").join(joined_digests(last).hint("merge"), on, "left")
    return joined.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"), (F.col("tokens") - F.col("tokens_to") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )

"""A Merkle manifest of a dataset: a persistent binary hash tree over aligned blocks, with versions by path copying."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise
from .ranking import ranked

#: A block holds 2 ** BLOCK_LEVELS nodes of a level; one task works on a block at a time.
BLOCK_LEVELS = 10

#: How a path says where a sibling stands; a node without one has no digest behind its letter.
LEFT, RIGHT, ALONE = "LR-"
_NO_LETTERS = str.maketrans("", "", LEFT + RIGHT + ALONE)


def join_digests(*digests: str) -> str:
    """The lower-case hexadecimal SHA-256 of digests in hexadecimal, one after the other."""
    return sha256("".join(digests).encode()).hexdigest()


class PersistentTree:
    """The binary hash tree of one aligned block, each new version of which shares all nodes but a path.

    ``levels[0]`` are the block's nodes; a run's last node may stand alone and is hashed alone.  A block that is not
    the only one of its key (``raised``) goes on to its full height, as the nodes beside it do.
    """

    def __init__(self, nodes: list[str], raised: bool):
        self.levels = [nodes]
        while len(nodes) > 1 or (raised and len(self.levels) <= BLOCK_LEVELS):
            nodes = [join_digests(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            self.levels.append(nodes)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def paths(self, above: str = "") -> list[str]:
        """For each node of the block its siblings up to the block's root, and then ``above``."""
        paths = [above]
        for nodes in reversed(self.levels[:-1]):
            last = len(nodes) - 1
            step = [(LEFT + nodes[i - 1]) if i & 1 else (RIGHT + nodes[i + 1]) if i < last else ALONE for i in range(len(nodes))]
            paths = [s + paths[i >> 1] for i, s in enumerate(step)]
        return paths

    def version(self, at: int, digest: str) -> list[str]:
        """The nodes a version with another digest at ``at`` does not share: that one and its copied ancestors, up to the block's root."""
        copied = [digest]
        for nodes in self.levels[:-1]:
            pair = (nodes[at - 1], digest) if at & 1 else (digest, *nodes[at + 1 : at + 2])
            digest = join_digests(*pair)
            copied.append(digest)
            at >>= 1
        return copied


def steps_of(path: str) -> list[tuple[str, str]]:
    """(letter, sibling) of a path."""
    out, at = [], 0
    while at < len(path):
        n = 0 if path[at] == ALONE else 64
        out.append((path[at], path[at + 1 : at + 1 + n]))
        at += 1 + n
    return out


def continued(digest: str, path: str) -> list[str]:
    """The ancestors of a node along ``path``, recomputed from its digest and the path's siblings."""
    copied = []
    for side, sibling in steps_of(path):
        digest = join_digests(sibling, digest) if side == LEFT else join_digests(digest, sibling)
        copied.append(digest)
    return copied


def fold(digest: str, path: str) -> str:
    """The root that a leaf's digest and the siblings on its path make."""
    return [digest, *continued(digest, path)][-1]


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values' texts, each behind its length in UTF-8 bytes and a colon; a null is a hyphen.  32 bytes."""
    shown = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256))


def _over_blocks(nodes: DataFrame, work: Callable[[int, pd.DataFrame], dict], schema: str) -> DataFrame:
    """``work(block, nodes of the block in order)`` for every aligned block of (``key``, ``index``, ``digest``)."""

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = work(int(keys[1]), part.sort_values("index", ignore_index=True))
        return pd.DataFrame({"key": keys[0], "block": keys[1], **found})

    return nodes.withColumn("block", F.shiftright("index", BLOCK_LEVELS)).groupBy("key", "block").applyInPandas(run, schema)


def _block_root(block: int, part: pd.DataFrame) -> dict:
    return {"digest": [PersistentTree([d.hex() for d in part["digest"]], block > 0).root]}


def _block_paths(block: int, part: pd.DataFrame) -> dict:
    tree = PersistentTree([d.hex() for d in part["digest"]], block > 0)
    return {"index": part["index"], "path": tree.paths(), "root": tree.root}


def block_roots(nodes: DataFrame) -> DataFrame:
    """(``key``, ``index``, ``digest``) one block height above ``nodes``."""
    found = _over_blocks(nodes, _block_root, "key string, block long, digest string")
    return found.select("key", F.col("block").alias("index"), F.unhex("digest").alias("digest"))


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``index``, ``path`` to the key's root) of all ``nodes``, and (``key``, ``root``).

    Rounds work on blocks of nodes, a 1024th of the round before; paths of later rounds go on behind those of
    earlier ones.  A written table, please.
    """
    rounds = []
    while True:
        found = materialise(_over_blocks(nodes, _block_paths, "key string, block long, index long, path string, root string"), "paths")
        rounds.append(found)
        if not found.where("block > 0").limit(1).count():
            break
        nodes = found.where(F.col("index") == F.shiftleft("block", BLOCK_LEVELS)).select("key", F.col("block").alias("index"), F.unhex("root").alias("digest"))
    roots = found.where("index = 0").select("key", F.unhex("root").alias("digest"))

    def onward(upper: DataFrame, lower: DataFrame) -> DataFrame:
        above = upper.select("key", F.col("index").alias("block"), F.col("path").alias("above"))
        return lower.select("key", "block", "index", "path").join(above, ["key", "block"]).select("key", "index", F.concat("path", "above").alias("path"))

    return reduce(onward, reversed(rounds[:-1]), rounds[-1].select("key", "index", "path")), roots


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changes: dict[str, Column] | None = None,
                    id_col: str = "doc_id", part_col: str = "lang", with_copies: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``[, ``copied``]).

    A leaf is the ``leaf_digest`` of ``columns``.  The leaves of a ``part_col`` value, by id (null first, equal ids by
    leaf), are paired to a subroot, the subroots by ``part_col`` (null first, bytewise) to the root.  ``proof_sha256``
    hashes the siblings on the way.  Rows where ``tampered`` holds have ``changes`` (column to new value) made and
    give one version of the tree each: it copies the ancestors of that leaf, inside its block and then above, and
    shares every other node.  ``folded_root`` is that version's root; of every other row it is folded from its own
    leaf along its proof's siblings, so a proof that doesn't fit shows.  ``verified``: whether it is the root.
    ``with_copies`` adds the nodes a version owns, leaf first (null where not tampered).

    Null and empty texts differ; a null id or part value is a value of its own; repeated rows are a leaf each; an
    empty table gives no rows; other columns are not carried.
    """
    changed = [(changes or {}).get(c, F.col(c)) for c in columns]
    key = F.coalesce(F.concat(F.lit("="), F.col(part_col).cast("string")), F.lit(""))
    other = F.when(tampered, leaf_digest(*changed)) if tampered is not None else F.lit(None).cast("binary")
    row = free_name(docs, "row")
    leaves = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"), other.alias("other")).withColumn(row, F.monotonically_increasing_id())
    placed = materialise(ranked(materialise(leaves, "hashed"), "key", [F.col("id").asc_nulls_first(), F.col("digest"), F.col(row)], out="index").drop(row).withColumn("id", F.col("id").cast("string")), "leaves")

    paths, subroots = climb(materialise(block_roots(placed.select("key", "index", "digest")), "blocks"))
    subroots = materialise(subroots, "subroots")
    langs = ranked(subroots.select(F.lit("").alias("all"), F.col("key").alias("lang"), "digest"), "all", [F.col("lang")], out="index")
    langs = materialise(langs.select(F.col("all").alias("key"), "index", "digest", "lang"), "top")
    top_paths, tops = climb(langs)
    root = tops.select(F.lower(F.hex("digest")).alias("root"))
    # The root is one row.
    top = langs.join(top_paths, ["key", "index"]).join(F.broadcast(root), F.lit(True))
    top = materialise(top.select(F.col("lang").alias("key"), F.col("path").alias("top"), F.lower(F.hex("digest")).alias("subroot"), "root"), "top-paths")
    above = materialise(paths.join(top, "key").select("key", F.col("index").alias("block"), F.concat("path", "top").alias("above"), "subroot", "root"), "above")

    def prove(part: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        part, up = part.sort_values("index", ignore_index=True), up.iloc[0]
        leaves = [d.hex() for d in part["digest"]]
        tree = PersistentTree(leaves, int(up["block"]) > 0)
        paths = tree.paths(up["above"])
        proofs = [sha256(p.translate(_NO_LETTERS).encode()).hexdigest() for p in paths]
        copied = [None if x is None else (lambda c: c + continued(c[-1], up["above"]))(tree.version(i, x.hex())) for i, x in enumerate(part["other"])]
        folded = [fold(leaf, path) if c is None else c[-1] for leaf, path, c in zip(leaves, paths, copied, strict=True)]
        found = {"id": part["id"], "leaf": leaves, "subroot": up["subroot"], "root": up["root"], "proof_sha256": proofs, "folded_root": folded, "verified": [f == up["root"] for f in folded]}
        return pd.DataFrame(found | ({"copied": copied} if with_copies else {}))

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", copied array<string>" if with_copies else "")
    blocks = placed.withColumn("block", F.shiftright("index", BLOCK_LEVELS)).groupBy("key", "block")
    return blocks.cogroup(above.groupBy("key", "block")).applyInPandas(prove, schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)

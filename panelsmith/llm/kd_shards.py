"""Shards of near-equal bytes by a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialise
from .ranking import ranked

#: Cuts into which a round divides the open range of a node's ordering key.
CUTS = 1024
#: What tells rows of equal value apart, in this order: the text's checksum (copies stay side by side), the id, the row.
_TIES = ("text_crc32", "id_high", "id_low", "row")


@dataclass
class Split:
    """A node with more than one leaf: the dimension and the goal of its cut, and the ordering key's open range.

    ``fixed`` are the key's columns that are settled, ``low`` and ``high`` the range of the next one, ``before`` the
    bytes in front of that range.  ``cut`` is the last key on the left once it is found.
    """

    node: int
    leaves: int
    dimension: int
    total: int
    lows: list[int]
    highs: list[int]
    fixed: list[int] = field(default_factory=list)
    before: int = 0
    rows: int = 2
    left: bool = False

    @property
    def goal(self) -> float:
        return self.total * (self.leaves // 2) / self.leaves

    def settle(self) -> None:
        """Step over columns that have one value left."""
        while not self.found and self.lows[len(self.fixed)] == self.highs[len(self.fixed)]:
            self.fixed.append(self.lows[len(self.fixed)])

    @property
    def found(self) -> bool:
        return len(self.fixed) == 1 + len(_TIES)


def coordinate(df: DataFrame, column: str) -> Column:
    """A column as a whole number that never decreases with it: numbers as they are, texts by their first 7 bytes; null is -1 below them.

    Numbers below 0 count as 0.
    """
    if isinstance(df.schema[column].dataType, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 7)), 14, "0")
        number = F.conv(head, 16, 10).cast("long")
    else:
        number = F.greatest(F.col(column).cast("long"), F.lit(0).cast("long"))
    return F.coalesce(number, F.lit(-1).cast("long"))


def _with_nodes(points: DataFrame, levels: list[list[Split]], key) -> DataFrame:
    """``points`` with the ``node`` that the cuts of all ``levels`` lead to, and its first ``shard``; a level's cuts are at most one a shard."""
    spark, placed = points.sparkSession, points.withColumns({"node": F.lit(1).cast("long"), "shard": F.lit(0)})
    for splits in levels:
        names = [f"cut_{i}" for i in range(1 + len(_TIES))]
        if not splits:
            continue
        rows = {"node": [s.node for s in splits], "dimension": [s.dimension for s in splits], "step": [s.leaves // 2 for s in splits], "left": [s.left for s in splits]}
        cuts = spark.createDataFrame(pa.table(rows | {n: pa.array([s.fixed[i] for s in splits], pa.int64()) for i, n in enumerate(names)}))
        here, cut = F.struct(*[c.alias(n) for c, n in zip(key(), names, strict=True)]), F.struct(*names)
        right = (F.when(F.col("left"), here > cut).otherwise(here >= cut)).cast("int")
        placed = placed.join(F.broadcast(cuts), "node", "left").withColumn("right", F.coalesce(right, F.lit(0)))
        placed = placed.withColumns({"node": F.when(F.col("dimension").isNotNull(), F.col("node") * 2 + F.col("right")).otherwise(F.col("node")), "shard": F.col("shard") + F.col("right") * F.coalesce(F.col("step").cast("int"), F.lit(0))})
        placed = placed.select(*points.columns, "node", "shard")
    return placed


def _narrow(spark: SparkSession, placed: DataFrame, splits: list[Split], key) -> None:
    """One round: the bytes of every open range between CUTS even cuts, summed where the rows are; the range that holds the goal stays open.

    One row a node comes back.
    """
    names = [f"k{i}" for i in range(1 + len(_TIES))]
    at = [len(s.fixed) for s in splits]
    state = spark.createDataFrame(pa.table({
        "node": [s.node for s in splits], "dimension": [s.dimension for s in splits], "at": at, "fixed": [s.fixed + [0] * (len(names) - n) for s, n in zip(splits, at, strict=True)],
        "low": [s.lows[n] for s, n in zip(splits, at, strict=True)], "high": [s.highs[n] for s, n in zip(splits, at, strict=True)], "goal": [s.goal - s.before for s in splits],
    }))
    met = placed.join(F.broadcast(state), "node").withColumns(dict(zip(names, key(), strict=True)))
    settled = reduce(Column.__and__, [(F.col("at") <= i) | (F.col(n) == F.col("fixed")[i]) for i, n in enumerate(names)])
    value = F.element_at(F.array(*names), F.col("at").cast("int") + 1)
    met = met.where(settled & value.between(F.col("low"), F.col("high")))
    bucket = F.floor((value - F.col("low")).cast("double") * CUTS / (F.col("high") - F.col("low") + 1).cast("double")).cast("int")
    ends = [f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]
    sums = met.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("goal").alias("goal"), *ends)
    upto = Window.partitionBy("node").orderBy("bucket")  # at most CUTS rows a node
    run = sums.withColumn("upto", F.sum("bytes").over(upto))
    holds = run.where("upto >= goal").groupBy("node").agg(F.min_by(F.struct(*run.columns), "bucket").alias("r"))
    by_node = {s.node: s for s in splits}
    for row in holds.collect():
        s, r = by_node[row.node], row.r
        s.before += r.upto - r.bytes
        s.lows, s.highs, s.rows = [r[f"min_{n}"] for n in names], [r[f"max_{n}"] for n in names], r.n
        if s.rows == 1:
            s.fixed = list(s.lows)
        s.settle()
        if s.found:
            # The row on the goal goes to the side that it leaves nearer to its goal.
            s.left = s.before + r.bytes - s.goal <= s.goal - s.before


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("n_chars", "source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``).

    Law ``bytes``: shards hold near-equal bytes, a row counting its text's UTF-8 bytes and one more.  ``shards``
    follows from ``target_bytes`` where that is given.  A node with more than one leaf is cut along its widest
    dimension (its range there over that of all rows, of equals the first named), so that the left part has the bytes of half its
    leaves: a weighted median where their number is even.  Rows of equal value are told apart by their text's checksum, then
    by id; no row goes to two shards, so a cut is off by half a row at most.  ``slot`` numbers a shard's rows by id.

    Cuts are found by rounds that sum bytes between even cuts of the open ranges of all nodes of a level: rows are not
    moved, and one row a node, at most ``shards``, comes to the driver.  A null text has one byte, its checksum is
    that of the empty text; null metadata is below all other; repeated rows are placed each; fewer rows than shards leave some
    empty; an empty table gives no rows; other columns are not carried.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [f"d{i}" for i in range(len(dimensions))]
    points = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[coordinate(docs, c).alias(n) for c, n in zip(dimensions, names, strict=True)],
    ).withColumns({"id_high": F.coalesce(F.shiftright("id", 32), F.lit(-(1 << 32))), "id_low": F.coalesce(F.col("id").bitwiseAND(0xFFFFFFFF), F.lit(0)), "row": F.monotonically_increasing_id()})
    points = materialise(points, "points")

    def key() -> list[Column]:
        return [F.element_at(F.array(*names), F.col("dimension").cast("int") + 1), *[F.col(c).cast("long") for c in _TIES]]

    def extents(placed: DataFrame) -> dict[int, tuple]:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in (*names, *_TIES) for f in (F.min, F.max)]
        return {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("total"), *ends).collect()}

    levels: list[list[Split]] = []
    whole = extents(points.withColumn("node", F.lit(1).cast("long"))).get(1)
    total = whole.total if whole else 0
    if target_bytes:
        shards = max(1, math.ceil(total / target_bytes))
    if not shards or shards < 1:
        raise ValueError("give a positive number of shards, or target_bytes")
    widths = [max(1, whole[f"max_{n}"] - whole[f"min_{n}"]) for n in names] if whole else []
    open_nodes, found = {1: shards}, {1: whole} if whole else {}
    while any(n > 1 for n in open_nodes.values()) and found:
        splits = []
        for node, leaves in open_nodes.items():
            if leaves > 1 and (e := found.get(node)):
                spread = [(e[f"max_{n}"] - e[f"min_{n}"]) / w for n, w in zip(names, widths, strict=True)]
                widest = spread.index(max(spread))
                columns = [names[widest], *_TIES]
                splits.append(Split(node, leaves, widest, e.total, [e[f"min_{c}"] for c in columns], [e[f"max_{c}"] for c in columns]))
        placed = _with_nodes(points, levels, key)
        for s in splits:
            s.settle()
        while waiting := [s for s in splits if not s.found]:
            _narrow(spark, placed, waiting, key)
        levels.append(splits)
        open_nodes = {2 * s.node + side: n for s in splits for side, n in ((0, s.leaves // 2), (1, s.leaves - s.leaves // 2))}
        if any(n > 1 for n in open_nodes.values()):
            found = extents(_with_nodes(points, levels, key))
    placed = _with_nodes(points, levels, key).select("id", "size", "text_crc32", "row", "shard")
    numbered = ranked(placed, "shard", [F.col("id").asc_nulls_first(), F.col("row")], out="slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Order-dependent columns without one task per key.

A plain ``Window.partitionBy(key)`` puts a whole key in one task.  That is fine
for a monthly series (twelve rows a year) but not for a key that holds a third
of a huge table.  ``windowed_by_rows`` splits a key into blocks of consecutive
rows, each carrying the few preceding rows its frames need.  ``nearest_before``
and ``nearest_after`` answer strict as-of lookups the same way: sort inside
small time slots, cut further where the times crowd, and carry one value per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import col, epoch_seconds

BLOCK_ROWS = 8192
#: Pieces into which values are cut at their quantiles, and how many sampled values make a piece.
PIECES, SAMPLED = 256, 16


def quantile_cuts(df: DataFrame, value: Column, pieces: int = PIECES, distinct: bool = True) -> DataFrame:
    """One row: ``_cuts``, the values that cut the ``value``s of ``df`` into ``pieces`` of about equal number, in order.

    They come from the ``pieces`` * SAMPLED values with the least hashes, a sample that is the
    same whenever it is drawn; fewer values are fewer cuts.  Values that often repeat are to be made ``distinct`` first.
    """
    values = df.select(value.alias("_v")).where("_v is not null")
    least = (values.distinct() if distinct else values).orderBy(F.xxhash64("_v"), "_v").limit(pieces * SAMPLED)
    drawn = least.agg(F.sort_array(F.collect_list("_v")).alias("_d"))
    return drawn.select(F.filter("_d", lambda _, i: (i % SAMPLED == SAMPLED - 1) & (i < pieces * SAMPLED - 1)).alias("_cuts"))


def with_piece(df: DataFrame, value: Column, cuts: DataFrame, out: str, pieces: int = PIECES) -> DataFrame:
    """Add ``out``, how many of the ``quantile_cuts`` a value has reached, by bisection; it never decreases with the value."""
    # The cuts are one row of fewer than ``pieces`` values.  One column a step, which Spark compiles; a fold over an array it would not.
    df = df.join(F.broadcast(cuts), F.lit(True)).withColumns({"_cut_value": value, out: F.lit(0)})
    for w in (1 << i for i in reversed(range(pieces.bit_length()))):
        df = df.withColumn(out, F.when(F.get("_cuts", F.col(out) + (w - 1)) <= F.col("_cut_value"), F.col(out) + w).otherwise(F.col(out)))
    return df.drop("_cuts", "_cut_value")


def row_positions(df: DataFrame, keys: list[str], order: list, chunk: Column) -> DataFrame:
    """Add ``_pos``, the 0-based position in the key's order.

    ``chunk`` must not decrease along ``order`` (say, the month of the time
    stamp).  Rows are ranked inside (key, chunk); the counts of earlier chunks
    come from a summary with one row per (key, chunk).
    """
    t = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        t.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        t.withColumn("_rank", F.row_number().over(inside))
        .join(base, [*keys, "_chunk"])
        .withColumn("_pos", F.col("_base") + F.col("_rank") - 1)
        .drop("_chunk", "_base", "_rank")
    )


def with_text_range(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``, a range of ``column`` in text order, cut at quantiles of its own values, whatever they begin with."""
    text = F.col(column).cast("string")
    return with_piece(df, text, quantile_cuts(df, text), out)


def windowed_by_rows(
    df: DataFrame,
    keys: list[str],
    order: list,
    halo: int,
    columns: Callable[[Window], dict[str, Column]],
    chunk: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns computed over at most ``halo`` preceding rows of the same key.

    ``columns`` maps a window (partitioned and ordered, no frame yet) to named
    expressions.  With ``chunk`` the key is split into row blocks; without it a
    key is taken to be short, as monthly series are.
    """
    if chunk is None:
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(*order)))
    block_rows = max(block_rows, halo)
    placed = row_positions(df, keys, order, chunk).withColumn("_block", F.floor(F.col("_pos") / block_rows))
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("halo"))
    spill = F.struct((F.col("_block") + 1).alias("block"), F.lit(True).alias("halo"))
    copies = placed.withColumn(
        "_at",
        F.explode(F.when(F.col("_pos") % block_rows >= block_rows - halo, F.array(own, spill)).otherwise(F.array(own))),
    ).withColumns({"_block": F.col("_at.block"), "_halo": F.col("_at.halo")})
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    return copies.withColumns(columns(w)).where(~F.col("_halo")).drop("_pos", "_block", "_at", "_halo")


def _nearest(points: DataFrame, marks: DataFrame, ts: str, out: str, keys: list[str], slot_s: int, later: bool, same: str | None) -> DataFrame:
    """Nearest mark strictly before (or after) every distinct point time; ``same`` flags a mark at that very time.

    Times are sorted inside pieces: slots of ``slot_s`` seconds, cut at quantiles of the points' and the marks' times.
    """
    p = points.select(*keys, ts).distinct().select(*keys, F.col(ts).alias("_t"), F.lit(None).cast("timestamp_ntz").alias("_m"))
    m = marks.select(*keys, ts).distinct().select(*keys, F.col(ts).alias("_t"), F.col(ts).alias("_m"))
    cuts = quantile_cuts(points.select(ts).unionByName(marks.select(ts)), F.col(ts))
    # A point sorts before a mark of the same time in the scan direction, so equal times do not match.
    rows = with_piece(p.unionByName(m), F.col("_t"), cuts, "_cut").withColumn("_piece", F.struct(F.floor(epoch_seconds("_t") / slot_s).alias("slot"), "_cut")).drop("_cut")
    rows = rows.withColumn("_k", F.col("_m").isNotNull())
    if later:
        direction = [F.col("_t").desc(), F.col("_k")]
        piece_order, edge = F.col("_piece").desc(), F.min
    else:
        direction = [F.col("_t"), F.col("_k")]
        piece_order, edge = F.col("_piece"), F.max
    inside = Window.partitionBy(*keys, "_piece").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys).orderBy(piece_order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece: the carry over pieces is small however many rows there are.
    carry = rows.groupBy(*keys, "_piece").agg(edge("_m").alias("_edge")).withColumn("_carry", edge("_edge").over(prior))
    return (
        rows.withColumn("_near", F.last("_m", ignorenulls=True).over(inside))
        .withColumns({same: F.max("_m").over(Window.partitionBy(*keys, "_piece", "_t")).isNotNull()} if same else {})
        .where(~F.col("_k"))
        .join(carry.drop("_edge"), [*keys, "_piece"])
        .select(*keys, F.col("_t").alias(ts), F.coalesce("_near", "_carry").alias(out), *([same] if same else []))
    )


def nearest_before(points, marks, ts: str, out: str, keys: list[str] | None = None, slot_s: int = 3600, same: str | None = None) -> DataFrame:
    """(keys, ts, out): the latest mark strictly before each distinct point time."""
    return _nearest(points, marks, ts, out, keys or [], slot_s, False, same)


def nearest_after(points, marks, ts: str, out: str, keys: list[str] | None = None, slot_s: int = 3600, same: str | None = None) -> DataFrame:
    """(keys, ts, out): the earliest mark strictly after each distinct point time."""
    return _nearest(points, marks, ts, out, keys or [], slot_s, True, same)


def keep_latest(df: DataFrame, keys: list[str], recency: list) -> DataFrame:
    """One row per key, the greatest by ``recency``.

    ``max_by`` keeps one candidate per key and task before the shuffle, so a
    key with a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[col(c).alias(f"_r{i}") for i, c in enumerate(recency)])).alias("_row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the smallest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[col(c).alias(f"_r{i}") for i, c in enumerate(order)])).alias("_row")
    )
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def tail_per_group(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last n rows per key; Spark prunes to n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_k(df: DataFrame, column, k: int, out: str = "examples", sep: str = ", ") -> DataFrame:
    """One row: the k smallest distinct values joined as text (a report sample)."""
    top = df.select(col(column).cast("string").alias("_v")).where("_v is not null").distinct().orderBy("_v").limit(k)
    return top.agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(out))

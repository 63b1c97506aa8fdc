"""Exact order statistics of groups of any size.

Spark's ``percentile`` and an unkeyed ``ORDER BY`` window both hold a whole
group in one task.  Here equal values are merged first, the merged values are
counted in buckets (an order-preserving function of the value), the bucket that holds the wanted rank is found from
that small summary, and only the values of that bucket are ordered, cut further where the data crowd into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import col
from ..functions.scalars import INF
from .ordered import quantile_cuts, with_piece

BUCKETS_PER_EFOLD = 1024
#: Above every -log of a double, so that magnitudes below 1 keep the order.
_ZERO_SHIFT = 800
#: Rows that share a bucket before it is cut by the range of its own values.
CROWDED = 1 << 16


def value_bucket(x, per_efold: int = BUCKETS_PER_EFOLD) -> Column:
    """Bucket number that never decreases with x; 1 / ``per_efold`` (by default about 0.1 %) of the value wide at any magnitude."""
    x = col(x).cast("double")
    spread = F.signum(x) * (F.floor(F.log(F.abs(x)) * per_efold) + _ZERO_SHIFT * per_efold)
    edge = F.lit(1 << 40).cast("long")
    return F.when(x == INF, edge).when(x == -INF, -edge).when(x == 0, F.lit(0).cast("long")).otherwise(spread.cast("long"))


def within_bucket(value: Column, low: Column, high: Column, rows: Column, most: int | None = None) -> Column:
    """An even cut of a bucket between its least and largest value; 0 where no more than ``most`` (``CROWDED``) rows share it.

    So a flat sensor, ids or epochs, whose values lie within 0.1 % of each other, spread over many tasks too.
    """
    most = most or CROWDED
    parts = F.ceil(rows / most)
    cut = F.least(F.floor((value - low) / (high - low) * parts), parts - 1)
    return F.when((rows > most) & (low < high), cut).otherwise(F.lit(0).cast("long"))


def merged_values(df: DataFrame, groups: list[str], value: str, mass: Column) -> DataFrame:
    """Equal values of a group merged, with their bucket.

    The (always true) test on the count keeps both aggregates in every use of
    this plan, so its shuffle is written once and reused.
    """
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(mass).alias("_mass"), F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > 0) & F.col("_mass").isNotNull())
    )
    return merged.withColumn("_bucket", value_bucket("_v"))


def _bucket_totals(merged: DataFrame, groups: list[str]) -> DataFrame:
    """Per (group, bucket): mass before it, its own mass, number and range of its values, their sum, and the group's totals."""
    upto = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    return (
        merged.groupBy(*groups, "_bucket")
        .agg(
            F.sum("_mass").alias("_own"), F.sum("_rows").alias("_n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
            F.sum(F.col("_v") * F.col("_mass")).alias("_area"),
        )
        .withColumns({
            "_end": F.sum("_own").over(upto),
            "_total": F.sum("_own").over(whole),
            "_count": F.sum("_n").over(whole),
        })
        .withColumn("_base", F.col("_end") - F.col("_own"))
    )


def _running(merged: DataFrame, near: DataFrame, groups: list[str], tags: list[str]) -> DataFrame:
    """The values of the buckets in ``near`` (rows of the totals with ``tags``) with ``_run``, the group's mass up to and with them.

    Only a crowded bucket is cut further, and only if a wanted rank lies in it.
    """
    bucket = [*groups, "_bucket", *tags]
    cell = [*bucket, "_cut"]
    kept = near.select(*bucket, "_base", "_values", "_low", "_high", *[c for c in near.columns if c not in {*bucket, "_base", "_values", "_low", "_high"}])
    rows = merged.join(kept, [*groups, "_bucket"]).withColumn("_cut", within_bucket(F.col("_v"), F.col("_low"), F.col("_high"), F.col("_values")))
    ahead = Window.partitionBy(*bucket).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = rows.where(F.col("_values") > CROWDED).groupBy(*cell).agg(F.sum("_mass").alias("_cut_mass")).select(*cell, F.sum("_cut_mass").over(ahead).alias("_ahead"))
    inside = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(cuts, cell, "left").withColumn("_run", F.col("_base") + F.coalesce(F.col("_ahead"), F.lit(0)) + F.sum("_mass").over(inside))


def select_by_mass(
    df: DataFrame,
    groups: list[str],
    value: str,
    threshold: Callable[[Column, Column], Column],
    mass: Column | None = None,
    out: str = "q",
) -> DataFrame:
    """Smallest value whose running mass reaches a threshold, per group.

    ``threshold(total_mass, n_rows)`` is an expression on the group's totals.
    With unit mass and an integer threshold k this is the k-th smallest value.
    Where the whole group stays below the threshold the result is +infinity.
    Columns: groups, ``out``, ``n``, ``mass_total``.
    """
    merged = merged_values(df, groups, value, F.lit(1.0) if mass is None else mass)
    totals = _bucket_totals(merged, groups).withColumn("_need", threshold(F.col("_total"), F.col("_count")))
    # A float running sum and a bucket sum may round apart by a few ulps, so the
    # neighbouring bucket is kept too; the exact pick happens below.
    slack = F.abs(F.col("_need")) * 1e-12
    near = totals.where(
        (F.col("_end") >= F.col("_need") - slack) & (F.col("_base") < F.col("_need") + slack) & (F.col("_need") > 0)
    )
    hits = (
        _running(merged, near.select(*groups, "_bucket", "_base", "_values", "_low", "_high", "_need"), groups, [])
        # Weights such as 0.5 ** (age / 6) have no exact sum; a tie on the threshold counts as reached.
        .where(F.col("_run") >= F.col("_need") - F.abs(F.col("_need")) * 1e-12)
        .groupBy(*groups).agg(F.min("_v").alias("_q"))
    )
    sizes = totals.groupBy(*groups).agg(F.max("_count").alias("n"), F.max("_total").alias("mass_total"))
    joined = sizes.join(hits, groups, "left") if groups else sizes.join(hits, F.lit(True), "left")
    return joined.select(*groups, F.coalesce("_q", F.lit(INF)).alias(out), "n", "mass_total")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (the pandas and SQL ``quantile_cont`` rule).

    Columns: groups, one per name in ``probs``, and ``n``.
    """
    return _quantiles(merged_values(df, groups, value, F.lit(1)), groups, probs)


def _quantiles(merged: DataFrame, groups: list[str], probs: dict[str, float]) -> DataFrame:
    totals = _bucket_totals(merged, groups)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p")) for k, p in probs.items()]))
    near = (
        totals.withColumn("_w", wanted)
        .withColumn("_rank", (F.col("_count") - 1) * F.col("_w.p"))
        .withColumns({"_lo": F.floor("_rank"), "_hi": F.ceil("_rank"), "_frac": F.col("_rank") - F.floor("_rank"), "_name": F.col("_w.name")})
        .where((F.col("_base") <= F.col("_hi")) & (F.col("_end") > F.col("_lo")))
        .select(*groups, "_bucket", "_base", "_values", "_low", "_high", "_lo", "_hi", "_frac", "_name")
    )
    run = _running(merged, near, groups, ["_name"]).select("*", F.col("_run").alias("_end"), (F.col("_run") - F.col("_mass")).alias("_start"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_start") <= F.col(rank)) & (F.col("_end") > F.col(rank)), F.col("_v")))

    picked = run.groupBy(*groups, "_name").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_frac").alias("_f")).select(
        *groups, "_name", F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_q")
    )
    wide = picked.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == k, F.col("_q"))).alias(k) for k in probs])
    sizes = totals.groupBy(*groups).agg(F.max("_count").alias("n"))
    return wide.join(sizes, groups) if groups else wide.join(sizes, F.lit(True))


def running_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Every row with inclusive running sums along ``order`` inside its group.

    Rows are cut into pieces at quantiles of the whole ``order``, so a value that fills a third of the table
    is cut by the columns behind it; one row a piece carries the sums on.
    """
    key = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    kept = {o: f"_own_{o}" for o in sums}
    rows = with_piece(df, key, quantile_cuts(df, key, distinct=False), "_piece").withColumns({k: sums[o] for o, k in kept.items()})
    ahead = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.groupBy(*groups, "_piece").agg(*[F.sum(k).alias(k) for k in kept.values()])
    carried = carried.select(*groups, "_piece", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_before_{o}") for o, k in kept.items()])
    out = rows.join(carried, [*groups, "_piece"]).withColumns({o: F.col(f"_before_{o}") + F.sum(k).over(inside) for o, k in kept.items()})
    return out.drop("_piece", *kept.values(), *[f"_before_{o}" for o in sums])


def running_mass(df: DataFrame, groups: list[str], value: str, mass: str, tie: list[str] | None = None, out: str = "cum") -> DataFrame:
    """Every row with its inclusive running mass in value order (ties by ``mass``, then ``tie``)."""
    return running_sums(df, groups, list(dict.fromkeys([value, mass, *(tie or [])])), {out: F.col(mass)})


def trimmed_mean(df: DataFrame, groups: list[str], value: str, share: float = 0.1, out: str = "trimmed_mean") -> DataFrame:
    """Mean without the lowest and highest ``share`` of rows: sums of whole buckets, and single values of the two that are cut."""
    return _trimmed(merged_values(df, groups, value, F.lit(1)), groups, share, out)


def _trimmed(merged: DataFrame, groups: list[str], share: float, out: str) -> DataFrame:
    cut = F.floor(F.col("_count") * share)
    first, last = cut, F.col("_count") - cut
    totals = _bucket_totals(merged, groups)
    inner = totals.where((F.col("_base") >= first) & (F.col("_end") <= last)).select(*groups, "_area", F.col("_own").alias("_k"))
    edge = totals.where((F.col("_end") > first) & (F.col("_base") < last) & ((F.col("_base") < first) | (F.col("_end") > last)))
    run = _running(merged, edge.select(*groups, "_bucket", "_base", "_values", "_low", "_high", "_count"), groups, [])
    kept = F.greatest(F.least(F.col("_run"), last) - F.greatest(F.col("_run") - F.col("_mass"), first), F.lit(0))
    parts = inner.unionByName(run.select(*groups, (F.col("_v") * kept).alias("_area"), kept.alias("_k")))
    return parts.groupBy(*groups).agg((F.sum("_area") / F.sum("_k")).alias(out))


def spread(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], centre: str, share: float) -> DataFrame:
    """Quantiles ``probs``, ``mad`` (the median distance from the quantile named ``centre``) and ``trimmed_mean``, all of one summary of the values."""
    merged = merged_values(df, groups, value, F.lit(1))
    quantiles = _quantiles(merged, groups, probs).drop("n")
    join = lambda a, b: a.join(b, groups) if groups else a.join(b, F.lit(True))
    away = join(merged.drop("_bucket"), quantiles.select(*groups, centre)).withColumn("_v", F.abs(F.col("_v") - F.col(centre)))
    away = away.groupBy(*groups, "_v").agg(F.sum("_mass").alias("_mass"), F.sum("_rows").alias("_rows")).withColumn("_bucket", value_bucket("_v"))
    return join(join(quantiles, _quantiles(away, groups, {"mad": 0.5}).drop("n")), _trimmed(merged, groups, share, "trimmed_mean"))


def positions_by_value(df: DataFrame, groups: list[str], value: str, tie: list[str], out: str = "pos") -> DataFrame:
    """1-based position of every row in ascending value order."""
    return running_sums(df, groups, [value, *tie], {out: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Average rank of each row (ties share the mean of their positions)."""
    return df.join(value_ranks(merged_values(df, groups, value, F.lit(1.0)), groups).withColumnsRenamed({"_v": value, "_rank": out}), [*groups, value])


def value_ranks(merged: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ``_v``, ``_rank``): the average rank of the rows of each merged value."""
    near = _bucket_totals(merged, groups).select(*groups, "_bucket", "_base", "_values", "_low", "_high")
    return _running(merged, near, groups, []).select(*groups, "_v", (F.col("_run") - (F.col("_mass") - 1) / 2).alias("_rank"))

"""Connected components of a large edge table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by doubling, and contracts the edges to those ends.  A round at
    least halves the nodes that still have edges, so rounds grow with the
    logarithm of the longest component; steps are sorted joins (nothing that grows
    with the edges is broadcast; skewed keys are split at run time) and map-side combined
    minima on small rows, written to the shared scratch folder.  Self-links and
    null ends are ignored; without edges the result is empty.
    """
    left = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        hooks = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "hooks")
        while True:
            far = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialise(hooks.join(far.hint("merge"), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        rounds.append(hooks)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(hooks.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")).hint("merge"), end)
        left = materialise(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        far = later.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = found.join(far.hint("merge"), "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found

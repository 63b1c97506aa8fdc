"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import materialise

__all__ = ["SLICE", "RecentValues", "free_name", "map_columns", "materialise"]

#: Rows worked on at once inside a task; bounds what Python holds beside the Arrow batch.
SLICE = 256


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Run a batch function over ``df`` in Arrow batches.

    ``make()`` is called once a task and returns a function that takes one list
    per column of ``df`` and returns one list (or array) per output column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


class RecentValues:
    """Values worked out for keys met lately, in two generations of at most ``most`` / 2 keys.

    A key met again moves to the young generation; the old one is dropped when
    the young one is full, so frequent keys stay and rare ones go.
    """

    def __init__(self, work_out: Callable[[list], list], most: int):
        self.work_out, self.most, self.known, self.old = work_out, most, {}, {}

    def hold(self, groups: list[list]) -> dict:
        """A mapping that holds every key of ``groups`` until the next call."""
        if len(self.known) > self.most // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for key in {k for g in groups for k in g if k not in known}:
            if (value := old.get(key)) is not None:
                known[key] = value
            else:
                new.append(key)
        known.update(zip(new, self.work_out(new), strict=True))
        return known


    def values(self, keys: list) -> list:
        """The value of each of distinct ``keys``, in order."""
        if len(self.known) > self.most // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        out, new = list(map(known.get, keys)), []
        for i in [i for i, v in enumerate(out) if v is None]:
            if (value := old.get(keys[i])) is not None:
                known[keys[i]] = out[i] = value
            else:
                new.append(i)
        if new:
            for i, value in zip(new, self.work_out([keys[i] for i in new]), strict=True):
                known[keys[i]] = out[i] = value
        return out


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted

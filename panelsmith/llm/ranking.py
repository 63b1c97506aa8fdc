"""Positions and running sums within keys of any size, over rows sorted by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import free_name, materialise


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo 2 ** 64."""
    out, factor, left = np.ones(len(exponents), dtype=np.uint64), base % (1 << 64), exponents.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)) == 1] *= np.uint64(factor)
        left, factor = left >> np.uint64(1), factor * factor % (1 << 64)
    return out


def ranked(df: DataFrame, key: str, order: list[Column], running: dict[str, tuple[str, int]] | None = None, out: str = "rank") -> DataFrame:
    """``df`` with ``out``, the position from 0 in its ``key``'s ``order``, and running sums.

    ``running`` maps an output to a long column v and an odd number m: the sum, modulo 2 ** 64, of
    v * m ** position over the rows of the key up to this one, itself included (m = 1: a plain sum).

    Rows are sorted by ranges of (key, order), so a key with a third of all rows becomes many tasks;
    ``order`` should end in something that tells rows apart.  Each task numbers its rows
    from 0 while they stream by.  Only a task's last key can go on in the next one, so what earlier
    tasks hold of a key is told by one row a task, which is all that the driver reads.
    ``key`` must not be null; an empty table stays empty.  Pass a written table: it is read twice, for
    the bounds of the ranges and to be sorted.
    """
    running = running or {}
    part = free_name(df, "part")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, held, carried = TaskContext.get().partitionId(), None, 0, dict.fromkeys(running, np.uint64(0))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, at = batch.column(key).to_numpy(zero_copy_only=False), np.arange(n)
            first = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(first, at, -1))
            rank = np.where(start < 0, held + at, at - start)
            columns = [pa.array(rank, pa.int64())]
            for name, (value, factor) in running.items():
                sums = np.cumsum(batch.column(value).to_numpy().view(np.uint64) * (powers(factor, rank) if factor != 1 else np.uint64(1)))
                sums = sums - np.where(start > 0, sums[start - 1], np.uint64(0)) + np.where(start < 0, carried[name], np.uint64(0))
                carried[name] = sums[-1]
                columns.append(pa.array(sums.view(np.int64)))
            last, held = keys[-1], int(rank[-1]) + 1
            names = [*batch.schema.names, part, out, *running]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), *columns], names=names)

    added = [StructField(part, IntegerType()), StructField(out, LongType()), *(StructField(n, LongType()) for n in running)]
    by = [F.col(key).asc_nulls_first(), *order]
    numbered = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, StructType([*df.schema.fields, *added])), "ranked")
    ends = numbered.groupBy(part).agg(F.max(F.struct(key, out, *running)).alias("end")).orderBy(part).collect()
    before, going = {}, None
    for row in ends:
        here, n, *sums = row.end
        if going is not None:
            before[row[part]] = going
        if going is None or going[0] != here:
            going = (here, n + 1, sums)
        else:
            mixed = [(a + b * pow(f, going[1], 1 << 64)) % (1 << 64) for a, b, (_, f) in zip(going[2], sums, running.values(), strict=True)]
            going = (here, going[1] + n + 1, mixed)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tasks, keys = batch.column(part).to_numpy(), batch.column(key).to_numpy(zero_copy_only=False)
            values = {n: batch.column(n).to_numpy().copy() for n in (out, *running)}
            for task in np.unique(tasks):
                if int(task) in before:
                    going_key, n, sums = before[int(task)]
                    goes_on = (tasks == task) & (keys == going_key)
                    values[out][goes_on] += n
                    for (name, (_, factor)), held in zip(running.items(), sums, strict=True):
                        unsigned = values[name].view(np.uint64)
                        unsigned[goes_on] = unsigned[goes_on] * np.uint64(pow(factor, n, 1 << 64)) + np.uint64(held % (1 << 64))
            names = [n for n in batch.schema.names if n != part]
            yield pa.RecordBatch.from_arrays([pa.array(values[n]) if n in values else batch.column(n) for n in names], names=names)

    return numbered.mapInArrow(carry, StructType([f for f in numbered.schema.fields if f.name != part]))

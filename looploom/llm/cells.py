"""Compare the members of many small cells, and of a few very large ones, within bounded tasks.

Similarity operators hash items to cells and must compare the items of a cell with each other. Rows (``cell``, ``id``, payload) are
sorted by cell inside a hash partition and go through Python in batches. Cells of more than ``limit`` rows are first divided into chunks by
hash of the id, and each pair of chunks becomes a task of its own, so no task holds more than two chunks whatever a cell's size, and
no pair of a cell is left out. What a comparison returns should be linear in the rows it got (counts and links to a least member).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def divided(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """``rows`` (``cell``, ``id``, …) joined with ``sizes`` (``cell``, ``n``), as rows with ``task`` (long) and ``side``.

    A cell of at most ``limit`` rows is one task in which all have side 0. Of a larger cell, task (i, i) compares chunk i with itself (side
    0) and task (i, j) the rows of chunk i (side 1) with those of chunk j (side 2).
    """
    d = rows.join(sizes, "cell").withColumn("__chunks", F.ceil(F.col("n") / limit).cast("int"))
    d = d.withColumn("__own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("__chunks")).cast("int"))
    other = F.explode(F.when(F.col("__chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    d = d.select(*rows.columns, "__own", other.alias("__other"))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), 1).otherwise(2)
    return d.select(*rows.columns, F.xxhash64("cell", low, high).alias("task"), side.cast("tinyint").alias("side"))


def runs(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table, np.ndarray], pa.Table | None], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Feed sorted batches to ``compare(table, starts)``: whole tasks only, at least ``least`` rows at a time where there are more.

    ``starts`` holds the first row of each task and the number of rows. Tasks are told apart by (task, cell).
    """
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        task, cell = (t.column(c).to_numpy() for c in ("task", "cell"))
        return np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (cell[1:] != cell[:-1]), True])

    def done(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = compare(t, starts)
        if out is not None and out.num_rows:
            yield from out.combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            starts = bounds(t)
            if len(starts) > 2:  # the last task may go on in the next batch
                yield from done(t.slice(0, starts[-2]), starts[:-1])
                held = t.slice(starts[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from done(t, bounds(t))


def candidate_pairs(starts: np.ndarray, side: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (a, b) of all pairs to compare in each task, as arrays of up to about ``most`` pairs."""
    size = np.diff(starts)
    for lo in (s for s in np.flatnonzero(size > 64)):
        rows = np.arange(starts[lo], starts[lo + 1])
        one, two = (rows[side[rows] == k] for k in (1, 2))
        if len(one) or len(two):
            step = max(1, most // max(1, len(two)))
            for i in range(0, len(one), step):
                yield np.repeat(one[i : i + step], len(two)), np.tile(two, len(one[i : i + step]))
        else:
            step = max(1, most // len(rows))
            for i in range(0, len(rows), step):
                a, b = np.meshgrid(np.arange(i, min(i + step, len(rows))), np.arange(len(rows)), indexing="ij")
                keep = a < b
                yield rows[a[keep]], rows[b[keep]]
    small = np.flatnonzero((size > 1) & (size <= 64))
    if len(small):
        task = np.repeat(small, size[small])
        row = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in small]) if len(small) < 1000 else _ranges(starts[small], size[small])
        end = starts[task + 1]
        for d in range(1, 64):
            ok = row + d < end
            if not ok.any():
                break
            a, b = row[ok], row[ok] + d
            keep = (side[a] == 0) & (side[b] == 0) | (side[a] != side[b]) & (side[a] > 0) & (side[b] > 0)
            yield a[keep], b[keep]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + size)."""
    out = np.ones(size.sum(), dtype=np.int64)
    out[0] = start[0]
    at = np.cumsum(size)[:-1]
    out[at] = start[1:] - (start[:-1] + size[:-1]) + 1
    return np.cumsum(out)


def least_member(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For rows 0 … n-1 joined by links (a, b): the smallest id that each row reaches."""
    at = ids.copy()
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == at).all():
            return at
        at = new

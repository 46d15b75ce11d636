"""Embedding near-duplicates by lattice hashing: random projections decoded to the E8 lattice, neighbouring cells probed, cosine verified.

In each table, a vector (made unit) is projected to 8 dimensions by a seeded Gaussian matrix and stands in the cell of its nearest E8
point; it also probes the neighbouring points (one of the 240 shortest lattice vectors away) within a radius. A pair is found in a table where
one of the two stands in a cell that the other probes or stands in. Rows of cells that could hold a pair, and only those, get their vectors,
are compared in tasks of bounded size and verified in double precision. A pair found more than once is counted where it comes first:
which table and cell that is follows from the two vectors alone, so no list of pairs is made or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from looploom.llm.cells import candidate_pairs, divided, least_member, runs
from looploom.llm.text import free, table
from looploom.operators.components import connected_components
from looploom.tables import materialize

#: Tables, cell width (in units of a projected coordinate's deviation) and probing radius (in lattice units; the covering radius is 1).
TABLES, WIDTH, RADIUS, SEED = 4, 1.0, 1.2, 20240917
CELL_ROWS = 1024


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be integers."""
    whole = [np.bincount([i, j], [a, b], 8) for i, j in combinations(range(8), 2) for a, b in product((2, -2), repeat=2)]
    half = [s for s in product((1, -1), repeat=8) if np.prod(s) == 1]
    return np.array([*whole, *half], dtype=np.int64)


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of 8 coordinates, doubled to be integers."""

    def even(z: np.ndarray) -> np.ndarray:  # nearest point with integer coordinates of even sum
        r = np.rint(z)
        off = z - r
        worst = np.argmax(np.abs(off), axis=1)
        rows = np.flatnonzero(r.sum(axis=1) % 2)
        r[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], b, a)).astype(np.int64)


@cache
def _matrix(dim: int, tables: int, width: float, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, 8 * tables)) / width


def project(x: np.ndarray, tables: int, width: float, seed: int) -> np.ndarray:
    """Projections (rows, tables, 8) of unit rows; summed in a fixed order, so a vector's values don't depend on its batch."""
    m, y = _matrix(x.shape[1], tables, width, seed), np.zeros((len(x), 8 * tables))
    for k in range(x.shape[1]):
        y += x[:, k, None] * m[k]
    return y.reshape(len(x), tables, 8)


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code(points: np.ndarray) -> np.ndarray:
    """One integer for each point."""
    out = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        out = out * np.uint64(1_000_003) + points[..., k].astype(np.uint64)
    return out.view(np.int64)


def _by_dim(b: pa.Table | pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    size = np.diff(b.column(column).combine_chunks().offsets.to_numpy() if isinstance(b, pa.Table) else b.column(column).offsets.to_numpy())
    for dim in np.unique(size):
        yield int(dim), np.flatnonzero(size == dim)


def hashes(classes: DataFrame, tables: int, width: float, radius: float, seed: int) -> DataFrame:
    """(``cell``, ``own``, ``tab``, ``id``) for each table and each own or probed cell of the vectors (``id``, ``label``, ``embedding``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        steps = shortest()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if c.offset == 0 else c.take(pa.array(range(len(c)))) for c in b.columns], b.schema.names)
                for dim, rows in _by_dim(b, "embedding"):
                    part = b.take(pa.array(rows))
                    ids, label = part.column("id").to_numpy(), part.column("label").to_numpy()
                    y = project(_unit(part.column("embedding"), dim), tables, width, seed)
                    for t in range(tables):
                        own = nearest(y[:, t])
                        probe = own[:, None, :] + steps
                        r, k = np.nonzero(((y[:, t, None, :] - probe / 2) ** 2).sum(axis=2) <= radius**2)
                        who = np.r_[np.arange(len(ids)), r]
                        code = np.r_[_code(own), _code(probe[r, k])]
                        flag = np.r_[np.ones(len(ids), bool), np.zeros(len(r), bool)]
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(flag), pa.array(np.full(len(who), t, np.int32)), pa.array(np.full(len(who), dim, np.int32)), pa.array(label[who]), pa.array(ids[who])], ["code", "own", "tab", "dim", "label", "id"])

    rows = classes.select("id", "label", "embedding").mapInArrow(run, "code long, own boolean, tab int, dim int, label long, id long")
    return rows.select(F.xxhash64("label", "dim", "tab", "code").alias("cell"), "own", "tab", "id")


def _comparer(cosine: float, tables: int, width: float, radius: float, seed: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def reaches(point: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether the vectors (projection, own point) stand in or probe the cell of ``point``."""
        d = ((point - own) ** 2).sum(axis=1)  # doubled coordinates: a shortest vector has squared length 8
        return (d == 0) | (d == 8) & (((y - point / 2) ** 2).sum(axis=1) <= radius**2)

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ids, label, own_row, tab, side = (t.column(c).to_numpy() for c in ("id", "label", "own", "tab", "side"))
        copies, lists = t.column("copies").to_numpy(), t.column("embedding").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        x = np.zeros((len(ids), int(size.max())))
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x[rows, :dim] = _unit(lists.take(pa.array(rows)), int(dim))
        pairs = [(np.zeros(0, np.int64),) * 2]
        for a, b in candidate_pairs(starts, side, 400_000):
            keep = (own_row[a] | own_row[b]) & (label[a] == label[b]) & (size[a] == size[b]) & (tab[a] == tab[b])
            a, b = a[keep], b[keep]
            for i in range(0, len(a), 1 << 16):
                p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                pairs.append((p[near], q[near]))
        a, b = (np.concatenate(s) for s in zip(*pairs, strict=True))
        if not len(a):
            return None
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        used, at = np.unique(np.r_[a, b], return_inverse=True)
        y, point = np.zeros((len(used), tables, 8)), np.zeros((len(used), tables, 8), np.int64)
        for dim in np.unique(size[used]):
            rows = np.flatnonzero(size[used] == dim)
            y[rows] = project(x[used[rows], :dim], tables, width, seed)
        for k in range(tables):
            point[:, k] = nearest(y[:, k])
        ia, ib = at[: len(a)], at[len(a) :]
        first = np.ones(len(a), bool)
        for k in range(tables):
            pa_, pb, ya, yb = point[ia, k], point[ib, k], y[ia, k], y[ib, k]
            by_a = reaches(pa_, yb, pb)  # found in the smaller id's cell
            first &= (tab[a] <= k) | ~(by_a | reaches(pb, ya, pa_))
            # in its own table a pair counts in the cell of the smaller id, or in the other's if that is the only one
            first &= (tab[a] != k) | own_row[a] | ~by_a
        links = np.bincount(ia[first], copies[b[first]], len(used)) + np.bincount(ib[first], copies[a[first]], len(used))
        # by id, not by row: the same vector may stand in many cells of this batch
        names, slot = np.unique(ids[used], return_inverse=True)
        least = least_member(len(names), slot[ia], slot[ib], names)
        return pa.Table.from_arrays([pa.array(names), pa.array(np.rint(np.bincount(slot, links, len(names))).astype(np.int64)), pa.array(least)], schema=schema)

    return lambda batches: runs(batches, compare, 20_000)


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, width: float = WIDTH, radius: float = RADIUS, seed: int = SEED) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``) for each row of ``vectors`` (``vec_id``, ``embedding``, ``label``; others are ignored).

    Vectors are linked where labels are equal and not null, lengths are equal, and the cosine (double precision) is at least ``cosine``.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest vec_id that links reach, ``kept`` marks
    it (and, of vectors without an id, those in whose component none has one). Vectors that are null, empty or zero, or hold nulls or
    non-finite numbers, and rows with a null label link with nothing. Equal vectors of a label are one class, known by a key of its own, so
    rows without a vec_id and different vectors that share one are told apart; members of a class are never compared with each other. No
    verified link is wrong; a true link is missed only if no table finds it (see the README for measured recall). Very long vectors are
    read whole; other columns are ignored; an empty table gives an empty one.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False)))
    grouped = v.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
    classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")  # written once, so the keys are fixed
    rows = materialize(hashes(classes, tables, width, radius, seed), "cells")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").select("cell", "n")
    tasks = divided(rows, sizes, CELL_ROWS).join(classes, "id").repartition("task").sortWithinPartitions("task", "cell")
    found = tasks.select("task", "cell", "side", "own", "tab", "id", "label", "copies", "embedding").mapInArrow(_comparer(cosine, tables, width, radius, seed), "id long, links long, least long")
    found = materialize(found, "links")
    joined = connected_components(found, "id", "least")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    members = classes.select("id", "vec").join(joined.withColumnRenamed("node", "id"), "id")
    least = members.groupBy("component").agg(F.min("vec").alias("component_id"))
    moved = materialize(members.join(least, "component").select("id", "component_id", F.lit(True).alias("linked")), "moved")
    named = classes.join(links, "id", "left").join(moved, "id", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec")).alias("component_id"))
    linked = v.where("sound").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; see :func:`embedding_duplicates`."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))

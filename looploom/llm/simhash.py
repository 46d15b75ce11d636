"""SimHash near-duplicates: fingerprints, popcount embedding, grid range-join under Manhattan distance, exact verification.

A fingerprint's 64 bits are cut into 32 segments of two bits and mapped to the vector of segment popcounts (each 0, 1 or 2, packed in one
long). The Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints. If it is at most 3, the 16
coordinates of one half differ by 1 at most in total, so the grid has a cell for each vector of a half: a fingerprint stands in its own
cell and is also sent to the cells one step up in one coordinate; of two vectors one step apart, one reaches the other's cell.
Members of a cell are filtered by the distance of whole vectors and then verified by XOR and bit count. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from looploom.llm.cells import candidate_pairs, divided, least_member, runs
from looploom.llm.text import WORD_RE, free, table
from looploom.operators.components import connected_components
from looploom.tables import materialize

#: The radius that the two halves of the grid make whole; smaller radii are whole too.
MAX_BITS = 3
#: Rows of a cell that one task compares with each other; larger cells are divided.
CELL_ROWS = 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash (unsigned) of a text: bit is 1 where over half the XXH64 hashes (seed 42) of its shingles have a 1; no words: 0."""
    w = WORD_RE.findall(text) if text else []
    if not w:
        return 0
    joined = " ".join(w).encode().translate(_LOWER)
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(joined, 42)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(ends + 1).tolist()]
    ends = [*ends.tolist(), len(joined)]
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)), dtype="<u8", count=len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(``doc_id``, ``fp`` and the long columns ``carry``): the fingerprint of each row's ``text`` as a signed long."""
    names = ["doc_id", *carry, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], names)

    return docs.select(F.col("text").cast("string"), *[F.col(c).cast("long") for c in names[:-1]]).mapInArrow(run, ", ".join(f"{c} long" for c in names))


_ODD = 0x5555555555555555


def popcounts(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, packed in a long (two bits each)."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid(prints: DataFrame) -> DataFrame:
    """(``cell``, ``own``, ``id``) of distinct fingerprints ``fp``: own cells and the cells one step up, in either half."""
    half = F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("pc").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")), F.struct(F.lit(1).alias("h"), F.shiftrightunsigned("pc", 32).alias("v"))))
    d = prints.select(F.col("fp").alias("id"), popcounts(F.col("fp")).alias("pc")).select("id", half.alias("c")).select("id", "c.h", "c.v")
    raised = F.array(*[F.when(F.getbit("v", F.lit(2 * s + 1)) == 0, F.col("v") + F.lit(1 << (2 * s))) for s in range(16)])
    up = F.filter(raised, lambda v: v.isNotNull())
    cells = F.explode(F.concat(F.array(F.struct(F.col("v").alias("v"), F.lit(True).alias("own"))), F.transform(up, lambda v: F.struct(v.alias("v"), F.lit(False).alias("own")))))
    return d.select("id", "h", cells.alias("c")).select((F.col("c.v") * 2 + F.col("h")).alias("cell"), "c.own", "id")


def _linker(max_bits: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ids, own, side = t.column("id").to_numpy(), t.column("own").to_numpy(zero_copy_only=False), t.column("side").to_numpy()
        bits, odd = ids.view(np.uint64), np.uint64(_ODD)
        pc = (bits & odd) + (bits >> np.uint64(1) & odd)
        found_a, found_b = [], []
        for a, b in candidate_pairs(starts, side):
            keep = own[a] | own[b]
            a, b = a[keep], b[keep]
            # Manhattan distance of the packed popcounts (0, 1, 2): |x - y| summed over 32 fields, as a lower bound
            x, y = pc[a], pc[b]
            hi, lo = np.uint64(0xAAAAAAAAAAAAAAAA), odd
            both = x ^ y
            low = np.bitwise_count(both & lo) + np.bitwise_count(both & hi & ~((both & lo) << np.uint64(1))) * 2
            near = low <= max_bits
            a, b = a[near], b[near]
            near = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
            found_a.append(a[near])
            found_b.append(b[near])
        if not found_a or not sum(map(len, found_a)):
            return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        # one link a member of each cell: to the smallest fingerprint that it reaches inside the cell
        used, inverse = np.unique(np.r_[a, b], return_inverse=True)
        least = least_member(len(used), inverse[: len(a)], inverse[len(a) :], ids[used])
        keep = least != ids[used]
        return pa.Table.from_arrays([pa.array(ids[used][keep]), pa.array(least[keep])], schema=schema)

    return lambda batches: runs(batches, compare)


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (``src``, ``dst``) whose components are those of all pairs of distinct fingerprints ``fp`` within ``max_bits`` bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the grid is whole for 0 to {MAX_BITS} bits")
    rows = materialize(grid(prints), "grid")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").select("cell", "n")
    tasks = divided(rows, sizes, CELL_ROWS).repartition("task").sortWithinPartitions("task", "cell")
    return tasks.select("task", "cell", "own", "id", "side").mapInArrow(_linker(max_bits), "src long, dst long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``, ``root`` and the long columns ``carry``) for every row of ``docs`` (``doc_id``, ``text``).

    Texts (A-Z lower-cased) are linked where their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest
    doc_id that links reach (null where no member has one), ``root`` the smallest fingerprint. Equal fingerprints are one class before
    any comparison, so copies cost nothing. Null and empty texts have fingerprint 0 and are linked to each other; texts under ``shingle``
    words are one shingle; very long texts are read whole; repeated rows and rows without a doc_id are members like any other. Other
    columns are ignored; an empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle, carry), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(classes, max_bits)
    joined = connected_components(links)
    members = classes.join(joined.withColumnRenamed("node", "fp"), "fp")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = materialize(members.join(least, "component").select("fp", F.col("component").alias("root"), "component_id"), "moved")
    named = classes.join(moved, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root", *carry)


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component of :func:`simhash_components`: the one with the smallest doc_id.

    A row is known by a 128-bit hash of all its columns, so rows without a doc_id and different rows that share one are told apart. Of
    rows of the smallest doc_id the one with the smallest hash stays, once if the whole row repeats; a row without a doc_id stays where
    no member has one. Rows are shuffled and sorted once, by that hash. An empty table gives an empty one.
    """
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    key = [F.xxhash64(F.lit(k), F.col("text"), rest).alias(f"k{k}") for k in (0, 1)]
    found = simhash_components(docs.select("doc_id", "text", *key), shingle, max_bits, ("k0", "k1"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1")).alias("m"))
    first = materialize(first.select("m.k0", "m.k1"), "first")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key).join(first.hint("merge"), ["k0", "k1"], "left_semi")
    again = F.row_number().over(W.partitionBy("k0", "k1").orderBy("k0"))  # both in the order that the join has made
    return rows.withColumn("again", again).where("again = 1").select("doc.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see :func:`simhash_components`."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

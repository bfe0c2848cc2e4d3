"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

A fingerprint has one bit for each of 64 positions, set when more than
half of the text's three-word shingles have it in their XXH64.  Two
fingerprints link when at most ``RADIUS`` = 3 bits differ.  Links are
found by letting every fingerprint emit the variants within half the
radius: one flip from one side meets two flips from the other.  Of any
three flipped bits two lie in the same 32-bit half, so pairs of flips
are emitted within a half only.  The flips of the leading bits are
shuffled as rows, those of the others are made where the rows arrive;
the shuffle is thus by variant, at 37 rows a fingerprint for 8 leading
bits and 172 for 18.  A cell of the variant space that many distinct
fingerprints reach is cut by further bits.

Everything that meets at a variant within one flip of a fingerprint is
within three bits of it, so a star around the smallest such fingerprint
stands for all pairs and the rows stay linear in the fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import slices
from trailweave.llm.components import connected_components, local_components
from trailweave.llm.scratch import discard, free_names, materialise, split_by_key

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints that one cell of the variant space should hold, about.
CELL = 4000
#: Rows of a cell that is cut further, and the bits that cut it.
HOT_CELL, MORE_BITS = 100_000, 6


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number; 0 for a null, empty or blank text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    width = min(SHINGLE, len(words))
    starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[part], ends[part], strict=True)], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        for k in range(0, len(bits), 255):  # so that a byte holds the sum
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def _pairs(lo: int, hi: int) -> list[int]:
    return [(1 << i) | (1 << j) for i in range(lo, hi) for j in range(lo, i)]


def cell_links(fp: np.ndarray, flips: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one cell: a spanning forest of the fingerprints that meet at its variants.

    ``fp`` are the fingerprints that reach the cell by ``flips`` flips of
    the leading ``bits`` bits; the leading bits of each variant are the
    cell's and cancel, so the rest of the bits alone is compared.
    """
    rest = 64 - bits
    mask = np.uint64((1 << rest) - 1)
    uniq, owner = np.unique(fp, return_inverse=True)
    low = fp & mask
    near, far1, at0 = flips == 0, flips == 1, np.uint64(0)
    ones = np.array([0] + [1 << i for i in range(rest)], np.uint64)
    # within one flip
    lv = np.concatenate([(low[near][:, None] ^ ones).ravel(), low[far1]])
    lo = np.concatenate([np.repeat(owner[near], len(ones)), owner[far1]])
    order = np.lexsort((lo, lv))
    lv, lo = lv[order], lo[order]
    first = np.flatnonzero(np.concatenate(([True], lv[1:] != lv[:-1]))) if len(lv) else np.array([], int)
    keys, heads = lv[first], lo[first]  # the smallest fingerprint at each variant
    a, b = [np.repeat(heads, np.diff(np.append(first, len(lv))))], [lo]
    if len(keys):
        width = 22
        mix = np.uint64(0x9E3779B97F4A7C15)
        slot = lambda v: (v * mix) >> np.uint64(64 - width)
        there = np.zeros(1 << width, bool)
        there[slot(keys)] = True

        def meet(base: np.ndarray, own: np.ndarray, masks: np.ndarray) -> None:
            step = max(1, (1 << 20) // max(len(masks), 1))
            for at in range(0, len(base), step):
                v = base[at : at + step, None] ^ masks
                hit = np.flatnonzero(there[slot(v.ravel())])
                v = v.ravel()[hit]
                pos = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                same = keys[pos] == v
                a.append(heads[pos[same]])
                b.append(own[at + hit[same] // len(masks)])

        # two flips in the same half
        meet(low[near], owner[near], np.array(_pairs(0, 32) + _pairs(32, rest), np.uint64))
        meet(low[far1], owner[far1], np.array([1 << i for i in range(32, rest)], np.uint64))
        meet(low[flips == 2], owner[flips == 2], np.array([at0], np.uint64))
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    code = np.unique(a[keep].astype(np.int64) * len(uniq) + b[keep])
    a, b = code // max(len(uniq), 1), code % max(len(uniq), 1)
    close = np.bitwise_count(uniq[a] ^ uniq[b]) <= RADIUS  # verified
    root = local_components(a[close], b[close], len(uniq))
    moved = np.flatnonzero(root != np.arange(len(uniq)))
    return uniq[moved], uniq[root[moved]]


def _emit(frame: DataFrame, lo: int, hi: int) -> DataFrame:
    """``fp, cell, flips`` -> the rows at all variants of the leading bits ``lo`` to ``hi`` within two flips in all."""
    top = [1 << i for i in range(hi - lo)]
    masks = [0] + top + [x | y for i, x in enumerate(top) for y in top[:i]]
    part = F.shiftrightunsigned("fp", 64 - hi).bitwiseAND((1 << (hi - lo)) - 1)
    return frame.withColumn("mask", F.explode(F.lit(masks).cast("array<long>"))).select(
        "fp", F.shiftleft("cell", hi - lo).bitwiseOR(part.bitwiseXOR(F.col("mask"))).alias("cell"),
        (F.col("flips") + F.bit_count("mask")).cast("int").alias("flips"),
    ).where("flips <= 2")


def _links_in(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        u, v = cell_links(table.column("fp").to_numpy().view(np.uint64), table.column("flips").to_numpy(), bits)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def fingerprint_links(distinct: DataFrame, bits: int, most: int = HOT_CELL) -> DataFrame:
    """Links ``(u, v)`` among the distinct fingerprints in column ``fp``, enough for their components.

    A cell of more than ``most`` rows is cut by the next ``MORE_BITS`` bits,
    again until none is left or a cell has the whole upper half in common.
    """
    start = distinct.select("fp", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("flips"))
    cells, out = _emit(start, 0, bits), None
    while True:
        hot = cells.groupBy("cell").count().where(F.col("count") > most).select("cell")
        hot = materialise(hot, "hot-cells") if bits < 32 else None
        some = hot is not None and not hot.isEmpty()
        part = cells.join(hot, "cell", "left_anti") if some else cells
        found = part.groupBy("cell").applyInArrow(_links_in(bits), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not some:
            return out
        more = min(32, bits + MORE_BITS)
        cells = materialise(_emit(cells.join(hot, "cell", "left_semi"), bits, more), "cells")
        bits = more


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for each row of ``docs``.

    ``component`` is the smallest id reachable over links of at most three
    differing bits.  Null, empty and blank texts have fingerprint zero and
    link like any other; very long texts are hashed in parts of 65536
    shingles, none left out; ties of a bit (half of the shingles) are 0;
    repeated rows give repeated result rows; a null id keeps its row and
    never names a component unless it is alone; an empty table has no rows.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    n = classes.count()
    bits = min(24, max(8, int(np.ceil(np.log2(max(n, 1) / CELL)))))
    links = fingerprint_links(classes.select("fp"), bits)
    comps = materialise(connected_components(links), "simhash-components")
    named = (
        classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_fp = materialise(named.join(least, "root").select("fp", "component"), "simhash-classes")
    discard(classes)
    discard(comps)
    return fps.join(of_fp, "fp", "left").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows of a null id stay.

    Of rows of one id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("id is not null").groupBy("id").agg(
        F.max(F.col("id") == F.col("component")).alias("first"), F.count("*").alias("rows")
    )
    gone = materialise(gone.where("not first or rows > 1"), "gone")
    near, far = split_by_key(docs, [F.col(id_col).cast("long")], gone.select("id"))
    key, first = free_names(docs, "__id", "__first")
    held = near.join(gone.select(F.col("id").alias(key), F.col("first").alias(first)), F.col(id_col).cast("long") == F.col(key), "left")
    stays = held.where(F.col(key).isNull()).select(*docs.columns)
    several = held.where(F.col(first)).select(*docs.columns).dropDuplicates([id_col, text_col])
    return far.unionByName(stays).unionByName(several)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: SimHash components of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )

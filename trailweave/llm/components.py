"""Connected components: inside one task with numpy, across tasks with alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.scratch import discard, materialise


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member index of the component of each of ``n`` nodes under the edges ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links of one orderable type -> ``(node, component)`` for every linked node.

    Large-star and small-star rounds contract every component to a star
    around its smallest node in O(log^2 n) rounds.  Each round is a
    map-combined minimum and an equi-join whose large side adaptive
    execution may split, so a hub with many neighbours is no single
    task's work.  Nothing but two numbers a round reaches the driver.
    """
    tidy = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = materialise(tidy.distinct(), "components")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Near-duplicate embeddings by an exact metric range join (operator 1).

Unit vectors are at cosine ``>= t`` when their Euclidean distance is at
most ``eps = sqrt(2 - 2t)``.  Pivots cut the sphere into cells: a vector's
home is its nearest pivot, and it is replicated to the cells before its home
whose pivot is within ``2 * eps`` of the distance to its home (triangle
inequality) and whose homes reach within ``eps`` of it.  Two partners thus
meet once, in the cell of the one whose home comes first, and cells join
independently.  Each label of more than ``PER_PIVOT`` vectors has pivots of
its own.  Cells of many vectors are cut into blocks; a task compares one
block of homes with one block of members and gives counts and a spanning
forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.components import connected_components, local_components
from trailweave.llm.scratch import discard, materialise

THRESHOLD = 0.98
#: Vectors a pivot, about, and pivots of all labels at most: more only cost replicas.
PER_PIVOT, MAX_PIVOTS = 2048, 4096
#: Vectors that a pivot is chosen among, about.
CANDIDATES = 8
#: Vectors of a block.
BLOCK = 2048
#: Slack of the bounds against rounding.
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit vectors in ``sample``, each the farthest from those before it."""
    chosen = [0]
    near = 1 - sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        chosen.append(k)
        near = np.minimum(near, 1 - sample @ sample[k])
    return sample[chosen]


def homes_of(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector and its distance to that pivot."""
    square = np.maximum(2 - 2 * units @ pivots.T, 0)
    home = square.argmin(axis=1)
    return home, np.sqrt(square[np.arange(len(units)), home])


def cells_of(units: np.ndarray, pivots: np.ndarray, eps: float, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, is_home)`` of each vector and its replicas; ``far`` is each cell's largest distance of a home to its pivot."""
    square = np.maximum(2 - 2 * units @ pivots.T, 0)
    dist = np.sqrt(square)
    home = dist.argmin(axis=1)
    own = np.arange(len(units))
    best = dist[own, home]
    reach = dist <= best[:, None] + 2 * eps + SLACK
    # the bisector between two pivots is farther than eps: the other cell's homes are too
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    reach &= square - (best**2)[:, None] <= 2 * (eps + SLACK) * between + SLACK
    if far is not None:
        reach &= dist <= far[None, :] + eps + SLACK
    reach &= np.arange(len(pivots))[None, :] < home[:, None]
    reach[own, home] = True
    row, cell = np.nonzero(reach)
    return row, cell, home[row] == cell


def _blocks(key: list[str], cells: DataFrame) -> DataFrame:
    """Rows for each pair of a block of homes and a block of members of a cell."""
    sizes = cells.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members"))
    sizes = sizes.where("homes > 0").select(
        *key, F.ceil(F.col("homes") / BLOCK).alias("qn"), F.ceil(F.col("members") / BLOCK).alias("dn")
    )
    sized = cells.join(sizes, key).withColumn("salt", F.xxhash64("cls", F.lit(7)))
    data = sized.select(
        *key, "cls", "v", F.lit(False).alias("query"), F.pmod("salt", "dn").alias("db"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("qb"), "mult", "home",
    )
    query = sized.where("home").select(
        *key, "cls", "v", F.lit(True).alias("query"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("dn") - 1)).alias("db"),
        F.pmod("salt", "qn").alias("qb"), "mult", "home",
    )
    return data.unionByName(query)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each label and length of vectors."""
    names = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
    rows: dict[tuple[str, int], list[int]] = {}
    for k, name in enumerate(names):
        rows.setdefault(name, []).append(k)
    for name, own in rows.items():
        for at in range(0, len(own), 2048):
            yield name, batch.take(pa.array(own[at : at + 2048]))


def range_join(classes: DataFrame, threshold: float, pivots: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """``(cls, other, mult)``: partial link counts and links among distinct vectors.

    ``classes`` has ``cls, label, dim, mult, v``.  A result row either counts
    the vectors linked with ``cls`` in one block (``other`` null) or names a
    link of the spanning forest (``mult`` null).  ``pivots`` are those of each
    label and length; where there are none the vectors are one cell.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    spark = classes.sparkSession
    kind = dict(classes.dtypes)["v"]
    shared = spark.sparkContext.broadcast(pivots)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), part in _by_group(batch):
                home, dist = homes_of(_unit(_matrix(part.column("v"), dim)), shared.value[label, dim])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(home)), pa.array([dim] * len(home), pa.int32()), pa.array(home.astype(np.int32)), pa.array(dist)], ["label", "dim", "cell", "dist"]
                )

    far: dict[tuple[str, int], np.ndarray] = {}
    if pivots:
        named = spark.createDataFrame(list(pivots), "label string, dim int")  # MAX_PIVOTS / 2 rows at most
        held = classes.join(F.broadcast(named), ["label", "dim"]).select("label", "dim", "v")
        far = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
        for r in held.mapInArrow(reach, "label string, dim int, cell int, dist double").groupBy("label", "dim", "cell").agg(F.max("dist").alias("far")).collect():
            far[r["label"], r["dim"]][r["cell"]] = r["far"]
    bounds = spark.sparkContext.broadcast(far)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in _by_group(batch):
                if name in shared.value:
                    row, cell, home = cells_of(_unit(_matrix(part.column("v"), name[1])), shared.value[name], eps, bounds.value[name])
                    part = part.take(pa.array(row))
                else:
                    cell, home = np.zeros(part.num_rows, np.int32), np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("cls", "label", "dim", "mult", "v")), pa.array(cell.astype(np.int32)), pa.array(home)],
                    ["cls", "label", "dim", "mult", "v", "cell", "home"],
                )

    cells = classes.select("cls", "label", "dim", "mult", "v").mapInArrow(
        deal, f"cls long, label string, dim int, mult long, v {kind}, cell int, home boolean"
    )
    key = ["label", "dim", "cell"]

    def meet(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        is_query = table.column("query").to_numpy()
        cls, mult = table.column("cls").to_numpy(), table.column("mult").to_numpy()
        home = table.column("home").to_numpy()
        units = _unit(_matrix(table.column("v"), dim))
        q, d = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        counts, met, a, b = np.zeros(len(q), np.int64), np.zeros(len(d), np.int64), [], []
        for at in range(0, len(q), 512):
            cos = units[q[at : at + 512]] @ units[d].T
            edge = np.argwhere(np.abs(cos - threshold) < 1e-12)
            for i, j in edge:  # the product's rounding must not decide
                cos[i, j] = float(np.longdouble(units[q[at + i]]) @ np.longdouble(units[d[j]]))
            linked = (cos >= threshold) & (cls[q[at : at + 512], None] != cls[d][None, :])
            counts[at : at + 512] = linked @ mult[d]
            met += mult[q[at : at + 512]] @ linked
            i, j = np.nonzero(linked)
            a.append(i + at)
            b.append(j)
        names, index = np.unique(np.concatenate((cls[q], cls[d])), return_inverse=True)
        root = local_components(index[: len(q)][np.concatenate(a)], index[len(q) :][np.concatenate(b)], len(names))
        moved = np.flatnonzero(root != np.arange(len(names)))
        none = lambda k: pa.nulls(k, pa.int64())
        # a replica meets these homes nowhere else; homes of one cell count each other as queries
        far = np.flatnonzero(~home[d] & (met > 0))
        near = np.flatnonzero(counts > 0)
        return pa.table({
            "cls": pa.array(np.concatenate((cls[q][near], cls[d][far], names[moved]))),
            "other": pa.concat_arrays([none(len(near) + len(far)), pa.array(names[root[moved]])]),
            "mult": pa.concat_arrays([pa.array(counts[near]), pa.array(met[far]), none(len(moved))]),
        })

    def guarded(table: pa.Table) -> pa.Table:
        sides = table.column("query").to_numpy()
        if sides.all() or not sides.any():
            return pa.table({k: pa.nulls(0, pa.int64()) for k in ("cls", "other", "mult")})
        return meet(table)

    cells = materialise(cells, "cells")
    return _blocks(key, cells).groupBy(*key, "qb", "db").applyInArrow(guarded, "cls long, other long, mult long")


def pivots_of(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Pivots for each label and length with several cells' worth of vectors, ``MAX_PIVOTS`` in all at most."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per = max(PER_PIVOT, -(-total // MAX_PIVOTS))
    wanted = {(r["label"], r["dim"]): r["n"] // per for r in sizes.where(F.col("n") >= 2 * per).collect()}  # MAX_PIVOTS / 2 rows at most
    if not wanted:
        return {}
    groups = classes.sparkSession.createDataFrame([(label, dim) for label, dim in wanted], "label string, dim int")
    draw = F.pmod(F.xxhash64("v", F.lit("pivots")), F.lit(1 << 30)) / float(1 << 30)
    # about CANDIDATES vectors a pivot, whatever the table
    sample = classes.where(draw < CANDIDATES / per).join(F.broadcast(groups), ["label", "dim"]).select("label", "dim", "v").orderBy("label", "dim", F.xxhash64("v"), "v").toArrow()
    out = {}
    for batch in sample.combine_chunks().to_batches():
        rows: dict[tuple[str, int], list] = {}
        for label, dim, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.setdefault((label, dim), []).append(v)
        for name, vectors in rows.items():
            out[name] = choose_pivots(_unit(np.array(vectors, np.float64)), wanted[name])
    return out


def near_duplicates(
    frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id, n_links, component)`` for each row of ``frame``.

    Vectors are compared when their labels are equal and not null and their
    lengths agree, in double precision.  Null, empty, zero vectors and those
    with null or non-finite components link with nothing, nor do rows of a
    null id name a component.  Each repeated row is a vector of its own and
    links with its copies; a cosine of just ``threshold`` links; very long
    vectors are compared whole; an empty table has no rows.
    """
    kind = dict(frame.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = materialise(
        frame.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v"),
        ).withColumn(
            "valid",
            F.expr(
                "label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or"
                " abs(x) = float('infinity')) and exists(v, x -> x != 0)"
            ),
        ),
        "vectors",
    )
    usable = base.where("coalesce(valid, false)").select("id", "label", "v")
    classes = materialise(
        usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
        .select("label", "v", "rep", "mult", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cls")),
        "vector-classes",
    )
    found = materialise(range_join(classes, threshold, pivots_of(classes)), "vector-links")
    counts = found.where("other is null").groupBy("cls").agg(F.sum("mult").alias("far"))
    comps = connected_components(found.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    named = (
        classes.join(counts, "cls", "left")
        .join(comps.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "label", "v", "rep", (F.col("mult") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("root"),
        )
    )
    named = materialise(named, "vector-named")
    for done in (classes, found):
        discard(done)
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_vector = named.join(least, "root").select("label", "v", "n_links", "component")
    linked = usable.join(by_vector, ["label", "v"]).select("id", "n_links", "component")
    alone = base.where("not coalesce(valid, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: links and components of the whole embeddings table."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x != 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id != b.vec_id and len(a.e) = len(b.e)
   and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n_links from links group by a),
c as (select a, min(b) as least from reach group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links,
       least(e.vec_id, coalesce(c.least, e.vec_id))::bigint as component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""

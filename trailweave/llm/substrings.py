"""Substring deduplication with a log-structured fingerprint index (operator 5).

A window is ``WINDOW`` words of one document.  Its fingerprint is the least
hash of the ``GRAM``-word runs in it, which is the same wherever the window
stands, and changes about once in eighteen windows: consecutive windows of
one fingerprint are one segment, known by the fingerprint ``h`` and the
128-bit digest ``g`` of its words.  The index has sorted immutable runs of
the segments of earlier batches, one for each ``(h, g)``, at its smallest
document.  A run is written in buckets of ``h``, each a file in order of
``(h, g)``; a manifest names the runs, so that a later session opens the
index and goes on.

A new batch is shuffled once and merge-joined with each run.  A segment
known from a smaller document, the digests of whose words agree, repeats as
a whole.  Where a fingerprint has segments of different words, the words of
the windows of one document for each segment are read again and their
digests compared one by one, so windows decide in the end and nothing
shorter does.  The batch's new segments become a run; runs of a level are
compacted into one when there are ``FANOUT`` of them, and their files go.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.bytestream import slices
from trailweave.llm.scratch import delete, discard, in_session, materialise, names_in, own_session, read_text, scratch_root, split_by_key, write_text

WINDOW, GRAM = 50, 16
#: Runs of a level before they are compacted.
FANOUT = 4
#: Batches that the query adds, and runs of a level there: the third batch meets the compacted runs of the first two.
BATCHES, QUERY_FANOUT = 3, 2
#: Bytes of documents for each bucket of an index, its least and most buckets.
PER_BUCKET, BUCKETS = 64 << 20, (8, 1 << 15)
DIGEST = 16
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_KEPT = 400_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Hasher:
    """64-bit word hashes, kept for words that come again."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get, out = self.kept.get, []
        for w in words:
            h = get(w)
            if h is None:
                if len(self.kept) > _KEPT:
                    self.kept.clear()
                h = self.kept[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words of each span, the same wherever it stands."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_B, len(words)), dtype=np.uint64)))
    back = _powers(_B_INV, len(words) + 1)
    return _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a text, joined by one space, and where each begins."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        self.starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Digests of the words from each of ``starts`` to before each of ``ends``."""
        view, new = memoryview(self.joined), hashlib.blake2b
        spans = zip(self.starts[starts].tolist(), (self.starts[ends] - 1).tolist(), strict=True)
        return [new(view[a:b], digest_size=DIGEST).digest() for a, b in spans]


def segments(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(h, lo, hi)`` of the segments of a document: window starts ``lo`` to ``hi`` have fingerprint ``h``."""
    if len(words) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none
    at = np.arange(len(words) - GRAM + 1)
    least = span_hashes(words, at, at + GRAM)
    width, span = WINDOW - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    cut = np.flatnonzero(least[1:] != least[:-1])
    lo, hi = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(least) - 1]))
    return least[lo].view(np.int64), lo, hi


_SEGMENT = "array<struct<h:long,g:binary,lo:int,hi:int>>"


def scan(rows: DataFrame) -> DataFrame:
    """``id, th, text`` -> ``id, th, n_words, sha, segments``: a document's words, their digest and its segments."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            n, sha, parts, digests = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = split_words(text)
                n.append(len(words))
                if len(words) < WINDOW:
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    parts.append(segments(np.empty(0, np.uint64)))
                    continue
                known = Words(words)
                sha.append(hashlib.sha256(known.joined).hexdigest())
                parts.append(segments(hasher(words)))
                digests += known.digests(parts[-1][1], parts[-1][2] + WINDOW)
            h, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
            fields = [pa.array(h), pa.array(digests, pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
            bounds = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), lists.cast(kind)], ["id", "th", "n_words", "sha", "segments"]
            )

    return rows.select("id", "th", "text").mapInArrow(run, f"id long, th long, n_words long, sha string, segments {_SEGMENT}")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``wanted`` at the same ``id, th``; few other texts are shuffled, and none goes to Python."""
    near, _ = split_by_key(rows.select("id", "th", "text"), [F.col("id"), F.col("th")], wanted.select("id", "th"))
    return near.join(wanted.hint("shuffle_hash"), ["id", "th"])


def window_digests(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """``(h, w, id, th, s)``: the digest of each window of the pending segments, from the texts."""
    wanted = materialise(pending.groupBy("id", "th").agg(F.collect_set(F.struct("h", "lo", "hi")).alias("parts")), "pending")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, (text, parts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s = np.concatenate([np.arange(p["lo"], p["hi"] + 1) for p in parts])
                h = np.repeat(np.array([p["h"] for p in parts], np.int64), [p["hi"] - p["lo"] + 1 for p in parts])
                w = Words(split_words(text)).digests(s, s + WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(w, pa.binary()), pa.array(np.full(len(s), ids[k])), pa.array(np.full(len(s), ths[k])), pa.array(s.astype(np.int32))],
                    ["h", "w", "id", "th", "s"],
                )

    return _texts_of(rows, wanted).mapInArrow(run, "h long, w binary, id long, th long, s int")


def without(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(id, th, n_removed, sha, kept)`` of the rows that lose words: ``ranges`` of window starts ``lo`` to ``hi``."""
    wanted = materialise(ranges.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("parts")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sha, kept = [], [], []
            for text, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = split_words(text)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, [p["lo"] for p in parts], 1)
                np.add.at(step, [p["hi"] + WINDOW for p in parts], -1)
                stay = np.cumsum(step[:-1]) == 0
                left = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
                n.append(len(words) - int(stay.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "th", "n_removed", "sha", "kept"],
            )

    return _texts_of(rows, wanted).mapInArrow(run, "id long, th long, n_removed long, sha string, kept string")


_RUN = "h long, g binary, id long, th long, lo int, hi int"


class FingerprintIndex:
    """Runs of the segments of the documents added so far, in a folder that all executors share.

    Batches come in the order of their ids: a later batch has no document
    that an earlier one should be compared with.  The texts stay where they
    are; ``texts`` reads those added so far, where windows must be compared.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS[0], texts: DataFrame | None = None, fanout: int = FANOUT):
        self.fanout = fanout
        self.spark, self.path = own_session(spark), path
        # a bucket is one file in order, and equal hashes of h are enough for a join by h and g
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # a union of bucketed scans has a partition for each of their buckets, whatever its plan says
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        found = [n for n in names_in(self.spark, path) if n.startswith("manifest-") and n.endswith(".json")]
        self.state = json.loads(read_text(self.spark, f"{path}/{found[-1]}")) if found else {"version": 0, "buckets": buckets, "runs": []}
        self.texts = None if texts is None else self._rows(texts)

    def _rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        return in_session(rows.withColumn("th", F.xxhash64("text")), self.spark)

    def run(self, name: str) -> DataFrame:
        """A run as a table, made known to this session if it isn't."""
        table = f"trailweave_{name}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"create table {table} ({_RUN}) using parquet clustered by (h) sorted by (h, g) into {self.state['buckets']} buckets location '{self.path}/{name}'"
            )
        return self.spark.table(table)

    def _write(self, segments: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        n = self.state["buckets"]
        dealt = segments.select("h", "g", "id", "th", "lo", "hi").repartition(n, "h").sortWithinPartitions("h", "g")
        dealt.write.bucketBy(n, "h").sortBy("h", "g").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(f"trailweave_{name}")
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists trailweave_{name}")
        delete(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.run(r["name"]) for r in self.state["runs"]]

    def drop(self) -> None:
        """Remove the index and its files."""
        for r in self.state["runs"]:
            self._drop(r["name"])
        delete(self.spark, self.path)

    def compact(self) -> None:
        """Where a level is full its runs become one of the next, the smallest document for each segment."""
        level = 0
        while len(full := [r for r in self.state["runs"] if r["level"] == level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, [self.run(r["name"]) for r in full])
            first = merged.groupBy("h", "g").agg(F.min_by(F.struct("id", "th", "lo", "hi"), F.struct("id", "th", "lo")).alias("p"))
            new = {"name": self._write(first.select("h", "g", "p.*")), "level": level + 1}
            self._publish([r for r in self.state["runs"] if r not in full] + [new])
            for r in full:
                self._drop(r["name"])
            level += 1

    def _publish(self, runs: list[dict]) -> None:
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs}
        write_text(self.spark, f"{self.path}/manifest-{self.state['version']:09d}.json", json.dumps(self.state))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
        """``(id, n_words, n_removed, sha, kept)`` for each row of ``docs``, which then belong to the index.

        Without ``keep`` they don't: for the last batch of an index that goes.

        A word goes if a window over it also starts in a document of a
        smaller id.  ``kept`` is null where nothing goes, ``sha`` is the
        digest of the kept words joined by one space.  A null text has no
        words; documents of fewer than 50 keep all, very long ones are taken
        whole; a null id is in no order and keeps all.  Rows of one id are
        one document and take nothing from each other; an empty table adds
        nothing and has no rows.
        """
        rows = self._rows(docs, id_col, text_col)
        named = rows.where("id is not null").select("id", "th", "text")
        scanned = materialise(scan(rows), "windows")
        mine = scanned.where("id is not null").select("id", "th", F.explode("segments").alias("p")).select("p.h", "p.g", "id", "th", "p.lo", "p.hi")
        runs, n = self.runs(), self.state["buckets"]
        classes = mine.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        if runs:
            # dealt as the runs are, and joined with each of them in its order
            classes = classes.repartition(n, "h")
            for k, run in enumerate(runs):
                classes = classes.join(run.select("h", "g", F.col("id").alias(f"old{k}")).hint("merge"), ["h", "g"], "left")
            classes = classes.select("h", "g", F.least("first", *(f"old{k}" for k in range(len(runs)))).alias("first"), "last")
        classes = materialise(classes, "segments")
        kinds = classes.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b"))
        unlike = kinds.where("a != b").select("h")
        if runs:
            kinds = materialise(kinds, "kinds")
            unlike = kinds.where("a != b").select("h")
            for run in runs:
                unlike = unlike.unionByName(kinds.repartition(n, "h").join(run.select("h", "g").hint("merge"), "h").where("g != a").select("h"))
            unlike = unlike.distinct()
        unlike = materialise(unlike, "unlike")
        told = (
            classes.join(unlike.withColumn("mixed", F.lit(True)), "h", "left").select("h", "g", "first", "last", F.coalesce("mixed", F.lit(False)).alias("mixed"))
            .where("mixed or first < last")
        )
        met = materialise(mine.join(told, ["h", "g"]).select("h", "g", "id", "th", "lo", "hi", "first", "mixed"), "met")
        pending = met.where("mixed and id = first").select("id", "th", "h", "lo", "hi")
        texts = named
        if runs:
            for run in runs:
                pending = pending.unionByName(run.join(unlike, "h", "left_semi").select("id", "th", "h", "lo", "hi"))
            texts = texts.unionByName(self.texts.select("id", "th", "text"))
        windows = materialise(window_digests(texts, pending), "window-digests")
        first = windows.groupBy("h", "w").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
        first = materialise(first, "repeated")  # by itself, so that a window of very many documents can be split in the join
        again = windows.join(first, ["h", "w"]).where("first < id").select("id", "th", F.col("s").alias("lo"), F.col("s").alias("hi"))
        whole = met.where("first < id").select("id", "th", "lo", "hi")
        ranges = materialise(whole.unionByName(again).join(named.select("id", "th").distinct(), ["id", "th"], "left_semi") if runs else whole.unionByName(again), "ranges")
        for read in (unlike, met, windows, first):
            discard(read)
        changed = materialise(without(named, ranges).dropDuplicates(["id", "th"]), "changed")
        discard(ranges)
        if keep:
            new = mine.join(classes, ["h", "g"]).where("id = first").select("h", "g", "id", "th", "lo", "hi")
            self._publish([*self.state["runs"], {"name": self._write(new), "level": 0}])
            self.compact()
            self.texts = named if self.texts is None else self.texts.unionByName(named)
        discard(classes)
        return scanned.select("id", "th", "n_words", "sha").join(changed.select("id", "th", "n_removed", F.col("sha").alias("sha2"), "kept"), ["id", "th"], "left").select(
            "id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha2", "sha").alias("sha"), "kept"
        )


def buckets_for(docs: DataFrame) -> int:
    """Buckets of an index of ``docs``, by the bytes that Spark expects of them."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # Spark can't tell
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(BUCKETS[1], max(BUCKETS[0], size // PER_BUCKET)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = QUERY_FANOUT) -> DataFrame:
    """All of ``docs`` through a new index, in batches of ascending ids; columns as ``FingerprintIndex.add``."""
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = sorted(set(ids.stat.approxQuantile("id", shares, 0.01))) if shares else []
    index, out, low = FingerprintIndex(spark, f"{scratch_root(spark)}/index-{uuid.uuid4().hex}", buckets_for(docs), fanout=fanout), None, None
    for k in range(len(cuts) + 1):
        part = docs
        if k < len(cuts):
            part = part.where(F.col(id_col) <= int(cuts[k]))
        if low is not None:
            part = part.where(F.col(id_col) > low)
        if k == len(cuts):
            alone = docs.where(F.col(id_col).isNull())
            part = docs if not cuts else part.unionByName(alone)
        found = index.add(part, id_col, text_col, keep=k < len(cuts))
        if k < len(cuts):
            low = int(cuts[k])
        out = found if out is None else out.unionByName(found)
    index.drop()
    return out


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: words that remain of every document."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))

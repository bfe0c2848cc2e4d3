"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A test item of ``m`` characters may be found with ``k = floor(RATE * m)``
edits.  Cut into ``k + 1`` pieces, one piece at least is untouched: an
Aho-Corasick automaton of all pieces finds the exact hits, each of which
says where the item would stand.  Candidates pass the q-gram count bound,
which loses nothing, and Myers' bit-parallel distance decides.

Items of fewer than ``MIN_WORDS`` words are found as they are, between word
borders, since with edits they would be found anywhere.

The automaton of a benchmark of ``BLOCK_CHARS`` characters at most is
broadcast.  A larger benchmark's pieces are a table: documents are read
once, substrings whose hash may be a piece's (a bitmap of ``SLOTS`` bits says
so) meet the pieces in a join, and the same bound and distance decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import slices
from trailweave.llm.scratch import free_names, materialise
from trailweave.llm.substrings import span_hashes

RATE = 0.1
#: Words that an item has at least, to be looked for with edits.
MIN_WORDS = 5
BLOCK_CHARS = 2_000_000
Q = 3
#: Bits of the bitmap of pieces, sent in rows of ``CHUNK`` bits.
SLOTS, CHUNK = 1 << 26, 1 << 20


def normal(text: str | None) -> str:
    """Lower case, white space as one space."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the best place of ``pattern`` in ``text``, the first of equals; None beyond ``most`` edits."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = dict(peq).get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


def budget(text: str, rate: float) -> int:
    """Edits within which a normalised item is looked for."""
    return int(len(text) * rate) if len(text.split()) >= MIN_WORDS else 0


def cut(text: str, k: int) -> list[tuple[int, int]]:
    """The places of an item's ``k + 1`` pieces."""
    return list(pairwise(len(text) * j // (k + 1) for j in range(k + 2)))


@lru_cache(maxsize=20_000)
def grams_of(pattern: str) -> list[str]:
    return [pattern[j : j + Q] for j in range(len(pattern) - Q + 1)]


def best_place(text: str, pattern: str, k: int, starts: list[int], short: bool) -> tuple[int, int, int] | None:
    """``(distance, start, end)`` of an item's best place about some ``starts``, the first of equals."""
    if short:
        for s in starts:
            e = s + len(pattern)
            if s >= 0 and text[s:e] == pattern and (s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " "):
                return 0, s, e
        return None
    best, spans = None, []
    for s in starts:
        lo, hi = max(0, s - k), min(len(text), s + len(pattern) + k)
        if spans and lo <= spans[-1][0] + 2 * k + 8:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    grams = grams_of(pattern)
    for lo, hi in spans:
        window = text[lo:hi]
        have = {window[j : j + Q] for j in range(len(window) - Q + 1)}
        if sum(g in have for g in grams) < len(grams) - k * Q:
            continue
        got = myers(pattern, window, k)
        if got and (best is None or got[0] < best[0]):
            back = myers(pattern[::-1], window[: got[1]][::-1][: len(pattern) + k], got[0])
            best = got[0], lo + got[1] - back[1], lo + got[1]
    return best


class Matcher:
    """Automaton of the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(t, rate), len(t.split()) < MIN_WORDS) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, k, _) in enumerate(self.items):
            for a, b in cut(text, k):
                pieces[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, distance, start, end)`` of each item's best place in a normalised text."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                starts[n].add(end - length + 1 - offset)
        out = []
        for n in sorted(starts):
            item, pattern, k, short = self.items[n]
            best = best_place(text, pattern, k, sorted(starts[n]), short)
            if best:
                out.append((item, *best))
        return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of a normalised text's spans in the text itself."""
    places: list[int] = []
    gap = True
    for at, c in enumerate(text):
        if c.isspace():
            if not gap:
                places.append(at)
            gap = True
        else:
            places.extend([at] * len(c.lower()))
            gap = False
    return [(places[s], places[e - 1] + 1) for s, e in spans]


_FOUND = "item long, distance int, start int, end int"


def _items(benchmark: DataFrame, item_col: str, text_col: str, least_words: int) -> DataFrame:
    """``(item, pattern)``: items that are not empty, normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            keep = [bool(t) and len(t.split()) >= least_words for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["item", "pattern"]).filter(pa.array(keep, pa.bool_()))

    return benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "item long, pattern string")


def _piece_hashes(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    for n in lengths:
        if n <= len(codes):
            at = np.arange(len(codes) - n + 1)
            yield n, span_hashes(codes, at, at + n).view(np.int64)


def _text_matches(rows: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """``(th, item, distance, start, end)`` for the different texts of ``th, text``, through a join of pieces."""
    spark = rows.sparkSession
    items = materialise(items.withColumn("n", F.monotonically_increasing_id()), "items")

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for n, text in zip(batch.column("n").to_pylist(), batch.column("pattern").to_pylist(), strict=True):
                for a, b in cut(text, budget(text, rate)):
                    (_, h), = _piece_hashes(text[a:b], [b - a])
                    found.append((int(h[0]), b - a, n, a))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["h", "length", "n", "offset"])

    pieces = materialise(items.mapInArrow(chop, "h long, length int, n long, offset int"), "pieces")
    lengths = sorted(r[0] for r in pieces.select("length").distinct().collect())  # ten at most, by the rate

    def chunk(table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, bool)
        bits[table.column("slot").to_numpy() % CHUNK] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.pmod(F.col("h"), F.lit(SLOTS))
    slots = pieces.select(slot.alias("slot")).distinct().withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    packed = np.zeros(SLOTS // 8, np.uint8)  # SLOTS bits, whatever the benchmark
    for r in slots.groupBy("chunk").applyInArrow(chunk, "chunk long, bits binary").toLocalIterator():
        packed[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(packed)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches, 16):
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, h in _piece_hashes(normal(text), lengths) if text else ():
                    at = h % SLOTS
                    pos = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[pos]), pa.array(np.full(len(pos), n, np.int32)), pa.array(np.full(len(pos), th)), pa.array(pos.astype(np.int32))], ["h", "length", "th", "pos"]
                    )

    starts = rows.mapInArrow(hits, "h long, length int, th long, pos int").join(pieces, ["h", "length"]).select("th", "n", (F.col("pos") - F.col("offset")).alias("s"))
    starts = materialise(starts.groupBy("th", "n").agg(F.sort_array(F.collect_set("s")).alias("starts")), "starts")
    texts = rows.join(starts.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found, last, low = [], None, ""
            for th, text, item, pattern, at in zip(*(batch.column(c).to_pylist() for c in ("th", "text", "item", "pattern", "starts")), strict=True):
                if th != last:
                    last, low = th, normal(text)
                best = best_place(low, pattern, budget(pattern, rate), at, len(pattern.split()) < MIN_WORDS)
                if best:
                    (s, e), = original_spans(text, [best[1:]])
                    found.append((th, item, best[0], s, e))
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["th", "item", "distance", "start", "end"]
            )

    return starts.join(items, "n").join(texts, "th").select("th", "text", "item", "pattern", "starts").mapInArrow(verify, f"th long, {_FOUND}")


def _few(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items themselves if they are few enough to broadcast."""
    chars = items.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if chars <= BLOCK_CHARS else None


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = RATE,
) -> DataFrame:
    """``(id, item, distance, start, end)``: each item's best place in each document that has it.

    Texts are compared in lower case with white space as one space; ``start``
    and ``end`` are code points of the document as it is.  Items of fewer
    than five words are found as they are, between word borders.  Null and
    empty texts and items have no matches; a very long text is searched
    whole; repeated documents, repeated items and null ids each give their
    rows; of places of one distance the first counts; empty tables have no
    rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col, 1)
    few = _few(items)
    if few is None:
        rows = rows.where("text is not null").withColumn("th", F.xxhash64("text"))
        found = _text_matches(rows.select("th", "text"), items, rate)
        return rows.select("id", "th").join(found, "th").select("id", "item", "distance", "start", "end")
    shared = spark.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in slices(batches):
            found = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (got := matcher.find(normal(text))):
                    spans = original_spans(text, [g[2:] for g in got])
                    found += [(i, item, d, s, e) for (item, d, _, _), (s, e) in zip(got, spans, strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)],
                ["id", "item", "distance", "start", "end"],
            )

    return rows.mapInArrow(run, f"id long, {_FOUND}")


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
    least_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` without the rows that have an item of ``benchmark`` of ``least_words`` words or more.

    A shorter item is no reason to drop a document: a phrase of a few words
    stands in clean texts too.  Null and empty texts and rows of a null id
    are judged by their text like any other; repeated rows go or stay
    together.
    """
    items = _items(benchmark, item_col, item_text_col, least_words)
    few = _few(items)
    if few is None:
        (key,) = free_names(docs, "__th")
        th = F.xxhash64(F.col(text_col).cast("string"))
        found = _text_matches(docs.select(th.alias("th"), F.col(text_col).cast("string").alias("text")).where("text is not null"), items, rate)
        gone = materialise(found.select(F.col("th").alias(key)).distinct(), "contaminated")
        return docs.join(gone, th == F.col(key), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in slices(batches):
            yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: benchmark items found in documents."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "start", "end")

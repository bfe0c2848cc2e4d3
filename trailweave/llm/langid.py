"""Language identification by prediction by partial matching (operator 2).

Each language has a byte context tree of orders 0 to ``ORDER``.  A context
gives a seen byte ``c / (n + d)`` (``n`` bytes seen there, ``d`` of them
different) and escapes with ``d / (n + d)`` to the next shorter context,
whose distribution is renormalised over the bytes not seen.  After training
the statistics are frozen; the code length of a text in a language is the
sum over its bytes, and the shortest code names the language.

The code lengths of all languages are one broadcast table of ``TABLE_BYTES``
at most; languages beyond it have tables of their own and passes of their
own, with the same result.

Trees are fitted on a bounded sample of labelled rows, ``train_docs`` a
language (expected number), drawn by a hash of id and text, so that rows
without an id are drawn each for itself; whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import before, grams, pieces, release, stream, sums, trim
from trailweave.llm.scratch import free_names, materialise

ORDER = 3
#: Documents of a language to train on, and the languages whose counts the driver takes at once.
TRAIN_DOCS, AT_ONCE = 1200, 32
#: Bytes of a table of code lengths; more languages are taken in several passes.
TABLE_BYTES = 400 << 20
#: Bits a byte beyond which no language's code says more than the bytes themselves.
MOST_BITS = 8.0
#: A longest context counts in a language from so many occurrences there on.
MIN_CONTEXT = 2
UNDETERMINED = "und"


@dataclass
class ContextTrees:
    """Frozen code lengths of all languages.

    ``symbol`` maps a byte to its index (0: never seen), ``row`` maps three
    symbols to a row of ``cost``, whose cells are bits for each language.
    """

    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    cost: np.ndarray

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        size = self.cost.shape[1]
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        flat = self.cost.reshape(-1, len(self.languages))
        for at, to in pieces(bounds, 1 << 19):
            part, own = self.symbol[data[bounds[at] : bounds[to]]], bounds[at : to + 1] - bounds[at]
            pad = int(self.symbol[10])
            key = before(part, own, 3, pad).astype(np.int64)
            for back in (2, 1):
                key *= size
                key += before(part, own, back, pad)
            cell = self.row[key].astype(np.int64)
            cell *= size
            cell += part
            out[at:to] = sums(flat[cell], own)
        return out


def symbols_of(gram: np.ndarray) -> np.ndarray:
    """The different bytes of some grams, the padding too."""
    return np.unique(np.concatenate([*((gram >> (8 * k)) & 255 for k in range(4)), [10]]))


def build_trees(counts: pd.DataFrame, seen: np.ndarray | None = None) -> ContextTrees:
    """Trees from rows ``lang, gram, n``; ``gram`` holds three bytes and the byte after them.

    ``seen`` are the bytes of all languages, where these are only some.
    """
    languages = sorted(counts["lang"].unique())
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object)) if languages else np.empty(0, int)
    parts = [(gram >> (8 * k)) & 255 for k in range(4)]
    seen = symbols_of(gram) if seen is None else seen
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size, many = len(seen) + 1, max(len(languages), 1)
    s0, s1, s2, s3 = (symbol[p].astype(np.int64) for p in parts)
    context = (s3 * size + s2) * size + s1
    uniq, index = np.unique(context, return_inverse=True)
    often = np.bincount(lang * len(uniq) + index, n, many * len(uniq)).reshape(many, len(uniq)) >= MIN_CONTEXT
    keep = often.any(0)
    place = np.cumsum(keep) - 1
    deep = int(keep.sum())
    row = (deep + np.arange(size**3, dtype=np.int64) % size**2).astype(np.int32)
    row[uniq[keep]] = place[keep]
    cost = np.zeros((deep + size**2, size, many), np.float32)

    def mix(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        got = count > 0
        total, kinds = count.sum(1, keepdims=True), got.sum(1, keepdims=True)
        escape = np.where(kinds < count.shape[1], kinds, 0)
        left = np.where(got, 0, lower)
        rest = np.maximum(left.sum(1, keepdims=True), 1e-300)
        high = np.maximum(total + escape, 1)
        return np.where(total > 0, np.where(got, count / high, escape / high * left / rest), lower)

    for k in range(len(languages)):
        own = lang == k
        tally = lambda key, rows: np.bincount(key[own] * size + s0[own], n[own], rows * size).reshape(rows, size)  # noqa: B023, E731
        p0 = mix(tally(np.zeros_like(s0), 1), np.full((1, size), 1 / size))
        p1 = mix(tally(s1, size), np.repeat(p0, size, 0))
        p2 = mix(tally(s2 * size + s1, size * size), np.tile(p1, (size, 1)))
        cost[deep:, :, k] = -np.log2(p2)
        some = own & often[k][index]
        c3 = np.bincount(place[index[some]] * size + s0[some], n[some], deep * size).reshape(deep, size)
        cost[:deep, :, k] = -np.log2(mix(c3, p2[uniq[keep] % size**2]))
    return ContextTrees(languages, symbol, row, cost)


def lower_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return stream(pc.utf8_lower(texts))


def table_bytes(counts: pd.DataFrame, size: int) -> int:
    """Bytes of the table that ``build_trees`` makes of the counts, at most."""
    contexts = len(np.unique(counts["gram"].to_numpy(np.int64) >> 8))
    return (contexts + size**2) * size * counts["lang"].nunique() * 4


def fitting(counts: pd.DataFrame, most: int, seen: np.ndarray) -> list[ContextTrees]:
    """Trees of the languages in order, in as many tables as ``most`` bytes each need."""
    names = sorted(counts["lang"].unique())
    if len(names) < 2 or table_bytes(counts, len(seen) + 1) <= most:
        return [build_trees(counts, seen)]
    half = set(names[: len(names) // 2])
    first = counts["lang"].isin(half)
    return fitting(counts[first], most, seen) + fitting(counts[~first], most, seen)


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, most: int = TABLE_BYTES) -> list[ContextTrees]:
    """Trees from ``id, text, lang``, none without a language; rows without text or language are left out."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in sorted(set(names.tolist())):
                data, bounds = lower_bytes(batch.column("text").take(pa.array(np.flatnonzero(names == name))))
                key, n = np.unique(grams(data, bounds, ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "gram", "n"])
        trim()

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(lower_bytes(batch.column(0))[0]).astype(np.int64))], ["byte"])

    def sample_of(some: list[str]) -> DataFrame:
        share = F.create_map(*[F.lit(x) for lang in some for x in (lang, min(1.0, train_docs / sizes[lang]))])
        return rows.where(F.col("lang").isin(some)).where(draw < share[F.col("lang")])

    parts = [sorted(sizes)[at : at + AT_ONCE] for at in range(0, len(sizes), AT_ONCE)]
    seen: set[int] = {10}
    for some in parts if len(parts) > 1 else []:
        seen |= {r["byte"] for r in sample_of(some).select("text").mapInArrow(bytes_of, "byte long").distinct().collect()}  # 256 at most
    out = []
    for some in parts:
        counted = sample_of(some).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
        counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        if len(counted):
            out += fitting(counted, most, np.array(sorted(seen)) if len(parts) > 1 else symbols_of(counted["gram"].to_numpy(np.int64)))
    return out


def lettered(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)


def _passes(rows: DataFrame, models: list[ContextTrees], text_col: str, names: tuple[str, str, str], without: str | None = None) -> DataFrame:
    """``rows`` with the best language (null without a letter), its bits and all languages' weight against it, table by table.

    Column ``without`` is left out in the end.
    """
    best, bits, weight = names
    rows = rows.withColumns({best: F.lit(None).cast("string"), bits: F.lit(float("inf")), weight: F.lit(0.0)})
    for k, trees in enumerate(models):
        shared = rows.sparkSession.sparkContext.broadcast(trees)
        out = [c for c in rows.columns if c != without or k + 1 < len(models)]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, out=out) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                texts = batch.column(text_col)
                there = lettered(texts)
                got = shared.value.bits(*lower_bytes(texts))
                at = got.argmin(1)
                least, was = got[np.arange(len(got)), at], batch.column(bits).to_numpy()
                now = np.minimum(least, was)
                old = np.where(np.isinf(was), 0.0, batch.column(weight).to_numpy() * np.exp2(np.maximum(now - np.where(np.isinf(was), now, was), -1000)))
                new = np.exp2(np.maximum(now[:, None] - got, -1000)).sum(1)
                named = np.where(least < was, np.array(shared.value.languages, object)[at], np.array(batch.column(best).to_pylist(), object))
                named = pa.array(np.where(there, named, None), pa.string())
                done = {best: named, bits: pa.array(now), weight: pa.array(old + new)}
                yield pa.RecordBatch.from_arrays([done[c] if c in done else batch.column(c) for c in out], out)

        rows = rows.mapInArrow(run, rows.select(*out).schema)
        if k + 1 < len(models):
            rows = materialise(rows, "languages")
    return rows


def predict(docs: DataFrame, models: list[ContextTrees]) -> DataFrame:
    """``id, text`` -> ``id, lang_pred, score, bits`` (``score``: the posterior of the language, all alike before)."""
    rows = _passes(docs.select("id", "text"), models, "text", ("lang_pred", "bits", "weight"), "text")
    known = F.col("lang_pred").isNotNull()
    return rows.select(
        "id", F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.when(known, 1 / F.col("weight")).otherwise(0.0).alias("score"),
        F.when(known, F.col("bits")).otherwise(0.0).alias("bits"),
    )


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    training: Column | None = None, train_docs: int = TRAIN_DOCS,
) -> DataFrame:
    """``(id, lang_pred, score, bits)`` for each row of ``docs``.

    Trees are learned from the rows where ``training`` holds (all, if none is
    given).  A null text, one without a letter, and every text when no
    language could be learned are ``und`` at score 0.  Ties go to the first
    language in order; a very long text is scored whole; repeated rows and
    null ids keep their rows; an empty table has no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if training is None else training).alias("training"),
    )
    return predict(rows, train(rows.where("training").select("id", "text", "lang"), train_docs))


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, most_bits: float = MOST_BITS
) -> DataFrame:
    """``docs`` without the rows whose language can't be told; trees are learned from all labelled rows.

    Null texts and texts without a letter go, and texts that the best
    language's code makes longer than ``most_bits`` bits a byte: they are
    like nothing that was learned.  Without any labelled row nothing can be
    told and all go.  Repeated rows and null ids are judged each by its text.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    names = tuple(free_names(docs, "__best", "__bits", "__weight"))
    rows = _passes(docs, train(named, train_docs), text_col, names)
    size = F.octet_length(F.lower(F.col(text_col).cast("string")))
    return rows.where(F.col(names[0]).isNotNull() & (F.col(names[1]) <= most_bits * size)).select(*docs.columns)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, training=~held_out("doc_id", 4, 2)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "bits")

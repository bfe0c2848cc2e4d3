"""Language-model scores from a probabilistic suffix tree (operator 10).

The tree models the bytes of a text's tokens, joined by one space and ended
by one end mark.  A context of up to ``DEPTH`` bytes becomes a state when it
occurs ``LEAST`` times in training, whatever the corpus, and its next-symbol
distribution diverges from that of its longest proper suffix by ``GAIN``
bits in all (or a longer state needs it).  Distributions are smoothed with
the suffix's, each weighted by the number of different symbols seen; a text
is scored by the longest suffix state at each byte.

The states grow with the corpus, so they are never in one place: texts are
cut into slices, the different grams of the slices get their probabilities
in the families whose states they need, and a join brings them back to the
slices.  Only the counts of single bytes after two (2**24 at most, whatever
the corpus) are broadcast.

The unigram base is counted exactly over all tokens.  Counts of the most
frequent ``FREQUENT`` tokens at most are broadcast; every other token of a
document meets its count in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import before, grams, pieces, slices, sums, trim
from trailweave.llm.langid import held_out
from trailweave.llm.scratch import discard, materialise

DEPTH, LEAST, GAIN = 5, 2, 4.0
FREQUENT = 200_000
END = 10
#: Distinct tokens that a task holds before it passes their counts on, and bytes whose contexts it counts at once.
HELD, CHUNK = 200_000, 1 << 20
#: Bytes of texts that meet the probabilities of their grams at once.
SLICE = 16 << 20
#: Grams whose probabilities are found at once, about.
GROUP = 100_000


def tokens(text: str | None) -> list[bytes]:
    """Words in ASCII lower case; the end mark is not among them."""
    return (text or "").encode().lower().split()


def byte_stream(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    texts = [b" ".join(words) + b"\n" for words in lists]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def token_counts(docs: DataFrame) -> DataFrame:
    """``text`` -> ``(token, n)``; the end mark is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                held[b""] += 1
                if len(held) > HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class _Slice:
    """Texts of one task that follow each other, until they are ``SLICE`` bytes."""

    def __init__(self, uid: int):
        self.first, self.texts, self.sizes, self.flags, self.size = uid, [], [], [], 0

    def add(self, words: list[bytes], training: bool) -> None:
        text = b" ".join(words) + b"\n"
        self.texts.append(text)
        self.sizes.append(len(text))
        self.flags.append(training)
        self.size += len(text)

    def packed(self) -> bytes:
        head = np.array([self.first, len(self.sizes)], np.int64).tobytes()
        body = head + np.array(self.sizes, np.int64).tobytes() + np.array(self.flags, np.uint8).tobytes() + b"".join(self.texts)
        return len(body).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(body, asbytes=True)


def unpacked(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The number of a slice's first text, whether each is training text, and their byte stream."""
    body = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    first, n = np.frombuffer(body, np.int64, 2).tolist()
    sizes = np.frombuffer(body, np.int64, n, 16)
    flags = np.frombuffer(body, np.uint8, n, 16 + 8 * n).astype(bool)
    return first, flags, np.frombuffer(body, np.uint8, offset=16 + 9 * n), np.concatenate([[0], np.cumsum(sizes)])


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(where, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def slice_grams(flags: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of a stream (``DEPTH`` bytes and the byte after them), each with its count in training texts."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at, to in pieces(bounds, CHUNK):
        own = bounds[at : to + 1] - bounds[at]
        gram = grams(data[bounds[at] : bounds[to]], own, DEPTH)
        training = np.repeat(flags[at:to], np.diff(own))
        parts.append(np.unique(gram[training], return_counts=True))
        other = np.unique(gram[~training])
        parts.append((other, np.zeros(len(other), np.int64)))
        if sum(len(k) for k, _ in parts[1:]) > 2 * len(parts[0][0]) + CHUNK:
            parts = [_folded(parts)]
    return _folded(parts)


def gram_counts(slices_: DataFrame) -> DataFrame:
    """``(slice, blob)`` -> ``(slice, gram, n)``: each slice's different grams with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, n = slice_grams(*unpacked(batch.column(1)[0].as_py())[1:])
            for at in range(0, len(key), 200_000):
                part = key[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[0].as_py())), pa.array(part), pa.array(n[at : at + 200_000])], ["slice", "gram", "n"])

    return slices_.mapInArrow(run, "slice long, gram long, n long")


def _levels(gram: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each depth the grams of that context length with their counts, sorted."""
    out = {DEPTH: (gram, n)}
    for depth in range(DEPTH - 1, -1, -1):
        key, where = np.unique(out[depth + 1][0] & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        out[depth] = key, np.bincount(where, out[depth + 1][1], len(key)).astype(np.int64)
    return out


@dataclass
class Second:
    """The counts of level 2 in training: 2**24 grams of three bytes at most, whatever the corpus."""

    gram: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        self.context, where = np.unique(self.gram >> 8, return_inverse=True)
        self.total = np.bincount(where, self.n, len(self.context))
        self.kinds = np.bincount(where, minlength=len(self.context))


def retained(gram: np.ndarray, n: np.ndarray, least: float, second: Second | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Levels 2 and longer of the grams of some families, without the contexts that aren't states.

    A family has all grams whose context ends in the same two bytes, or in
    the same three if the counts of level ``second`` are given; level 2 is
    left out then.
    """
    order = np.argsort(gram)
    levels = _levels(gram[order], n[order])
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    needed = np.empty(0, np.int64)
    for depth in range(DEPTH, 1 if second is None else 2, -1):
        key, count = levels[depth]
        context, where = np.unique(key >> 8, return_inverse=True)
        total = np.bincount(where, count, len(context))
        if depth > 2:
            if depth == 3 and second is not None:
                short, scount, sctx, stotal = second.gram, second.n, second.context, second.total
            else:
                short, scount = levels[depth - 1]
                sctx, swhere = np.unique(short >> 8, return_inverse=True)
                stotal = np.bincount(swhere, scount, len(sctx))
            cut = (1 << (8 * (depth - 1))) - 1
            p_short = scount[np.searchsorted(short, key & ((cut << 8) | 255))] / stotal[np.searchsorted(sctx, (key >> 8) & cut)]
            bits = np.bincount(where, count * np.log2(count / total[where] / p_short), len(context))
            state = (total >= least) & ((bits >= GAIN) | np.isin(context, needed))
            needed = np.unique(context[state] & cut)
        else:
            state = (total >= least) | np.isin(context, needed)
        chosen = state[where]
        kept[depth] = key[chosen], count[chosen]
    if second is None:
        kept[-2] = levels[2]  # the whole level, for the shorter ones
    return kept


@dataclass
class SuffixTree:
    """States in rows; row 0 is the empty context, the last row has no longer ones."""

    symbol: np.ndarray
    child: np.ndarray
    logp: np.ndarray

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each text of the stream."""
        out = np.zeros(len(bounds) - 1)
        size, dead = self.child.shape[1], len(self.child) - 1
        child, logp = self.child.ravel(), self.logp.ravel()
        for at, to in pieces(bounds, 1 << 19):
            own = bounds[at : to + 1] - bounds[at]
            part = self.symbol[data[bounds[at] : bounds[to]]]
            best = np.zeros(len(part), np.int64)
            here = best
            for back in range(1, DEPTH + 1):
                here = child[here * size + before(part, own, back, int(self.symbol[END]))].astype(np.int64)
                found = here > 0
                best = np.where(found, here, best)
                here = np.where(found, here, dead)
            out[at:to] = sums(logp[best * size + part], own)
        return out


def build_tree(rows: pd.DataFrame) -> SuffixTree:
    """A tree in one place, from rows ``depth, gram, n``; depth -2 holds all grams of two bytes' context.

    The query doesn't make one; it is what the partitioned model is tested with.
    """
    by = {int(d): (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for d, g in rows.groupby("depth")}
    whole = by.pop(-2, (np.array([], np.int64), np.array([])))

    def shorter(keep: int) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(whole[0] & ((1 << (8 * (keep + 1))) - 1), return_inverse=True)
        return key, np.bincount(where, whole[1], len(key))

    by |= {0: shorter(0), 1: shorter(1)}
    seen = np.unique(np.append(by[0][0], END))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1
    contexts = {0: np.zeros(1, np.int64)}
    offset, total = {0: 0}, 1
    for depth in range(1, DEPTH + 1):
        contexts[depth] = np.unique(by[depth][0] >> 8) if depth in by else np.empty(0, np.int64)
        offset[depth], total = total, total + len(contexts[depth])
    child = np.zeros((total + 1, size), np.int32)
    p = np.zeros((total + 1, size), np.float32)
    floor = np.full(size, 1 / 256)
    for depth in range(DEPTH + 1):
        context = contexts[depth]
        if not len(context):
            continue
        gram, n = by.get(depth, (np.empty(0, np.int64), np.empty(0)))
        count = np.zeros((len(context), size), np.float32)
        if len(gram):
            np.add.at(count, (np.searchsorted(context, gram >> 8), symbol[gram & 255]), n)
        if depth:
            parent = offset[depth - 1] + np.searchsorted(contexts[depth - 1], context & ((1 << (8 * (depth - 1))) - 1))
            child[parent, symbol[(context >> (8 * (depth - 1))) & 255]] = offset[depth] + np.arange(len(context))
            lower = p[parent]
        else:
            lower = floor[None]
        kinds, all_n = (count > 0).sum(1, keepdims=True), count.sum(1, keepdims=True)
        p[offset[depth] : offset[depth] + len(context)] = np.where(all_n > 0, (count + kinds * lower) / np.maximum(all_n + kinds, 1), lower)
    p[-1] = 1
    return SuffixTree(symbol, child, np.log10(p, out=p))


def first_orders(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probabilities of a byte after one byte, by ``byte before << 8 | byte``, from training counts."""
    count = np.zeros((256, 256))
    count[pair >> 8, pair & 255] = n

    def smoothed(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds, total = (count > 0).sum(1, keepdims=True), count.sum(1, keepdims=True)
        return np.where(total > 0, (count + kinds * lower) / np.maximum(total + kinds, 1), lower)

    return smoothed(count, smoothed(count.sum(0)[None], np.full((1, 256), 1 / 256))).ravel()


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(gram: np.ndarray, n: np.ndarray, base: np.ndarray, second: Second, least: float = LEAST) -> np.ndarray:
    """log10 probability of each gram's last byte by its longest state; the grams are those of some families, ``n`` is 0 for those not in training."""
    p = base[gram & 0xFFFF]
    if not len(second.gram):
        return np.log10(p)

    def longer(p: np.ndarray, own: np.ndarray, key: np.ndarray, count: np.ndarray, state: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        s, there = _at(state, own >> 8)
        k, counted = _at(key, own)
        return np.where(there, (np.where(counted, count[k], 0) + kinds[s] * p) / (total[s] + kinds[s]), p)

    some = second.total >= least
    if some.any():
        p = longer(p, gram & 0xFFFFFF, second.gram, second.n, second.context[some], second.total[some], second.kinds[some])
    seen = n > 0
    if seen.any():
        levels = retained(gram[seen], n[seen], least, second)
        for depth in range(3, DEPTH + 1):
            key, count = levels[depth]
            if not len(key):
                break
            state, where = np.unique(key >> 8, return_inverse=True)
            p = longer(p, gram & ((1 << (8 * (depth + 1))) - 1), key, count, state, np.bincount(where, count), np.bincount(where))
    return np.log10(p)


def gram_scores(counts: DataFrame) -> DataFrame:
    """``(slice, gram, n)`` -> ``(gram, logp)`` for each different gram."""
    spark = counts.sparkSession
    some = counts.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    key, n = some.column("key").to_numpy().astype(np.int64), some.column("n").to_numpy().astype(np.int64)
    second = Second(key, n)
    pair, where = np.unique(key & 0xFFFF, return_inverse=True)
    shared = spark.sparkContext.broadcast((first_orders(pair, np.bincount(where, n, len(pair))), second))

    def run(table: pa.Table) -> pa.Table:
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        return pa.table({"gram": gram, "logp": log_probabilities(gram, n, *shared.value).astype(np.float32)})

    # a group has whole families of three bytes, some GROUP rows and the rest of its largest family
    groups = max(64, -(-counts.count() // GROUP))
    family = F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8).bitwiseAND(0xFFFFFF)), F.lit(groups))
    return counts.groupBy("gram").agg(F.sum("n").alias("n")).groupBy(family.alias("family")).applyInArrow(run, "gram long, logp float")


def slice_scores(slices_: DataFrame) -> DataFrame:
    """``(slice, blob)`` -> ``(uid, score)`` for each text."""
    counts = materialise(gram_counts(slices_), "grams")
    met = counts.select("slice", "gram").join(gram_scores(counts), "gram")

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("gram").to_numpy()
        order = np.argsort(key)
        key, logp = key[order], known.column("logp").to_numpy()[order]
        uids, scores = [np.empty(0, np.int64)], [np.empty(0)]
        for blob in texts.column("blob"):
            first, _, data, bounds = unpacked(blob.as_py())
            uids.append(first + np.arange(len(bounds) - 1))
            for at, to in pieces(bounds, CHUNK):
                own = bounds[at : to + 1] - bounds[at]
                place = np.searchsorted(key, grams(data[bounds[at] : bounds[to]], own, DEPTH))
                scores.append(sums(logp[place], own))
        trim()
        return pa.table({"uid": np.concatenate(uids), "score": np.concatenate(scores)})

    out = slices_.groupBy("slice").cogroup(met.groupBy("slice")).applyInArrow(run, "uid long, score double")
    found = materialise(out, "slice-scores")
    discard(counts)
    return found


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Learned from the rows where ``training`` holds (all, if none is given).
    A null text is empty: its only token is the end.  Without training text
    the base has no tokens (``train_tokens`` 0) and bytes are equally likely.
    A very long text is scored whole; contexts of one count and divergence
    are states alike; repeated rows and null ids keep their rows; an empty
    table has no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.lit(True) if training is None else training).alias("training"))
    known = rows.where("training").select("text")
    counts = materialise(token_counts(known), "tokens")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    # the most frequent tokens, by powers of two: never more than FREQUENT
    power, many = 62, 0
    for p, k in sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("c")).alias("p")).count().collect()), reverse=True):
        if many + k > FREQUENT:
            break
        power, many = p, many + k
    least = 1 << int(power)
    common = {t.encode(): int(c) for batch in counts.where(F.col("c") >= least).toArrow().to_batches() for t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)} if many else {}
    shared = docs.sparkSession.sparkContext.broadcast(common)
    rare_type = pa.list_(pa.struct([("token", pa.string()), ("k", pa.int64())]))
    types = [*[pa.int64()] * 4, pa.float64(), rare_type]
    names = ["uid", "id", "n_tokens", "known", "part", "rare", "slice", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = {t: float(np.log10(c + 0.5)) for t, c in shared.value.items()}
        get = logs.get
        uid = TaskContext.get().partitionId() << 33
        held, done = _Slice(uid), []

        def out(packed: bool) -> pa.RecordBatch:
            """The rows done; the last of a slice carries all its texts."""
            blobs = [None] * (len(done) - 1) + [held.packed() if packed else None]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array([held.first] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names)

        for batch in slices(batches):
            for id_, text, training in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held.size >= SLICE:
                    yield out(True)
                    held = _Slice(uid)
                elif len(done) >= 1024:
                    yield out(False)
                words = tokens(text)
                held.add(words, bool(training))
                words.append(b"")
                found = [get(w) for w in words]
                missed = Counter(w for w, x in zip(words, found, strict=True) if x is None) if None in found else {}
                rare = [{"token": w.decode(), "k": k} for w, k in missed.items()]
                done.append((uid, id_, len(words), len(words) - sum(missed.values()), sum(x for x in found if x is not None), rare))
                uid += 1
        if done:
            yield out(True)

    scanned = rows.select("id", "text", "training").mapInArrow(
        run, "uid long, id long, n_tokens long, known long, part double, rare array<struct<token:string,k:bigint>>, slice long, blob binary"
    )
    scanned = materialise(scanned, "scores")
    found = slice_scores(scanned.where("blob is not null").select("slice", "blob"))
    scanned = scanned.drop("slice", "blob")
    rare = scanned.select("uid", F.explode("rare").alias("r")).select("uid", "r.token", "r.k")
    met = rare.join(counts.where(F.col("c") < least), "token", "left").groupBy("uid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("far"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("met")
    )
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return scanned.drop("rare").join(found, "uid").join(met, "uid", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("far", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score",
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Query: language-model scores of every document."""
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), training=~held_out("doc_id", 5, 1)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

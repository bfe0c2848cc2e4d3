"""Toxicity by a linear-chain conditional random field (operator 4).

Tokens are runs of letters in lower case; their features are the word and
its prefixes of ``PREFIXES`` letters, since insults are inflected.  Features are those that
occur at least ``RATIO`` times as often in documents labelled toxic, in
``MIN_DOCS`` of them at least and between enough different neighbours, so
that the words of a copied text are none; a prefix stands for all that begin
with it.  The tokens of toxic documents that have such a feature are the
labelled toxic tokens, all others are clean.  The field has a weight for
each feature, a bias and a weight for each transition, and is fitted by
gradient ascent on the conditional likelihood.

A document's tokens get forward-backward marginals - stretches of tokens
without features go through a power of one matrix - and aggregate to the
probability that one token at least is toxic; the offsets of tokens at 0.5
and above are reported.

The field is fitted on a bounded sample: ``TRAIN_TOXIC`` and ``TRAIN_CLEAN``
labelled documents (expected numbers), drawn by a hash of the id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import slices
from trailweave.llm.langid import held_out
from trailweave.llm.scratch import discard, materialise

TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
RATIO, MIN_DOCS = 20.0, 4
#: Different neighbourhoods of a feature: so many for each toxic document, and for each document that has it, at least.
DOC_SHARE, OWN_SHARE = 0.004, 0.08
PREFIXES = (4, 5, 6, 7, 8)
#: Tokens of a training window, and features of a token at most.
SPAN, KINDS = 32, 1 + len(PREFIXES)
STEPS, RATE, PENALTY = 150, 0.15, 1e-4
_TOKEN = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    """The word marked ``=``, its prefixes marked ``^``."""
    return ["=" + token, *("^" + token[:k] for k in PREFIXES if len(token) >= k)]


@dataclass
class Field:
    """A fitted field: state 1 is toxic, 0 clean."""

    weights: dict[str, float]
    bias: float
    turn: np.ndarray

    def __post_init__(self):
        self.starts = {f[1:5] for f in self.weights}
        a = np.exp(self.turn + np.array([0.0, self.bias]))
        values, right = np.linalg.eig(a)
        order = np.argsort(-values.real)
        self._values, self._right = values.real[order], right.real[:, order]
        self._left = np.linalg.inv(self._right)
        first = np.abs(self._right[:, 0]), np.abs(self._left[0])
        both = first[0] * first[1]
        #: The marginal of a token far from any feature.
        self.rest = float(both[1] / both.sum())

    def _power(self, g: int) -> tuple[float, float, float, float]:
        """The matrix of ``g`` tokens without features, but for a factor."""
        f = (self._values[1] / self._values[0]) ** g
        m = self._right[:, :1] * self._left[:1] + f * self._right[:, 1:] * self._left[1:]
        return float(m[0, 0]), float(m[0, 1]), float(m[1, 0]), float(m[1, 1])

    def marginals(self, n: int, hits: list[tuple[int, float]]) -> list[float]:
        """P(toxic) of the tokens at the given places, with their emissions, among ``n`` tokens."""
        t00, t01, t10, t11 = np.exp(self.turn).ravel().tolist()
        forward, a0, a1, was = [], 1.0, 0.0, -1  # a text begins and ends in the clean state
        steps = []
        for at, weight in hits:
            m = self._power(at - was - 1)
            a0, a1 = a0 * m[0] + a1 * m[2], a0 * m[1] + a1 * m[3]
            e = float(np.exp(min(weight + self.bias, 300.0)))
            a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * e
            s = a0 + a1
            a0, a1 = a0 / s, a1 / s
            forward.append((a0, a1))
            steps.append((m, e))
            was = at
        m = self._power(n - was - 1)
        b0, b1 = m[0] * t00 + m[1] * t10, m[2] * t00 + m[3] * t10
        out = []
        for (a0, a1), (m, e) in zip(reversed(forward), reversed(steps), strict=True):
            p, q = a0 * b0, a1 * b1
            out.append(q / (p + q))
            c0, c1 = t00 * b0 + t01 * e * b1, t10 * b0 + t11 * e * b1
            b0, b1 = m[0] * c0 + m[1] * c1, m[2] * c0 + m[3] * c1
            s = b0 + b1
            b0, b1 = b0 / s, b1 / s
        return out[::-1]

    def emission(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(token))

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """``(score, spans)``: the document's score and its toxic tokens' offsets and marginals."""
        low = (text or "").lower()
        tokens, starts = _TOKEN.findall(low), self.starts
        places = [i for i, t in enumerate(tokens) if t[:4] in starts]
        hits = [(i, w) for i in places if (w := self.emission(tokens[i]))]
        if not hits:
            return self.rest, []
        p = self.marginals(len(tokens), hits)
        clean = 1.0 - self.rest
        for x in p:
            clean *= 1.0 - x
        spans = []
        toxic = {i: x for (i, _), x in zip(hits, p, strict=True) if x >= 0.5}
        if toxic:
            spans = [(m.start(), m.end(), toxic[i]) for i, m in enumerate(_TOKEN.finditer(low)) if i in toxic]
            if len(low) != len(text):  # a letter's lower case may be longer than the letter
                at = [k for k, c in enumerate(text) for _ in c.lower()]
                spans = [(at[s], at[e - 1] + 1, x) for s, e, x in spans]
        return 1.0 - clean, spans


def fit(windows: np.ndarray, labels: np.ndarray, weight: np.ndarray, names: list[str]) -> Field:
    """A field from ``windows`` of feature numbers (0: none; last axis: a token's features) and their labels."""
    k = len(names)
    theta, turn, bias = np.zeros(k + 1), np.zeros((2, 2)), -2.0
    moments = [[np.zeros(k + 1), np.zeros(k + 1)], [np.zeros((2, 2)), np.zeros((2, 2))], [0.0, 0.0]]
    total = weight.sum() * windows.shape[1]
    pairs = np.zeros((2, 2))
    for t in range(1, windows.shape[1]):
        np.add.at(pairs, (labels[:, t - 1], labels[:, t]), weight)
    for step in range(1, STEPS + 1):
        theta[0] = 0.0
        emit = theta[windows].sum(2) + bias
        e = np.exp(np.minimum(emit, 60.0))
        a = np.exp(turn)
        n, length = emit.shape
        alpha = np.empty((length, n, 2))
        beta = np.ones((length, n, 2))
        alpha[0] = np.stack([np.ones(n), e[:, 0]], 1)
        for t in range(length):
            if t:
                alpha[t] = alpha[t - 1] @ a
                alpha[t, :, 1] *= e[:, t]
            alpha[t] /= alpha[t].sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(length - 1, 0, -1):
            ahead = beta[t] * np.stack([np.ones(n), e[:, t]], 1)
            joint = alpha[t - 1][:, :, None] * a * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True) * weight[:, None, None]).sum(0)
            back = ahead @ a.T
            beta[t - 1] = back / back.sum(1, keepdims=True)
        both = alpha * beta
        p = (both[:, :, 1] / both.sum(2)).T
        gap = (labels - p) * weight[:, None]
        grads = [np.zeros(k + 1), (pairs - expected) / total, gap.sum() / total]
        for f in range(windows.shape[2]):
            grads[0] += np.bincount(windows[:, :, f].ravel(), gap.ravel(), k + 1)
        grads[0] = grads[0] / total - PENALTY * theta / max(k, 1)
        moved = []
        for g, (m, v) in zip(grads, moments, strict=True):
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moved.append((m, v, RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)))
        moments = [[m, v] for m, v, _ in moved]
        theta, turn, bias = theta + moved[0][2], turn + moved[1][2], bias + moved[2][2]
    return Field({f: float(w) for f, w in zip(names, theta[1:], strict=True)}, float(bias), turn - turn[0, 0])


def distinct_features(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Of a prefix and what begins with it the purer; ``counts`` has toxic and clean documents of each feature."""
    pure = {f: (t + 0.5) / (c + 0.5) for f, (t, c) in counts.items()}
    out = set(counts)
    for f in sorted(counts, key=lambda f: (len(f), f[0] == "=")):
        for k in PREFIXES:
            short = "^" + f[1 : 1 + k]
            if short != f and short in counts and (f[0] == "=" or len(f) - 1 > k):
                if pure[short] >= pure[f]:
                    out.discard(f)
                elif 2 * counts[f][0] >= counts[short][0]:
                    out.discard(short)
    return sorted(out)


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TRAIN_TOXIC, clean_docs: int = TRAIN_CLEAN) -> Field:
    """A field from ``docs (id, text)`` and ``labels (id, toxic)``; an id of several labels is toxic if one says so."""
    labels = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_docs / sizes.get(1, 1))).otherwise(min(1.0, clean_docs / sizes.get(0, 1)))
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    # about toxic_docs + clean_docs ids, whatever the corpus
    sample = docs.join(F.broadcast(labels.where(F.col("toxic").isin(0, 1) & (draw < share))), "id").select("text", "toxic")
    sample = materialise(sample, "toxicity-sample")
    field = _learn(sample)
    discard(sample)
    return field


def _learn(sample: DataFrame) -> Field:
    """A field from ``text, toxic``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for t in set(_TOKEN.findall((text or "").lower())) for f in features(t)}
                tally[toxic].update([*found, ""])  # "" counts the documents
        for toxic, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["f", "toxic", "n"])

    counted = sample.select("text", "toxic").mapInArrow(count, "f string, toxic int, n long").groupBy("f").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    kept = counted.where((F.col("t") >= MIN_DOCS) | (F.col("f") == "")).toArrow().to_pandas()
    every = kept[kept["f"] == ""]
    nt, nc = (int(every["t"].sum()), int(every["c"].sum())) if len(every) else (0, 0)
    kept = kept[(kept["f"] != "") & ((kept["t"] + 0.5) / max(nt, 1) >= RATIO * (kept["c"] + 0.5) / max(nc, 1))]
    spark = sample.sparkSession
    wanted = spark.sparkContext.broadcast(set(kept["f"]))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {f[1:5] for f in wanted.value}
        for batch in slices(batches):
            found = set()
            for text in batch.column(0).to_pylist():
                tokens = ["", *_TOKEN.findall((text or "").lower()), ""]
                for i, token in enumerate(tokens):
                    if token[:4] in starts:
                        near = xxhash.xxh3_64_intdigest(" ".join(tokens[i - 1 : i + 2])) - (1 << 63)
                        found.update((f, near) for f in features(token) if f in wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["f", "near"])

    places = sample.where("toxic = 1").select("text").mapInArrow(around, "f string, near long").groupBy("f").agg(F.countDistinct("near").alias("k")).toArrow().to_pandas()
    kept = kept.merge(places, on="f")
    kept = kept[kept["k"] >= np.maximum(MIN_DOCS, np.maximum(DOC_SHARE * nt, OWN_SHARE * kept["t"]))]
    names = distinct_features({f: (t, c) for f, t, c in zip(kept["f"], kept["t"], kept["c"], strict=True)})
    if not names or not nc:
        return Field({}, float(np.log((nt + 0.5) / (nt + nc + 1))) - 3.0, np.zeros((2, 2)))
    number = {f: i + 1 for i, f in enumerate(names)}
    shared = spark.sparkContext.broadcast(number)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, empty = shared.value, 0
        starts = {f[1:5] for f in number}
        for batch in slices(batches):
            rows, marks = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _TOKEN.findall((text or "").lower())
                for at in range(0, len(tokens), SPAN):
                    part = tokens[at : at + SPAN]
                    if not any(t[:4] in starts for t in part):
                        empty += 1
                        continue
                    got = [[number.get(f, 0) for f in features(t)] for t in part] + [[0]] * (SPAN - len(part))
                    rows.append([x for g in got for x in (g + [0] * KINDS)[:KINDS]])
                    marks.append([int(bool(toxic and any(g))) for g in got])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32())), pa.array([1] * len(rows), pa.int64())], ["w", "y", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([[0] * KINDS * SPAN], pa.list_(pa.int32())), pa.array([[0] * SPAN], pa.list_(pa.int32())), pa.array([empty], pa.int64())], ["w", "y", "n"])

    got = sample.select("text", "toxic").mapInArrow(cut, "w array<int>, y array<int>, n long").groupBy("w", "y").agg(F.sum("n").alias("n")).where("n > 0").toArrow().to_pandas()
    # a fixed order, so that sums and weights do not depend on the order of arrival
    got = got.iloc[sorted(range(len(got)), key=lambda i: (list(got["w"].iloc[i]), list(got["y"].iloc[i])))]
    windows = np.array([list(w) for w in got["w"]], np.int32).reshape(-1, SPAN, KINDS)
    return fit(windows, np.array([list(y) for y in got["y"]], np.int64), got["n"].to_numpy(float), names)


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """``id, text`` -> ``id, score, spans`` (``spans``: start, end and marginal of each toxic token)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [shared.value.tag(t) for t in batch.column("text").to_pylist()]
            spans = [[{"start": s, "end": e, "p": p} for s, e, p in spans] for _, spans in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], ["id", "score", "spans"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double, spans array<struct<start:int,end:int,p:double>>")


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    training: Column | None = None,
) -> DataFrame:
    """``(id, score, spans)`` for each row of ``docs``.

    The field is learned from the labels where ``training`` holds (all, if
    none is given); without any toxic or clean document every score is one
    small constant.  A null text is empty; texts without a feature, empty
    ones too, get the score of a token far from any.  A very long text is
    tagged whole; repeated rows and null ids keep their rows; an id with
    labels of both kinds is toxic; an empty table has no rows.  Offsets are
    code points of the text as it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.lit(True) if training is None else training).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("toxic"))
    return tag(rows, train(rows, known))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: a toxicity score for every document."""
    found = score(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), training=~held_out("doc_id", 5, 0)
    ).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"),
    )

"""Personal data by patterns and information-theoretic sanitisation (operator 9).

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers.
Each distinct value is a protected entity.  A term near a mention discloses
the entity as far as seeing the term tells of it: the pointwise mutual
information ``log2(N * n(a, t) / (n(a) * n(t)))``, counted in documents of
the whole corpus, against the entity's information content
``log2(N / n(a))``.  Terms that reach the share ``ALPHA`` of it, in
``SUPPORT`` different contexts at least, or in all of an entity that has
fewer, but in two, are spans of kind ``term`` wherever they occur, in any
document; ``sanitise`` removes base spans and generalises terms.  Copies of
one passage are one context, so repeating a document discloses nothing, and
an entity of one context has no term that could be told from chance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bytestream import slices
from trailweave.llm.scratch import discard, free_names, materialise, split_by_key

KINDS = ("email", "ip", "card", "phone")
ALPHA, SUPPORT = 0.9, 3
#: Words on either side of a mention that make its context, and letters that a term has at least.
WINDOW, TERM_CHARS = 6, 4
#: Bits of the filter of candidate terms; it only saves work.
FILTER_BITS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{%d,}" % TERM_CHARS)


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: the local part is the run before one."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            floor = match.end()
            out.append((start, floor))
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one text by start, then by kind."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _inside(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a range overlaps one of the spans."""
    order = sorted((s, e) for _, s, e in spans)
    froms, reach = [s for s, _ in order], list(accumulate((e for _, e in order), max))
    return lambda a, b: (k := bisect_left(froms, b)) > 0 and reach[k - 1] > a


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """For each mention its entity, a hash of its context and the terms near it."""
    out = []
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\s]+", text)]
    starts = [w[0] for w in words]
    inside = _inside(spans)
    for kind, s, e in spans:
        k, end = bisect_left(starts, s + 1) - 1, bisect_left(starts, e)
        lo, hi = words[max(0, k - WINDOW)][0], words[min(len(words), end + WINDOW) - 1][1]
        terms = [
            (m[0].lower(), lo + m.start(), lo + m.end())
            for m in _TERM.finditer(text[lo:hi])
            if not inside(lo + m.start(), lo + m.end())
        ]
        value = text[s:e].lower() if kind == "email" else text[s:e] if kind == "ip" else _digits(text[s:e])
        out.append({
            "entity": f"{kind}:{value}",
            "context": xxhash.xxh3_64_intdigest(text[lo:hi].lower().encode()) - (1 << 63),
            "terms": [{"term": t, "s": a, "e": b} for t, a, b in terms],
        })
    return out


_SCAN = (
    "id long, th long, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "mentions array<struct<entity:string,context:long,terms:array<struct<term:string,s:int,e:int>>>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: base counts and spans, and the contexts of its mentions."""
    mention = pa.list_(pa.struct([
        ("entity", pa.string()), ("context", pa.int64()),
        ("terms", pa.list_(pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            spans = [base_spans(t) for t in texts]
            counts = [Counter(k for k, _, _ in s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
                 pa.array([joined(s) for s in spans], pa.string()),
                 pa.array([contexts(t, s) if s else [] for t, s in zip(texts, spans, strict=True)], mention)],
                ["id", "th", "n_email", "n_ip", "n_card", "n_phone", "base", "mentions"],
            )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, _SCAN)


def _slot(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) % FILTER_BITS


def _taken(words: DataFrame) -> np.ndarray:
    """The slots of a table of terms; at most FILTER_BITS numbers, whatever the corpus."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_slot(t) for t in batch.column(0).to_pylist()}), pa.int32())], ["slot"])

    taken = np.zeros(FILTER_BITS, bool)
    taken[words.mapInArrow(slots, "slot int").distinct().toArrow().to_pandas()["slot"].to_numpy(int)] = True
    return taken


def disclosing_terms(docs: DataFrame, scanned: DataFrame, text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``(entity, term)`` above the disclosure threshold, counted over all documents."""
    near = scanned.select("uid", F.explode("mentions").alias("m")).select("uid", "m.entity", "m.context", F.explode("m.terms.term").alias("term"))
    shown = near.groupBy("entity", "term", "context").agg(F.min("uid").alias("uid")).groupBy("entity", "term").agg(
        F.count("*").alias("contexts")
    )
    together = near.groupBy("entity", "term", "uid").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("nat"))
    seen = scanned.select(F.explode("mentions").alias("m")).select("m.entity", "m.context").distinct().groupBy("entity").agg(F.count("*").alias("seen"))
    enough = F.greatest(F.least(F.lit(support), F.col("seen")), F.lit(min(2, support)))
    candidates = materialise(shown.join(seen, "entity").where(F.col("contexts") >= enough).join(together, ["entity", "term"]).select("entity", "term", "nat"), "candidates")
    words = candidates.select("term").distinct()
    taken = _taken(words)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).astype(bool)
        some = bool(there.any())
        known: dict[str, bool] = {}
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
            count.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column(0).to_pylist() if some else []:
                for term in set(_TERM.findall((text or "").lower())):
                    hit = known.get(term)
                    if hit is None:
                        if len(known) > 300_000:
                            known.clear()
                        hit = known[term] = bool(there[_slot(term)])
                    if hit:
                        count[term] += 1
            if len(count) > 200_000:
                yield out()
        yield out()

    if not taken.any():
        return candidates.select("entity", "term").limit(0)
    of_term = docs.select(F.col(text_col).cast("string")).mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("nt"))
    of_entity = (
        scanned.select("uid", F.explode(F.array_distinct("mentions.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("na"))
    )
    total = scanned.count()
    scored = candidates.join(of_term, "term").join(of_entity, "entity")
    pmi = F.log2(F.lit(float(total)) * F.col("nat") / (F.col("na") * F.greatest("nt", "nat")))
    return scored.where((F.lit(total) > F.col("na")) & (pmi >= alpha * F.log2(F.lit(float(total)) / F.col("na")))).select("entity", "term")


def occurrences(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, terms)``: where the terms of ``words`` stand in any document, outside base spans."""
    taken = _taken(words)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))
    places = pa.list_(pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
    some = bool(taken.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).astype(bool)
        known: dict[str, bool] = {}
        for batch in slices(batches):
            out = []
            for id_, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                for m in _TERM.finditer(text or ""):
                    hit = known.get(m[0])
                    if hit is None:
                        if len(known) > 300_000:
                            known.clear()
                        hit = known[m[0]] = bool(there[_slot(m[0].lower())])
                    if hit:
                        found.append({"term": m[0].lower(), "s": m.start(), "e": m.end()})
                if found:
                    inside = _inside(base_spans(text))
                    out.append((id_, th, [x for x in found if not inside(x["s"], x["e"])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), places), strict=True)], ["id", "th", "terms"])

    text = F.col(text_col).cast("string")
    rows = docs if some else docs.limit(0)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    where = rows.mapInArrow(run, "id long, th long, terms array<struct<term:string,s:int,e:int>>")
    return (
        where.select("id", "th", F.explode("terms").alias("t")).select("id", "th", F.col("t.term").alias("term"), F.col("t.s").alias("s"), F.col("t.e").alias("e"))
        .join(words, "term", "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("terms"))
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``(id, th, n_email, n_ip, n_card, n_phone, base, spans)`` for each row of ``docs``; ``th`` is the text's xxhash64.

    ``base`` and ``spans`` are ``kind:start:end`` by start, then by kind
    (email, ip, card, phone, term), in code points.  A null text is empty and
    has no spans.  Repeated rows and null ids keep their rows.
    """
    scanned = materialise(scan(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pii")
    terms = materialise(disclosing_terms(docs, scanned, text_col, alpha, support).select("term").distinct(), "terms")
    extra = occurrences(docs, terms, id_col, text_col).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "terms")
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.split(x, ":")[1].cast("int").alias("s"),
            F.array_position(F.lit([*KINDS, "term"]), F.split(x, ":")[0]).cast("int").alias("k"),
            F.split(x, ":")[2].cast("int").alias("e"),
        ),
    )
    added = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS) + 1).alias("k"), x["e"].alias("e")))
    both = F.array_join(
        F.transform(
            F.array_sort(F.concat(base, added)),
            lambda x: F.concat_ws(":", F.element_at(F.lit([*KINDS, "term"]), x["k"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    return scanned.drop("mentions").join(extra, same, "left").select(
        "id", "th", "n_email", "n_ip", "n_card", "n_phone", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(both).alias("spans")
    )


def redact(text: str, spans: str) -> str:
    """The text with base spans named by kind and terms generalised; of overlapping spans the first in order stays."""
    out, at = [], 0
    for span in spans.split(",") if spans else []:
        kind, s, e = span.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"[{kind.upper()}]"]
        at = max(at, int(e))
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with every span of its texts redacted; rows of a null id lose their base spans only.

    The rows to redact go through a shuffle first, however few there are: a
    task that picks and redacts holds two Python workers at once, and a busy
    executor keeps them, each with what later operators keep in a worker.
    """
    found = find(docs, id_col, text_col, alpha, support)
    wanted = found.where("spans != '' and id is not null").groupBy("id", "th").agg(F.min("spans").alias("spans"))
    wanted = materialise(wanted, "spans")
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))]
    near, far = split_by_key(docs, keys, wanted.select("id", "th"))
    key, hashed, marks = free_names(docs, "__id", "__th", "__spans")
    named = wanted.select(F.col("id").alias(key), F.col("th").alias(hashed), F.col("spans").alias(marks))

    def at_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    def at_base(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redact(t, joined(base_spans(t))) for t in texts], dtype=object)

    redacted, base = F.pandas_udf(at_spans, "string"), F.pandas_udf(at_base, "string")
    rows = near.join(named.hint("shuffle_hash"), (keys[0] == F.col(key)) & (keys[1] == F.col(hashed)), "left")
    clean = F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.coalesce(marks, F.lit(""))))
    changed = rows.withColumn(text_col, clean)
    alone = docs.where(F.col(id_col).isNull()).withColumn(text_col, base(F.col(text_col)))
    return changed.select(*docs.columns).unionByName(far.where(F.col(id_col).isNotNull())).unionByName(alone.select(*docs.columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Query: personal data of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
    )

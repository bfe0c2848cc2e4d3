"""What the review of the first round found to be less than the whole job."""

import math

import numpy as np
import pandas as pd

from trailweave.llm import pii, suffixlm
from trailweave.llm.bytestream import grams


def whole_tree(texts, least):
    data, bounds = suffixlm.byte_stream([suffixlm.tokens(t) for t in texts])
    key, n = np.unique(grams(data, bounds, suffixlm.DEPTH), return_counts=True)
    family = (key >> 8) & 0xFFFF
    parts = [pd.DataFrame({"depth": d, "gram": g, "n": c}) for f in np.unique(family) for d, (g, c) in suffixlm.retained(key[family == f], n[family == f], least).items()]
    return suffixlm.build_tree(pd.concat(parts))


def lm_frame(spark, filler):
    rows = [(k, "xq zzzzzy") for k in range(3)] + [(10 + k, f"the word {k % 97} of the other words {k % 89}") for k in range(filler)]
    return spark.createDataFrame(rows, "doc_id long, text string"), [t for _, t in rows]


def test_lm_context_of_three_is_a_state_in_any_corpus(spark):
    """2.2 MB of training text: a share of 1.5e-6 or more of it would be four occurrences."""
    frame, texts = lm_frame(spark, 66_000)
    assert sum(len(t) + 1 for t in texts) * 1.5e-6 > 3
    got = {r.id: r.score for r in suffixlm.score(frame).where("id < 3").collect()}
    fine, coarse = (whole_tree(texts, least).score(*suffixlm.byte_stream([suffixlm.tokens(texts[0])]))[0] for least in (2.0, 3.2))
    assert abs(fine - coarse) > 1e-3
    assert all(math.isclose(v, fine, rel_tol=1e-4) for v in got.values()) and len(got) == 3


def test_lm_slices_score_as_the_whole_tree(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(suffixlm, "SLICE", 1 << 16)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    training = [t for k, t in rows if k % 3]
    tree = whole_tree(training, float(suffixlm.LEAST))
    want = dict(zip((k for k, _ in rows), tree.score(*suffixlm.byte_stream([suffixlm.tokens(t) for _, t in rows])), strict=True))
    from pyspark.sql import functions as F

    got = {r.id: r.score for r in suffixlm.score(docs, training=F.col("doc_id") % 3 != 0).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-4) for k in want)


def test_disclosing_terms_are_spans_wherever_they_occur(spark):
    filler = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra".split()
    rng = np.random.default_rng(6)
    some = lambda n: " ".join(rng.choice(filler, n))
    rows = [(k, f"{some(12)} quillfeather {some(2)} q.f@example.org {some(12)} Quillfeather {some(3)}") for k in range(6)]
    rows += [(6, f"{some(9)} quillfeather {some(9)}"), (None, f"{some(9)} quillfeather")]
    rows += [(k, f"{some(20)} pennywhistle p.w@example.org {some(20)}") for k in (7, 8)]  # two contexts only
    rows += [(k, some(30)) for k in range(9, 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in pii.find(frame).collect()}
    for k, text in rows:
        got = [s.split(":") for s in found[k].spans.split(",") if s.startswith("term")]
        want = [t for t in text.split() if t.lower() in ("quillfeather", "pennywhistle")]
        assert [text[int(s) : int(e)] for _, s, e in got] == want
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).where("doc_id is not null").collect()}
    assert not any("quillfeather" in t.lower() or "pennywhistle" in t for t in clean.values())

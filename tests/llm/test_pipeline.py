"""The pipeline against a plain version of its stages, and its odd rows."""

import hashlib

import sentencepiece

import corpus_pipeline
from trailweave.llm import decontaminate, pieces, pii, simhash

SF = "/root/testdata/sf0.001"


def plain(rows, items):
    """Ids and texts that stay, by pairwise comparison."""
    rows = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    fps = [simhash.fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] != label[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    moved = True
    first = {}
    for i, (k, _) in enumerate(rows):
        first[label[i]] = min(first.get(label[i], k), k)
    rows = [(k, t) for i, (k, t) in enumerate(rows) if first[label[i]] == k]
    rows = [(k, t) for k, t in rows if not any(x in decontaminate.normal(t) for x in items)]
    return {k: pii.redact(t, pii.joined(pii.base_spans(t))) for k, t in rows}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {}
    for k, text in plain([tuple(r) for r in docs], items).items():
        ids = model.encode(text, add_bos=True, add_eos=True)
        want[k] = len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "one two three four", "en", None, 18), (4, "one two three four", None, "s", 18), (None, "alone here a@b.co", "en", "s", 5), (6, "123 456", "en", "s", 7), (3, "one two three four", "en", None, 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id or 0)
    assert [tuple(r) for r in left] == [(None, "alone here [EMAIL]"), (3, "one two three four")]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

"""Corpus operators against brute force, libraries and planted cases; nulls, empty tables, ties, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trailweave.llm import decontaminate, embeddings, langid, pieces, pii, simhash, substrings, suffixlm, toxicity
from trailweave.llm.components import connected_components, local_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, one very long word, repeated rows, clashing columns."""
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, " \n\t ", None, 0), (None, "a b c d e f", "fr", 1), (5, "x" * 200_000, "de", 2), (6, "one two", "en", 3), (6, "one two", "en", 3), (7, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "score as id", "score as component", "score as th", "score as uid", "score as slot", "score as n_chars", "score as __id", "score as __first", "score as __th", "score as __spans", "score as __bits")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def reach(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    want = reach(600, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked and all(got[x] == want[x] for x in linked)
    a, b = np.array(links).T
    assert local_components(a, b, 600).tolist() == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows, k = [], 0
    for i in range(40):
        for _ in range(1 + i % 6):
            rows.append((k, (base[i] + rng.normal(scale=0.04 * np.linalg.norm(base[i]) / 4, size=16)).astype(np.float32).tolist(), i % 3))
            k += 1
    rows += [(900, rows[3][1], rows[3][2]), (901, [0.0] * 16, 1), (902, None, 1), (903, [math.nan] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, rows[0][1], None), (906, rows[0][1][:8], 0), (907, [2 * x for x in rows[5][1]], rows[5][2]), (908, [], 1), (909, [math.inf] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "label as cls", "label as mult")
    good = [r for r in rows if r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links = Counter()
    edges = []
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                    links[a[0]] += 1
                    edges.append((i, j))
    root = reach(len(good), edges)
    want = {g[0]: good[root[i]][0] for i, g in enumerate(good)}
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(frame).collect()}
    assert len(edges) > 100
    assert got == {r[0]: (links[r[0]], want.get(r[0], r[0])) for r in rows}


def test_embedding_cells_lose_nothing():
    rng = np.random.default_rng(2)
    x = embeddings._unit(np.concatenate([rng.normal(size=(200, 6)), np.repeat(rng.normal(size=(10, 6)), 20, 0) + rng.normal(scale=0.05, size=(200, 6))]))
    pivots = embeddings.choose_pivots(x, 12)
    home, dist = embeddings.homes_of(x, pivots)
    far = np.array([dist[home == c].max(initial=-1.0) for c in range(len(pivots))])
    row, cell, is_home = embeddings.cells_of(x, pivots, math.sqrt(0.04), far)
    members = {c: set(row[cell == c]) for c in set(cell)}
    assert sorted(row[is_home]) == list(range(len(x))) and (cell[is_home] == home[row[is_home]]).all() and (cell <= home[row]).all()
    for i, j in np.argwhere(x @ x.T >= 0.98):
        assert {i, j} <= members[min(home[i], home[j])]


def test_embeddings_of_many_cells(spark, monkeypatch):
    """Pivots, replicas and blocks in play: counts and components against all pairs, doubles that single precision would merge included."""
    monkeypatch.setattr(embeddings, "PER_PIVOT", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 8))
    rows = [(k, (centres[k % 25] + rng.normal(scale=0.09, size=8)).tolist(), "a" if k % 3 else "b") for k in range(420)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(2000, [1.0] + [0.0] * 7, "c"), (2001, [0.98, math.sqrt(1 - 0.98**2) * (1 + 1e-9)] + [0.0] * 6, "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    root = reach(len(rows), list(map(tuple, np.argwhere(near).tolist())))
    want = {r[0]: (int(near[i].sum()), rows[root[i]][0]) for i, r in enumerate(rows)}
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_duplicates(frame).collect()}
    assert got == want and near.sum() > 500 and not near[-1].any()


def test_language(spark, docs, odd, empty):
    out = langid.op2_language_id(spark, "/root/testdata/sf0.001").toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(bool(zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r.id: r.lang_pred for r in got}[1] == "und" and {r.id: r.score for r in got}[3] == 0.0
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_code_lengths_are_those_of_distributions(docs):
    import pyarrow as pa
    from trailweave.llm.bytestream import stream

    rows = docs.where("doc_id % 4 != 2").select("doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
    (trees,) = langid.train(rows)
    total = np.exp2(-trees.cost.astype(float)).sum(1)
    assert np.allclose(total, 1, atol=1e-3)
    whole, parts = trees.bits(*stream(pa.array(["the other one", ""]))), trees.bits(*stream(pa.array(["the other one"])))
    assert np.allclose(whole[0], parts[0]) and not whole[1].any()


def plain_ppm(training, text):
    """Code length of ``text`` in each language of ``training`` (lang, text), context by context."""
    seen = sorted({b for _, t in training for b in t.lower().encode()} | {10})
    size, counts = len(seen) + 1, {}
    for lang, t in training:
        data = b"\n\n\n" + t.lower().encode()
        for at in range(3, len(data)):
            for order in range(4):
                counts.setdefault((lang, data[at - order : at]), Counter())[data[at]] += 1

    def p(lang, context, c):
        lower = (lambda x: p(lang, context[1:], x)) if context else (lambda x: 1 / size)
        got = counts.get((lang, context))
        if not got or len(context) == 3 and sum(got.values()) < langid.MIN_CONTEXT:
            return lower(c)
        escape = len(got) if len(got) < size else 0
        high = sum(got.values()) + escape
        if c in got:
            return got[c] / high
        return escape / high * lower(c) / sum(lower(x) for x in [*seen, None] if x not in got)

    data = b"\n\n\n" + text.lower().encode()
    return {lang: -sum(math.log2(p(lang, data[at - 3 : at], data[at] if data[at] in seen else None)) for at in range(3, len(data))) for lang in sorted({x for x, _ in training})}


def test_language_as_plain_ppm(spark, monkeypatch):
    training = [("aa", "banana band"), ("aa", "an bad nab"), ("bb", "dada dance"), ("bb", "cad dab Dab"), ("cc", "nab\ncab"), ("cc", "bb")]
    texts = ["banana", "Dad danced", "qx nab", "b", "", "12", None, "nab\nnab", "bb bb"]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(training)] + [(100 + k, t, None) for k, t in enumerate(texts)] + [(None, "bands", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = frame.selectExpr("doc_id as id", "text", "lang")
    for most, at_once in ((langid.TABLE_BYTES, 32), (1, 32), (1, 2)):  # one table, and a table and a pass for each language
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        models = langid.train(named, most=most)
        assert len(models) == (1 if most > 1 else 3)
        got = {r.id: r for r in langid.predict(named, models).collect()}
        assert len(got) == len(rows)
        for k, text, _ in rows:
            if text and any(c.isalpha() for c in text):
                bits = plain_ppm(training, text)
                best = min(bits, key=lambda x: (round(bits[x], 4), x))
                assert got[k].lang_pred == best and math.isclose(got[k].bits, bits[best], abs_tol=1e-3)
                assert math.isclose(got[k].score, 1 / sum(2 ** (bits[best] - b) for b in bits.values()), abs_tol=1e-3)
            else:
                assert (got[k].lang_pred, got[k].score) == ("und", 0.0)


def test_language_sample_is_bounded_without_ids(spark):
    rows = spark.range(6000).selectExpr("cast(null as long) as id", "concat('word ', id) as text", "'en' as lang")
    (trees,) = langid.train(rows, train_docs=500)
    small = sum(langid.train(rows.limit(0)) == [] for _ in range(1))
    assert small and trees.languages == ["en"]
    draw = "pmod(xxhash64(id, xxhash64(text), 'langid'), 1073741824) / 1073741824D"
    assert 350 < rows.where(f"{draw} < 500 / 6000D").count() < 650


def test_language_stage_rejects_what_no_code_shortens(spark):
    rows = [(k, "the cat sat on the mat and the dog ran " * 4, "en") for k in range(40)] + [(100, "the dog sat", "en"), (101, "語" * 300, None), (102, "...", "en"), (103, None, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "doc_id as __bits", "text as __best")
    kept = langid.keep_identified(frame, most_bits=2.0)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {*range(40), 100}


@pytest.fixture(scope="module")
def table():
    return pieces.Pieces(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab et▁\n  thé日🙂.,019-=<>", max_size=60)))
def test_pieces_as_library(table, library, text):
    ids, said = table.encode(text)
    want = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want and said == library.decode(want) and table.decode(want) == said


def test_pieces_over_documents(spark, docs, odd, empty, table, library):
    for r in docs.limit(60).collect():
        ids, said = table.encode(r.text)
        want = library.encode(r.text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and said == library.decode(want)
    got = {r.id: r for r in pieces.encode(odd).collect()}
    assert got[1].n_tokens == 2 and got[1].decoded == "" and got[1].ids_sha256 == hashlib.sha256(bytes([1, 0, 0, 0, 2, 0, 0, 0])).hexdigest()
    assert pieces.encode(odd).count() == odd.count() and pieces.encode(empty).count() == 0 and pieces.count_tokens(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab et\n  thé日🙂.,019-=<>", max_size=60)))
def test_counts_as_library(table, unigram, text):
    if pieces.MARK not in text:
        want = len(unigram.encode(pieces.MARK + text.replace(" ", pieces.MARK), add_special_tokens=False).ids) if text else 0
        assert table.count(text) == want


@pytest.fixture(scope="module")
def unigram(table):
    from tokenizers import Tokenizer, models

    return Tokenizer(models.Unigram(list(zip(table.text, table.score, strict=True)), unk_id=0, byte_fallback=True))


def test_toxicity(spark, docs, odd, empty):
    found = toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(found, on="doc_id")
    held = labels[labels.held_out]
    assert (held.toxic == held.predicted).mean() > 0.93 and found.score.between(0, 1).all()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, none).count() == odd.count() and toxicity.score(empty, none).count() == 0


def test_field_marginals():
    import itertools

    field = toxicity.Field({"=bad": 3.0, "^vile": 2.0}, -1.5, np.array([[0.0, -0.7], [-0.4, 0.6]]))
    hits, n = [(0, 3.0), (3, -1.0), (4, 5.0)], 7
    e = np.full(n, field.bias)
    for i, w in hits:
        e[i] += w
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(field.turn[a, b] + e[i] * b for i, (a, b) in enumerate(zip((0, *y), y, strict=False))) + field.turn[y[-1], 0]
        total += math.exp(s)
        mass += math.exp(s) * np.array(y)
    assert np.allclose((mass / total)[[0, 3, 4]], field.marginals(n, hits))
    score, spans = field.tag("so BAD a thing")
    assert 0 < score < 1 and all((s, e) == (3, 6) for s, e, _ in spans)


def brute_windows(rows, size=50):
    first, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            if first.setdefault(key, i) < i:
                gone[s : s + size] = True
        out[i] = len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    shared, rows = [word(n) for n in (49, 50, 51, 80, 200)], []
    for i in range(60):
        text = word(rng.integers(0, 90))
        for _ in range(rng.integers(0, 3)):
            part = shared[rng.integers(5)]
            a = rng.integers(0, 20)
            text += part[a:] + word(rng.integers(0, 30))
        rows.append((int(i * 7 % 61), " ".join(text)))
    rows += [(70, "same " * 300), (71, "same " * 120), (72, rows[0][1]), (73, None), (74, "")]
    want = brute_windows(rows)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
    assert {r.id: (r.n_words, r.n_removed, r.sha) for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_index_is_opened_again(spark, tmp_path):
    """Batches added by sessions that know the index by its folder only give what one pass over all gives; full levels are compacted."""
    rng = np.random.default_rng(13)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    shared, rows = [word(n) for n in (55, 90, 160)], []
    for i in range(40):
        part = shared[rng.integers(3)]
        rows.append((i, " ".join(word(rng.integers(0, 40)) + part[rng.integers(0, 20) :] + word(rng.integers(0, 40)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path, got, levels = f"file://{tmp_path}/index", {}, []
    for k in range(5):
        known = frame.where(f"doc_id < {8 * k}")
        index = substrings.FingerprintIndex(spark.newSession() if k else spark, path, texts=known if k else None, fanout=2)
        for r in index.add(frame.where(f"doc_id >= {8 * k} and doc_id < {8 * k + 8}")).collect():
            got[r.id] = r.n_words, r.n_removed, r.sha
        levels.append(sorted(r["level"] for r in index.state["runs"]))
    assert got == brute_windows(rows) and sum(w[1] > 0 for w in got.values()) > 10
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 2  # compacted runs are gone
    for run in index.runs():
        assert run.count() == run.select("h", "g").distinct().count()
    plan = index.runs()[0].select("h", "g")
    text = plan.join(index.runs()[1].select("h", "g").hint("merge"), ["h", "g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort [" not in text


def test_substrings_odd(odd, empty):
    got = substrings.deduplicate(odd).collect()
    assert len(got) == odd.count() and all(r.n_removed == 0 for r in got)
    assert substrings.deduplicate(empty).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(spark, docs, odd, empty):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    label = reach(len(fps), links)
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], 1 << 60), r.doc_id)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op7_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (fps[i], least[label[i]]) for i, r in enumerate(rows)}
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component for r in got if r.id in (1, 2, 3, 7)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(odd).count() == 4 and simhash.one_of_each(odd).columns == odd.columns


def test_hot_cells_are_cut(spark, monkeypatch):
    """A family whose fingerprints share their leading bits, cut by further bits, has the links of all pairs."""
    rng = np.random.default_rng(12)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ sum(1 << int(i) for i in rng.choice(50, rng.integers(1, 7), replace=False)) for _ in range(300)}
    fps = np.array(sorted(fps), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [(r.u, r.v) for r in simhash.fingerprint_links(frame, 8, most=50).collect()]
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert all((int(u) ^ int(v)) & ((1 << 64) - 1) for u, v in got)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert reach(len(fps), [(at[u], at[v]) for u, v in got]) == reach(len(fps), want)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_balls_meet(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(4):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    bits, links = 8, []
    top = [1 << i for i in range(bits)]
    masks = [0] + top + [x | y for i, x in enumerate(top) for y in top[:i]]
    cells = {}
    for f in fps.tolist():
        for m in masks:
            cells.setdefault((f >> 56) ^ m, []).append((f, m.bit_count()))
    for members in cells.values():
        u, v = simhash.cell_links(np.array([f for f, _ in members], np.uint64), np.array([k for _, k in members]), bits)
        links += list(zip(np.searchsorted(fps, u).tolist(), np.searchsorted(fps, v).tolist(), strict=True))
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert reach(len(fps), links) == reach(len(fps), want)


def test_myers():
    rng = np.random.default_rng(4)
    for _ in range(300):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, 25))), "".join(rng.choice(list("abc"), rng.integers(1, 40))))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        best = min(row)
        got = decontaminate.myers(p, t, len(p))
        assert best == len(p) or got[0] == best


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [r for r in bench.collect() if len(r.text.split()) >= 5]
    rng, rows, want = np.random.default_rng(5), [], set()
    clean = [r.text for r in docs.limit(30).collect()]
    for k, item in enumerate(items[:30]):
        text, n = list(decontaminate.normal(item.text)), int(len(decontaminate.normal(item.text)) * 0.1)
        for at in rng.choice(len(text), rng.integers(0, n + 1), replace=False):
            text[at] = "#"
        rows.append((k, clean[k][:500] + " \n " + "".join(text).upper().replace(" ", "  ") + " " + clean[k][500:900]))
        want.add((k, item.item_id))
    rows += [(100, None), (101, ""), (102, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as item_id")
    got = decontaminate.matches(frame, bench).collect()
    assert want <= {(r.id, r.item) for r in got}
    texts, by = dict(rows), {i.item_id: decontaminate.normal(i.text) for i in items}
    for r in got:
        found = decontaminate.normal(texts[r.id][r.start : r.end])
        assert decontaminate.myers(by[r.item], found, len(by[r.item]))[0] == r.distance <= 0.1 * len(by[r.item])
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(odd, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_benchmark(odd, bench).count() == odd.count()


def brute_distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_as_full_search(spark, monkeypatch):
    """All pairs of small texts and items by plain dynamic programming; short items, repeats, ties and null ids; both ways of search."""
    rng = np.random.default_rng(11)
    words = ["ab", "ba", "aab", "b", "abba", "bab"]
    some = lambda n: " ".join(rng.choice(words, n))
    items = [(k, some(rng.integers(1, 9))) for k in range(14)] + [(20, None), (21, " \t"), (None, "Abba  bab"), (3, "bab abba bab ab ba aab")]
    rows = [(k, some(rng.integers(0, 22))) for k in range(40)]
    for k in range(12):
        text = list(items[k][1])
        for at in rng.choice(len(text), min(len(text) // 8, 3), replace=False):
            text[at] = "#"
        rows.append((100 + k, some(3) + "\n " + "".join(text).upper() + "  " + some(2)))
    rows += [(100, rows[40][1]), (None, rows[41][1]), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as item_id", "text as __th")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "item_id as doc_id", "text as pattern")
    want, dirty = Counter(), set()
    for d, text in rows:
        for i, item in items:
            low, own = decontaminate.normal(item), decontaminate.normal(text)
            if not low or not own:
                continue
            if len(low.split()) < decontaminate.MIN_WORDS:
                distance = 0 if f" {low} " in f" {own} " else None
            else:
                distance = brute_distance(low, own)
                distance = distance if distance <= int(len(low) * decontaminate.RATE) else None
            if distance is not None:
                want[d, i, distance] += 1
                if len(low.split()) >= decontaminate.MIN_WORDS:
                    dirty.add(text)
    assert len(want) > 40 and any(d for _, _, d in want) and dirty
    for chars in (decontaminate.BLOCK_CHARS, 0):  # broadcast, and through the join
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = decontaminate.matches(docs, bench).collect()
        assert Counter((r.id, r.item, r.distance) for r in got) == want
        kept = decontaminate.without_benchmark(docs, bench)
        assert kept.columns == docs.columns
        assert Counter(tuple(r)[:2] for r in kept.collect()) == Counter(r for r in rows if r[1] not in dirty)


def brute_pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "0", "-", "+", " ", "(", "b.c", "é", "4111 1111 1111 1111", "٣", "\n", "x@y.z", "+1 234 567 8901", "10.0.0.1"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii(spark, docs, odd, empty):
    got = {r.id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base = pii.joined(brute_pii(r.text))
        assert got[r.doc_id].base == base and set(base.split(",")) <= set(got[r.doc_id].spans.split(","))
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0
    assert pii.sanitise(odd).count() == odd.count() and pii.sanitise(odd).columns == odd.columns


def test_disclosing_terms(spark):
    filler = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra".split()
    rng = np.random.default_rng(6)
    some = lambda n: " ".join(rng.choice(filler, n))
    rows = [(k, f"{some(12)} quillfeather {some(2)} q.f@example.org {some(12)}") for k in range(6)]
    rows += [(k, some(30)) for k in range(6, 60)] + [(k, "plain zebracrossing once.only@example.org end " + "same words here") for k in range(60, 70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in pii.find(frame).collect()}
    for k in range(6):
        terms = [s.split(":") for s in found[k].spans.split(",") if s.startswith("term")]
        assert [rows[k][1][int(s) : int(e)] for _, s, e in terms] == ["quillfeather"]
    assert all(found[k].spans == found[k].base for k in range(6, 70))  # copies are one context
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "quillfeather" not in clean[0] and clean[10] == rows[10][1]


def test_lm_scores(spark, docs, odd, empty):
    out = {r.doc_id: r for r in suffixlm.op10_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    count = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update([*suffixlm.tokens(r.text), b""])
    n, v = sum(count.values()), len(count)
    for r in rows:
        words = [*suffixlm.tokens(r.text), b""]
        got = out[r.doc_id]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(got.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert got.score < 0
    got = suffixlm.score(odd).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.id in (1, 2, 3)} == {1}
    assert suffixlm.score(empty).count() == 0


def test_rare_tokens_meet_their_counts(spark, docs, monkeypatch):
    want = {r.id: round(r.base_score, 6) for r in suffixlm.score(docs).collect()}
    monkeypatch.setattr(suffixlm, "FREQUENT", 0)
    assert {r.id: round(r.base_score, 6) for r in suffixlm.score(docs).collect()} == want


def test_tree_is_a_distribution(spark, docs):
    data, bounds = suffixlm.byte_stream([suffixlm.tokens(r.text) for r in docs.limit(40).collect()])
    from trailweave.llm.bytestream import grams

    key, n = np.unique(grams(data, bounds, suffixlm.DEPTH), return_counts=True)
    import pandas as pd

    parts = []
    family = (key >> 8) & 0xFFFF
    for f in np.unique(family):
        for d, (g, c) in suffixlm.retained(key[family == f], n[family == f], 3.0).items():
            parts.append(pd.DataFrame({"depth": d, "gram": g, "n": c}))
    tree = suffixlm.build_tree(pd.concat(parts))
    seen = tree.child.shape[1] - 1
    p = 10.0 ** tree.logp[:-1].astype(float)
    assert np.allclose(p[:, 1:].sum(1) + (256 - seen) * p[:, 0], 1, atol=1e-3)
    assert (tree.child[-1] == 0).all() and len(tree.child) > 50

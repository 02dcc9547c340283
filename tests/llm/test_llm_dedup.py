"""SimHash, suffix dedup, pivots, components and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edges import CLASHES, TEXTS, edge_documents, no_documents, prose

import corpus_pipeline
from hearthgrid.llm import anchors, bwt, pivots, simhash, suffix_dedup
from hearthgrid.llm.components import connected


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    order = rng.sample(range(1000), 1000)
    links = [(order[i], order[i + 1]) for i in range(300)] + [(order[400], order[i]) for i in range(401, 600)] + [(7, 7)]
    got = {r.node: r.component for r in connected(
        spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    expected = components(1000, links)
    assert got == {x: expected[x] for pair in links for x in pair}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text, length=4):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + length]) for i in range(max(1, len(words) - length + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [t for _, t in TEXTS if not t or len(t) < 5000] + ["É A\xa0B \x85C", "One two", "a b c d e"]
    for text in texts:
        assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [4096, 5])
def test_near_fingerprints_are_linked(spark, limit):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        prints.append(x)
    prints = sorted(set(prints), key=lambda x: x - 2**64 if x >> 63 else x)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = components(len(prints), links)
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    got = {r.fp: r["class"] for r in simhash.near_classes(
        spark.createDataFrame([(x,) for x in signed], "fp long"), 4, limit).collect()}
    assert got == {signed[i]: signed[expected[i]] for i in range(len(signed))}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 7])
def test_other_distances(spark, distance):
    rng = random.Random(distance)
    base = rng.getrandbits(62)
    near = base
    for bit in rng.sample(range(62), distance):
        near ^= 1 << bit
    far = near ^ 1 << 62
    rows = spark.createDataFrame([(base,), (near,), (far,)], "fp long")
    classes = {r.fp: r["class"] for r in simhash.near_classes(rows, distance).collect()}
    assert classes[base] == classes[near]
    assert (classes[far] == classes[near]) == (distance >= 1)


def test_near_duplicate_edges(spark):
    got = simhash.near_duplicates(edge_documents(spark)).collect()
    assert len(got) == len(TEXTS)
    component = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert component[1] == component[6] == 1
    assert component[2] == component[3] == component[4] == 2
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    kept = simhash.keep_one(edge_documents(spark)).collect()
    groups = Counter(r.component_id for r in got)
    assert len(kept) == len(groups) and len({(r.doc_id, r.text) for r in kept}) == len(kept)


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_equal_windows_by_interval_expansion():
    rng = random.Random(3)
    for _ in range(150):
        length, letters = rng.choice([1, 2, 3, 5, 9, 20]), rng.choice([b"ab", b"abc\x00\xff", b"a"])
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = [base[rng.randint(0, 30):rng.randint(30, 60)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 10)))
                 for _ in range(rng.randint(0, 8))]
        count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        expected = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i:i + length]] > 1]
        number, at = bwt.equal_windows(texts, length)
        assert list(zip(number.tolist(), at.tolist())) == expected


@pytest.mark.parametrize("kinds,length", [(2048, 200), (2, 200), (1, 40)])
def test_repeats_are_cut_exactly(spark, kinds, length):
    rng = random.Random(5)
    passages = [prose(100 + i, 60) for i in range(6)]
    texts = []
    for i in range(90):
        parts = [prose(1000 + i, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 120)
            parts += [p[a:a + rng.randint(100, 330)], prose(2000 + 7 * i + a, rng.randint(0, 30))]
        texts.append(" ".join(parts))
    texts += [texts[3], "b" * 900, "ab" * 300 + prose(1, 3), None, "", "x" * 199, prose(77, 30) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(docs, length, kinds=kinds).collect()}
    assert got == dict(enumerate(repeats(texts, length)))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcdefghij "
    long = "".join(rng.choice(letters) for _ in range(anchors.CHUNK + 5000))
    texts = [long, long[anchors.CHUNK - 300:anchors.CHUNK + 300], long[70_000:70_500] + "x", "y" + long[:250]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = {r.doc_id: [(s.start, s.end) for s in r.runs] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert runs == {0: [(0, 250), (70_000, 70_500), (anchors.CHUNK - 300, anchors.CHUNK + 300)],
                    1: [(0, 600)], 2: [(0, 500)], 3: [(1, 251)]}


def test_repeat_edges(spark):
    got = suffix_dedup.remove_repeats(edge_documents(spark))
    expected = Counter((k, *r) for (k, _), r in zip(TEXTS, repeats([t for _, t in TEXTS], 200)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == expected
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0
    cut = suffix_dedup.cut_repeats(edge_documents(spark), count="length")
    rows = cut.collect()
    assert cut.columns == edge_documents(spark).columns and len(rows) == len(TEXTS)
    assert all(r.length is None if r.text is None else r.length == len(r.text) for r in rows)


def near_vectors(n, size=64, seed=0, cosine=(0.85, 0.99)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(n, size))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(*cosine, size=(n, 1))
    return np.vstack([x, c * x + np.sqrt(1 - c * c) * other]).astype(np.float32)


def brute(x, least=0.9):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("limit", [512, 20])
def test_links_between_vectors(spark, limit):
    x = near_vectors(700)
    x = np.vstack([x, x[:5], x[:1]])
    near = brute(x)
    got = {r.vec_id: r for r in pivots.near_duplicates(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"),
        limit=limit).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_recall_does_not_fall_with_a_crowd(spark):
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=(1, 32)) + 0.12 * rng.normal(size=(500, 32))
    x = np.vstack([crowd, rng.normal(size=(500, 32))]).astype(np.float32)
    got = {r.vec_id: r for r in pivots.near_duplicates(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"),
        limit=64).collect()}
    near = brute(x)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()


@pytest.mark.parametrize("noise", [0.12, 0.36])
def test_recall_in_a_crowd_of_a_large_table(spark, noise):
    rng = np.random.default_rng(6)
    n, crowd = 20_000, 6_667
    x = rng.normal(size=(n, 32))
    x[:crowd] = rng.normal(size=(1, 32)) + noise * x[:crowd]
    x = x.astype(np.float32)
    got = dict(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
               .transform(pivots.near_duplicates).select("vec_id", "n_links").collect())
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.concatenate([(u[at:at + 1000] @ u.T >= 0.9).sum(1) - 1 for at in range(0, n, 1000)])
    found = np.array([got[i] for i in range(n)])
    assert (found <= near).all() and found.sum() >= 0.99 * near.sum() > 0


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (None, [0.0, 3.0]),
            (12, [-1.0, 0.0]), (12, [-2.0, 0.0])]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, node int, pivot int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(frame, shared=1).collect())
    assert got == Counter([(1, 2, 1, True), (2, 2, 1, False), (10, 2, 1, False), (None, 0, None, True), (9, 0, 9, True),
                           (12, 1, 12, True), (12, 1, 12, True), *((i, 0, i, True) for i in range(3, 9))])
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for (name, stage), op in zip(corpus_pipeline.STAGES, (7, 2, 10, 9, 1)):
        after = stage(spark, before, sf).cache()
        if op == 1:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
            break
        assert after.columns == columns
        was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(now) <= set(was) and len(now) > 0.5 * len(was), name
        if op == 10:
            prints = {k: slow_fingerprint(r.text) for k, r in was.items()}
            ids = sorted(was)
            links = [(i, j) for i in range(len(ids)) for j in range(i)
                     if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 4]
            assert set(now) == {ids[r] for r in set(components(len(ids), links))}
        if op == 9:
            ids = sorted(was)
            for i, r in zip(ids, repeats([was[i].text for i in ids], 200)):
                assert len(now[i].text.encode()) <= r[0] - r[1] and now[i].n_chars == len(now[i].text)
                if r[1] == 0:
                    assert now[i].text == was[i].text
        before = after


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Every stage keeps the same rows as without the extra columns, and their values."""
    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    wide = plain.selectExpr("*", *[f"doc_id * 100 + {i} AS `{c}`" for i, c in enumerate(CLASHES)])
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, plain, sf).cache(), stage(spark, wide, sf).cache()
        if name == "packing":
            columns = sorted(set(plain.columns) & set(wide.columns))
            assert {"doc_id", "start", "length"} <= set(columns)
            assert sorted(map(str, plain.select("doc_id", "start").collect())) == sorted(map(str, wide.select("doc_id", "start").collect()))
            break
        assert wide.columns == plain.columns + CLASHES, name
        want = {r.doc_id: r.text for r in plain.collect()}
        rows = wide.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want), name
        assert all(r[c] == r["doc_id"] * 100 + i for r in rows for i, c in enumerate(CLASHES)), name


def test_rows_with_clashing_names_and_odd_keys_survive(spark):
    docs = edge_documents(spark)
    assert simhash.keep_one(docs).columns == docs.columns == suffix_dedup.cut_repeats(docs).columns
    assert suffix_dedup.cut_repeats(docs).count() == docs.count() and simhash.keep_one(docs).count() < docs.count()

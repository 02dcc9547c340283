"""Packing, byte-level BPE and token counts against the libraries and plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from edges import TEXTS, edge_documents, no_documents
from tokenizers import Tokenizer

from hearthgrid.llm import byte_bpe, packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "abcdehtion ABC  \n\t'ssreé中\U0001f600ÀÿßµŁ3.,##\x1c\x85\xa0  "


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.PrefixEncoder(byte_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS),
                             special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(encoder, library):
    for text in [*odd_texts(3000), "x" * 5000, " \n" * 50, "don't I'll we've", *(t for _, t in TEXTS if t)]:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_every_prefix_is_encoded(encoder, library):
    data = b"thentingeredly unhappiness"
    last = encoder.prefixes(data)
    for n in range(1, len(data) + 1):
        assert encoder.decode(encoder.tokens_of(data[:n], last)) == data[:n]
    assert encoder.tokens_of(data[:8], last) == library._encode_single_piece(data[:8])


def test_appends_and_edits_keep_what_still_holds(encoder):
    rng = random.Random(2)
    for _ in range(200):
        old = bytes(rng.choice(b"abthe onig") for _ in range(rng.randint(0, 400)))
        last, at = encoder.prefixes(old), rng.randint(0, len(old))
        new = old[:at] + bytes(rng.choice(b"abthe") for _ in range(rng.randint(0, 4))) + old[at + rng.randint(0, 3):]
        assert encoder.edit(old, last, new) == encoder.prefixes(new)
        assert encoder.prefixes(old + b"xyz", last, len(last)) == encoder.prefixes(old + b"xyz")


def test_round_trip_of_documents(spark, library):
    docs = edge_documents(spark)
    got = sorted(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect(), key=str)
    expected = []
    for key, text in TEXTS:
        ids = library.encode_ordinary(text or "")
        expected.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in decoded) == sorted((str(k), t or "") for k, t in TEXTS)
    assert byte_bpe.round_trip(no_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    for text in [*odd_texts(3000), "<|endoftext|> x<|startoftext|>", "I'll've DON'T", *(t for _, t in TEXTS if t)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_and_a_sign_need_no_pattern(monkeypatch):
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    monkeypatch.setattr(own, "split", lambda text: pytest.fail(f"split by the pattern: {text}"))
    text = "Words, \u00c9t\u00e9! \u00aa. \u00b5; \u00df? Plain done."
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("fan_in,capacity", [(256, 4096), (2, 512), (2, 4096)])
def test_packing_places_each_id_once(spark, monkeypatch, fan_in, capacity):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    docs = edge_documents(spark).repartition(5)
    rows = packing.pack(docs, WORDS, capacity).collect()
    library = Tokenizer.from_file(WORDS)
    left = {}
    for key, text in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        left.setdefault((key, len(ids)), []).append(ids)
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(pieces) == set(left)
    for key, own in pieces.items():
        copies = len(left[key])
        ids = left[key][0]
        assert sum(r.length for r in own) == copies * len(ids)
        covered = np.zeros(len(ids), dtype=int)
        for r in own:
            covered[r.start:r.start + r.length] += 1
            assert copies > 1 or r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert (covered == copies).all()
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(no_documents(spark), WORDS, capacity).count() == 0


def test_packing_returns_ids_and_wastes_little(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (37 * i % 900))) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(docs.repartition(4), WORDS, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) > 0.95 * 4096 * len({r.sequence_id for r in rows})


def best_segmentation(scores, data):
    best = [(0.0, 0)]
    for end in range(1, len(data) + 1):
        best.append(max((best[s][0] + scores[data[s:end]], -(best[s][1] + 1)) for s in range(end) if data[s:end] in scores))
        best[end] = best[end][0], -best[end][1]
    return best[-1]


def test_token_counts_equal_plain_dynamic_programming(spark):
    ranks = byte_bpe.load_ranks(RANKS)
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    scores = {t: -math.log(r + 1) - norm for t, r in ranks.items()}
    got = token_counts.token_counts(edge_documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    expected, known = [], {}
    for key, text in TEXTS:
        words = regex.findall(public_tokenizers.PATTERN, text or "")
        for w in set(words) - set(known):
            known[w] = best_segmentation(scores, w.encode()) if len(w) < 800 else None
        if all(known[w] for w in words):
            expected.append((str(key), len(words), sum(known[w][1] for w in words)))
    seen = [(str(r.doc_id), r.n_pretokens, r.n_tokens) for r in got]
    assert len(got) == len(TEXTS) and all(seen.count(e) >= expected.count(e) for e in expected)
    assert token_counts.token_counts(no_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_full_trie_changes_nothing():
    ranks = byte_bpe.load_ranks(RANKS)
    large, small = token_counts.ScoredTrie(ranks), token_counts.ScoredTrie(ranks, limit=40)
    for word in ["thing", "things", "thinking", "unthinkable", "thing"]:
        assert large.insert(word.encode()) == small.insert(word.encode())
    assert small.nodes <= 40 < large.nodes + 40

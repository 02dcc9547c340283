"""Quality rules, language identification, toxicity and sharding."""

import re
import zlib
from collections import Counter

import pytest
from edges import TEXTS, edge_documents, no_documents, prose
from pyspark.sql import functions as F

from hearthgrid.llm import langid, quality, queries, sharding, toxicity

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    got = quality.quality(edge_documents(spark)).collect()
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert seen == Counter((k, *counts(t)) for k, t in TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(no_documents(spark)).count() == 0


def test_windows_sorted_by_words_give_the_same(spark):
    texts = ["a b c d a b c x", "x y z", "a b c a b c a b c", "a a a a a a", prose(3, 300) + " " + prose(3, 50)]
    words = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.split("text", " ").alias("words"))
    for r in words.select("text", F.expr(quality.REPEATED).alias("n"),
                          F.expr(f"IF(size(words) < 3, 0L, {quality._BY_WORDS})").alias("m")).collect():
        assert r.n == r.m == counts(r.text)[4]


def test_every_row_of_the_table_rejects(spark):
    good = prose(1, 120)
    words = good.split()
    planted = {
        "good": good, "word_length": "a I " * 5 + " ".join(w[:2] for w in words), "long": " ".join(w + "x" * 8 for w in words) + " the" * 6,
        "symbols": " ".join(w + "#" * (i % 4 == 0) for i, w in enumerate(words)),
        "stop_words": " ".join(f"thoner{i}" for i in range(120)),
        "dup_lines": "\n".join([*words, "x", "x", *["the mat"] * 80]),
        "repeats": good + " " + good}
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(list(planted.items()), "doc_id string, text string")).collect()}
    assert got["good"].kept and not any(r.kept for k, r in got.items() if k != "good")
    assert not got["long"].rule_word_length
    for name, *_ in quality.THRESHOLDS:
        assert not got[name][f"rule_{name}"], name


def test_quality_follows_the_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert set(n) == {(1, True), (0, False)}


def test_accepted_keeps_rows_as_they_are(spark):
    docs = edge_documents(spark)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    ids = quality.quality(docs).filter("kept").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in ids) != []


def test_languages_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_bitmask_language_id(spark, SF).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_filters_miss_nothing_and_hit_little_else(spark):
    rows = [("x", "abcd abce abcf"), ("y", "wxyz wxya"), ("x", None), (None, "zzzz"), ("z", "")]
    filters = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert filters.langs == ["x", "y"]
    assert all(filters.containing(g) & 1 for w in ("abcd", "abce", "abcf") for g in langid.grams_of(w))
    assert all(filters.containing(g) & 2 for w in ("wxyz", "wxya") for g in langid.grams_of(w))
    assert sum(bool(filters.containing(f"q{i}")) for i in range(2000)) < 200


def test_language_edges(spark):
    docs = edge_documents(spark).withColumn("lang", F.lit("en"))
    filters = langid.learn(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, filters).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (12, "und"), (None, "und"), (1, "en"), (8, "en")} <= got
    assert langid.predict(no_documents(spark), filters).count() == 0
    nothing = langid.learn(no_documents(spark))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def grammar():
    return toxicity.Grammar(dict.fromkeys(toxicity.INSULTS + toxicity.THREATS, 3.0))


@pytest.mark.parametrize("clause,way", [
    ("you are an idiot", "aimed"), ("what a stupid rule", "plain"), ("you are not an idiot", "negated"),
    ("she said you are an idiot", "reported"), ("i will kill you", "plain"), ("you i will kill", "aimed")])
def test_grammar_tells_ways_apart(grammar, clause, way):
    out = grammar.clause(clause.split())
    assert [k for k, v in out.items() if v] == [way]


def test_clauses_are_scored_by_themselves(grammar):
    apart = grammar.outputs("They said nothing. You idiot!")
    assert apart[0] > 0 and apart[3] == 0
    assert grammar.outputs("a clean text, nothing here") == [0.0] * 10 == grammar.outputs(None)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op7_grammar_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)


def test_toxicity_edges(spark):
    docs = edge_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (99, 1), (6, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.learn(docs, labels)
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(no_documents(spark), model).count() == 0
    assert toxicity.clean(docs, model).columns == docs.columns


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    dims = {"size": F.octet_length("text"), "chars": F.col("n_chars"), "lang": F.col("lang")}
    got = sharding.shard(docs, dims, shards=7).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and sorted(size.index) == list(range(7))
    assert size.max() < 1.02 * size.mean() and size.min() > 0.98 * size.mean()
    assert (got.sort_values("slot").groupby("shard").slot.apply(lambda s: list(s) == list(range(len(s))))).all()
    both = got.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    assert (both["size"] == [len(t.encode()) + 16 for t in both.text]).all()
    assert (both.text_crc32 == [zlib.crc32(t.encode()) for t in both.text]).all()
    torn = both.groupby("text").shard.nunique()
    assert (torn > 1).mean() < 0.002


def test_a_hot_group_is_shared_out(spark):
    rows = [(i, "same text " * 20 if i % 3 else prose(i, 20)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), {"size": F.octet_length("text")}, 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() < 1.05 * size.mean()


def test_sharding_edges(spark):
    docs = edge_documents(spark)
    got = sharding.shard(docs, {"size": F.octet_length("text"), "lang": F.lit(None).cast("string")}).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len((t or "").encode()) + 16) for k, t in TEXTS)
    assert all(0 <= r.shard < 40 for r in got)
    assert sharding.shard(no_documents(spark), {"size": F.octet_length("text")}).count() == 0

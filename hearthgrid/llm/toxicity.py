"""Toxicity by a weighted finite-state pattern grammar.

A clause (text between punctuation marks or line ends) is read word by word by five transducers that
run in composition: insults, threats, targets, negation and reported speech. Each is a small
automaton over word classes; their joint state says in which way an abusive word is meant, and
the weight of that word goes to the matching output: aimed at someone, plain, negated or reported.
Clauses that contain no abusive word end in no accepting state and score nothing.

The weights come from labelled texts. A word, or a beginning of a word, that occurs far more often
in texts labelled toxic than in others (a likelihood-ratio test against chance) becomes an arc of the
insult transducer with its log odds as weight; the fixed lists below give the classes in general
use. A logistic fit over the outputs' sums and maxima turns them into a score in 0..1.

Null and empty texts match nothing and get the score of a text without matches. Labels that are null
or belong to no document are not used; if one document has several labels, the largest counts.
Without both classes among the labels nothing is learned, and only the fixed lists count. Repeated
rows repeat their answer, a null key is kept, empty tables give empty results, other columns are ignored.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.llm.common import Memory, keyed_text, slices, with_key

# Words of the classes that the transducers know without learning.
INSULTS = """idiot idiots moron morons stupid pathetic worthless disgusting scum trash loser losers clown
dumb imbecile idiote imbécile connard salaud stupide abruti dummkopf vollidiot arschloch trottel
dreckskerl blöd imbécil estúpido estúpida idiota tonto basura""".split()
THREATS = """kill hurt destroy shoot stab strangle tuer frapper détruire töten umbringen schlagen vernichten
matar golpear destruir""".split()
TARGETS = """you your yours yourself he she they them tu toi vous ton votre ils elles du dich dir euch ihr
sie ustedes usted tú ti vosotros ellos ellas""".split()
NEGATIONS = """not never no nobody isn't aren't don't didn't won't pas jamais nicht kein keine nie niemals
nunca jamás""".split()
REPORTS = """said says told claimed wrote quoted reported called dit déclaré écrit sagte sagt schrieb
behauptete dijo dice escribió""".split()

CLAUSE = re.compile(r"[.!?;:,\n|]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
PREFIXES = (4, 5, 6)
OUTPUTS = ("aimed", "plain", "negated", "reported")


def features_of(word):
    """A word and its beginnings, by which relatives of an abusive word are known."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def word_table(docs, labels, text="text", label="toxic"):
    """(term, toxic, clean): in how many labelled documents of either class a term occurs.

    Tasks add up their own documents before the shuffle.
    """
    slim = docs.select(F.col(label).cast("int").alias("y"), F.col(text).cast("string").alias("text"))

    def count(batches):
        counts = (Counter(), Counter())

        def flush():
            terms = sorted(set(counts[0]) | set(counts[1]))
            out = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0))],
                names=["term", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return out

        known = Memory(features_of, limit=50_000)
        for batch in slices(batches):
            for y, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[1 if y else 0].update({t for w in set(WORD.findall((content or "").lower())) for t in known[w]})
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield flush()
        yield flush()

    return slim.mapInArrow(count, "term string, toxic long, clean long") \
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Grammar:
    """The five transducers in composition, over a lexicon of weighted insults and threats."""

    def __init__(self, weights):
        self.weights = weights
        self.fixed = {w: (c, 0.0) for c, words in (
            ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.classes = Memory(self._class, limit=100_000)
        self.chunks = Memory(self._abusive, limit=100_000)

    def _class(self, word):
        """(class, weight) of a word; learned arcs come before the fixed ones."""
        found = [self.weights[t] for t in features_of(word) if t in self.weights]
        if found:
            return "threat" if word in THREATS else "insult", max(found)
        return self.fixed.get(word, (None, 0.0))

    def _abusive(self, chunk):
        return any(self.classes[w][0] in ("insult", "threat") for w in WORD.findall(chunk.lower()))

    def clause(self, words):
        """Weight per output for one clause.

        State: words since the last negation, whether a reporting verb came before, whether
        someone is addressed. A negation reaches three words, a report to the clause's end; a
        target counts on either side, for a threat only before it.
        """
        read = [self.classes[w] for w in words]
        targets = [i for i, (c, _) in enumerate(read) if c == "target"]
        since, reported = math.inf, False
        out = dict.fromkeys(OUTPUTS, 0.0)
        for i, (kind, weight) in enumerate(read):
            since += 1
            if kind == "negation":
                since = 0
            elif kind == "report":
                reported = True
            elif kind in ("insult", "threat"):
                aimed = any((t < i if kind == "threat" else True) and abs(t - i) <= 4 for t in targets)
                way = "reported" if reported else "negated" if since <= 3 else "aimed" if aimed else "plain"
                out[way] += weight
        return out

    def outputs(self, text):
        """Document features: per output the sum over clauses and its largest clause, and the clauses' share."""
        sums, most = [0.0] * len(OUTPUTS), [0.0] * len(OUTPUTS)
        hit = 0
        if text and any(map(self.chunks.__getitem__, text.split())):
            for clause in CLAUSE.split(text.lower()):
                words = WORD.findall(clause)
                if any(self.classes[w][0] in ("insult", "threat") for w in words):
                    hit += 1
                    for i, value in enumerate(self.clause(words).values()):
                        sums[i] += value
                        most[i] = max(most[i], value)
        return [math.log1p(s) for s in sums] + most + [math.log1p(sum(sums)), math.log1p(hit)]


def lexicon(counted, n_toxic, n_clean, least_evidence=33.0):
    """Weights of the terms whose likelihood ratio against chance exceeds ``least_evidence``.

    Only terms with evidence come to the driver. There are no more of them than a text's words
    times its class can support: each needs several toxic documents of its own.
    """
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = n_toxic / max(1.0, n_toxic + n_clean)

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    evidence = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    rows = counted.withColumns({"evidence": evidence, "odds": odds}) \
        .filter((F.col("evidence") > least_evidence) & (F.col("odds") > 1.5)).select("term", "odds").collect()
    return {r.term: r.odds for r in rows}


def fit_logistic(x, y, ridge=1.0, rounds=30):
    """Ridge logistic regression by Newton steps on a bounded sample."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, weights, coefficients):
        self.weights, self.coefficients = weights, coefficients

    def scorer(self):
        grammar = Grammar(self.weights)
        w = self.coefficients

        def score(text):
            z = w[0] + float(np.dot(w[1:], grammar.outputs(text)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def learn(docs, labels, key="doc_id", text="text", label="toxic", sample=20_000):
    """Fit lexicon and coefficients on at most ``sample`` labelled documents, chosen by a hash of the key.

    The rows to learn from are those of ``labels``; callers hold rows out by filtering it.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()) \
        .groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fixed = dict.fromkeys(INSULTS + THREATS, 3.0)
    texts = keyed_text(docs, key, text).join(F.broadcast(chosen), "doc_id") \
        .select("doc_id", "y", "text").repartition(64, "doc_id", F.xxhash64("text")).persist()
    try:
        n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = sum(v for k, v in n.items() if k), sum(v for k, v in n.items() if not k)
        if not n_toxic or not n_clean:
            return ToxicityModel(fixed, np.array([-4.0, *[2.0] * len(OUTPUTS), *[0.5] * len(OUTPUTS), 0.0, 0.0]))
        learned = lexicon(word_table(texts, labels, label="y"), n_toxic, n_clean)
        weights = {**{k: v for k, v in fixed.items()}, **learned}
        shared = docs.sparkSession.sparkContext.broadcast(weights)
        width = 2 * len(OUTPUTS) + 2

        def measure(batches):
            grammar = Grammar(shared.value)
            for batch in slices(batches):
                rows = [grammar.outputs(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                                 names=["y", "x"])

        rows = texts.select(F.col("y").cast("int").alias("y"), "text") \
            .mapInArrow(measure, "y int, x array<double>").collect()
    finally:
        texts.unpersist()
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, width)
    y = np.array([1.0 if r.y else 0.0 for r in rows])
    return ToxicityModel(weights, fit_logistic(x, y))


def score(docs, model, key="doc_id", text="text"):
    """doc_id, score, predicted for every whole text."""
    slim = keyed_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("score", T.DoubleType()), ("predicted", T.IntegerType())]

    def run(batches):
        of = shared.value.scorer()
        for batch in slices(batches):
            scores = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"])

    return slim.mapInArrow(run, with_key(slim, *fields))


def clean(docs, model, text="text", most=0.5):
    """The rows of ``docs`` whose score is below ``most``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        of = shared.value.scorer()
        for batch in slices(batches):
            yield batch.filter(pa.array([of(t) < most for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

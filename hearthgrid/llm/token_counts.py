"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Each task inserts its distinct pre-tokens in a byte trie. A trie node holds the best score of the
bytes on its path and the number of tokens in that segmentation, computed once however many
pre-tokens share the path; a document's count is the sum over its pre-tokens' terminal nodes.

The score of a token is ``-log(rank + 1)``, the usual Zipf prior for a vocabulary in rank order (its
constant part is the same for all tokens but counts per token, so it is included). Of
segmentations with equal scores the one with fewer tokens counts.

Null texts count as empty: no pre-tokens, no tokens, score 0. Rows are independent: repeated rows
repeat their answer, a null key is kept, empty tables give empty results, other columns are ignored.
"""

import math

import pyarrow as pa
from pyspark.sql import types as T

from hearthgrid.llm.byte_bpe import load_ranks
from hearthgrid.llm.common import Memory, keyed_text, with_key


class ScoredTrie:
    """Trie whose nodes carry the forward scores of their prefixes.

    Nodes are numbers; ``children``, ``score`` and ``tokens`` are indexed by them. A new node looks back
    along its own path for the tokens that end there. A full trie is emptied, which only costs time.
    """

    def __init__(self, ranks, limit=2_000_000):
        norm = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
        self.scores = {t: -math.log(r + 1) - norm for t, r in ranks.items()}
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.limit = limit
        self.clear()

    def clear(self):
        self.children, self.score, self.tokens, self.nodes = [{}], [0.0], [0], 1

    def insert(self, data):
        """Terminal (tokens, score) of a pre-token; only the part beyond known prefixes is computed."""
        if self.nodes + len(data) > self.limit and self.nodes > 1:
            self.clear()
        children, score, tokens = self.children, self.score, self.tokens
        node, path = 0, [0]
        for end in range(1, len(data) + 1):
            after = children[node].get(data[end - 1])
            if after is None:
                best, fewest, start = -math.inf, 0, end - 1
                while start >= 0 and (tail := data[start:end]) in self.tails:
                    own = self.scores.get(tail)
                    if own is not None:
                        before = path[start]
                        total, count = score[before] + own, tokens[before] + 1
                        if total > best or (total == best and count < fewest):
                            best, fewest = total, count
                    start -= 1
                after = self.nodes
                children[node][data[end - 1]] = after
                children.append({})
                score.append(best)
                tokens.append(fewest)
                self.nodes += 1
            node = after
            path.append(node)
        return tokens[node], score[node]


_TRIES = {}


def _trie_for(path, pattern):
    import regex

    if (path, pattern) not in _TRIES:
        trie = ScoredTrie(load_ranks(path))
        _TRIES[path, pattern] = regex.compile(pattern).findall, Memory(lambda w: trie.insert(w.encode()))
    return _TRIES[path, pattern]


def token_counts(docs, ranks_path, pattern, key="doc_id", text="text"):
    """doc_id, n_pretokens, n_tokens and score (of the best segmentation, rounded to 6 digits)."""
    slim = keyed_text(docs, key, text)
    fields = [("n_pretokens", T.LongType()), ("n_tokens", T.LongType()), ("score", T.DoubleType())]

    def run(batches):
        split, terminal = _trie_for(ranks_path, pattern)
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                found = [terminal[w] for w in split(content)] if content else []
                out.append((len(found), sum(f[0] for f in found), round(math.fsum(f[1] for f in found), 6)))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64())))],
                names=["doc_id", *(n for n, _ in fields)])

    return slim.mapInArrow(run, with_key(slim, *fields))

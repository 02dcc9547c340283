"""The registered queries of this subpackage and their SQL counterparts."""

import public_tokenizers
from pyspark.sql import functions as F

from hearthgrid.llm import (
    byte_bpe, collocations, html_text, infill, langid, packing, pivots, quality, sharding, simhash, suffix_dedup,
    token_counts, toxicity)
from hearthgrid.llm.common import table


def op1_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_rules(spark, sf_dir):
    rules = [f"rule_{r[0]}" for r in quality.THRESHOLDS]
    return quality.quality(table(spark, sf_dir, "documents")).drop(*rules)


def _op2_sql():
    """The counts by unnesting words and lines, and the same threshold table."""
    space = r"[\x20\x09-\x0D]+"
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.stop_forms())
    rules = []
    for _, ratio, least, most in quality.THRESHOLDS:
        bounds = [f"{ratio} >= {least}" if least is not None else None, f"{ratio} <= {most}" if most is not None else None]
        rules.append("coalesce(" + " AND ".join(b for b in bounds if b) + ", false)")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), counts AS (
  SELECT docs.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(words, lambda w: w IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN split USING (r) LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND {" AND ".join(rules)} AS kept FROM judged
"""


def _remainder(n):
    """crc32 of the document id's decimal digits, modulo ``n``."""
    return F.expr(f"crc32(CAST(doc_id AS STRING)) % {n}")


def op3_bitmask_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    filters = langid.learn(docs.filter(~held))
    return langid.predict(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_kd_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, {"size": F.octet_length("text"), "chars": F.col("n_chars"), "lang": F.col("lang")})


def op5_prefix_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pivot_permutation(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_grammar_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = toxicity.learn(docs, labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_trie_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_bwt_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("runs")


def op10_deletion_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_text_density(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op12_arrow_infill(spark, sf_dir):
    done = infill.restore(infill.infill(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op13_fm_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, share=80, top=2000)


QUERIES = {f.__name__: f for f in (
    op1_harmonic_packing, op2_quality_rules, op3_bitmask_language_id, op4_kd_sharding, op5_prefix_byte_bpe,
    op6_pivot_permutation, op7_grammar_toxicity, op8_trie_token_counts, op9_bwt_suffix_dedup, op10_deletion_simhash,
    op11_text_density, op12_arrow_infill, op13_fm_collocations)}

_OP6_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT vec_id, v FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN counted USING (vec_id)
"""

_OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS pieces,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digits FROM documents
), numbers AS (
  SELECT *, len(pieces) - CAST(pieces[len(pieces)] = '' AS BIGINT) AS n, CAST('0x' || digits[1:8] AS BIGINT) AS h1,
         CAST('0x' || digits[9:16] AS BIGINT) AS h2, CAST('0x' || digits[25:32] AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM numbers
), heads AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a < len(pieces) THEN array_to_string(pieces[1:a], chr(10)) || chr(10) ELSE text END AS prefix,
         CASE WHEN b = 0 THEN '' WHEN b < len(pieces) THEN array_to_string(pieces[1:b], chr(10)) || chr(10) ELSE text END AS head FROM cuts
), parts AS (
  SELECT *, head[length(prefix) + 1:] AS middle, text[length(head) + 1:] AS suffix,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM heads
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
         ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sized AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3), (4)) AS t(k)
), counted AS (
  SELECT lang, w[i:i + k - 1] AS words, count(*) AS f FROM sized GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), found AS (
  SELECT lang, words, f AS a FROM counted WHERE len(words) > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.words, a, k, l.f AS l, r.f AS r, (CAST(a AS HUGEINT) * 2000000) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM found) c
  JOIN counted l ON l.lang = c.lang AND l.words = c.words[1:k]
  JOIN counted r ON r.lang = c.lang AND r.words = c.words[k + 1:len(c.words)]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, words AS whole, a AS longer, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM found, (VALUES (2), (3)) AS t(k) WHERE k < len(words)
), inside AS (
  SELECT lang, whole[i:i + k - 1] AS words, max(longer) AS longer FROM inner_parts GROUP BY ALL
), free AS (
  SELECT lowest.*, array_to_string(words, ' ') AS phrase FROM lowest LEFT JOIN inside USING (lang, words)
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op12_arrow_infill": _OP12_SQL, "op13_fm_collocations": _OP13_SQL, "op2_quality_rules": _op2_sql(), "op6_pivot_permutation": _OP6_SQL}

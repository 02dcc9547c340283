"""Quality rules as one Spark projection: a threshold table turned into columns, no user functions.

Words are runs of anything but the six ASCII white-space characters. Ratios come from the same counts:
mean word length, symbols per word, stop words, repeated lines and repeated word windows. A row of the
table says within which bounds a ratio must be; a document is kept if no base rule and no row of
the table rejects it.

Null and empty texts have no words and fail the base rule. A null key is kept, repeated rows repeat
their answer, empty tables give empty results, and of other columns only those asked for are read.
"""

from pyspark.sql import functions as F

SPACE = "\\u0020\\u0009-\\u000D"
SYMBOLS = "#*$%&|<>"

# Common short words of the languages that the rules know.
STOP_WORDS = """
the be to of and that have with a in is it for on as was by at or from this are an
le la les de des et un une en que qui dans pour par sur pas avec du au est ne
der die das und ist nicht ein eine mit von zu den im auf für sich des dem als auch
el los las una y es por con para del se su no al lo
""".split()

#: (name, ratio, least, most): a null bound does not bind. Limits are those usual for the rule families where the
#: rows labelled as good allow it: these reach 1/3 of duplicate lines, 0.49 of repeats (so that row stays at the
#: base rule's limit) and 0.048 of stop words. The stop words are those of four languages, and texts in any
#: other language need a table without that row.
THRESHOLDS = [
    ("word_length", "CAST(word_chars AS DOUBLE) / nullif(n_words, 0)", 3.0, 10.0),
    ("symbols", "CAST(n_symbols AS DOUBLE) / nullif(n_words, 0)", None, 0.1),
    ("stop_words", "CAST(n_stop_words AS DOUBLE) / nullif(n_words, 0)", 0.03, 0.95),
    ("dup_lines", "CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0)", None, 0.35),
    ("repeats", "CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0)", None, 0.5),
]


def stop_forms():
    """The stop words as they are written within a sentence, at its beginning and in capitals."""
    return sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


def _literal(words):
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def _without(text, characters):
    for c in characters:
        text = f"replace({text}, {c}, '')"
    return text


def _let(name, value, body):
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WINDOWS = "sequence(0, size(words) - 3)"
_COVERED = "CAST(size(array_distinct(flatten(transform({at}, p -> array(p, p + 1, p + 2))))) AS BIGINT)"

#: Sorted by the words themselves, equal windows are neighbours.
_BY_WORDS = _let(
    "e", f"array_sort(transform({_WINDOWS}, i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i AS at)))",
    _COVERED.format(at="""transform(filter(sequence(0, size(e) - 1), j ->
        (e[j].a <=> get(e, j + 1).a AND e[j].b <=> get(e, j + 1).b AND e[j].c <=> get(e, j + 1).c)
        OR (e[j].a <=> get(e, j - 1).a AND e[j].b <=> get(e, j - 1).b AND e[j].c <=> get(e, j - 1).c)), j -> e[j].at)"""))

_CLASH = """exists(f, j -> NOT (
    words[s[j] & m] = words[s[j + 1] & m] AND words[(s[j] & m) + 1] = words[(s[j + 1] & m) + 1]
    AND words[(s[j] & m) + 2] = words[(s[j + 1] & m) + 2]))"""

#: Words in windows of three that occur twice or more, counted once each. A text whose windows all hash
#: differently has none. Otherwise hash and place share a number, so that sorting numbers brings equal
#: windows together; neighbours with equal hashes are compared by their words, and if any two differ
#: (a clash, hardly ever) the windows are sorted by their words instead.
REPEATED = f"""CASE WHEN size(words) < 4 THEN 0L ELSE {_let(
    "h", f"transform({_WINDOWS}, i -> xxhash64(words[i], words[i + 1], words[i + 2]))",
    "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE " + _let(
        "m", "IF(size(words) <= 1048576, 1048575L, 2147483647L)", _let(
            "s", "sort_array(transform(h, (x, i) -> (x & ~m) | i))", _let(
                "f", "filter(sequence(0, size(s) - 2), j -> (s[j] | m) = (s[j + 1] | m))",
                f"CASE WHEN size(f) = 0 THEN 0L WHEN {_CLASH} THEN {_BY_WORDS} ELSE "
                + _COVERED.format(at="flatten(transform(f, j -> array(CAST(s[j] & m AS INT), CAST(s[j + 1] & m AS INT))))")
                + " END"))) + " END")} END"""


def measure(docs, key="doc_id", text="text", carry=()):
    """Counts per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words."""
    blanks = ["' '", "'\\t'", "'\\n'", "'\\u000B'", "'\\u000C'", "'\\r'"]
    symbols = [f"'{c}'" for c in SYMBOLS]
    counts = f"""named_struct(
        'n_words', CAST(size(words) AS BIGINT),
        'word_chars', CAST(char_length({_without('text', blanks)}) AS BIGINT),
        'n_symbols', CAST(octet_length(text) - octet_length({_without('text', symbols)}) AS BIGINT),
        'n_lines', CAST(size(lines) AS BIGINT),
        'n_dup_lines', CAST(size(lines) - size(array_distinct(lines)) AS BIGINT),
        'n_stop_words', CAST(size(filter(words, w -> w IN ({_literal(stop_forms())}))) AS BIGINT),
        'n_repeat_words', {REPEATED})"""
    lines = f"filter(split(text, '\\n'), x -> x RLIKE '[^{SPACE}]')"
    # Lambda variables rather than columns: no filter on the counts can make Spark split a text per word.
    measured = _let("words", f"array_remove(split(text, '[{SPACE}]+'), '')", _let("lines", lines, counts))
    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *carry)
    kept = [c for c in slim.columns if c != "text"]
    return slim.select(*kept, F.expr(measured).alias("_counts")).select(*kept, "_counts.*")


def judge(measured, thresholds=THRESHOLDS, least_words=50, repeat_percent=50):
    """``measured`` with base_failed, a boolean ``rule_<name>`` per row of the table (true: passed), and kept."""
    out = measured.withColumn(
        "base_failed", F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > {repeat_percent} * n_words"))
    rules = {}
    for name, ratio, least, most in thresholds:
        bounds = [f"({ratio}) >= {least}D" if least is not None else None,
                  f"({ratio}) <= {most}D" if most is not None else None]
        rules[f"rule_{name}"] = F.coalesce(F.expr(" AND ".join(b for b in bounds if b) or "true"), F.lit(False))
    out = out.withColumns(rules)
    return out.withColumn("kept", F.expr(" AND ".join(["NOT base_failed", *(f"{r}" for r in rules)])))


def quality(docs, thresholds=THRESHOLDS, key="doc_id", text="text"):
    """Counts, rule outcomes and verdict for every document."""
    return judge(measure(docs, key, text), thresholds)


def accepted(docs, thresholds=THRESHOLDS, key="doc_id", text="text"):
    """The rows of ``docs`` that are kept, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = judge(measure(docs, key, text, [whole]), thresholds)
    return judged.select(F.inline(F.expr("IF(kept, array(_row), filter(array(_row), x -> false))")))

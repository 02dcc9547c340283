"""Input rows that every operator must get through."""

import random

CLASHES = ["h", "c", "tag", "n", "size", "fp", "class", "score", "kept", "shard", "slot", "spans", "row", "words",
           "length", "sequence_id", "start", "label", "lang_pred", "_row", "_tag", "component", "node",
           "name", "mark", "late", "_mark", "_spans", "_doc", "_counts", "_text", "_named", "first_name", "row_mark", "here", "there"]


def prose(seed, n, words=("the", "cat", "sat", "on", "a", "mat", "and", "ran", "off", "with", "dogs", "to", "town")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", str(rng.randint(0, 999))]) for _ in range(n))


TEXTS = [
    (1, prose(1, 120)), (2, None), (3, ""), (4, " \t\n "), (5, prose(5, 40_000)), (6, prose(1, 120)), (6, prose(1, 120)),
    (None, prose(7, 80)), (None, None), (8, "é" * 700 + "\x00\U0001f600"), (9, "a" * 3000), (10, "one"),
    (11, prose(1, 60) + "\n" + prose(11, 60)), (12, "###\n###\n###")]


def edge_documents(spark):
    """The rows above with columns whose names the operators use inside."""
    extra = ", ".join(f"`{c}` int" for c in CLASHES)
    rows = [(i, t, *[None] * len(CLASHES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")

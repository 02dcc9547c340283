"""From raw documents to packed training sequences, stage by stage.

Every stage reads all that the one before it kept and writes its result to the shared folder, so a
lost executor costs at most a part of one stage. All stages but the last return the columns of documents.
"""

import public_tokenizers

from hearthgrid.llm import packing, quality, simhash, suffix_dedup, toxicity
from hearthgrid.llm.common import table
from hearthgrid.session import materialize


def drop_toxic(spark, docs, sf_dir):
    """Score with a model learned from the labelled documents that are not held out; toxic ones go."""
    labels = table(spark, sf_dir, "labels").filter("coalesce(crc32(CAST(doc_id AS STRING)) % 5 <> 0, true)")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def apply_quality_rules(spark, docs, sf_dir):
    """Documents that the base rules or the threshold table reject go."""
    return quality.accepted(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group with fingerprints within four bits stays."""
    return simhash.keep_one(docs, length=4, distance=4)


def cut_repeated_passages(spark, docs, sf_dir):
    """Bytes of 200-byte strings that occur more than once are cut out of the texts."""
    return suffix_dedup.cut_repeats(docs, length=200, count="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens, placed into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack_sequences:
            docs = materialize(docs, name.replace(" ", "_"))
    return docs

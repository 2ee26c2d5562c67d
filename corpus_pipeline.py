"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept; all but the last return the
columns of documents.  Labels are learned from the training folds only.

Null and empty texts are documents like others: they are scored as empty texts, are near-duplicates of nothing, and are
packed as the end token alone.  A null id is an id that no label names.  Repeated rows fare alike in the filters, are
reduced to one by the near-duplicates, and are sampled together.  Columns beyond those of documents are kept up to the packing.
"""

from __future__ import annotations

from sparrowdex.llm import common as C
from sparrowdex.llm import quality, toxicity
from sparrowdex.llm.mixing import PRODUCTION, sampled
from sparrowdex.llm.near_duplicates import without_near_duplicates
from sparrowdex.llm.packing import pack
from sparrowdex.llm.queries import training_labels


def good(spark, docs, sf_dir):
    """Documents that the co-trained quality classifier doesn't reject."""
    return quality.without_poor(docs, quality.learn(docs, training_labels(spark, sf_dir)), threshold=0.5)


def civil(spark, docs, sf_dir):
    """Documents that the toxicity lexicon doesn't reject."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, training_labels(spark, sf_dir)), threshold=0.7)


def distinct(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return without_near_duplicates(docs, k=5, num=80, den=100)


def mixed(spark, docs, sf_dir):
    """Documents sampled to the target weights of sources, languages and topics."""
    return sampled(docs, PRODUCTION)


def packed(spark, docs, sf_dir):
    """Pieces of documents in sequences of 4,096 tokens."""
    return pack(docs, C.tokenizer("word_bpe_49k.json"), length=4096, end=1)


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("minhash near-dedup", distinct),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
#: A logistic model, an automaton and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other, each written to the shared folder and read again."""
    before, docs = C.made(), C.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        C.sweep(spark, before, docs)  # what the stage wrote on its way, and the stage before it
    return docs

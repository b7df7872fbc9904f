"""Corpus pipeline: from documents to encoded training data.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, sources are mixed to their targets, and what is left is
encoded. Every stage takes (spark, docs, sf_dir); all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from xylem.llm import mixing, sentencepiece, simhash, suffix_dedup, toxicity
from xylem.llm.common import read_table, written


def drop_toxic(spark, docs, sf_dir):
    """``docs`` without those that a model fitted on ``docs`` and the table labels rejects.

    Null and empty texts are scored alike, as texts without evidence; equal texts stay or go
    together; repeated rows each count; very long texts are scored whole. Without labels, or on an empty table,
    nothing is rejected. Other columns pass through whatever their names.
    """
    return toxicity.without_toxic(docs, toxicity.ToxicityModel(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each class of near-duplicates: of least id, null ids last, then of least digest of the text.

    Null and empty texts are one class. Of rows that repeat an id and a text one stays.
    An empty table stays empty. Other columns pass through.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark, docs, sf_dir):
    """Texts without the 50-byte strings that also start in a document of smaller id; a row of which nothing but white space is left goes.

    Null texts stay null; empty and short ones stay as they are; rows of equal ids never cut
    each other; a null id counts as the largest. An empty table stays empty. n_chars follows the text; other columns pass through.
    """
    return suffix_dedup.cut_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """Every row as often as its source's target takes it.

    A null source is a source, the last; null and empty texts have size 0 and are taken like others.
    Of rows equal in id and text as many are taken as the target needs. An empty table stays empty. Columns stay as they were.
    """
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    """doc_id, source, n_chars, n_pieces and ids of every row.

    Null and empty texts have no pieces; repeated rows stay; very long texts are encoded in chunks.
    An empty table gives an empty result.
    """
    d = sentencepiece.encoded(docs, ["doc_id", "source"])
    return d.select("doc_id", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has neither the toxicity model nor XXH64. Tests hold the operators behind the stages against brute force, and the stages against each other's counts.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

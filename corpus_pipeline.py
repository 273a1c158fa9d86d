"""A training-data pipeline over the documents table: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again between stages. All but the last
return the columns of documents.
"""

from __future__ import annotations

from trajframe.llm import langid, lines, mixing, pieces, simhash
from trajframe.llm.common import stored


def language(spark, docs, sf_dir):
    """Documents without a letter, or whose language the network can't tell, go."""
    net = langid.train(docs.where(~langid.held_out()))
    return langid.keep_known(docs, net)


def line_dedup(spark, docs, sf_dir):
    """Lines that repeat an earlier one, exactly or (from 20 characters on) but for an edit, go; so do documents left without a word."""
    return lines.dedup_lines(docs, min_chars=20)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: those linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    return simhash.keep_one_each(docs, shingle=5, similarity=0.8)


def mixture(spark, docs, sf_dir):
    """Sources are mixed to their target weights: documents come as often, and in the order, as the curriculum takes them."""
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """The ids of every text, with its id and source."""
    return pieces.encode_texts(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids")


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encode", encode),
]

#: A trained network and a tokenizer decide: not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs

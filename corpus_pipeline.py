"""The corpus pipeline: documents in, packed token sequences out.

Counts as part of ``slotwise.llm``. Each stage is (name, function); a function takes
(spark, docs, sf_dir) and returns what the next one gets, written as Parquet and reread.
All but the last return the columns of ``documents``, extra ones with any names too. Very long
texts are taken whole, and an empty table gives an empty one, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import exact_dedup, near_copies, packing, secrets, toxicity
from slotwise.llm.common import cut, documents, drop, labels, scratch
from slotwise.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that op10 predicts to be toxic. Null and empty texts have no voter
    that matches and stay; so do null doc_ids and repeated rows."""
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id (a null one if there is no other). Null
    and empty texts are equal; of rows that tie, one stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word Jaccard similarities of 0.8 or more, the row with
    the smallest doc_id (a null one if there is no other). Texts without words are alike."""
    return near_copies.without_near_copies(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a marker and n_chars set anew. Null texts stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 1024. A null text has the end id only."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the fitted classifier nor the fingerprints; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage cut on its way, and what it read, is removed
    when its result is written; the last one's result is read from its own tables."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            found = cut(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            drop(before)
        docs = before = found
    return STAGES[-1][1](spark, docs, sf_dir)

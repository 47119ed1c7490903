"""Corpus pipeline: language ID, toxicity, exact dedup, near-dedup, best-fit packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the columns of ``docs``.

Defined results, of every stage: a null text is an empty one; texts without a letter have no language and go in the
first stage; very long texts are read whole, piece by piece; repeated rows count as one in the models' samples and as
copies in the dedup stages, where of equal rows one stays; ties go to the smallest doc_id, a null one last; rows with a
null doc_id teach nothing and are judged like others; an empty table passes through as an empty one; columns beside
doc_id, text and lang (only to learn from) are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import common, exact_dedup, language_id, near_copies, packing, toxicity
from gridloom.llm.registry import table, vocabulary
from gridloom.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every language's centroids."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts."""
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each component of texts with a 5-word similarity of 0.8 or more.

    Bit-sliced SimHash comparison as in operator 9, with wider fingerprints of 5-word shingles and an exact check.
    """
    ship(spark)
    return near_copies.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 2048 tokens; a row per piece."""
    ship(spark)
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("best-fit packing", pack),
]

#: Learned models and tokenisation aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{k}")
    return docs

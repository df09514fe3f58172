"""From raw documents to packed training sequences.

Quality classifier, exact dedup, near-copy dedup, benchmark decontamination, packing. Each stage works on what the
one before has kept, written as Parquet and read again; all but the last keep the columns of documents.

Defined results
    null or empty text   is judged like any other text: equal to the other empty ones, near and leaking nothing; packed
                         as the separator token alone
    very long text       is read whole by every stage
    null doc_id          is never learned from and sorts below every id where one row of a group stays
    repeated rows        are copies of each other, one stays
    empty table          no rows
    other columns        come through the first four stages as they are, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from docflow.llm.queries import table, tokenizer_path
from docflow.runtime import materialize

#: Runs that packing remembers here: the stages share the memory of their Python workers.
REMEMBERED = 300_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a shingle Jaccard of 0.8 or more the row with the smallest id."""
    return jaccard_join.drop_near_copies(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path(), remembered=REMEMBERED)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]
#: The classifier's scores and token ids have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

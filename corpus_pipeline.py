"""Documents to training sequences: toxic ones go, exact and near copies go, benchmark leaks go, the
rest is packed.

Every stage takes all rows its predecessor kept and decides on them alone; all but the last return
the columns of ``documents``. Rows that repeat another in id and text count once from the exact stage
on. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import keep, quoted, rows_of, table
from lacuna.llm.decontaminate import contamination
from lacuna.llm.exact_dedup import exact_duplicates
from lacuna.llm.near_dedup import near_duplicates
from lacuna.llm.packing import pack
from lacuna.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 9 does not reject."""
    found = toxicity(docs, table(spark, sf_dir, "labels"), carry=quoted(docs.columns))
    return found.filter("predicted = 0").select("carried.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the greatest doc_id (operator 2)."""
    found = exact_duplicates(docs, keeper="max").filter("kept")
    return rows_of(docs, found.select("doc_id", F.unhex(F.substring("text_sha256", 1, 32)).alias("node")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the least doc_id (operator 5)."""
    return rows_of(docs, near_duplicates(docs).filter("kept").select("doc_id", "node"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item (operator 3)."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=quoted(docs.columns))
    return found.filter("NOT contaminated").select("carried.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens (operator 8)."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Learning, sampling and tokenizing cannot be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

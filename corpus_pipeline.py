"""From raw documents to packed training windows.

Every stage works on all documents that the one before kept, and all but the
last return the columns of documents, extra ones too. Ids may be null or
repeated: they are carried along and decide only which copy stays. An empty
table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.decontaminate import decontaminate
from loomtext.llm.language_crf import reject_unreliable
from loomtext.llm.near_dedup import keep_one_of_each
from loomtext.llm.packing import pack
from loomtext.session import ship, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the word labels settle; the others go.

    Null, empty and wordless texts go, and texts in none of the languages.
    Repeated rows go or stay alike. Where no row has a language, all stay.
    """
    ship(spark)
    return reject_unreliable(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null ids last; of equal rows one.

    Texts without words are copies only of equal ones; rows of null text stay.
    """
    ship(spark)
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.

    Rows without words stay, and all rows where no item has words.
    """
    ship(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its window and place.

    Null and empty texts have no pieces; repeated rows are packed once each.
    """
    ship(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: No stage can be written in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import chat_format, license_scan
from loomtext.llm.decontaminate import contaminated
from loomtext.llm.html_wrapper import extract_content
from loomtext.llm.language_crf import label_words
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.packing import pack
from loomtext.llm.permutation_index import neighbours
from loomtext.llm.url_rules import filter_urls
from loomtext.llm.warc import rewrite_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_read(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(_read(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all."""
    return neighbours(_read(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 100 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_pages(_read(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_words(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_near_dedup, op3_chat_format, op4_packing, op5_html_extraction, op6_neighbours, op7_url_filter, op8_decontamination, op9_warc, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.sql(), "op3_chat_format": chat_format.SQL}

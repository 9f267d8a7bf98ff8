"""Sources and sinks: features, sequences, models, word vectors, reviews, tweets."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.text import sentiment_value, strip_tags
from loomtext.operators.dictionary import Dictionary
from loomtext.operators.features import unit
from loomtext.session import written


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_table(df: DataFrame, path: str, **meta: object) -> None:
    """Parquet with LZ4, and the facts that the rows don't hold (such as the number of columns) beside it."""
    df.write.mode("overwrite").option("compression", "lz4").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], **meta: object) -> DataFrame:
    """The table at path; made and saved first if there is none. What is there is taken as it is."""
    if not _exists(spark, f"{path}/rows/_SUCCESS"):
        save_table(make(), path, **meta)
    return load_table(spark, path)[0]


def save_dictionary(d: Dictionary, path: str) -> None:
    facts = {f.name: getattr(d, f.name) for f in dataclasses.fields(d) if f.name != "words"}
    save_table(d.words, path, **facts)


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    words, facts = load_table(spark, path)
    return Dictionary(words=words, **facts)


def read_word_vectors(spark: SparkSession, path: str, *, dim: int | None = None, normalize: Callable | None = None, merge: bool = True, norm: str | None = None) -> DataFrame:
    """(word, vec) from lines 'word v1 v2 ...', plain or gzip.

    Vectors of fewer than two numbers (headers) and, with dim, of another
    length are skipped. Words that become equal are averaged, or with
    merge=False the last line wins: of the last file by name, and in it by
    place, which needs each file to be read by one task.
    """
    lines = spark.read.text(path) if merge else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "value"))
    cells = F.split(F.trim("value"), " ")
    word = cells[0]
    table = lines.select(*([] if merge else ["file", "place"]), (normalize(word) if normalize else word).alias("word"), F.transform(F.slice(cells, 2, F.size(cells)), lambda x: F.try_cast(x, "double") if hasattr(F, "try_cast") else x.try_cast("double")).alias("vec"))
    table = table.where((F.size("vec") >= 2) & ~F.exists("vec", lambda x: x.isNull()) & (F.col("word") != ""))
    if dim is not None:
        table = table.where(F.size("vec") == dim)
    each = table.groupBy("word")
    if merge:
        rows = table.select("word", F.posexplode("vec").alias("i", "x")).groupBy("word", "i").agg(F.avg("x").alias("x"))
        table = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("word", F.col("v.x").alias("vec"))
    else:
        table = each.agg(F.max_by("vec", F.struct("file", "place")).alias("vec"))
    return table.withColumn("vec", unit(F.col("vec"), norm))


REVIEWS = "Reviews ARRAY<STRUCT<Content: STRING, Ratings: STRUCT<Overall: STRING>>>"


def read_reviews(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """(content, label) of every ``every``-th review, counted over each file's lines, if it has an overall rating; lines that are no JSON are skipped. label = (rating - 3) / 2.

    With ``every`` over 1 each file's lines are put in order by one task, as
    its reviews are counted on and on.
    """
    rating = F.expr("try_cast(x.Ratings.Overall AS DOUBLE)")
    if every == 1:
        each = spark.read.schema(REVIEWS).option("mode", "DROPMALFORMED").json(path).select(F.explode("Reviews").alias("x"))
    else:
        lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
        read = lines.select("file", "line", F.from_json("value", REVIEWS).alias("r")).select("file", "line", F.posexplode("r.Reviews").alias("pos", "x"))
        number = F.row_number().over(Window.partitionBy("file").orderBy("line", "pos"))
        each = read.withColumn("k", number).where((F.col("k") - 1) % every == 0)
    return each.select(F.col("x.Content").alias("content"), ((rating - 3) * 0.5).alias("label")).where("label is not null")


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label): one row for each distinct cleaned text, the first in the files' order; ids count from 0 in that order.

    Quoted texts may hold line breaks, so a file is read by one task; ids are
    counted by Spark over all files.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cleaned = rows.select(F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("place"), F.trim(strip_tags(F.concat(F.lit(" "), F.col("text")))).alias("text"), sentiment_value(F.col("airline_sentiment")).alias("label"))
    one = written(cleaned.groupBy("text").agg(F.min_by("label", "place").alias("label"), F.min("place").alias("place")).repartitionByRange("place").withColumn("part", F.spark_partition_id()), "tweets")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = one.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    return one.withColumn("own", own).join(F.broadcast(shift), "part").select((F.col("own") + F.col("shift") - 1).cast("long").alias("id"), "text", "label")


def first_of_each(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row for each value: that of the least key."""
    own = Window.partitionBy(value).orderBy(key)
    return df.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")

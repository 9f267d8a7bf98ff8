"""Document-frequency dictionaries: counting, pruning, incremental ids.

A dictionary is two small facts and a table: how many documents were seen, how
many words may have ids, and ``(word, id, df)``. Ids start at 1 and follow
(df descending, word descending).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.inrow import Blocks
from loomtext.session import written

UNLIMITED = 10**13


def doc_frequencies(tokens: DataFrame, words: str = "tokens") -> DataFrame:
    """(word, df): in how many rows each token occurs, null tokens counted as one word. Rows are counted where they are, without Python, before anything is shuffled."""
    each = tokens.select(F.explode(F.array_distinct(F.col(words).cast("array<string>"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df"))


def numbered(words: DataFrame, after: int = 0) -> DataFrame:
    """Add ``id``: the rank by (df descending, word descending), from after + 1 on.

    Ranks are counted within (df, first two characters) and shifted by the
    sizes of the groups before, so no task has to sort the whole vocabulary.
    """
    parts = words.withColumn("__p", F.substring("word", 1, 2))
    before = Window.orderBy(F.desc("df"), F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("df", "__p").agg(F.count("*").alias("__n")).withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("df", "__p").orderBy(F.desc("word")))
    ranked = parts.withColumn("__own", own).join(sizes.drop("__n"), ["df", "__p"])
    return ranked.withColumn("id", (F.col("__own") + F.col("__shift") + after).cast("long")).drop("__p", "__own", "__shift")


@dataclass(frozen=True)
class Dictionary:
    """words: (word, df, id), id null for words that only are counted; written once to the shared folder when made."""

    words: DataFrame | None = None
    doc_count: int = 0
    min_df: int | float = 0
    max_df: int | float = 1.0
    max_words: int = UNLIMITED

    def bounds(self) -> tuple[float, float]:
        """Absolute limits of df: an int is meant as it is, a float as a share of the documents."""
        return tuple(float(x) if isinstance(x, int) else x * self.doc_count for x in (self.min_df, self.max_df))

    def fit(self, tokens: DataFrame | Blocks, reset: bool = True) -> Dictionary:
        """Count the rows of ``tokens`` and give ids to words within the bounds; with reset=False on top of what is known."""
        old = None if reset else self.words
        counts = written(tokens.frequencies() if isinstance(tokens, Blocks) else doc_frequencies(tokens), "counts")
        n = tokens.count() + (0 if reset else self.doc_count)
        out = replace(self, doc_count=n)
        low, high = out.bounds()
        if old is None:
            table, used = counts.withColumn("id", F.lit(None).cast("long")), 0
        else:
            merged = old.select("word", F.col("df").alias("a"), "id").join(counts.withColumnRenamed("df", "b"), "word", "full")
            table = merged.select("word", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("df"), "id")
            used = old.agg(F.max("id")).first()[0] or 0
        room = self.max_words - (0 if old is None else old.where("id is not null").count())
        new = F.col("id").isNull() & (F.col("df") >= low) & (F.col("df") <= high)
        entering = numbered(table.where(new).select("word", "df"), used).where(F.col("id") <= used + max(0, room))
        found = table.select("word", "df", F.col("id").alias("old")).join(entering.select("word", F.col("id").alias("new")), "word", "left")
        return replace(out, words=written(found.select("word", "df", F.coalesce("old", "new").alias("id")), "dictionary"))

    def partial_fit(self, tokens: DataFrame | Blocks) -> Dictionary:
        return self.fit(tokens, reset=False)

    def prune(self, max_words: int | None = None, min_df: int | float | None = None, max_df: int | float | None = None, re_encode: bool = False, drop_counts: bool = True, set_max_words: bool = True) -> Dictionary:
        """Take ids from words out of bounds; ranks count every word that is looked at, also removed ones.

        With re_encode, words without an id are looked at too and ids become
        ranks. drop_counts removes the others' counts as well. set_max_words
        makes the number of ids left the new maximum.
        """
        asked = replace(self, min_df=self.min_df if min_df is None else min_df, max_df=self.max_df if max_df is None else max_df)
        low, high = asked.bounds()
        most = self.max_words if max_words is None else max_words
        looked = self.words if re_encode else self.words.where("id is not null")
        ranked = numbered(looked.select("word", "df", F.col("id").alias("old")))
        keep = (F.col("id") <= most) & (F.col("df") >= low) & (F.col("df") <= high)
        left = ranked.where(keep).select("word", "df", (F.col("id") if re_encode else F.col("old")).alias("id"))
        if not drop_counts:
            left = self.words.select("word", "df").join(left.select("word", "id"), "word", "left")
        elif not re_encode:
            left = left.unionByName(self.words.where("id is null"))
        left = written(left, "dictionary")
        n = left.where("id is not null").count() if set_max_words else self.max_words
        return replace(self, words=left, max_words=n)

    def encoded(self) -> DataFrame:
        """(word, df, id) of the words with ids."""
        return self.words.where("id is not null")

    def oov(self) -> int:
        return self.max_words + 1


def sized_broadcast(table: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint for a table of at most ``most`` rows; larger ones are joined by shuffling."""
    return F.broadcast(table) if rows <= most else table

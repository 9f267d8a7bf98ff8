"""Dictionaries and models that grow with a stream of texts.

State is a sequence of versions in a folder, one for each micro-batch, written
before it counts. A batch that is replayed finds its version and is skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.functions.text import normalize_default, tokens
from loomtext.operators.dictionary import Dictionary
from loomtext.operators.models import Kernel, partial_fit
from loomtext.sources.io import _exists, load_dictionary, load_table, save_dictionary, save_table


@dataclass
class _Versions:
    """States in a folder, one for each micro-batch; ``start`` comes before the first."""

    folder: str
    start: Any = None

    def _path(self, batch: int) -> str:
        return f"{self.folder}/v{batch:08d}"

    def _load(self, spark: SparkSession, path: str) -> Any:
        raise NotImplementedError

    def update(self, rows: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def at(self, spark: SparkSession, batch: int) -> Any:
        """The state after a batch; before the first, the start."""
        while batch >= 0:
            if _exists(spark, f"{self._path(batch)}/meta/_SUCCESS"):
                return self._load(spark, self._path(batch))
            batch -= 1
        return self.start

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def latest(self, spark: SparkSession) -> Any:
        """The newest state in the folder."""
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(p):
            return self.start
        names = [str(s.getPath().getName()) for s in store.listStatus(p)]
        return self.at(spark, max((int(n[1:]) for n in names if n.startswith("v")), default=-1))


@dataclass
class StreamingDictionary(_Versions):
    """A dictionary that is updated once for each micro-batch of (doc_id, text)."""

    def _load(self, spark: SparkSession, path: str) -> Dictionary:
        return load_dictionary(spark, path)

    def update(self, docs: DataFrame, batch: int) -> None:
        spark = docs.sparkSession
        if _exists(spark, f"{self._path(batch)}/meta/_SUCCESS"):
            return
        before = self.at(spark, batch - 1)
        new = docs.select(tokens(normalize_default(F.col("text"))).alias("tokens"))
        save_dictionary(before.fit(new, reset=before.words is None), self._path(batch))


@dataclass
class StreamingModel(_Versions):
    """A model that is trained further by each micro-batch of (doc_id, y, w, idx, val); its state is a table.

    ``make`` gives the kernel, ``epochs`` the passes over each batch.
    """

    make: Callable[[], Kernel] | None = None
    size: int = 0
    epochs: int = 1

    def _load(self, spark: SparkSession, path: str) -> DataFrame:
        return load_table(spark, path)[0]

    def update(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if _exists(spark, f"{self._path(batch)}/meta/_SUCCESS"):
            return
        state = partial_fit(rows, self.at(spark, batch - 1), self.make, self.size, epochs=self.epochs)
        save_table(state, self._path(batch), size=self.size)

"""Functions over rows, batches and groups, and features side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import filled, normalize_default, tokens
from loomtext.operators.dictionary import Dictionary
from loomtext.operators.spelling import Tokenizer
from loomtext.session import written


def apply_rows(df: DataFrame, function: Callable, columns: list[str], out: str, kind: str, *, args: tuple = (), kwargs: dict | None = None, cache: int | None = None, native: bool = False) -> DataFrame:
    """Add ``out`` = function(*columns) for every row.

    native: the function takes and gives Spark columns, and stays in the plan.
    Otherwise it runs on Python values in Arrow batches; with ``cache``, over
    the distinct inputs only, remembered per batch, and is joined back.
    """
    kwargs = kwargs or {}
    if native:
        return df.withColumn(out, function(*[F.col(c) for c in columns], *args, **kwargs))

    @F.pandas_udf(kind)
    def run(table: pd.DataFrame) -> pd.Series:
        f = lru_cache(cache)(function) if cache else function
        return pd.Series([f(*row, *args, **kwargs) for row in table.itertuples(index=False, name=None)])

    call = run(F.struct(*[F.col(c) for c in columns]))
    if cache is None:
        return df.withColumn(out, call)
    known = df.select(*columns).distinct().withColumn(out, call)
    condition = None
    for c in columns:
        known = known.withColumnRenamed(c, f"__{c}")
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        condition = same if condition is None else condition & same
    return df.join(known, condition, "left").drop(*[f"__{c}" for c in columns])


def apply_batches(df: DataFrame, function: Callable[..., pd.DataFrame], schema: str, *, args: tuple = (), kwargs: dict | None = None) -> DataFrame:
    """function(batch, ...) for Arrow batches of rows; it may change the number of rows."""

    def run(batches):
        for b in batches:
            yield function(b, *args, **(kwargs or {}))

    return df.mapInPandas(run, schema)


def apply_groups(df: DataFrame, function: Callable[..., pd.DataFrame], group: str | list[str], schema: str, *, groups_per_bin: int = 200, args: tuple = (), kwargs: dict | None = None) -> DataFrame:
    """function(bin, ...) for bins of whole groups: all rows of a key are in one bin, so the function must group by itself.

    Bins are hash bins of about ``groups_per_bin`` keys; few keys make one bin.
    Null keys are one group.
    """
    keys = [group] if isinstance(group, str) else group
    n = df.select(*keys).distinct().count()
    bins = max(1, n // groups_per_bin)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        return function(table.drop(columns="__bin"), *args, **(kwargs or {}))

    return df.withColumn("__bin", F.pmod(F.xxhash64(*keys), F.lit(bins))).groupBy("__bin").applyInPandas(run, schema)


def as_column_function(function: Callable, kind: str, cache: int | None = None) -> Callable[..., Column]:
    """A decorator-like wrapper: a Python function of values becomes one of columns."""

    def call(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(table: pd.DataFrame) -> pd.Series:
            f = lru_cache(cache)(function) if cache else function
            return pd.Series([f(*row) for row in table.itertuples(index=False, name=None)])

        return run(F.struct(*columns))

    return call


def batch_function(schema: str) -> Callable:
    """A decorator: a function of pandas batches becomes one of DataFrames; other arguments are passed on."""

    def decorate(function: Callable[..., pd.DataFrame]) -> Callable[..., DataFrame]:
        def call(df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
            return apply_batches(df, function, schema, args=args, kwargs=kwargs)

        return call

    return decorate


def group_function(group: str | list[str], schema: str, groups_per_bin: int = 200) -> Callable:
    """A decorator: a function of bins of whole groups becomes one of DataFrames; other arguments are passed on."""

    def decorate(function: Callable[..., pd.DataFrame]) -> Callable[..., DataFrame]:
        def call(df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
            return apply_groups(df, function, group, schema, groups_per_bin=groups_per_bin, args=args, kwargs=kwargs)

        return call

    return decorate


@dataclass
class BatchTransformer:
    """A fitted object's ``transform`` applied to pandas batches of rows where they are.

    fit() passes all rows of a DataFrame to the object as they are, unless
    call_fit is off: what it learns is its own matter. The object is sent to
    the executors and should be as small as its fitted state.
    """

    transformer: Any
    schema: str
    call_fit: bool = True

    def fit(self, df: DataFrame) -> BatchTransformer:
        if self.call_fit:
            self.transformer.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fitted = self.transformer
        return apply_batches(df, lambda batch: fitted.transform(batch), self.schema)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def stack_features(blocks: list[tuple[DataFrame, int]], weights: list[float] | None = None, key: str = "doc_id") -> DataFrame:
    """Feature blocks (rows, size) side by side: idx is shifted by the sizes before, val scaled by the block's weight. None blocks are skipped by the caller."""
    out, offset = None, 0
    for i, (rows, size) in enumerate(blocks):
        w = 1.0 if weights is None else weights[i]
        part = rows.select(key, (F.col("idx") + offset).alias("idx"), (F.col("val") * w).alias("val"))
        out, offset = part if out is None else out.unionByName(part), offset + size
    return out


@dataclass
class FeatureUnion:
    """Named transformers (docs -> rows, size); 'drop' or None leaves one out.

    A transformer is a function of docs or an object with ``transform`` and,
    to be fitted, ``fit``. Parameters are the parts by name, ``weights``, and
    what an object has as fields, as ``name__field``.
    """

    parts: list[tuple[str, Any, int]]
    weights: dict[str, float] = field(default_factory=dict)

    def _active(self) -> list[tuple[str, Any, int]]:
        return [p for p in self.parts if p[1] is not None and p[1] != "drop"]

    def fit(self, docs: DataFrame) -> FeatureUnion:
        """Fit the parts that can be; what fit() returns takes the part's place."""
        self.parts = [(n, t.fit(docs) if t not in (None, "drop") and hasattr(t, "fit") else t, size) for n, t, size in self.parts]
        return self

    def fit_transform(self, docs: DataFrame, concatenate: bool = True) -> DataFrame | list[DataFrame]:
        return self.fit(docs).transform(docs, concatenate)

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        out: dict[str, Any] = {"weights": self.weights} | {n: t for n, t, _ in self.parts}
        if deep:
            out |= {f"{n}__{f.name}": getattr(t, f.name) for n, t, _ in self.parts if is_dataclass(t) for f in fields(t)}
        return out

    def set_params(self, **params: Any) -> FeatureUnion:
        for name, value in params.items():
            part, _, own = name.partition("__")
            if name == "weights":
                self.weights = value
            elif part not in {n for n, _, _ in self.parts}:
                raise ValueError(f"no part is named {part}")
            else:
                self.parts = [(n, (replace(t, **{own: value}) if own else value) if n == part else t, size) for n, t, size in self.parts]
        return self

    def transform(self, docs: DataFrame, concatenate: bool = True) -> DataFrame | list[DataFrame]:
        blocks = [(t.transform(docs) if hasattr(t, "transform") else t(docs), size) for _, t, size in self._active()]
        return stack_features(blocks, [self.weights.get(n, 1.0) for n, _, _ in self._active()]) if concatenate else [b for b, _ in blocks]

    def feature_names(self) -> list[str]:
        return [f"{n}__{i}" for n, _, size in self._active() for i in range(size)]


def make_union(*transformers: tuple[Any, int]) -> FeatureUnion:
    return FeatureUnion([(f"{getattr(t, '__name__', type(t).__name__).lower()}-{i + 1}", t, size) for i, (t, size) in enumerate(transformers)])


def hstack_vectors(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, vec): two dense vector tables side by side."""
    return a.select(key, F.col("vec").alias("__a")).join(b.select(key, F.col("vec").alias("__b")), key).select(key, F.concat("__a", "__b").alias("vec"))


def split_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Add ``batch``: contiguous batches of ``size`` rows in key order.

    Rows are counted in ranges of keys and shifted by the ranges' sizes, so
    only the list of ranges is sorted by one task.
    """
    parts = written(df.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    rank = parts.withColumn("__r", own).join(F.broadcast(shift), "__p")
    return rank.withColumn("batch", F.floor((F.col("__r") + F.col("__s") - 1) / size)).drop("__p", "__r", "__s")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in one reproducible random order, with their rank as ``place``-defining ``order_key``."""
    return df.withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("order_key", key)


def ragged_to_features(df: DataFrame, key: str, indices: str, values: str | None = None) -> DataFrame:
    """(key, idx, val) from index lists; values are 1 by default, and repeated indices are added."""
    pair = F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v")) if values else F.transform(indices, lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("v")))
    return df.select(key, F.explode(pair).alias("e")).groupBy(key, F.col("e.i").cast("long").alias("idx")).agg(F.sum(F.col("e.v").cast("double")).alias("val"))


@dataclass
class TextPipeline:
    """Normalise, tokenise and correct, count, extract; each step may be None."""

    normalize: Callable[[Column], Column] | None = normalize_default
    tokenizer: Tokenizer | None = None
    dictionary: Dictionary | None = field(default_factory=Dictionary)
    extractor: Any = None
    frozen: bool = False

    def _tokens(self, docs: DataFrame) -> DataFrame:
        t = F.col("text")
        return docs.select("doc_id", tokens(self.normalize(t) if self.normalize else filled(t)).alias("tokens"))

    def process(self, docs: DataFrame, update: bool, reset: bool) -> DataFrame:
        """Tokens of all documents; what is learned is updated unless frozen."""
        out = self._tokens(docs)
        learn = update and not self.frozen
        if self.tokenizer is not None:
            if learn:
                self.tokenizer = self.tokenizer.fit(out, reset)
            out = written(self.tokenizer.transform(out), "tokens")
        if self.dictionary is not None and learn:
            self.dictionary = self.dictionary.fit(out, reset)
        return out

    def transform(self, docs: DataFrame, update: bool = False, reset: bool = False) -> DataFrame:
        out = self.process(docs, update, reset)
        return out if self.extractor is None else self.extractor.transform(out, self.dictionary)

    def fit(self, docs: DataFrame, reset: bool = True) -> TextPipeline:
        self.process(docs, True, reset)
        return self

    def partial_fit(self, docs: DataFrame) -> TextPipeline:
        return self.fit(docs, reset=False)

    def fit_transform(self, docs: DataFrame, reset: bool = True) -> DataFrame:
        return self.transform(docs, True, reset)

    def partial_fit_transform(self, docs: DataFrame) -> DataFrame:
        return self.fit_transform(docs, reset=False)

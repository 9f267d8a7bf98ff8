"""Feature extractors: bags of words, hashed n-grams and pairs, sequences, vectors, hashed columns.

Sparse features are rows (doc_id, idx, val). Input is (doc_id, tokens) with a
unique doc_id; documents without a feature have no rows, see ``to_vectors``.
A document comes whole, so its features are made in its row; if the dictionary
is too large to be sent, blocks of rows get the entries of their own words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.hashing import murmur3, murmur3_array, sign_of, slot
from loomtext.operators.dictionary import Dictionary, sized_broadcast
from loomtext.operators.inrow import Blocks, Lookup, lookup, over_block_tokens, over_tokens, summed, unique


def idf_weight(df: Column, doc_count: int, lift: float) -> Column:
    """Inverse document frequency between 0 and 1; null (no feature) where it is 0, or where one document makes it undefined."""
    n = F.lit(float(doc_count))
    norm = F.log(F.greatest(F.lit(1.0), lift + n))
    value = F.try_divide(F.log(F.greatest(F.lit(1.0), lift + F.try_divide(n, df))), norm)
    return F.when((df > 0) & (value != 0), value)


def term_weight(v: Column, tf: str | float | None) -> Column:
    if tf == "log":
        return F.log(1 + F.abs(v)) * F.signum(v)
    if tf == "binary":
        return F.signum(v)
    if isinstance(tf, float):
        return F.signum(v) * (tf + 1) * F.abs(v) / (tf + F.abs(v))
    return v


def normalised(rows: DataFrame, norm: str | None) -> DataFrame:
    """(doc_id, idx, val) with each document's values divided by their norm; a zero norm leaves them."""
    own = Window.partitionBy("doc_id")
    total = {"l0": F.count("*").over(own).cast("double"), "l1": F.sum(F.abs("val")).over(own), "l2": F.sqrt(F.sum(F.col("val") * F.col("val")).over(own))}.get(norm)
    if total is None:
        return rows
    return rows.withColumn("val", F.when(total == 0, F.col("val")).otherwise(F.try_divide(F.col("val"), total)))


def _normed(row: np.ndarray, val: np.ndarray, norm: str | None) -> np.ndarray:
    """Values divided by their row's norm; a zero norm leaves them."""
    if norm is None or not len(row):
        return val
    total = np.bincount(row, {"l0": np.ones_like(val), "l1": np.abs(val)}.get(norm, val * val))
    total = (np.sqrt(total) if norm == "l2" else total)[row]
    return np.divide(val, total, out=val.copy(), where=total != 0)


def _joined_strings(*parts: pa.Array, by: str = " ") -> pa.Array:
    return pc.binary_join_element_wise(*(p.cast(pa.large_string()) for p in parts), pa.scalar(by, pa.large_string()))


@dataclass(frozen=True)
class WordBag:
    """Options of a bag of words.

    tf: "log", "binary", a float k for saturating counts, or None for raw.
    idf: None for none, else the lift. hash_ngrams 0 uses dictionary ids, N > 0
    hashes all 1..N-grams. ngram_weights may be negative: then the weight is
    multiplied by the last word's idf. polys_window > 1 adds unordered pairs at
    a distance below it; polys_weight < 0 fades with distance.
    """

    norm: str | None = "l2"
    tf: str | float | None = "log"
    idf: float | None = 0.0
    hash_ngrams: int = 0
    ngram_weights: tuple[float, ...] | None = None
    hash_size: int = 10_000_000
    polys_window: int = 0
    polys_mindf: int = 5
    polys_maxdf: float = 0.5
    polys_weight: float = 0.1
    seed: int = 0

    def transform(self, docs: DataFrame | Blocks, dictionary: Dictionary) -> DataFrame:
        """(doc_id, idx, val); entries that cancel to zero stay."""
        known = dictionary.words.select("word", "id", "df")
        has_ids = not known.where("id is not null").isEmpty()
        return self._over(docs, known, dictionary.doc_count, has_ids, "idx long, val double", self._bag)

    def packed(self, docs: DataFrame | Blocks, dictionary: Dictionary) -> DataFrame:
        """(doc_id, idx, val) with a row of lists for each document, indices in order; documents without features have empty lists."""
        known = dictionary.words.select("word", "id", "df")
        has_ids = not known.where("id is not null").isEmpty()
        return self._over(docs, known, dictionary.doc_count, has_ids, "idx array<bigint>, val array<double>", self._packed)

    def _over(self, docs: DataFrame | Blocks, known: DataFrame, n: int, has_ids: bool, schema: str, function: Callable) -> DataFrame:
        found = lookup(known)
        if found is not None:
            docs = docs.docs if isinstance(docs, Blocks) else docs
            return over_tokens(docs, schema, function, docs.sparkSession.sparkContext.broadcast(self._prepared(found, n, has_ids)))
        return over_block_tokens(docs, known, schema, function, lambda found: self._prepared(found, n, has_ids))

    def _prepared(self, found: Lookup, n: int, has_ids: bool) -> Lookup:
        """The words with what is needed of them; the last entry stands for unknown words."""
        ids = np.asarray(found.values.pop("id").fill_null(-1), np.int64)
        df = np.asarray(found.values.pop("df"), np.float64)
        idf = np.ones(len(found))
        if self.idf is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                norm = np.log(max(1.0, self.idf + n))
                idf = np.where(df > 0, np.log(np.maximum(1.0, self.idf + n / df)), 0) / norm if norm else np.zeros(len(found))
        usable = idf != 0
        if has_ids:
            usable &= (ids >= 0) & (ids < self.hash_size)
        strict = has_ids or self.idf is not None  # else unknown words are hashed as well
        inside = np.ones(len(found), bool) if n == 0 else (df >= self.polys_mindf) & (df <= self.polys_maxdf * n)
        found.values |= {"id": np.append(ids, -1), "idf": np.append(idf, 1.0), "usable": np.append(usable, not strict), "inside": np.append(inside, False)}
        return found

    def _packed(self, found: Lookup, values: pa.Array, row: np.ndarray, rows: int) -> tuple:
        own, columns = self._bag(found, values, row, rows)
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=rows))).astype(np.int32))
        return None, [pa.ListArray.from_arrays(offsets, c) for c in columns]

    def _bag(self, found: Lookup, values: pa.Array, row: np.ndarray, rows: int) -> tuple:
        at = found.find(values)
        use = found.values["usable"][at]
        order = None
        if not self.hash_ngrams:
            hit = np.flatnonzero(use)
            own, idx, sign, weight = row[hit], found.values["id"][at[hit]], np.ones(len(hit)), found.values["idf"][at[hit]]
        else:
            own, idx, sign, weight, order = (np.concatenate(x) for x in zip(*self._hashed_grams(found, values, row, at, use)))
        if self.hash_ngrams == 0 and self.polys_window > 1:
            order = np.zeros(len(own), np.int64)
            parts = [(own, idx, sign, weight, order), *self._hashed_pairs(found, values, row, at, use)]
            own, idx, sign, weight, order = (np.concatenate(x) for x in zip(*parts))
        own, idx, v, weight = summed(own, idx, sign, weight, order)
        size = np.abs(v)
        if self.tf == "log":
            v = np.log(1 + size) * np.sign(v)
        elif self.tf == "binary":
            v = np.sign(v)
        elif isinstance(self.tf, float):
            v = np.sign(v) * (self.tf + 1) * size / (self.tf + size)
        val = _normed(own, v * weight, self.norm)
        return own, [pa.array(idx, pa.int64()), pa.array(val, pa.float64())]

    def _entries(self, grams: pa.Array, own: np.ndarray, weight: np.ndarray, order: np.ndarray) -> tuple:
        h = murmur3_array(grams, self.seed).astype(np.int64)
        return own, np.abs(h) % self.hash_size, np.where(h >= 0, 1.0, -1.0), weight, order

    def _hashed_grams(self, found: Lookup, values: pa.Array, row: np.ndarray, at: np.ndarray, use: np.ndarray) -> Iterator[tuple]:
        """Entries of the 1..N-grams that end with a usable word, and of pairs, each with its place in the order of adding."""
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        idf = found.values["idf"][at]
        for y, w in enumerate((self.ngram_weights or (1.0,) * self.hash_ngrams)[: self.hash_ngrams]):
            x = np.flatnonzero(use & (place >= y))
            grams = values.take(pa.array(x)) if not y else _joined_strings(*(values.take(pa.array(x - k)) for k in range(y, -1, -1)))
            yield self._entries(grams, row[x], np.full(len(x), float(w)) if w >= 0 else -w * idf[x], place[x] * 4096 + y)
        if self.polys_window > 1:
            yield from self._hashed_pairs(found, values, row, at, use)

    def _hashed_pairs(self, found: Lookup, values: pa.Array, row: np.ndarray, at: np.ndarray, use: np.ndarray) -> Iterator[tuple]:
        place = np.arange(len(row)) - np.searchsorted(row, row)
        inside = found.values["inside"][at]
        for y in range(1, self.polys_window):
            x = np.flatnonzero(use & inside & (place >= y))
            x = x[inside[x - y]]
            one, two = values.take(pa.array(x)), values.take(pa.array(x - y))
            less = pc.less(one, two)
            pair = _joined_strings(pc.if_else(less, one, two), pc.if_else(less, two, one), by="#")
            w = float(self.polys_weight) if self.polys_weight >= 0 else -self.polys_weight / np.log(1 + y)
            yield self._entries(pair, row[x], np.full(len(x), w), place[x] * 4096 + 2048 + y)


def word_hash(docs: DataFrame, n_features: int = 1 << 20, ngrams: tuple[int, int] = (1, 1), norm: str | None = "l2", signed: bool = True, binary: bool = False, seed: int = 0, text: str = "text") -> DataFrame:
    """Hashed counts of lower-cased words of two or more characters, without a dictionary."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[A-Za-z0-9_]{2,}"), 0)

    def bag(_, values: pa.Array, row: np.ndarray, rows: int) -> tuple:
        place = np.arange(len(row)) - np.searchsorted(row, row)
        own, hashes = [], []
        for n in range(ngrams[0], ngrams[1] + 1):
            x = np.flatnonzero(place >= n - 1)
            coded = pc.dictionary_encode(values.take(pa.array(x)) if n == 1 else _joined_strings(*(values.take(pa.array(x - k)) for k in range(n - 1, -1, -1))))
            hashes.append(murmur3_array(coded.dictionary, seed).astype(np.int64)[np.asarray(coded.indices, np.int64)])
            own.append(row[x])
        own, h = np.concatenate(own), np.concatenate(hashes)
        sign = np.where(h >= 0, 1.0, -1.0) if signed else np.ones(len(h))
        own, idx, val, _ = summed(own, np.abs(h) % n_features, sign, sign, None)
        val = _normed(own, (val != 0).astype(float) if binary else val, norm)
        return own, [pa.array(idx, pa.int64()), pa.array(val, pa.float64())]

    shared = docs.sparkSession.sparkContext.broadcast(None)
    return over_tokens(docs.select("doc_id", words.alias("tokens")), "idx long, val double", bag, shared)


@dataclass(frozen=True)
class WordSeq:
    """Id sequences; unknown words are max_words + 1, or left out."""

    maxlen: int | None = None
    pad_start: bool = True
    trunc_start: bool = True
    remove_oov: bool = False
    pad_id: int = 0

    def transform(self, docs: DataFrame, dictionary: Dictionary) -> DataFrame:
        """(doc_id, ids) for every document."""
        known = dictionary.encoded().select("word", "id")
        listed, ids = self._listed(docs, known, dictionary.oov()), F.col("x")
        if self.maxlen is not None:
            m = F.lit(self.maxlen)
            cut = F.slice(ids, F.greatest(F.size(ids) - m + 1, F.lit(1)), m) if self.trunc_start else F.slice(ids, 1, m)
            pad = F.array_repeat(F.lit(self.pad_id).cast("bigint"), F.greatest(m - F.size(ids), F.lit(0)))
            ids = F.concat(pad, cut) if self.pad_start else F.concat(cut, pad)
        return listed.select("doc_id", ids.alias("ids"))

    def _listed(self, docs: DataFrame, known: DataFrame, oov: int) -> DataFrame:
        drop = self.remove_oov

        def prepared(found: Lookup) -> Lookup:
            found.values["id"] = np.append(np.asarray(found.values["id"], np.int64), oov)
            return found

        def run(found: Lookup, values: pa.Array, row: np.ndarray, rows: int) -> tuple:
            at = found.find(values)
            if drop:
                row, at = row[at >= 0], at[at >= 0]
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)
            return None, [pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.values["id"][at]))]

        found = lookup(known)
        if found is None:
            return over_block_tokens(docs, known, "x array<bigint>", run, prepared)
        return over_tokens(docs, "x array<bigint>", run, docs.sparkSession.sparkContext.broadcast(prepared(found)))


@dataclass(frozen=True)
class WordVec:
    """Mean of word vectors over all tokens, unknown ones counting as zero; merge None lists the tokens' vectors."""

    merge: str | None = "mean"
    norm: str | None = "l2"

    def transform(self, docs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
        """(doc_id, vec) from (word, vec)."""
        vectors = vectors.select("word", "vec")
        rows = vectors.count()
        found = lookup(vectors) if rows * dim <= 2_000_000 else None
        if found is None and not unique(vectors):
            return self._joined(docs, vectors, dim)
        return self._in_rows(docs, vectors, found, dim)

    def _in_rows(self, docs: DataFrame, vectors: DataFrame, found: Lookup | None, dim: int) -> DataFrame:
        """Documents without tokens have no row. Vectors are read as doubles; missing elements are zero, further ones left out."""

        def prepared(found: Lookup) -> Lookup:
            table, vec = np.zeros((len(found) + 1, dim)), found.values.pop("vec").combine_chunks()
            lens = np.asarray(pc.fill_null(pc.list_value_length(vec), 0), np.int64)
            row = np.repeat(np.arange(len(lens)), lens)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
            near = at < dim
            table[row[near], at[near]] = np.asarray(pc.fill_null(vec.flatten().cast(pa.float64()), 0.0))[near]
            found.values["vec"] = table
            return found

        whole = self.merge is None

        def run(found: Lookup, values: pa.Array, row: np.ndarray, rows: int) -> tuple:
            at, table = found.find(values), found.values["vec"]
            counts = np.bincount(row, minlength=rows)
            some = np.flatnonzero(counts)
            if whole:
                inner = pa.FixedSizeListArray.from_arrays(pa.array(table[at].ravel()), dim).cast(pa.list_(pa.float64()))
                return some, [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[some])).astype(np.int32)), inner)]
            begin = np.append(0, np.cumsum(counts))[some]
            total = np.empty((len(some), dim))
            for i in range(0, len(some), 256):  # the tokens' vectors of some rows at a time
                a, z = begin[i], begin[i + 256] if i + 256 < len(some) else len(row)
                total[i : i + 256] = np.add.reduceat(table[at[a:z]], begin[i : i + 256] - a, axis=0)
            mean = total / counts[some][:, None]
            return some, [pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel()), dim).cast(pa.list_(pa.float64()))]

        schema = "vec array<array<double>>" if whole else "vec array<double>"
        got = over_block_tokens(docs, vectors, schema, run, prepared) if found is None else over_tokens(docs, schema, run, docs.sparkSession.sparkContext.broadcast(prepared(found)))
        return got if whole else got.withColumn("vec", unit(F.col("vec"), self.norm))

    def _joined(self, docs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
        each = docs.select("doc_id", F.posexplode("tokens").alias("pos", "word")).join(vectors, "word", "left")
        zero = F.array_repeat(F.lit(0.0), dim)
        if self.merge is None:
            got = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("vec", zero).alias("v")))).alias("x"))
            return got.select("doc_id", F.transform("x", lambda x: x["v"]).alias("vec"))
        counts = each.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(dim)])
        mean = counts.select("doc_id", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)]).alias("vec"))
        return mean.withColumn("vec", unit(F.col("vec"), self.norm))


def unit(vec: Column, norm: str | None) -> Column:
    """A vector divided by its l1 or l2 norm; a zero vector stays."""
    if norm is None:
        return vec
    size = F.aggregate(vec, F.lit(0.0), (lambda a, x: a + F.abs(x)) if norm == "l1" else (lambda a, x: a + x * x))
    size = size if norm == "l1" else F.sqrt(size)
    return F.when(size == 0, vec).otherwise(F.transform(vec, lambda x: F.try_divide(x, size)))


def default_salt(name: str) -> str:
    """Initials of the parts of a column name."""
    return "".join(p[0] for p in re.split(r"[ |_]", name) if p)


def hash_columns(table: DataFrame, key: str, columns: list[str], n_features: int, salts: dict[str, str] | None = None, weights: dict[str, float] | None = None, dtype_specific: bool = False, seed: int = 0, unique: bool = False) -> DataFrame:
    """(key, idx, val): every column's value and salt hashed to a slot.

    With dtype_specific, floating and boolean columns have one slot, and the
    value as val. Values that meet in a slot are added; nulls hash as 'null'.
    Rows are hashed and added up where they are; those of one key are then
    added up too, unless keys are said to be ``unique``.
    """
    kind, texts, values, whole = table.schema[key].dataType.simpleString(), [], [], []
    for i, c in enumerate(columns):
        salt, w = (salts or {}).get(c, default_salt(c)), float((weights or {}).get(c, 1.0))
        numeric = dtype_specific and table.schema[c].dataType.typeName() in ("double", "float", "boolean")
        texts.append((F.lit(None).cast("string") if numeric else F.concat(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(salt))).alias(f"g{i}"))
        values.append((w * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if numeric else F.lit(w)).alias(f"v{i}"))
        whole.append(int(murmur3_array(pa.array([salt]), seed)[0]) if numeric else None)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            h = np.stack([np.full(rows, x) if x is not None else murmur3_array(b.column(1 + i), seed).astype(np.int64) for i, x in enumerate(whole)], axis=1)
            v = np.stack([np.asarray(b.column(1 + n + i)) for i in range(n)], axis=1)
            row, idx, val, _ = summed(np.repeat(np.arange(rows), n), h.ravel() % n_features, v.ravel(), v.ravel(), None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(idx, pa.int64()), pa.array(val)], [key, "idx", "val"])

    rows = table.select(key, *texts, *values).mapInArrow(run, f"{key} {kind}, idx long, val double")
    return rows if unique else rows.groupBy(key, "idx").agg(F.sum("val").alias("val"))


def encode_categories(table: DataFrame, key: str, column: str, max_words: int | None = None) -> DataFrame:
    """(key, code): ranks of whole values by (count descending, value descending) over the rows; others get the number after the last."""
    values = table.select(F.array(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("tokens"))
    d = Dictionary(**({} if max_words is None else {"max_words": max_words})).fit(values).prune(re_encode=True, drop_counts=False)
    known = d.encoded().select("word", F.col("id").alias("code"))
    rows = table.select(key, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("word"))
    return rows.join(sized_broadcast(known, d.max_words), "word", "left").select(key, F.coalesce("code", F.lit(d.oov())).alias("code"))


def to_vectors(docs: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(doc_id, size, indices, values) for every document, also those without features."""
    packed = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("x"))
    out = docs.select("doc_id").join(packed, "doc_id", "left")
    get = lambda f, kind: F.coalesce(F.transform("x", lambda e: e[f]), F.array().cast(f"array<{kind}>"))
    return out.select("doc_id", F.lit(size).alias("size"), get("idx", "bigint").alias("indices"), get("val", "double").alias("values"))

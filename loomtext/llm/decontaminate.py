"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every benchmark item gives word n-grams. Those that are rare in the corpus
(counted over all documents) are seeds; wherever enough seeds of one item lie
close together in a document, that passage is aligned with the item word by
word, and the alignment's score as a share of the best possible one decides.

Rarity is relative to the item: a seed is kept if no more than
``max(min_df, max_df_share x documents, spread x q)`` documents hold it, where
q is the lower quartile of the document frequencies of the item's own n-grams.
An item that leaked thousands of times therefore keeps its seeds.

The documents are read twice and never shuffled. Benchmark items are sent to
the executors in parts of at most ``part_words`` words; a benchmark that is
larger takes one more reading of the documents for each further part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.llm.columnar import ngrams, row_slices, strings, words

MATCH, MISS, GAP = 2, -1, -1
_NONE = np.int32(-1)


@dataclass
class Items:
    """Items with words. Seeds of length n are sorted; seed s occurs at occ_item, occ_at[occ_first[s] : occ_first[s + 1]]."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    vocabulary: np.ndarray
    seeds: dict[int, np.ndarray]
    occ_first: dict[int, np.ndarray]
    occ_item: dict[int, np.ndarray]
    occ_at: dict[int, np.ndarray]
    need: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def index_items(ids: list, texts: list, n: int, min_seeds: int) -> Items:
    w = words(pa.array(texts, pa.string()))
    kept = np.flatnonzero(w.counts > 0)
    lengths = w.counts[kept]
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    vocabulary, coded = np.unique(w.hash, return_inverse=True)
    out = Items([ids[i] for i in kept], coded.astype(np.int32), first, vocabulary, {}, {}, {}, {}, np.zeros(len(kept), np.int64))
    for k in sorted({min(n, int(x)) for x in lengths}):
        g, at = ngrams(w, k)
        item = np.searchsorted(first, at, "right") - 1
        own = np.minimum(lengths[item], n) == k
        g, at, item = g[own], at[own], item[own]
        order = np.argsort(g, kind="stable")
        g, at, item = g[order], at[order], item[order]
        out.seeds[k], begins = np.unique(g, return_index=True)
        out.occ_first[k] = np.append(begins, len(g))
        out.occ_item[k], out.occ_at[k] = item, at - first[item]
        pairs = np.unique(np.stack([item, g.view(np.int64)]), axis=1)[0]
        distinct = np.bincount(pairs, minlength=len(kept))
        out.need = np.where(np.minimum(lengths, n) == k, np.minimum(min_seeds, distinct), out.need)
    return out


def _found(items: Items, w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed numbers and word positions of all seeds of length k."""
    g, at = ngrams(w, k)
    s = items.seeds[k]
    p = np.searchsorted(s, g)
    p[p == len(s)] = 0
    hit = s[p] == g if len(s) else np.zeros(len(g), bool)
    return p[hit], at[hit]


def _frequencies(shared, text: str) -> Callable:
    """Sums of the rows that hold each seed; row (0, -1) counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rows = shared.value, 0
        df = {k: np.zeros(len(s), np.int64) for k, s in items.seeds.items()}
        for b in batches:
            col = strings(b.column(text))
            rows += len(col)
            for a, z in row_slices(col):
                w = words(col.slice(a, z - a))
                for k in df:
                    p, at = _found(items, w, k)
                    if len(p):
                        row = np.searchsorted(w.first, at, "right") - 1
                        df[k] += np.bincount(np.unique(row * len(df[k]) + p) % len(df[k]), minlength=len(df[k]))
        ks, ns, cs = [np.array([0])], [np.array([-1])], [np.array([rows])]
        for k, x in df.items():
            held = np.flatnonzero(x)
            ks.append(np.full(len(held), k))
            ns.append(held)
            cs.append(x[held])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ks, ns, cs)], ["k", "seed", "df"])

    return run


def rare_only(items: Items, df: dict[int, np.ndarray], n_rows: int, max_df_share: float, min_df: int, spread: float) -> Items:
    """The items with seeds that aren't rare left out; they stay where too few others would be left."""
    floor = max(min_df, max_df_share * n_rows)
    for k in items.seeds:
        of = df[k][np.repeat(np.arange(len(items.seeds[k])), np.diff(items.occ_first[k]))]
        item = items.occ_item[k]
        keep = np.ones(len(of), bool)
        order = np.lexsort((of, item))
        begins = np.flatnonzero(np.diff(item[order], prepend=-1))
        for a, z in zip(begins, np.append(begins[1:], len(order))):
            own = order[a:z]
            limit = max(floor, spread * of[own][(z - a - 1) // 4])
            keep[own] = of[own] <= max(limit, of[own][min(z - a, int(items.need[item[own[0]]])) - 1])
        seed = np.repeat(np.arange(len(items.seeds[k])), np.diff(items.occ_first[k]))[keep]
        used, begins = np.unique(seed, return_index=True)
        items.seeds[k] = items.seeds[k][used]
        items.occ_first[k] = np.append(begins, len(seed))
        items.occ_item[k], items.occ_at[k] = items.occ_item[k][keep], items.occ_at[k][keep]
    return items


def align(windows: list[np.ndarray], lengths: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each window with its target: words as codes, -1 is a word that no target has."""
    out = np.zeros(len(windows), np.int64)
    order = np.lexsort((lengths, [len(t) for t in targets]))
    at = 0
    while at < len(order):
        width, to = 0, at
        while to < len(order) and (to == at or (to - at + 1) * max(width, lengths[order[to]]) <= 1 << 18):
            width = max(width, int(lengths[order[to]]))
            to += 1
        block = order[at:to]
        tall = max(len(targets[i]) for i in block)
        doc = np.full((len(block), width), -1, np.int32)
        target = np.full((len(block), tall), -2, np.int32)
        for r, i in enumerate(block):
            doc[r, : lengths[i]] = windows[i]
            target[r, : len(targets[i])] = targets[i]
        ramp = np.arange(width, dtype=np.int32) * -GAP
        h = np.zeros((len(block), width), np.int32)
        best = np.zeros((len(block), width), np.int32)
        step = np.empty_like(h)
        for j in range(tall):
            step[:] = np.where(doc == target[:, j : j + 1], np.int32(MATCH), np.int32(MISS))
            step[:, 1:] += h[:, :-1]
            np.maximum(step, h + GAP, out=step)
            np.maximum(step, 0, out=step)
            step += ramp
            np.maximum.accumulate(step, axis=1, out=step)
            step -= ramp
            h, step = step, h
            np.maximum(best, h, out=best)
        out[block] = best.max(axis=1)
        at = to
    return out


def _scores(items: Items, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, items and scores of all candidate passages of the column, the best of each row and item."""
    w = words(col)
    parts = []
    for k in items.seeds:
        p, at = _found(items, w, k)
        times = items.occ_first[k][p + 1] - items.occ_first[k][p]
        flat = np.repeat(items.occ_first[k][p] - np.cumsum(times) + times, times) + np.arange(times.sum())
        parts.append((np.repeat(at, times), items.occ_item[k][flat], items.occ_at[k][flat], np.repeat(p, times)))
    at, item, q, seed = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
    if not len(at):
        return at, item, np.zeros(0)
    row = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((at, item, row))
    at, item, q, seed, row = at[order], item[order], q[order], seed[order], row[order]
    length = items.lengths[item]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[1:])
    group = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    distinct = np.bincount(np.unique(np.stack([group, seed]), axis=1)[0])
    low = np.minimum.reduceat(at - q, begins)
    high = np.maximum.reduceat(at - q, begins)
    row, item, length = row[begins], item[begins], length[begins]
    take = distinct >= items.need[item]
    row, item, length, low, high = row[take], item[take], length[take], low[take], high[take]
    low = np.maximum(low - length // 2 - 1, w.first[row])
    high = np.minimum(high + length + length // 2 + 1, w.first[row + 1])
    code = np.searchsorted(items.vocabulary, w.hash)
    code[code == len(items.vocabulary)] = 0
    code = np.where(items.vocabulary[code] == w.hash, code, _NONE).astype(np.int32)
    best = align([code[a:z] for a, z in zip(low, high)], high - low, [items.words[items.first[i] : items.first[i + 1]] for i in item])
    score = best / (MATCH * length)
    order = np.lexsort((-score, item, row))
    row, item, score = row[order], item[order], score[order]
    one = np.ones(len(row), bool)
    one[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[one], item[one], score[one]


def _parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> Iterator[tuple[list, list]]:
    """Items in parts that are small enough to be sent to every executor."""
    sized = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = sized.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    n = int(total // part_words) + 1
    for i in range(n):
        rows = sized.where(F.expr(f"pmod(xxhash64(t), {n}) = {i}")).collect()
        rows = sorted(rows, key=lambda r: (r.i is None, r.i, r.t))
        yield [r.i for r in rows], [r.t for r in rows]


def _ready(docs: DataFrame, ids: list, texts: list, text: str, n: int, min_seeds: int, max_df_share: float, min_df: int, spread: float):
    """The broadcast items of one part, with rare seeds only; None without items."""
    items = index_items(ids, texts, n, min_seeds)
    if not items.ids:
        return None
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(items)
    df = {k: np.zeros(len(s), np.int64) for k, s in items.seeds.items()}
    counted = docs.select(text).mapInArrow(_frequencies(shared, text), "k long, seed long, df long").groupBy("k", "seed").agg(F.sum("df").alias("df")).toPandas()
    rows = 0
    for k, own in counted.groupby("k"):
        if k:
            df[int(k)][own.seed.to_numpy()] = own.df.to_numpy()
        else:
            rows = int(own.df.sum())
    shared.unpersist()
    return sc.broadcast(rare_only(items, df, rows, max_df_share, min_df, spread))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 2, min_seeds: int = 2, min_score: float = 0.5, max_df_share: float = 0.0002, min_df: int = 8, spread: float = 3.0, part_words: int = 4_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, score) of documents and the items that they hold a copy of.

    score is the Smith-Waterman score over words (match 2, mismatch and gap -1)
    divided by that of the whole item; pairs of at least min_score are given,
    one for each input row and item. A passage is aligned if it holds min_seeds
    different seeds of the item; an item of at most n + min_seeds - 1 words
    must therefore occur whole (with n = min_seeds = 2: up to 3 words). Items and documents without words match nothing, nor
    does a null text. Null ids are carried along; repeated rows give repeated
    pairs; no columns but those named are read; an empty table gives no pairs.
    """
    spark, out = docs.sparkSession, None
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("score", T.DoubleType())])
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for ids, texts in _parts(benchmark, item_id, item_text, part_words):
        shared = _ready(plain, ids, texts, "text", n, min_seeds, max_df_share, min_df, spread)
        if shared is None:
            continue

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                col = strings(b.column("text"))
                for a, z in row_slices(col):
                    row, item, score = _scores(items, col.slice(a, z - a))
                    good = score >= min_score
                    if good.any():
                        who = b.column("doc_id").take(pa.array(row[good] + a))
                        what = pa.array(items.ids, item_type).take(pa.array(item[good]))
                        yield pa.RecordBatch.from_arrays([who, what, pa.array(score[good])], ["doc_id", "item_id", "score"])

        pairs = plain.mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 2, min_seeds: int = 2, min_score: float = 0.5, max_df_share: float = 0.0002, min_df: int = 8, spread: float = 3.0, part_words: int = 4_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item, as contaminated() finds them.

    Rows of null, empty or wordless text stay, and all rows if no item has
    words. Repeated rows go or stay alike; null ids and extra columns, whatever
    their names, are carried along; an empty table stays empty.
    """
    kept = docs
    for ids, texts in _parts(benchmark, item_id, item_text, part_words):
        shared = _ready(docs, ids, texts, text, n, min_seeds, max_df_share, min_df, spread)
        if shared is None:
            continue

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                col = strings(b.column(b.schema.get_field_index(text)))
                clean = np.ones(len(col), bool)
                for a, z in row_slices(col):
                    row, _, score = _scores(items, col.slice(a, z - a))
                    clean[a + row[score >= min_score]] = False
                yield b.filter(pc.equal(pa.array(clean), True))

        kept = kept.mapInArrow(run, docs.schema)
    return kept

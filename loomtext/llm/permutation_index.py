"""k nearest neighbours by a permutation index.

A vector is represented by its ``length`` nearest pivots in order, and posted in
the inverted files of the first ``posted`` of them. A query opens the files of
its ``opened`` nearest pivots. Within a file, vectors are ranked by Spearman's
footrule between the two orders (a pivot that is missing counts as coming
last); the best share of them is reranked by cosine similarity. A pair is
ranked only in the first file, in the query's order, that holds it.

Pivots grow as the cube root of the table and the reranked share shrinks as its
power -0.3, so a query compares an ever smaller share of a growing table. Which
footrule bounds that share is read, for each query, off ``sample`` vectors that
are drawn by hash; the index itself holds every vector.

Files are dealt as cells of bounded size: where a file has more than ``cell``
vectors or queries, each side is split, and all pairs of parts are run. Vectors
travel ``posted`` times, queries ``opened`` times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columnar import mix
from loomtext.session import written


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), kind).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(x.ravel())
    return pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(flat.type))


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and these as unit vectors: width elements, none null or not finite, not all zero."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(n) & (n > 0)
    at = np.flatnonzero(fits)[good]
    return at, (x[good] / n[good, None]).astype(np.float32)


def _directions(width: int, seed: int) -> Callable:
    """Unit vectors and a hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, width + 1).astype(np.uint64) + np.uint64(seed))
        for b in batches:
            at, x = unit_rows(b.column("v"), width)
            if len(at):
                h = mix((mix(x.view(np.uint32).astype(np.uint64) + place)).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(b.column(c).take(pa.array(at)) for c in ("id", "asks")), _lists(x)], ["h", "id", "asks", "v"])

    return run


def nearest(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each row in order; of equally near ones the first."""
    s = x @ pivots.T
    if n < s.shape[1]:
        near = np.sort(np.argpartition(-s, n - 1, axis=1)[:, :n], axis=1)
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
    return np.argsort(-s, axis=1, kind="stable").astype(np.int32)


def _orders(shared, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                near = nearest(_matrix(part.column("v"), pivots.shape[1], np.float32), pivots, length)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "h", "id", "asks", "v")), _lists(near)], ["row", "h", "id", "asks", "v", "order"])

    return run


def agreement(order: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For one order, how well each column's order agrees: a constant less half the footrule. weights[p] has, for each column, length less the place of pivot p, 0 without it."""
    own = np.arange(len(order), 0, -1, dtype=weights.dtype)
    return np.minimum(weights[order], own[:, None]).sum(axis=0, dtype=np.int32)


def pivot_weights(order: np.ndarray, pivots: int) -> np.ndarray:
    """pivots x rows: length less the place of each pivot in each order, 0 without it."""
    out = np.zeros((pivots, len(order)), np.uint8)
    out[order, np.arange(len(order))[:, None]] = np.arange(order.shape[1], 0, -1, dtype=np.uint8)
    return out


def _queries(shared, drawn, length: int, opened: int, share: float) -> Callable:
    """What each query opens, and the least agreement that the best ``share`` of the sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        sample = pivot_weights(drawn.value, len(pivots))
        take = min(sample.shape[1], int(np.ceil(share * sample.shape[1])))
        for b in batches:
            if not b.num_rows:
                continue
            near = nearest(_matrix(b.column("v"), pivots.shape[1], np.float32), pivots, max(opened, length))
            least = np.zeros(len(near), np.int32)
            for i, own in enumerate(near):
                if share < 1:
                    least[i] = -np.partition(-agreement(own[:length], sample), take - 1)[take - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "v")), _lists(near), pa.array(least)], ["row", "id", "v", "order", "least"])

    return run


def rank_cell(q_order: np.ndarray, q_least: np.ndarray, q_vec: np.ndarray, q_row: np.ndarray, o_order: np.ndarray, o_vec: np.ndarray, o_row: np.ndarray, pivot: int, posted: int, opened: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, object, similarity) of each query's best k in one cell, by position; objects come in the order that ties go by."""
    names, local = np.unique(o_order, return_inverse=True)
    local = local.reshape(o_order.shape)
    weights = pivot_weights(local, len(names))
    length, found = o_order.shape[1], []
    last = np.int32(1 << 30)
    for i, own in enumerate(q_order):
        at = np.searchsorted(names, own)
        at[at == len(names)] = 0
        here = names[at] == own
        place = np.full(len(names), last, np.int32)
        place[at[here][::-1]] = np.flatnonzero(here)[::-1]
        place[place >= opened] = last
        first = place[local[:, :posted]].min(axis=1) == place[np.searchsorted(names, pivot)]
        best = np.flatnonzero(first & (o_row != q_row[i]))
        if q_least[i] > 0 and len(best):
            rank = np.flatnonzero(here[:length])
            own_weight = (length - rank).astype(np.uint8)
            score = np.minimum(weights[at[rank]], own_weight[:, None]).sum(axis=0, dtype=np.int32)
            best = best[score[best] >= q_least[i]]
        if not len(best):
            continue
        similarity = o_vec[best] @ q_vec[i]
        if len(best) > k:
            least = np.partition(similarity, len(best) - k)[len(best) - k]
            best, similarity = best[similarity >= least], similarity[similarity >= least]
            order = np.lexsort((best, -similarity))[:k]
            best, similarity = best[order], similarity[order]
        found.append((np.full(len(best), i), best, similarity))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found))


def _cells(width: int, length: int, posted: int, opened: int, k: int) -> Callable:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        asks = np.asarray(t["least"].is_valid().combine_chunks())
        q, o = t.filter(pa.array(asks)), t.filter(pa.array(~asks)).sort_by([("id", "ascending"), ("row", "ascending")])
        if q.num_rows and o.num_rows:
            wide = max(opened, length)
            i, j, s = rank_cell(_matrix(q["order"], wide, np.int32), q["least"].to_numpy(), _matrix(q["v"], width, np.float32), q["row"].to_numpy(), _matrix(o["order"], length, np.int32), _matrix(o["v"], width, np.float32), o["row"].to_numpy(), key[0].as_py(), posted, opened, k)
        else:
            i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, to = pa.array(i), pa.array(j)
        return pa.table({"row": q["row"].take(at), "id": q["id"].take(at), "neighbour": o["id"].take(to), "other": o["row"].take(to), "similarity": pa.array(s.astype(np.float64))})

    return run


def neighbours(vectors: DataFrame, *, asks: Column | None = None, k: int = 10, pivots: int | None = None, length: int = 32, posted: int = 4, opened: int = 96, rerank_share: float | None = None, sample: int = 4096, cell: int = 20_000, width: int | None = None, seed: int = 11, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the k most similar other vectors of every query, among all rows.

    Queries are the rows for which ``asks`` is true, by default all. By default
    there are 12 n^(1/3) pivots for n rows, drawn from the distinct vectors by
    hash, and a share of 6 n^-0.3 of the table, and ten times k at least, is
    reranked. Rows whose vector is null, has a null or non-finite element, is
    all zero or hasn't ``width`` elements (by default the most frequent length,
    of equal ones the smaller) are neither queries nor answers. Ties go to the
    smaller id, null last. A repeated row is another vector, so copies are each
    other's neighbours; null ids are carried along. Fewer than k others in the
    opened files give fewer rows; an empty table gives none. Extra columns
    aren't read.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    kind = vectors.schema[vec_id].dataType.simpleString()
    v = F.col(embedding)
    n = vectors.count()
    if width is None:
        common = vectors.where(v.isNotNull()).groupBy(F.size(v).alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = common.w if common else 1
    none = spark.createDataFrame([], f"vec_id {kind}, rank int, neighbour_id {kind}, similarity double")
    if not n or not width:
        return none
    raw = vectors.select(F.col(vec_id).alias("id"), F.coalesce(asks if asks is not None else F.lit(True), F.lit(False)).alias("asks"), v.alias("v"))
    whole = raw.mapInArrow(_directions(width, seed), f"h long, id {kind}, asks boolean, v array<float>")
    base = written(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    m = pivots or int(round(12 * n ** (1 / 3)))
    # only hashes are told apart here: the vectors of the chosen ones are fetched afterwards
    chosen = base.select("h").distinct().orderBy("h").limit(m)
    drawn = base.join(F.broadcast(chosen), "h").select("h", "v").dropDuplicates(["h"]).orderBy("h").collect()
    if not drawn:
        return none
    p = np.array([r.v for r in drawn], np.float32)
    length, opened = min(length, len(p)), min(opened, len(p))
    posted = min(posted, length)
    share = min(1.0, max(6 * n**-0.3, 10 * k / n)) if rerank_share is None else rerank_share
    shared = sc.broadcast(p)
    index = written(base.mapInArrow(_orders(shared, length), f"row long, h long, id {kind}, asks boolean, v array<float>, order array<int>"), "permutations")
    some = index.select("order").orderBy(F.xxhash64("row", F.lit(seed))).limit(sample).collect()
    some = sc.broadcast(np.array([r["order"] for r in some], np.int32))
    wide = index.where("asks").select("row", "id", "v").mapInArrow(_queries(shared, some, length, opened, share), f"row long, id {kind}, v array<float>, order array<int>, least int")
    queries = written(wide, "queries")
    posts, opens = (x.withColumn("pivot", F.explode(F.slice("order", 1, y))) for x, y in ((index, posted), (queries, opened)))
    # one row for each pivot, whatever the table's size
    counts = posts.groupBy("pivot").agg(F.count("*").alias("o")).join(opens.groupBy("pivot").agg(F.count("*").alias("q")), "pivot")
    sizes = spark.createDataFrame(counts.select("pivot", F.ceil(F.col("o") / cell).cast("int").alias("on"), F.ceil(F.col("q") / cell).cast("int").alias("qn")).collect(), "pivot int, `on` int, qn int")
    sizes = F.broadcast(sizes)
    own, every = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = opens.join(sizes, "pivot").withColumn("qc", own("qn")).withColumn("oc", every("on"))
    held = posts.join(sizes, "pivot").withColumn("oc", own("on")).withColumn("qc", every("qn")).withColumn("least", F.lit(None).cast("int"))
    columns = ["pivot", "qc", "oc", "row", "id", "v", "order", "least"]
    cells = asked.select(*columns).unionByName(held.select(*columns))
    pairs = cells.groupBy("pivot", "qc", "oc").applyInArrow(_cells(width, length, posted, opened, k), f"row long, id {kind}, neighbour {kind}, other long, similarity double")
    best = Window.partitionBy("row").orderBy(F.desc("similarity"), F.col("neighbour").asc_nulls_last(), "other")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))

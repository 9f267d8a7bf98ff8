"""Near-duplicate groups by consistent weighted sampling over TF-IDF shingles.

1. A reading of the texts counts in how many documents each word shingle is
   found, in ``ROWS`` hashed tables of ``SLOTS`` entries; a shingle's frequency
   is the least of its entries, each less the table's median entry, which is
   what other shingles put there. Frequent shingles are thus told from rare ones
   whatever the corpus's size. Weights are tf x ln(1 + N / df).
2. A second reading draws ``bands x rows`` consistent weighted samples of each
   document (Ioffe's improved scheme); each band of samples gives one key.
3. Documents that share a band key are candidates. Each is first compared with
   its bucket's leader; members of a bucket that are then still in different
   groups are compared in blocks, so that no pair of a bucket is passed over.
4. A pair holds if the weighted Jaccard similarity of the full shingle vectors
   is at least ``threshold``. Groups are the connected components of the pairs.

Texts are told apart by a 128-bit digest, so exact copies are one text from the
start, whatever their ids. Only texts in candidate pairs are vectorised again.
Nothing is windowed by bucket or group: hot ones are combined before the shuffle
and joined back, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.columnar import mix, ngrams, row_slices, strings, words
from loomtext.session import written

_LOW44 = np.uint64((1 << 44) - 1)
_STEPS = 4096
#: Tables of document frequencies, entries of each, and entries in a block as they are added up.
ROWS, SLOTS, _BLOCK = 3, 1 << 18, 1 << 12


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 44-bit identity and count of every distinct shingle of every row, in that order.

    A text of fewer than ``size`` words has one shingle of all its words, one without words none.
    """
    w = words(col)
    g, at = ngrams(w, size)
    row = np.searchsorted(w.first, at, "right") - 1
    for k in range(1, size):
        short = np.flatnonzero(w.counts == k)
        if len(short):
            h, begin = ngrams(w, k)
            g = np.concatenate([g, mix(h[np.searchsorted(begin, w.first[short])] + np.uint64(k))])
            row = np.concatenate([row, short])
    both = np.sort((row.astype(np.uint64) << np.uint64(44)) | (g >> np.uint64(20)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    begins = np.flatnonzero(new)
    both = both[begins]
    return (both >> np.uint64(44)).astype(np.int64), both & _LOW44, np.diff(np.append(begins, len(new)))


def _entries(g: np.ndarray) -> list[np.ndarray]:
    """The entry of each shingle in each table."""
    h = mix(g + np.uint64(0x9FB21C651E98DF25))
    return [((h >> np.uint64(46 - 18 * r)) & np.uint64(SLOTS - 1)).astype(np.intp) for r in range(ROWS)]


def _document_frequencies(size: int) -> Callable:
    """Blocks of the tables as 32-bit counts of this task's texts; block -1 is the number of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros((ROWS, SLOTS), np.int64), 0
        for b in batches:
            col = strings(b.column(0))
            for a, z in row_slices(col):
                row, g, _ = shingles(col.slice(a, z - a), size)
                rows += int((np.diff(row, prepend=-1) > 0).sum())
                for own, at in zip(df, _entries(g)):
                    own += np.bincount(at, minlength=SLOTS)
        blocks = df.reshape(-1, _BLOCK)
        held = np.flatnonzero(blocks.any(axis=1))
        counts = [np.array([rows], "<i4").tobytes(), *(blocks[i].astype("<i4").tobytes() for i in held)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held), pa.int32()), pa.array(counts, pa.binary())], ["block", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of equal blocks, as 64-bit counts; one of each is held, however many come."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts")):
            x = np.frombuffer(counts.as_buffer(), "<i4").astype("<i8")
            if block in held:
                held[block] += x
            else:
                held[block] = x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "counts"])


def inverse_frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """ln(1 + N / df) by table and entry, counted over all rows; N is the number of texts with words."""
    schema = "block int, counts binary"
    counted = texts.mapInArrow(_document_frequencies(size), schema).repartition("block").mapInArrow(_added, schema).collect()
    df, n = np.zeros((ROWS * SLOTS // _BLOCK, _BLOCK)), 0
    for r in counted:
        x = np.frombuffer(bytes(r.counts), "<i8")
        if r.block < 0:
            n += int(x[0])
        else:
            df[r.block] = x
    df = df.reshape(ROWS, SLOTS)
    df = np.maximum(df - np.median(df, axis=1, keepdims=True), 1)
    return np.log1p(max(n, 1) / df).astype(np.float32)


def weighted(g: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of shingles: the least document frequency has the largest idf."""
    return (tf * np.maximum.reduce([own[at] for own, at in zip(idf, _entries(g))])).astype(np.float32)


def _sampling_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """1 / r, r and ln c at the mid-quantiles of Gamma(2, 1), from which samples are drawn by hash bits."""
    p = (np.arange(_STEPS) + 0.5) / _STEPS
    low, high = np.zeros(_STEPS), np.full(_STEPS, 64.0)
    for _ in range(80):
        x = (low + high) / 2
        less = 1 - np.exp(-x) * (1 + x) < p
        low, high = np.where(less, x, low), np.where(less, high, x)
    return (1 / high).astype(np.float32), high.astype(np.float32), np.log(high).astype(np.float32)


def band_keys(row: np.ndarray, g: np.ndarray, weight: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their keys: one 64-bit key for each band."""
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    which = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(row))))
    inv_r, r, ln_c = _sampling_tables()
    x, ln_w = mix(g + np.uint64(0x632BE59BD9B4E019)), np.log(weight).astype(np.float32)
    keys = np.zeros((len(begins), bands), np.uint64)
    for k in range(bands * rows):
        z = (x ^ mix(np.array([k + 1], np.uint64))) * np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        i = (z >> np.uint64(52)).astype(np.intp)
        j = ((z >> np.uint64(40)) & np.uint64(_STEPS - 1)).astype(np.intp)
        beta = ((z >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32)
        beta *= np.float32(2**-24)
        t = np.floor(ln_w * inv_r[i] + beta)
        ln_a = ln_c[j] - r[i] * (t - beta + np.float32(1))
        least = np.minimum.reduceat(ln_a, begins)
        at = np.flatnonzero(ln_a == least[which])[::-1]
        sample = np.zeros(len(begins), np.uint64)
        sample[which[at]] = mix(g[at] ^ (t[at].astype(np.int64).astype(np.uint64) << np.uint64(48)))
        band = k // rows
        keys[:, band] = mix(keys[:, band] + sample + np.uint64(band + 1))
    return row[begins], keys


def _signatures(shared, size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in batches:
            col = strings(b.column("text"))
            for a, z in row_slices(col):
                row, g, tf = shingles(col.slice(a, z - a), size)
                if len(row):
                    at, keys = band_keys(row, g, weighted(g, tf, idf), bands, rows)
                    flat = pa.array(keys.view(np.int64).ravel())
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at + a)), pa.FixedSizeListArray.from_arrays(flat, bands).cast(pa.list_(pa.int64()))], ["k", "keys"])

    return run


def _vectors(shared, wanted, size: int) -> Callable:
    """Identities and weights of the texts whose digest may be wanted, by a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, bits = shared.value, wanted.value
        for b in batches:
            b = b.filter(pa.array(_maybe(b.column("k"), bits)))
            col = strings(b.column("text"))
            for a, z in row_slices(col):
                row, g, tf = shingles(col.slice(a, z - a), size)
                if not len(row):
                    continue
                weight = weighted(g, tf, idf)
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                ends = np.append(begins[1:], len(row))
                ids = pa.array([g[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())
                ws = pa.array([weight[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row[begins] + a)), ids, ws], ["k", "ids", "ws"])

    return run


def _slots(keys: pa.Array, n: int) -> np.ndarray:
    """The first 8 bytes of each 16-byte digest, modulo n."""
    keys = keys.cast(pa.large_binary())
    data, offsets = np.frombuffer(keys.buffers()[2] or b"", np.uint8), np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = data[offsets[0] : offsets[-1]].reshape(-1, 16)[:, :8]
    return (np.ascontiguousarray(data).view("<u8").ravel() % np.uint64(n)).astype(np.int64)


def _maybe(keys: pa.Array, bits: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, bool)
    s = _slots(keys, len(bits) * 8)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def _bit_table(keys: DataFrame, n: int) -> np.ndarray:
    """Which of n slots the digests take: of fixed size, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n, bool)
        for b in batches:
            if b.num_rows:
                bits[_slots(b.column(0), n)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["bits"])

    out = np.zeros(n // 8, np.uint8)
    for r in keys.select("k").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _similar(threshold: float) -> Callable:
    """Rows come sorted by leader, the leader's own vector first; only that one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, ws, total = None, None, None, 0.0
        for b in batches:
            found: list[tuple[int, float]] = []
            lead, other = b.column("a").to_pylist(), b.column("leads").to_pylist()
            for i, (g, w) in enumerate(zip(b.column("ids"), b.column("ws"))):
                g, w = np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32)
                if other[i]:
                    own, ids, ws, total = lead[i], g, w, float(w.sum(dtype=np.float64))
                elif own == lead[i]:
                    at = np.searchsorted(ids, g)
                    at[at == len(ids)] = 0
                    hit = ids[at] == g
                    least = float(np.minimum(ws[at[hit]], w[hit]).sum(dtype=np.float64))
                    most = total + float(w.sum(dtype=np.float64)) - least
                    if least >= threshold * most:
                        found.append((i, least / most))
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array([s for _, s in found], pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) whose vectors are similar. A leader of many pairs, as n says, is dealt over several tasks."""
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / per_task)).alias("salt"), "b")
    partners = dealt.join(vectors.withColumnRenamed("k", "b"), "b").select("a", "salt", F.lit(False).alias("leads"), "b", "ids", "ws")
    leaders = dealt.select("a", "salt").distinct().join(vectors.withColumnRenamed("k", "a"), "a").select("a", "salt", F.lit(True).alias("leads"), F.col("a").alias("b"), "ids", "ws")
    both = leaders.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("leads").desc())
    return both.mapInArrow(_similar(threshold), "a binary, b binary, similarity double")


def _blocks(threshold: float) -> Callable:
    """The similar pairs of different groups between two parts of a bucket, or within one.

    A pair that shares several buckets is compared in the one with the least key.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket, i, j = (x.as_py() for x in key)
        part, root = t["part"].to_numpy(), np.array(t["root"].to_pylist(), object)
        before = [np.array([x for x in keys if x < bucket]) for keys in t["keys"].to_pylist()]
        ids = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["ids"]]
        ws = [np.frombuffer(x.as_buffer(), np.float32) for x in t["ws"]]
        first = np.append(0, np.cumsum([len(x) for x in ids]))
        flat, weight = np.concatenate(ids), np.concatenate(ws)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        total = np.array([w.sum(dtype=np.float64) for w in ws])
        earlier = np.concatenate(before)
        earlier_of = np.repeat(np.arange(len(before)), [len(x) for x in before])
        left, right, found = [], [], []
        for x in np.flatnonzero(part == i):
            other = part == j
            if i == j:
                other[: x + 1] = False
            other &= (root != root[x]) & (np.minimum(total, total[x]) >= threshold * np.maximum(total, total[x]))
            if len(before[x]):
                other[earlier_of[np.isin(earlier, before[x])]] = False
            if not other.any():
                continue
            take = other[owner]
            g, own, w = flat[take], owner[take], weight[take]
            at = np.searchsorted(ids[x], g)
            at[at == len(ids[x])] = 0
            hit = ids[x][at] == g
            least = np.bincount(own[hit], np.minimum(w[hit], ws[x][at[hit]]), len(ids))
            most = total + total[x] - least
            for y in np.flatnonzero(other & (least >= threshold * most)):
                left.append(x)
                right.append(y)
                found.append(least[y] / most[y])
        a, b = t["k"].take(pa.array(left, pa.int64())), t["k"].take(pa.array(right, pa.int64()))
        roots = t["root"].take(pa.array(left, pa.int64())), t["root"].take(pa.array(right, pa.int64()))
        return pa.table({"a": a, "b": b, "root_a": roots[0], "root_b": roots[1], "similarity": pa.array(found, pa.float64())})

    return run


def between_groups(members: DataFrame, roots: DataFrame, vectors: DataFrame, threshold: float, side: int) -> DataFrame:
    """Similar pairs of texts that share a bucket but not a group: (a, b, root_a, root_b, similarity).

    Members of a bucket are dealt in parts of about ``side``, and every two parts meet in a task.
    """
    named = members.select("k", "key").join(roots, "k", "left").select("k", "key", F.coalesce("root", "k").alias("root"))
    spread = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / side).cast("int").alias("parts"))
    mixed = named.join(spread, "key")
    own = mixed.groupBy("k").agg(F.first("root").alias("root"), F.collect_list(F.struct("key", "parts")).alias("each"))  # as many as bands, at most
    whole = own.join(vectors, "k").select("k", "root", F.col("each.key").alias("keys"), "ids", "ws", F.explode("each").alias("e")).select("*", "e.key", "e.parts").drop("e")
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("key", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "k", "root", "keys", "part", "ids", "ws")
    return cells.groupBy("key", "i", "j").applyInArrow(_blocks(threshold), "a binary, b binary, root_a binary, root_b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(k, root): the least node of the component of every node, by alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("k"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("k"), F.col("v").alias("root")).distinct())


def text_groups(texts: DataFrame, *, size: int = 3, bands: int = 20, rows: int = 3, threshold: float = 0.5, side: int = 256, most_bits: int = 1 << 27) -> DataFrame:
    """(k, root) of all texts with a near copy; texts has k, a 16-byte digest, and text."""
    sc = texts.sparkSession.sparkContext
    idf = sc.broadcast(inverse_frequencies(texts.select("text"), size))
    signed = written(texts.mapInArrow(_signatures(idf, size, bands, rows), "k binary, keys array<long>"), "signatures")
    each = signed.dropDuplicates(["k"]).select("k", F.explode("keys").alias("key"))
    leads = each.groupBy("key").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1")
    members = written(each.join(leads, "key").select("k", "key", "a", "n"), "buckets")
    stars = members.where("k <> a").groupBy("a", F.col("k").alias("b")).agg(F.max("n").alias("n"))
    wanted = members.select("k").distinct()
    bits = min(most_bits, 1 << max(16, (8 * wanted.count()).bit_length()))
    table = sc.broadcast(_bit_table(wanted, bits))
    vectors = texts.mapInArrow(_vectors(idf, table, size), "k binary, ids binary, ws binary").join(wanted, "k", "left_semi").dropDuplicates(["k"])
    vectors = written(vectors, "vectors")
    roots = components(verified(stars, vectors, threshold))
    more = written(between_groups(members, roots, vectors, threshold, side).select("root_a", "root_b").distinct(), "similar")
    if more.isEmpty():
        return roots
    # what is joined now are whole groups: only their roots are looked at
    again = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("k").alias("root"), F.col("root").alias("new"))
    alone = again.select(F.col("root").alias("k"), F.col("new").alias("root")).join(roots.select("k"), "k", "left_anti")
    return roots.join(again, "root", "left").select("k", F.coalesce("new", "root").alias("root")).unionByName(alone)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k, text) of every row that has text; k is the text's digest."""
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("k"), F.col(text).alias("text"))


def _keepers(docs: DataFrame, doc_id: str, text: str, **how) -> DataFrame:
    """(k, keep_id, keep_k, copies) of every text in a group of at least two rows; copies is how many rows have the text."""
    keyed = _keyed(docs, doc_id, text)
    roots = text_groups(keyed.select("k", "text"), **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    each = keyed.groupBy("k").agg(F.count("*").alias("copies"), first).join(roots, "k", "left")
    each = written(each.select("k", "copies", "first", F.coalesce("root", "k").alias("root")), "texts")
    groups = each.groupBy("root").agg(F.sum("copies").alias("n"), F.min(F.struct("first", "k")).alias("best")).where("n > 1")
    return each.join(groups, "root").select("k", F.col("best.first.doc_id").alias("keep_id"), F.col("best.k").alias("keep_k"), "copies")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, keep_id, exact) of every document in a group of at least two; keep_id is the group's least id.

    exact tells whether the text equals the kept one's. Null ids come last in
    the choice of keep_id. Null texts are in no group; texts without words are
    grouped by equality alone. Repeated rows count as copies, each with a row
    of its own. Other columns aren't read. An empty table gives no rows.
    """
    rows = _keyed(docs, doc_id, text).select("doc_id", "k").join(_keepers(docs, doc_id, text, **how), "k")
    return rows.select("doc_id", "keep_id", (F.col("k") == F.col("keep_k")).alias("exact"))


def keep_one_of_each(docs: DataFrame, *, hot_share: float = 0.001, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with all columns, but of each group of near copies only the row of least id; of equal rows one stays.

    Rows of null text stay. Copies of a text that more than ``hot_share`` of all
    rows have are dropped where they are read (there are at most 1 / hot_share
    such texts); the others where the documents meet the groups' choices.
    """
    own = "__own"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    k, keep, keep_k, copies = (own + x for x in ("_k", "_keep", "_keep_k", "_copies"))
    chosen = written(_keepers(docs, doc_id, text, **how).toDF(k, keep, keep_k, copies), "chosen")
    hot = chosen.where(F.col(copies) > F.lit(hot_share) * F.lit(docs.count()))
    keyed = docs.where(F.col(text).isNotNull()).withColumn(k, F.unhex(F.md5(F.col(text).cast("binary"))))

    def kept(rows: DataFrame, choice: DataFrame) -> DataFrame:
        stays = F.col(keep_k).isNull() | (F.col(k) == F.col(keep_k)) & F.col(doc_id).eqNullSafe(F.col(keep))
        return rows.join(choice, k, "left").where(stays).drop(keep, keep_k, copies)

    left = kept(kept(keyed, F.broadcast(hot)), chosen)
    n = own + "_n"
    left = left.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(k))).where(F.col(n) == 1).drop(k, n)
    return left.unionByName(docs.where(F.col(text).isNull()))

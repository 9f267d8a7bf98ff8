"""Packing of documents into training windows by non-negative least squares.

Token counts come from a public byte-level BPE, whose path is a parameter. A
document longer than a window gives full windows and a remainder. Lengths are
taken in units of ``unit`` tokens, rounded up, so a window has at most
``window / unit`` different lengths whatever the corpus's size. Of these:

1. all combinations of at most three lengths that fill a window exactly are
   enumerated;
2. how often each is to be used is the non-negative least-squares solution
   against the histogram of all pieces;
3. repeat counts are rounded, kept within what the histogram has, and
   the pieces left over are packed greedily, largest first.

The plan is made on the histogram alone, so its cost doesn't grow with the
corpus. Pieces find their place by their rank among those of equal length,
counted within hash shards of bounded size and shifted by the shards' totals.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column("text")):
                if text.is_valid and (t := text.as_py()):
                    n[i] = len(encoding.encode_ordinary(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n)], ["doc_id", "h", "n"])

    return run


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n): n tokens in the text with hash h, 0 for null and empty texts."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return plain.mapInArrow(_count(shared), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, h long, n long")


@dataclass
class Plan:
    """Windows in order: combos[i] (lengths in units, largest first) is used times[i] times."""

    combos: list[tuple[int, ...]]
    times: list[int]

    def slots(self) -> dict[str, np.ndarray]:
        """One entry for each combination and member, sorted by length and first rank: rank r of a length is in bin base + r - rank."""
        rows, base, used = [], 0, {}
        for combo, n in zip(self.combos, self.times):
            at = 0
            for u in combo:
                rows.append((u, used.get(u, 0), base, at))
                used[u] = used.get(u, 0) + n
                at += u
            base += n
        rows.sort()
        return dict(zip(("u", "rank", "base", "at"), np.array(rows, np.int64).reshape(-1, 4).T))


def combinations(full: int) -> list[tuple[int, ...]]:
    """All ways to fill a window of ``full`` units with one to three lengths."""
    out = [(full,)] + [(a, full - a) for a in range(full - 1, (full - 1) // 2, -1)]
    return out + [(a, b, full - a - b) for a in range(full - 2, 0, -1) for b in range(min(a, full - a - 1), 0, -1) if full - a - b <= b]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by Lawson and Hanson's active sets, until no column would lower the residual any more."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = np.abs(b).max() or 1.0
    b = b / scale
    least = np.inf
    while True:
        rest = b - a @ x
        if rest @ rest >= least * (1 - 1e-12):
            break  # rounding is all that a further step would change
        least = rest @ rest
        g = a.T @ rest
        g[passive] = -np.inf
        j = int(g.argmax())
        if g[j] <= tolerance:
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            ap = a[:, on]
            s = np.linalg.solve(ap.T @ ap + 1e-10 * np.eye(len(on)), ap.T @ b)
            if s.min() > 0:
                break
            low = s <= 0
            step = (x[on[low]] / np.maximum(x[on[low]] - s[low], 1e-300)).min()
            x[on] += step * (s - x[on])
            gone = on[(x[on] <= 1e-12) & low]
            if not len(gone):
                gone = on[[int(s.argmin())]]
            x[gone], passive[gone] = 0, False
            if not passive.any():
                s = np.zeros(0)
                on = np.zeros(0, np.int64)
                break
        x[:] = 0
        x[on] = s
    return x * scale


def plan(histogram: np.ndarray) -> Plan:
    """The plan for histogram[u] pieces of u units each, u from 0 to the window's."""
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out = Plan([], [])

    def use(combo: tuple[int, ...], times: int) -> None:
        need = np.bincount(combo, minlength=full + 1)
        times = min(times, int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            left[:] -= times * need
            out.combos.append(combo)
            out.times.append(times)

    use((full,), int(left[full]))
    held = left > 0
    combos = [c for c in combinations(full) if all(held[u] for u in c)]
    if combos:
        a = np.zeros((full + 1, len(combos)))
        for j, c in enumerate(combos):
            for u in c:
                a[u, j] += 1
        rows = held.nonzero()[0]
        x = nnls(a[rows], left[rows].astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            use(combos[j], int(round(x[j])))
    while left.any():
        have, combo, room = left.copy(), [], full
        while room and have[: room + 1].any():
            u = int(np.flatnonzero(have[: room + 1])[-1])
            k = int(min(have[u], room // u))
            combo += [u] * k
            have[u] -= k
            room -= k * u
        use(tuple(combo), 1 << 62)
    return out


def _place(shared, unit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = (slots["u"] << 48) + slots["rank"]
        for b in batches:
            u, rank = b.column("u").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, (u << 48) + rank, "right") - 1
            where = [pa.array(slots["base"][i] + rank - slots["rank"][i]), pa.array(slots["at"][i] * unit)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "tokens")] + where, ["doc_id", "piece", "start", "tokens", "bin", "at"])

    return run


def pack_counts(counted: DataFrame, *, window: int = 2048, unit: int = 8, shard: int = 1 << 18) -> DataFrame:
    """pack() for (doc_id, h, n) rows of token counts."""
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    sc = counted.sparkSession.sparkContext
    counted = written(counted.where("n > 0"), "lengths")
    pieces = (
        counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {window}"))))
        .withColumn("start", F.col("piece") * window)
        .withColumn("tokens", F.least(F.lit(window), F.col("n") - F.col("start")))
        .withColumn("u", F.expr(f"(tokens + {unit - 1}) div {unit}"))
    )
    histogram = np.zeros(window // unit + 1, np.int64)
    for r in pieces.groupBy("u").count().collect():
        histogram[r["u"]] = r["count"]
    slots = sc.broadcast(plan(histogram).slots())
    shards = int(histogram.sum() // shard) + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(shards)))
    before = Window.partitionBy("u").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("u", "shard").count().select("u", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("u", "shard").orderBy("doc_id", "h", "piece")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(totals, ["u", "shard"]).withColumn("rank", F.col("own") - 1 + F.col("shift"))
    kind = counted.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "tokens", "u", "rank").mapInArrow(_place(slots, unit), f"doc_id {kind}, piece long, start long, tokens long, bin long, at long")


def pack(docs: DataFrame, *, window: int = 2048, unit: int = 8, shard: int = 1 << 18, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, tokens, bin, at): where every piece of every document goes.

    A piece is ``tokens`` tokens of its document from number ``start`` on, at
    most a window; it is placed in window ``bin`` from token ``at`` on. No two
    pieces overlap, and each token of the corpus has exactly one place. Null
    and empty texts have no pieces. Repeated rows are packed once each; null
    ids are carried along; extra columns aren't read; an empty table gives no
    rows. Pieces of equal length are dealt by shard, then by id, text hash and
    number, so the result doesn't depend on the partitioning.
    """
    return pack_counts(token_counts(docs, vocabulary=vocabulary, doc_id=doc_id, text=text), window=window, unit=unit, shard=shard)

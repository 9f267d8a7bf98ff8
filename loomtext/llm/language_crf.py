"""Language labels of words in code-switched text by a linear-chain CRF.

Each word has one hidden label. Its evidence is a sum of learned weights of
hashed features: the whole word, the lexicons (which languages have it among
their frequent words), prefixes and suffixes of 1 to 3 bytes, and byte bi- and
trigrams with word boundaries. Transitions are learned too. Marginals come from
the forward-backward algorithm, exact over texts of any length: a batch of
texts is one chain with restarts, cut into equal blocks whose transfer matrices
are multiplied side by side in numpy.

The model is fitted on a bounded sample of documents with a known language
(``docs_per_language``), chosen by hash; fragments of different languages are
chained so that switches are seen. Everything else covers all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columnar import Words, mix, row_slices, strings, words

SPACE = 1 << 16
#: Codes of byte trigrams lie below this.
TRIGRAMS = 257**3
_SALT = {name: np.uint64(0x51ED270B * (i + 1)) for i, name in enumerate(("word", "lexicon", "p1", "p2", "p3", "s1", "s2", "s3", "two", "three"))}


@dataclass
class Model:
    """weights: SPACE x labels; lexicon and its codes are sorted by word hash; seen: bits of the byte trigrams of the words it was fitted on, ``common`` the share of these trigrams that two words or more have: what a new word of the languages can be expected to share."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    codes: np.ndarray
    seen: np.ndarray
    common: float


def _slot(kind: str, x: np.ndarray) -> np.ndarray:
    return (mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SALT[kind]) >> np.uint64(48)).astype(np.int64)


def features(w: Words, at: np.ndarray, lexicon: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words number ``at``: a table of 8 feature slots each, the slots of all n-grams, where each word's begin, how many it has, and the codes of its trigrams, which are half as many."""
    start, end, h = w.start[at], w.end[at], w.hash[at]
    lens = end - start
    p = np.searchsorted(lexicon, h)
    p[p == len(lexicon)] = 0
    known = np.where(lexicon[p] == h, codes[p], 0) if len(lexicon) else np.zeros(len(h), np.int64)
    table = [_slot("word", h), _slot("lexicon", known)]
    data = w.data.astype(np.uint64)
    for side in "ps":
        x = np.zeros(len(at), np.uint64)
        for k in range(3):
            place = start + k if side == "p" else end - 1 - k
            inside = k < lens
            x = np.where(inside, x * np.uint64(257) + data[np.where(inside, place, start)] + np.uint64(1), x)
            table.append(_slot(f"{side}{k + 1}", x))
    total = lens + 2  # with a boundary on either side
    begin = np.zeros(len(at), np.int64)
    np.cumsum(total[:-1], out=begin[1:])
    size = int(total.sum())
    flat = np.zeros(size + 2, np.uint64)
    inner = np.ones(size, bool)
    inner[begin] = inner[begin + total - 1] = False
    flat[:size][inner] = data[np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())] + np.uint64(1)
    two = flat[:size] * np.uint64(257) + flat[1 : size + 1]
    three = two * np.uint64(257) + flat[2 : size + 2]
    three[begin + total - 2] = two[begin + total - 2]
    grams = np.stack([_slot("two", two), _slot("three", three)])
    last = np.ones(size, bool)
    last[begin + total - 1] = False
    grams = grams[:, last]
    return np.stack(table, axis=1), grams.T.ravel(), 2 * (begin - np.arange(len(at))), 2 * (total - 1), three[:size][last].astype(np.int64)


def familiar(seen: np.ndarray, begin: np.ndarray, times: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """The share of each word's trigrams that were seen."""
    hit = (seen[trigrams >> 3] >> (trigrams & 7).astype(np.uint8)) & 1
    return np.add.reduceat(hit.astype(np.float64), begin // 2) / (times // 2)


def evidence(weights: np.ndarray, table: np.ndarray, grams: np.ndarray, begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    out = weights[table].sum(axis=1)
    out += np.add.reduceat(weights[grams], begin, axis=0) / np.sqrt(times)[:, None]
    return out


def _by_label(weights: np.ndarray, table: np.ndarray, grams: np.ndarray, begin: np.ndarray, root: np.ndarray) -> np.ndarray:
    """evidence() with a label's temporary arrays at a time."""
    out = np.empty((len(table), weights.shape[1]))
    for j in range(weights.shape[1]):
        own = np.ascontiguousarray(weights[:, j])
        out[:, j] = own[table].sum(axis=1) + np.add.reduceat(own[grams], begin) / root
    return out


def marginals(e: np.ndarray, restart: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of each word; ``restart`` marks the first words of texts."""
    n, labels = e.shape
    side = max(1, int(np.sqrt(n)))
    blocks = -(-n // side)
    p = np.ones((blocks * side, labels))
    p[:n] = np.exp(e - e.max(axis=1, keepdims=True))
    again = np.zeros(blocks * side, bool)
    again[:n] = restart
    again[0] = True
    again[n:] = True
    p, again = p.reshape(blocks, side, labels), again.reshape(blocks, side)
    t, first = np.exp(transitions), np.exp(start)
    p = np.ascontiguousarray(p.transpose(1, 0, 2))
    fresh = [np.flatnonzero(x) for x in again.T]
    m = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for i in range(side):
        x = (m.reshape(-1, labels) @ t).reshape(m.shape)
        if len(fresh[i]):
            x[fresh[i]] = m[fresh[i]].sum(axis=2, keepdims=True) * first
        x *= p[i][:, None, :]
        if i % 4 == 3:
            x /= x.max(axis=(1, 2), keepdims=True)
        m = x
    m /= m.max(axis=(1, 2), keepdims=True)
    alpha = np.empty((blocks, labels))
    a = np.full(labels, 1 / labels)
    for k in range(blocks):
        alpha[k] = a
        a = a @ m[k]
        a /= a.sum()
    beta = np.empty((blocks, labels))
    b = np.ones(labels)
    for k in range(blocks - 1, -1, -1):
        beta[k] = b
        b = m[k] @ b
        b /= b.max()
    forward = np.empty_like(p)
    for i in range(side):
        x = alpha @ t
        if len(fresh[i]):
            x[fresh[i]] = alpha[fresh[i]].sum(axis=1, keepdims=True) * first
        x *= p[i]
        if i % 4 == 3:
            x /= x.sum(axis=1, keepdims=True)
        forward[i] = alpha = x
    for i in range(side - 1, -1, -1):
        forward[i] *= beta
        x = p[i] * beta
        beta = x @ t.T
        if len(fresh[i]):
            beta[fresh[i]] = (x[fresh[i]] @ first)[:, None]
        if i % 4 == 0:
            beta /= beta.max(axis=1, keepdims=True)
    forward = forward.transpose(1, 0, 2)
    out = forward.reshape(-1, labels)[:n]
    return out / out.sum(axis=1, keepdims=True)


def _learn(texts: list[str], langs: list[str], *, lexicon_size: int, rounds: int, fragment: int, seed: int) -> Model:
    """Fit by Adam on the exact conditional likelihood of chains of 96 words."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    w = words(pa.array(texts, pa.string()))
    truth = np.repeat([labels.index(x) for x in langs], w.counts)
    n, k = len(w.hash), len(labels)
    if not n:
        return Model(labels, np.zeros((SPACE, k), np.float32), np.zeros((k, k)), np.zeros(k), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(TRIGRAMS // 8 + 1, np.uint8), 0.0)
    vocabulary, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    counts = np.zeros((len(vocabulary), k))
    np.add.at(counts, (which, truth), 1)
    codes = np.zeros(len(vocabulary), np.int64)
    for label in range(k):
        top = np.lexsort((vocabulary, -counts[:, label]))[:lexicon_size]
        codes[top[counts[top, label] > 1]] |= 1 << label
    lexicon, codes = vocabulary[codes > 0], codes[codes > 0]
    table, grams, begin, times, trigrams = features(w, first, lexicon, codes)
    seen_trigrams = np.zeros(TRIGRAMS + 8, bool)
    seen_trigrams[trigrams] = True
    times_seen = np.unique(trigrams, return_counts=True)[1]
    common = float(times_seen[times_seen > 1].sum() / times_seen.sum())
    table, grams, root = table.astype(np.int32), grams.astype(np.int32), np.sqrt(times)
    cuts, owner = [], np.repeat(np.arange(len(texts)), w.counts)
    at = 0
    while at < n:  # fragments within texts
        to = min(at + int(rng.integers(fragment // 3, 2 * fragment)), n)
        to = at + int(np.searchsorted(owner[at:to], owner[at], "right"))
        cuts.append((at, to))
        at = to
    order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))])
    length = min(96, n)
    lanes = n // length
    order = order[: lanes * length].reshape(lanes, length).T
    gold, word = truth[order], which[order]
    weights, transitions, start = np.zeros((SPACE, k)), np.zeros((k, k)), np.zeros(k)
    params = [weights, transitions, start]
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1], gold[1:]), 1)
    for step in range(1, rounds + 1):
        p = _by_label(weights, table, grams, begin, root)[word]  # a label at a time: the driver's memory is small
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        t = np.exp(transitions)
        alpha, beta = np.empty_like(p), np.ones_like(p)
        alpha[0] = p[0] * np.exp(start)
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for i in range(1, length):
            alpha[i] = (alpha[i - 1] @ t) * p[i]
            alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(length - 2, -1, -1):
            nxt = p[i + 1] * beta[i + 1]
            joint = alpha[i][:, :, None] * t * nxt[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[i] = nxt @ t.T
            beta[i] /= beta[i].max(axis=1, keepdims=True)
        alpha *= beta
        del p, beta
        alpha /= alpha.sum(axis=2, keepdims=True)
        g = np.zeros_like(weights)
        for j in range(k):
            by_word = np.bincount(word.ravel(), ((gold == j) - alpha[:, :, j]).ravel(), len(vocabulary))
            g[:, j] = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), SPACE)
            g[:, j] += np.bincount(grams, np.repeat(by_word / root, times), SPACE)
        grads = [g - 0.1 * weights, seen - pairs - transitions, (np.eye(k)[gold[0]] - alpha[0]).sum(axis=0) - start]
        del alpha
        for x, dx, m, v in zip(params, grads, mean, square):
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, weights.astype(np.float32), transitions, start, lexicon, codes, np.packbits(seen_trigrams, bitorder="little"), common)


def fit(docs: DataFrame, *, docs_per_language: int = 300, lexicon_size: int = 400, rounds: int = 40, fragment: int = 24, max_chars: int = 50_000, seed: int = 7, text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the languages in ``lang``; None if no row has both a language and a text.

    At most about ``docs_per_language`` whole texts of up to ``max_chars``
    characters each are taken for every language, by a hash of the text.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.length(F.col(text)).between(1, max_chars)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r.lang: r.n for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, min(1.0, docs_per_language / n)).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).distinct()
    rows = sorted((r.text, r.lang) for r in drawn.collect())
    if not rows:
        return None
    return _learn([t for t, _ in rows], [x for _, x in rows], lexicon_size=lexicon_size, rounds=rounds, fragment=fragment, seed=seed)


def posteriors(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of all words of the column, where each row's words begin, and how familiar each word is."""
    w = words(col)
    if not len(w.hash):
        return np.zeros((0, len(model.labels))), w.first, np.zeros(0)
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    *slots, trigrams = features(w, first, model.lexicon, model.codes)
    e = evidence(model.weights, *slots)[which]
    known = familiar(model.seen, slots[2], slots[3], trigrams)[which]
    restart = np.zeros(len(e), bool)
    begins = w.first[:-1]
    restart[begins[w.counts > 0]] = True
    return marginals(e, restart, model.transitions, model.start), w.first, known


def _summary(model: Model, col: pa.Array, min_confidence: float, min_familiar: float) -> dict[str, np.ndarray]:
    """Of each row: label number (-1 without words), confidence, words, and the runs of equal labels."""
    post, first, known = posteriors(model, col)
    counts, rows = np.diff(first), len(first) - 1
    some = counts > 0
    total = np.zeros((rows, len(model.labels)))
    if len(post):
        total[some] = np.add.reduceat(post, first[:-1][some], axis=0)
    best = np.where(some, total.argmax(axis=1), -1)
    confidence = np.where(some, total.max(axis=1) / np.maximum(counts, 1), 0.0)
    share = np.zeros(rows)
    if len(post):
        share[some] = np.add.reduceat(known, first[:-1][some]) / counts[some]
    label = post.argmax(axis=1)
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[first[:-1][some]] = True
    runs = np.flatnonzero(new)
    run_first = np.searchsorted(runs, first)
    return {"best": best, "confidence": confidence, "counts": counts, "runs": runs, "run_first": run_first, "run_label": label[runs], "first": first, "familiar": share, "accepted": some & (confidence >= min_confidence) & (share >= min_familiar * model.common)}


def _label(shared, min_confidence: float, min_familiar: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.labels, pa.string())
        for b in batches:
            col = strings(b.column("text"))
            for a, z in row_slices(col, 2 << 20):
                s = _summary(model, col.slice(a, z - a), min_confidence, min_familiar)
                offsets = pa.array(s["run_first"], pa.int32())
                at = s["runs"] - np.repeat(s["first"][:-1], np.diff(s["run_first"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(a, z - a),
                        names.take(pa.array(s["best"], mask=s["best"] < 0)),
                        pa.array(s["confidence"]),
                        pa.array(s["counts"], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                        pa.ListArray.from_arrays(offsets, names.take(pa.array(s["run_label"]))),
                        pa.array(s["accepted"]),
                    ],
                    ["doc_id", "language", "confidence", "words", "run_at", "run_language", "accepted"],
                )

    return run


def label_words(docs: DataFrame, model: Model | None = None, *, min_confidence: float = 0.4, min_familiar: float = 0.5, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document: its language, and the labels of all its words as runs.

    language has the largest mean probability over the words, which is
    confidence. run_at has the number of the first word of each run of equal
    labels, run_language the labels. accepted: the text has words, confidence
    is at least min_confidence, and of a word's byte trigrams, in the mean over
    the words, min_familiar of the share that new words of the languages can be
    expected to have in common with those the model was fitted on: so a text in
    none of the languages is rejected however few they are. Null, empty and wordless texts have
    language null, confidence 0, no runs and aren't accepted. With equal
    probabilities the first language in alphabetical order wins. Repeated rows
    and null ids are labelled like others; clashing extra columns aren't read.
    Without any labelled row to learn from, all languages are null.
    """
    model = model or fit(docs, text=text, **how)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        none = F.array().cast("array<int>")
        return plain.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("words"), none.alias("run_at"), F.array().cast("array<string>").alias("run_language"), F.lit(False).alias("accepted"))
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_label(shared, min_confidence, min_familiar), f"doc_id {kind}, language string, confidence double, words long, run_at array<int>, run_language array<string>, accepted boolean")


def reject_unreliable(docs: DataFrame, model: Model | None = None, *, min_confidence: float = 0.4, min_familiar: float = 0.5, text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that label_words() accepts.

    Null, empty and wordless texts go. Repeated rows go or stay alike; null ids
    and extra columns are carried along. Without a row to learn from, none can
    be judged and all stay; an empty table stays empty.
    """
    model = model or fit(docs, text=text, **how)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b.column(b.schema.get_field_index(text)))
            keep = [_summary(shared.value, col.slice(a, z - a), min_confidence, min_familiar)["accepted"] for a, z in row_slices(col, 2 << 20)]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)

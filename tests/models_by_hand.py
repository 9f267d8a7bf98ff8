"""Plain Python versions of the extractors, written from their definitions."""

import math
from collections import Counter, defaultdict


def murmur3(data: bytes, seed: int = 0) -> int:
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    h = seed
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i : i + 4], "little")
        h = rot(h ^ (rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13)
        h = (h * 5 + 0xE6546B64) & m
    k = int.from_bytes(data[len(data) // 4 * 4 :], "little")
    h ^= rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def dictionary(docs, max_words=10**13, low=0, high=math.inf):
    df = Counter(w for t in docs for w in set(t))
    ids = {}
    for w, c in sorted(df.items(), key=lambda x: (x[1], x[0]), reverse=True):
        if len(ids) < max_words and low <= c <= high:
            ids[w] = len(ids) + 1
    return ids, df


def bag(tokens, ids, df, n, *, norm="l2", tf="log", idf=0.0, hash_ngrams=0, ngram_weights=None, hash_size=10**7, polys_window=0, polys_mindf=5, polys_maxdf=0.5, polys_weight=0.1, seed=0):
    value, weight = defaultdict(float), {}
    ngram_weights = ngram_weights or [1.0] * hash_ngrams

    def add(i, s, w):
        value[i] += s
        weight[i] = w

    def hashed(text, w):
        h = murmur3(text.encode(), seed)
        add(abs(h) % hash_size, 1 if h >= 0 else -1, w)

    ok = lambda d: polys_mindf <= d <= polys_maxdf * n
    for x, w in enumerate(tokens):
        if w not in ids or ids[w] >= hash_size:
            continue
        f = 1.0
        if idf is not None:
            norm_by = math.log(max(1, idf + n))
            if not df.get(w) or not norm_by:
                continue
            f = math.log(max(1, idf + n / df[w])) / norm_by
            if not f:
                continue
        if not hash_ngrams:
            add(ids[w], 1, f)
        for y in range(min(hash_ngrams, x + 1)):
            g = ngram_weights[y]
            hashed(" ".join(tokens[x - y : x + 1]), g if g >= 0 else -g * f)
        if polys_window and ok(df[w]):
            for y in range(1, min(polys_window - 1, x) + 1):
                v = tokens[x - y]
                if v in df and ok(df[v]):
                    hashed("#".join(sorted((w, v))), polys_weight if polys_weight >= 0 else -polys_weight / math.log(1 + y))
    out = {}
    for i, v in value.items():
        sign = (v > 0) - (v < 0)
        if tf == "log":
            v = sign * math.log(1 + abs(v))
        elif tf == "binary":
            v = sign
        elif isinstance(tf, float):
            v = sign * (tf + 1) * abs(v) / (tf + abs(v))
        out[i] = v * weight[i]
    total = {"l0": len(out), "l1": sum(map(abs, out.values())), "l2": math.sqrt(sum(v * v for v in out.values()))}.get(norm, 1)
    return {i: v / total if total else v for i, v in out.items()}


def deleted(word, order):
    level, found = {word}, set()
    for _ in range(order):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found |= level
    return found - {word}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]

"""The 32-bit Murmur3 hash of UTF-8 strings, with any seed.

Spark's own ``hash`` treats the last bytes of a string otherwise and has a
fixed seed, so this is an Arrow function: numpy steps through the blocks of
all strings of a batch together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_array(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """Signed 32-bit hashes of a string array without nulls."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    start, length = offsets[:-1], np.diff(offsets)
    h = np.full(n, seed & 0xFFFFFFFF, np.uint32)
    blocks = length // 4
    active, i = np.flatnonzero(blocks > 0), 0
    while len(active):
        at = start[active] + 4 * i
        k = sum(data[at + b].astype(np.uint32) << np.uint32(8 * b) for b in range(4))
        x = h[active] ^ _turn(k * _C1, 15) * _C2
        h[active] = _turn(x, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        i += 1
        active = active[blocks[active] > i]
    tail = length % 4
    k = np.zeros(n, np.uint32)
    for b in range(3):
        has = np.flatnonzero(tail > b)
        k[has] |= data[start[has] + 4 * blocks[has] + b].astype(np.uint32) << np.uint32(8 * b)
    h ^= _turn(k * _C1, 15) * _C2
    h ^= length.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.view(np.int32)


def murmur3(text: Column, seed: int = 0) -> Column:
    """Signed hash as BIGINT; null stays null."""

    @F.arrow_udf("long")
    def hashed(x: pa.Array) -> pa.Array:
        h = pa.array(murmur3_array(pc.fill_null(x, ""), seed).astype(np.int64))
        return pc.if_else(pc.is_valid(x), h, pa.scalar(None, pa.int64()))

    return hashed(text)


def slot(h: Column, size: int) -> Column:
    """|h| modulo size; h is BIGINT, so the least 32-bit integer is no exception."""
    return F.pmod(F.abs(h), F.lit(size))


def sign_of(h: Column) -> Column:
    return F.when(h >= 0, 1.0).otherwise(-1.0)


def murmur3_sql(source: str, word: str = "w", seed: int = 0, prefix: str = "mm") -> str:
    """CTEs that give ``{prefix}(w, h)`` from the distinct words of a relation, for DuckDB."""
    m, c1, c2 = "4294967295::UBIGINT", "3432918353::UBIGINT", "461845907::UBIGINT"
    mul = lambda a, b: f"(({a}*{b}) & {m})"
    rot = lambda a, r: f"((({a}*{2**r}::UBIGINT) & {m}) | ({a} >> {32 - r}))"
    let = lambda e, v, body: f"list_transform([{e}], lambda {v}: {body})[1]"
    scramble = lambda k: let(mul(k, c1), "p", mul(rot("p", 15), c2))
    byte = lambda at: f"substr(hx, {at}, 2)"
    block = "('0x' || " + " || ".join(byte(f"8*i+{o}") for o in (7, 5, 3, 1)) + ")::UBIGINT"
    round_ = let(f"xor(a, {scramble('k')})", "y", f"({rot('y', 13)}*5::UBIGINT + 3864292196::UBIGINT) & {m}")
    tail = " || ".join(byte(f"8*(n//4)+{o}") for o in (5, 3, 1))
    return f"""
{prefix}0 as (select distinct {word} as w, hex(encode({word})) as hx, strlen({word}) as n from {source}),
{prefix}1 as (select w, n, hx, list_reduce(list_transform(range(0, n//4), lambda i: {block}), lambda a, k: {round_}, {seed}::UBIGINT) as a from {prefix}0),
{prefix}2 as (select w, xor(case when n % 4 = 0 then a else xor(a, {scramble(f"('0x' || {tail})::UBIGINT")}) end, n::UBIGINT) as a from {prefix}1),
{prefix}3 as (select w, {mul("xor(a, a >> 16)", "2246822507::UBIGINT")} as a from {prefix}2),
{prefix}4 as (select w, {mul("xor(a, a >> 13)", "3266489909::UBIGINT")} as a from {prefix}3),
{prefix}5 as (select w, xor(a, a >> 16) as a from {prefix}4),
{prefix} as (select w, case when a >= 2147483648 then a::BIGINT - 4294967296 else a::BIGINT end as h from {prefix}5)"""

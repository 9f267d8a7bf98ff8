"""Dictionaries looked up where the rows are.

A table of words that is small enough is sent to the executors once. Tokens of
a batch are told apart by Arrow, the distinct ones are found by binary search
over hashes and compared with the words found; the rest is numpy over whole
batches. For larger tables, rows are put into blocks of a bounded number of
values: each block's distinct words are joined with the table by shuffling and
come back to the block, which then is handled as with a small table. So no
task or driver holds the table, and a frequent word comes once a block. Blocks
are kept and shuffled with places in their distinct words instead of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.hashing import murmur3_array
from loomtext.session import written

MOST_ROWS, MOST_BYTES = 300_000, 16 << 20
BLOCK_VALUES, BLOCK_BYTES, WORDS_OF_ROW = 1 << 20, 64 << 20, 1 << 16


def _hashes(words: pa.Array, seed: int) -> np.ndarray:
    one, two = (murmur3_array(words, s).view(np.uint32).astype(np.uint64) for s in (seed, seed + 1))
    return (one << np.uint64(32)) | two


class Lookup:
    """Words with values; find() gives their places, -1 for others."""

    def __init__(self, table: pa.Table, word: str = "word"):
        table = table.combine_chunks()
        words = table[word].cast(pa.large_string())
        self.words = words.chunk(0) if words.num_chunks else pa.array([], pa.large_string())
        self.values = {c: table[c] for c in table.column_names if c != word}
        self.seed = 0
        while True:  # until no two words share a hash
            h = _hashes(self.words, self.seed)
            self.order = np.argsort(h)
            self.sorted = h[self.order]
            if not (self.sorted[1:] == self.sorted[:-1]).any():
                break
            self.seed += 2

    def __len__(self) -> int:
        return len(self.words)

    def find(self, tokens: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(tokens)
        own = coded.dictionary.cast(pa.large_string())
        if not len(self) or not len(own):
            return np.full(len(tokens), -1, np.int64)
        h = _hashes(own, self.seed)
        p = np.searchsorted(self.sorted, h)
        p[p == len(self)] = 0
        at = self.order[p]
        same = np.asarray(pc.equal(self.words.take(pa.array(at)), own))
        at = np.append(np.where(same, at, -1), -1)
        return at[np.asarray(pc.fill_null(coded.indices, len(own)))]


def lookup(table: DataFrame, word: str = "word") -> Lookup | None:
    """A table of distinct words in memory, None if it is too large for that or has a word twice."""
    table = table.where(F.col(word).isNotNull())
    rows, size = table.agg(F.count("*"), F.sum(F.octet_length(word))).first()
    if rows > MOST_ROWS or (size or 0) > MOST_BYTES:
        return None
    whole = table.toArrow()
    return Lookup(whole, word) if len(pc.unique(whole[word])) == rows else None


def lists(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(from, to, values, row of each value, from 0) for row ranges of about ``most`` values."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to, column.slice(at, to - at).flatten(), np.repeat(np.arange(to - at), lens[at:to])
        at = to


def summed(row: np.ndarray, idx: np.ndarray, sign: np.ndarray, weight: np.ndarray, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, sum of signs, weight of the last in order) of each row and index."""
    if not len(row):
        return row, idx, sign, weight
    at = np.lexsort((idx, row) if order is None else (order, idx, row))
    row, idx, sign, weight = row[at], idx[at], sign[at], weight[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return row[begin], idx[begin], np.add.reduceat(sign, begin), weight[last]


def over_tokens(docs: DataFrame, schema: str, function: Callable, shared, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """function(lookup, values, row) -> (row or None, arrays) over the token lists of docs; (key, arrays) by row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            for a, z, values, row in lists(b.column(1)):
                where, columns = function(shared.value, values, row, z - a)
                own = keys.slice(a, z - a) if where is None else keys.take(pa.array(where + a))
                yield pa.RecordBatch.from_arrays([own, *columns], [key, *(f"c{i}" for i in range(len(columns)))])

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split(" ", 1)[1] for x in schema.split(", ")]
    plain = f"{key} {kind}, " + ", ".join(f"c{i} {x}" for i, x in enumerate(kinds))
    out = docs.select(key, tokens).mapInArrow(run, plain)
    return out.select(key, *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def unique(table: DataFrame, word: str = "word") -> bool:
    """Whether no word comes twice."""
    return table.where(F.col(word).isNotNull()).groupBy(word).count().where("count > 1").isEmpty()


def numbered_blocks(docs: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """docs with ``__block``: the rows of one task in runs of about BLOCK_VALUES values or, if ``whole``, in one. Written, as a task that is run again may see its rows in another order."""
    place, most = docs.columns.index(column), 1 << 62 if whole else BLOCK_VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column(place)), 0), np.int64) + 1)
            at = 0
            while at < b.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + (not held), int(np.searchsorted(ends, base + most - held, "right")))
                if to > at:
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns), pa.array(np.full(to - at, block))], [*b.schema.names, "__block"])
                    held += int(ends[to - 1] - base)
                if to < b.num_rows:
                    block, held = block + 1, 0
                at = to

    return written(docs.mapInArrow(run, f"{ddl(docs)}, __block long"), "blocks")


def ddl(table: DataFrame) -> str:
    """The columns of a table, nulls allowed everywhere."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def words_of_blocks(rows: DataFrame, column: str, word: str, kind: str) -> DataFrame:
    """(__block, word): the distinct values of each block, those of one batch told apart where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.asarray(b.column(0))
            for block in np.unique(of):
                own = np.flatnonzero(of == block)
                words = pc.unique(b.column(1).slice(own[0], own[-1] - own[0] + 1).flatten()).drop_null()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), words], ["__block", word])

    return rows.select("__block", column).mapInArrow(run, f"__block long, {word} {kind}").distinct()


def coded_blocks(docs: DataFrame, column: str, counted: bool = False) -> DataFrame:
    """docs in blocks as numbered_blocks() has them, also bounded in bytes, with places in the block's distinct values instead of values.

    The distinct values, null among them, stand in rows of their own, those
    with ``__from``: the place of the first of ``__words``. Each block has one
    such row at 0. If ``counted``, ``__dfs`` has in how many of the block's
    rows each of ``__words`` occurs.
    """
    place, kind = docs.columns.index(column), docs.schema[column].dataType.elementType.simpleString()
    others = ddl(docs.drop(column))
    names = [c for c in docs.columns if c != column]
    heads = ["__block", "__from", "__words", *["__dfs"] * counted, column, *names]

    def block(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists_, rows = pa.chunked_array([b.column(place) for b in held]).combine_chunks(), sum(b.num_rows for b in held)
        coded = pc.dictionary_encode(lists_.flatten(), null_encoding="encode")
        lens = np.asarray(pc.fill_null(pc.list_value_length(lists_), 0), np.int64)
        codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), coded.indices, mask=lists_.is_null())
        words = coded.dictionary
        if counted and len(words):
            once = np.unique(np.repeat(np.arange(rows), lens) * len(words) + np.asarray(coded.indices, np.int64))
            dfs = pa.array(np.bincount(once % len(words), minlength=len(words)).astype(np.int32))
        else:
            dfs = pa.array([], pa.int32())
        for a in range(0, max(1, len(words)), WORDS_OF_ROW):
            piece = words.slice(a, WORDS_OF_ROW)
            own = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece)
            nulls = [pa.nulls(1, held[0].schema.field(c).type) for c in names]
            of = [pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), dfs.slice(a, WORDS_OF_ROW))] if counted else []
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([a], pa.int32()), own, *of, pa.nulls(1, codes.type), *nulls], heads)
        own = [pa.chunked_array([b.column(b.schema.get_field_index(c)) for b in held]).combine_chunks() for c in names]
        of = [pa.nulls(rows, pa.list_(pa.int32()))] if counted else []
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(words.type)), *of, codes, *own], heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, values, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column(place)), 0), np.int64) + 1)
            at = 0
            while at < b.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + (not held), int(np.searchsorted(ends, base + BLOCK_VALUES - values, "right")))
                while to - at > (not held) and size + b.slice(at, to - at).nbytes > BLOCK_BYTES:
                    to = at + (to - at) // 2
                if to > at:
                    held.append(b.slice(at, to - at))
                    values, size = values + int(ends[to - 1] - base), size + held[-1].nbytes
                if to < b.num_rows:
                    yield from block(number, held)
                    number, held, values, size = number + 1, [], 0, 0
                at = to
        if held:
            yield from block(number, held)

    schema = f"__block long, __from int, __words array<{kind}>, " + "__dfs array<int>, " * counted + f"`{column}` array<int>" + (f", {others}" if names else "")
    return written(docs.mapInArrow(run, schema), "blocks")


@dataclass(frozen=True)
class Blocks:
    """docs and their coded_blocks(), from which a dictionary is counted and looked up, so that texts are normalised once for both."""

    docs: DataFrame
    rows: DataFrame
    column: str = "tokens"

    @classmethod
    def of(cls, docs: DataFrame, column: str = "tokens", counted: bool = True) -> Blocks:
        return cls(docs, coded_blocks(docs, column, counted), column)

    def count(self) -> int:
        return self.rows.where("__from is null").count()

    def frequencies(self) -> DataFrame:
        """(word, df): in how many rows each value occurs, nulls counted as one word. No more is added up than the distinct words of each block."""
        each = self.rows.where("__from is not null").select(F.explode(F.arrays_zip("__words", "__dfs")).alias("e"))
        return each.groupBy(F.col("e.__words").cast("string").alias("word")).agg(F.sum("e.__dfs").alias("df"))


def consecutive(rows: DataFrame) -> tuple[DataFrame, int]:
    """coded_blocks() with ``__block`` from 0 on without gaps, and how many tasks they need, 1 at least. The driver holds a number for each task that made blocks."""
    task = F.shiftright("__block", 32)
    made = sorted((r[0], r[1]) for r in rows.where("__from = 0").groupBy(task).count().collect())
    ends = np.cumsum([n for _, n in made], dtype=np.int64).tolist()
    first = rows.sparkSession.createDataFrame([(t, end - n) for (t, n), end in zip(made, ends)], "__task long, __first long")
    number = (F.col("__first") + F.col("__block").bitwiseAND((1 << 32) - 1)).cast("int")
    placed = rows.withColumn("__task", task).join(F.broadcast(first), "__task").withColumn("__block", number).drop("__task", "__first")
    return placed, ends[-1] if ends else 1


def over_blocks(docs: DataFrame | Blocks, table: DataFrame, schema: str, function: Callable[[pa.Table, pa.Table], Iterator[pa.Table] | pa.Table], column: str = "tokens", word: str = "word") -> DataFrame:
    """function(rows of a block, rows of ``table`` whose ``word`` is among the block's values), for tables of any size.

    Each block has a task of its own, however many blocks there are, so tasks
    don't grow with the rows.
    """
    made = docs if isinstance(docs, Blocks) else Blocks.of(docs, column, counted=False)
    column, order = made.column, made.docs.columns
    rows, blocks = consecutive(made.rows.drop("__dfs"))
    parts = max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.where("__from is not null").select(F.col("__block").alias("__of"), "__from", F.posexplode("__words").alias("__code", word))
    asked = asked.select("__of", (F.col("__from") + F.col("__code")).alias("__code"), word).repartition(parts, word)
    known = asked.join(table.repartition(parts, word), word).select("__of", "__code", *[c for c in table.columns if c != word])

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        first = own["__from"].combine_chunks()
        heads = own.filter(first.is_valid()).sort_by("__from")["__words"].combine_chunks().flatten()
        own = own.filter(first.is_null()).drop_columns(["__block", "__from", "__words"]).select(order)
        codes = own[column].combine_chunks()
        lens = np.asarray(pc.fill_null(pc.list_value_length(codes), 0), np.int64)
        offsets = pa.array(np.append(0, np.cumsum(lens)).astype(np.int32))
        values = pa.ListArray.from_arrays(offsets, heads.take(codes.flatten()), mask=codes.is_null())
        own = own.set_column(order.index(column), column, values)
        words = heads.take(found["__code"].combine_chunks())
        return function(own, found.drop_columns(["__of", "__code"]).add_column(0, word, words))

    return rows.repartitionById(blocks, F.col("__block")).groupBy("__block").cogroup(known.repartitionById(blocks, F.col("__of")).groupBy("__of")).applyInArrow(run, schema)


def cogrouped(rows: DataFrame, words: DataFrame, table: DataFrame, schema: str, function: Callable, word: str = "word") -> DataFrame:
    """function(rows of a block, rows of ``table`` whose ``word`` is among the block's values) for blocks and words of blocks that are at hand."""
    known = words.join(table, word).select("__block", word, *[c for c in table.columns if c != word])

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        return function(own.drop_columns("__block"), words.drop_columns("__block"))

    return rows.groupBy("__block").cogroup(known.groupBy("__block")).applyInArrow(run, schema)


def over_block_tokens(docs: DataFrame | Blocks, table: DataFrame, schema: str, function: Callable, prepare: Callable[[Lookup], Lookup], key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """As over_tokens, with a lookup made by ``prepare`` from each block's own words of ``table``, which must be distinct."""
    made = docs if isinstance(docs, Blocks) else Blocks.of(docs.select(key, tokens), tokens, counted=False)
    kind, column = made.docs.schema[key].dataType.simpleString(), made.column
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split(" ", 1)[1] for x in schema.split(", ")]

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        found = prepare(Lookup(words))
        parts = []
        for b in own.select([key, column]).combine_chunks().to_batches():
            keys = b.column(0)
            for a, z, values, row in lists(b.column(1)):
                where, columns = function(found, values, row, z - a)
                keyed = keys.slice(a, z - a) if where is None else keys.take(pa.array(where + a))
                parts.append(pa.RecordBatch.from_arrays([keyed, *columns], [key, *(f"c{i}" for i in range(len(columns)))]))
        return pa.Table.from_batches(parts)

    plain = f"{key} {kind}, " + ", ".join(f"c{i} {x}" for i, x in enumerate(kinds))
    out = over_blocks(made, table, plain, run)
    return out.select(key, *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

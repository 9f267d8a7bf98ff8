"""Chat transcripts as training text, assembled column by column.

Each turn becomes header, content and footer. The lengths of all segments of a
batch are computed at once, their cumulative sums are the places, and headers,
contents and footers are scattered into one preallocated Arrow buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.columnar import raw, row_slices

OPEN, AFTER_ROLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy the segments data[start : start + length] to out[to :]."""
    total = int(length.sum())
    if not total:
        return
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The transcripts of rows first[i] : first[i + 1], and the bytes that each row takes."""
    coded = pc.dictionary_encode(pc.fill_null(roles.cast(pa.large_string()), ""))
    names = [OPEN + (r or "").encode() + AFTER_ROLE for r in coded.dictionary.to_pylist()]
    heads = np.frombuffer(b"".join(names), np.uint8)
    head_len = np.array([len(x) for x in names], np.int64)
    head_at = np.cumsum(head_len) - head_len
    role = np.asarray(coded.indices, np.int64)
    content, offsets = raw(pc.fill_null(texts.cast(pa.large_string()), ""))
    lengths = np.empty((len(role), 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = head_len[role], np.diff(offsets), len(CLOSE)
    ends = np.cumsum(lengths.ravel())
    places = (ends - lengths.ravel()).reshape(-1, 3)
    buffer = pa.allocate_buffer(int(ends[-1]) if len(ends) else 0)
    out = np.frombuffer(buffer, np.uint8) if buffer.size else np.zeros(0, np.uint8)
    _scatter(out, places[:, 0], heads, head_at[role], lengths[:, 0])
    for a, z in row_slices(texts):
        _scatter(out, places[a:z, 1], content, offsets[a:z], lengths[a:z, 1])
    _scatter(out, places[:, 2], np.frombuffer(CLOSE, np.uint8), np.zeros(len(role), np.int64), lengths[:, 2])
    row_ends = np.append(0, ends.reshape(-1, 3)[:, 2]) if len(ends) else np.zeros(1, np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(row_ends[first].astype(np.int64)), buffer])
    return text, np.diff(row_ends)


def _finish(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Transcripts of whole conversations, a bounded number of bytes at a time."""
    texts = t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    before = np.append(0, np.cumsum(size))[first]
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(before, before[at] + (4 << 20), "right")) - 1)
        own = t.slice(int(first[at]), int(first[to] - first[at])).combine_chunks()
        edges = first[at : to + 1] - first[at]
        roles = own["role"].chunk(0)
        text, taken = assemble(roles, own["text"].chunk(0), edges)
        answers = np.where(np.asarray(pc.fill_null(pc.equal(roles, "assistant"), False)), taken, 0)
        sums = lambda x: pa.array(np.add.reduceat(x, edges[:-1]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([own["conv_id"].chunk(0).take(pa.array(edges[:-1])), pa.array(np.diff(edges)), sums(taken), sums(answers), text.cast(pa.string())], ["conv_id", "turns", "bytes", "assistant_bytes", "text"])
        at = to


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with g, which grows by one where another conversation begins."""
    g, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("conv_id")
        code = np.asarray(pc.dictionary_encode(ids, null_encoding="encode").indices, np.int64)
        g += last is not None and (ids[0].as_py(),) != last
        group = g + np.cumsum(np.diff(code, prepend=code[0]) != 0)
        g, last = int(group[-1]), (ids[-1].as_py(),)
        yield pa.RecordBatch.from_arrays([pa.array(group), ids, b.column("role"), b.column("text")], ["g", "conv_id", "role", "text"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; the last conversation of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in _numbered(batches):
        group = b.column("g").to_numpy()
        if held and group[-1] == last:
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        group = t["g"].to_numpy()
        first = np.append(np.flatnonzero(np.diff(group, prepend=group[0] - 1)), len(group))
        yield from _finish(t.slice(0, int(first[-2])), first[:-1])
        held, last = t.slice(int(first[-2])).to_batches(), group[-1]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from _finish(t, np.array([0, t.num_rows]))


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, bytes, assistant_bytes, text): one row for each conversation.

    text has, for every turn in order, ``<|im_start|>role\\n``, the content and
    ``<|im_end|>\\n``; assistant_bytes are those of assistant turns with header
    and footer. Turns are ordered by number, then role, then text, nulls first,
    so ties have one order; repeated rows are repeated turns. A null role or
    text is written as empty. Rows of null conv_id form one conversation. Extra
    columns aren't read; an empty table gives no rows.
    """
    kind = turns.schema[conv_id].dataType.simpleString()
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = plain.repartition("conv_id").sortWithinPartitions(*keys)
    return ordered.mapInArrow(_run, f"conv_id {kind}, turns long, bytes long, assistant_bytes long, text string")


#: string_agg over the same order.
SQL = """
select conv_id, count(*) as turns, sum(n)::bigint as bytes, sum(case when role = 'assistant' then n else 0 end)::bigint as assistant_bytes,
  string_agg(piece, '' order by turn nulls first, role nulls first, text nulls first) as text
from (select *, strlen(piece) as n from (
  select conv_id, turn, role, text, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as piece from conversations))
group by conv_id
"""

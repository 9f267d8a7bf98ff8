"""WARC files whose records are members of their own, from monolithic gzip streams.

A WARC that was compressed as one stream can't be read from the middle. Each
such file is inflated once, as a stream; every record is written again as its
own gzip member, and a sidecar index holds where each begins. Members that are
already single records are normalised alike, whatever the input's members are.

Files lie in the shared folder and are reached through Arrow's file systems, so
local paths and cluster stores are alike. A file is written under a temporary
name and moved into place, so a task that is run again leaves nothing half done.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import fresh_path, written

_CHUNK = 1 << 20


_UNFIT = re.compile(r"[\r\n]|\A[ \t]+|[ \t]+\Z")


def record(kind: str, uri: str | None, identity: str | None, body: bytes, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.0 record. Line breaks and outer blanks in the URI are percent-encoded, in the identity all but letters and digits."""
    urn = "urn:x-nopage" if identity is None else "urn:x-page:" + quote(identity, safe="")
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + urn.encode() + b">", b"WARC-Date: " + date.encode()]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + _UNFIT.sub(lambda m: quote(m.group()), uri).encode())
    head += [b"Content-Type: text/html", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a bounded piece at a time."""
    machine, pending = zlib.decompressobj(31), b""
    fresh = True
    while True:
        data = pending or source.read(_CHUNK)
        if not data:
            break
        if machine.eof:
            data = data.lstrip(b"\0") if fresh else data
            if not data:
                pending = b""
                continue
            machine = zlib.decompressobj(31)
        out = machine.decompress(data, _CHUNK)
        pending = machine.unconsumed_tail or machine.unused_data
        fresh = machine.eof
        if out:
            yield out
    while not machine.eof and (out := machine.decompress(machine.unconsumed_tail, _CHUNK)):
        yield out
    if not machine.eof and not (fresh and not pending):
        raise ValueError("the gzip stream is cut off")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of every record of an inflated WARC; names are in lower case."""
    held = bytearray()

    def more() -> bool:
        x = next(pieces, None)
        if x is None:
            return False
        held.extend(x)
        return True

    while True:
        while held[:2] in (b"\r\n", b"\r") or not held:
            if held[:2] == b"\r\n":
                del held[:2]
            elif not more():
                if held:
                    raise ValueError("bytes after the last record")
                return
        at = 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not more():
                raise ValueError("a record's header is cut off")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record: " + lines[0][:80])
        headers = {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise ValueError("a record has no length")
        size = end + 4 + int(length) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record's body is cut off")
        if held[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line breaks")
        yield headers, bytes(held[:size])
        del held[:size]


def normalise(source: BinaryIO, sink: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Write every record as a member of its own; an index entry for each."""
    offset = 0
    for number, (headers, whole) in enumerate(records(inflate(source))):
        machine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = machine.compress(whole) + machine.flush()
        sink.write(member)
        body = whole[whole.index(b"\r\n\r\n") + 4 : -4]
        yield {
            "record": number,
            "offset": offset,
            "length": len(member),
            "type": headers.get("warc-type"),
            "id": headers.get("warc-record-id"),
            "url": headers.get("warc-target-uri"),
            "bytes": len(body),
            "sha1": hashlib.sha1(body).hexdigest(),
        }
        offset += len(member)


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _into_place(store: fs.FileSystem, draft: str, path: str) -> None:
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)
    store.move(draft, path)


def _monolith(folder: str, file_bytes: int) -> Callable:
    """Each task's rows as files of one gzip stream each; another begins after ``file_bytes`` of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _at(folder)
        store.create_dir(path)
        task = TaskContext.get().partitionId()
        number, name, draft, sink, machine, n, size = 0, "", "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            sink.write(machine.flush())
            sink.close()
            _into_place(store, draft, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["file", "records", "bytes"])

        for b in batches:
            for page, url, html in zip(b.column("page_id"), b.column("url"), b.column("html")):
                if sink is None:
                    name, n, size = f"{task:07d}-{number:05d}.warc.gz", 0, 0
                    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
                    sink, machine = store.open_output_stream(draft, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                whole = record("resource", url.as_py(), page.as_py(), (html.as_py() or "").encode())
                sink.write(machine.compress(whole))
                n, size = n + 1, size + len(whole)
                if size >= file_bytes:
                    yield close()
                    sink, number = None, number + 1
        if sink is not None:
            yield close()

    return run


def write_monoliths(pages: DataFrame, folder: str, *, file_bytes: int = 16 << 20, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(file, records, bytes): the pages as WARCs of one gzip stream each, written where they are read, without a shuffle."""
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return written(rows.mapInArrow(_monolith(folder, file_bytes), "file string, records long, bytes long"), "monoliths")


INDEX = "file string, record long, offset long, length long, type string, id string, url string, bytes long, sha1 string, error string"


def _normaliser(source: str, target: str, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _at(source)
        to, out = _at(target)
        for b in batches:
            for name in b.column("file").to_pylist():
                to.create_dir(out)
                mark = uuid.uuid4().hex
                draft, side = f"{out}/.{name}-{mark}", f"{out}/.{name}.idx-{mark}"
                rows: list[dict] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as read, to.open_output_stream(draft, compression=None) as sink, to.open_output_stream(side, compression=None) as index:
                    entries, n = normalise(read, sink, level), 0
                    while True:
                        try:
                            entry = next(entries, None)
                        except (ValueError, zlib.error) as e:
                            entry = {"record": n, "error": str(e)}
                        if entry is None:
                            break
                        index.write(json.dumps(entry).encode() + b"\n")
                        rows.append({"file": name} | entry)
                        n += 1
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                _into_place(to, draft, f"{out}/{name}")
                _into_place(to, side, f"{out}/{name}.idx")
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"record": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "bytes": pa.int64()}
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)


def normalise_files(spark: SparkSession, source: str, target: str, names: DataFrame, *, level: int = 6, task_bytes: int = 128 << 20) -> DataFrame:
    """The index of all records of the files (column ``file``) below source, rewritten below target with sidecars.

    The files are written once, when this is called. A file that is cut off or
    broken keeps its whole records up to there; a last row, also in its
    sidecar, has the number of the record that failed and, as ``error``, what
    is wrong, and nothing else. Where names has ``bytes``, tasks get about
    ``task_bytes`` of files each, else a file each.
    """
    size = F.max("bytes") if "bytes" in names.columns else F.lit(task_bytes)
    each = written(names.groupBy("file").agg(size.alias("bytes")), "warc-names")
    files, total = each.agg(F.count("*"), F.sum("bytes")).first()
    few = min(files, 4 * spark.sparkContext.defaultParallelism)
    n = max(1, few, min(files, -(-(total or 0) // task_bytes)))
    return written(each.select("file").repartitionByRange(n, "file").mapInArrow(_normaliser(source, target, level), INDEX), "warc-index")


def rewrite_pages(pages: DataFrame, *, file_bytes: int = 16 << 20, **columns) -> DataFrame:
    """Pages as monolithic WARCs of about ``file_bytes``, normalised: (file, page_id, url, record, offset, length, bytes, sha1) of every page.

    A null page_id is kept as null, a null url is no header, a null html an
    empty body. Line breaks and outer blanks of a URL come back percent-encoded. Repeated rows
    are repeated records. Empty tables give no files and no rows; extra columns
    aren't read. ``bytes`` and ``sha1`` are of the body.
    """
    spark = pages.sparkSession
    before, after = fresh_path(spark, "warc-in"), fresh_path(spark, "warc-out")
    names = write_monoliths(pages, before, file_bytes=file_bytes, **columns)
    index = normalise_files(spark, before, after, names)
    kind = pages.schema[columns.get("page_id", "page_id")].dataType.simpleString()
    number = F.url_decode(F.regexp_extract("id", r"^<urn:x-page:(.*)>$", 1))
    number = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error"))).when(F.startswith("id", F.lit("<urn:x-page:")), number)
    return index.select("file", number.cast(kind).alias("page_id"), "url", "record", "offset", "length", "bytes", "sha1")

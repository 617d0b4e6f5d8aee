"""Capture files as a Spark data source, in batches and as a stream: lines of gzip files that writers append members to.

    spark.dataSource.register(Captures)
    spark.read.format("captures").load(root)
    spark.readStream.format("captures").load(root)

A file is a run of gzip members, one appended after another; a writer that died leaves its last member torn.  Members are
decompressed as a stream, some KB at a time, so a file's size and its number of members cost neither memory nor
more than linear time; lines come out in batches, with the number of the member that ends them.  What a torn member
still holds counts up to its last line end, and a torn file has one row with `torn` and a null line; a file
without a line has a row with a null line.  Writers end members at line ends.

Files are laid out as root/dt=YYYY-MM-DD/...; folders without days are read too.  Files are packed in partitions of about
`partitionBytes`.  The stream's offset is the size of each file of the newest `openDays` days, and the day before
which all is read; a file is read on from the size it had.  If that fell within a member, the stream goes back
to the member's start and leaves out the lines that were complete before.  A day's files have to be closed
when it is `openDays` days behind the newest (two by default), as writers roll over at midnight.

Paths are URIs of stores that pyarrow can open, or plain paths; for stores that only Spark can read, `bronze.gzip_lines` takes
what the binaryFile reader gives.
"""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, member int, torn boolean, line string"
#: Compressed bytes that are decompressed at a time, and lines of a batch.
CHUNK, LINES = 1 << 14, 5_000
MAGIC = b"\x1f\x8b\x08"
_DAY = re.compile(r"dt=(\d{4}-\d{2}-\d{2})")


def pieces(stream, limit: int | None = None) -> Iterator[tuple[int, bytes, bool, bool]]:
    """member, bytes, whole, torn: what the stream's gzip members hold, piece by piece; `whole` at a member's end.

    The last is torn if the stream, or its first `limit` bytes, ends within a member, or something else follows.
    """
    member, reader, data, left = 0, None, b"", limit
    while True:
        if not data:
            data = stream.read(CHUNK if left is None else min(CHUNK, left))
            left = None if left is None else left - len(data)
            if not data:
                break
        if reader is None:
            reader = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            out = reader.decompress(data)
        except zlib.error:
            yield member, b"", False, True
            return
        yield member, out, reader.eof, False
        data = reader.unused_data
        if reader.eof:
            member, reader = member + 1, None
    if reader is not None:
        yield member, b"", False, True


def lines_of(stream, limit: int | None = None, before: int = 0) -> Iterator[tuple[int, bool, list[bytes]]]:
    """member, torn and lines, in runs; a line belongs to the member that ends it.

    Lines that the first `before` bytes already hold complete are left out.
    """
    done = 0
    if before:
        done = sum(text.count(b"\n") for _, text, _, _ in pieces(stream, before))
        stream.seek(0)
    rest = b""
    for member, text, _, torn in pieces(stream, limit):
        *lines, rest = (rest + text).split(b"\n")
        if done:
            lines, done = lines[done:], max(0, done - len(lines))
        if lines or torn:
            yield member, torn, lines


def member_end(stream, at: int) -> int:
    """The end of the last member that ends at or before byte `at`: found by a member before it that is whole, checksum and all."""
    reach = CHUNK
    while at:
        first = max(0, at - reach)
        stream.seek(first)
        window = stream.read(at - first)
        place = len(window)
        while (place := window.rfind(MAGIC, 0, place)) >= 0:
            start = first + place
            stream.seek(start)
            reader, end = zlib.decompressobj(16 + zlib.MAX_WBITS), start
            try:
                while not reader.eof and end < at and (data := stream.read(min(CHUNK, at - end))):
                    reader.decompress(data)
                    end += len(data)
            except zlib.error:
                continue
            if reader.eof:
                return end - len(reader.unused_data)
        if not first:
            return 0
        reach *= 2
    return 0


def file_system(root: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def files(root: str, suffix: str) -> dict[str, int]:
    """The size of each file under a root, by its path in the store."""
    from pyarrow import fs

    store, path = file_system(root)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {x.path: x.size for x in found if x.is_file and x.path.endswith(suffix)}


@dataclass
class Part(InputPartition):
    #: path, and the bytes from and to which it is read
    spans: list[tuple[str, int, int]]


def packed(spans: list[tuple[str, int, int]], most: int) -> list[Part]:
    """Spans in partitions of about `most` bytes, large ones first."""
    out, size = [], 0
    for span in sorted(spans, key=lambda s: s[1] - s[2]):
        n = span[2] - span[1]
        if not out or size + n > most:
            out.append(Part([]))
            size = 0
        out[-1].spans.append(span)
        size += n
    return out


def read_spans(root: str, part: Part | None) -> Iterator[pa.RecordBatch]:
    """The lines of a partition; Spark asks for None where there is no partition."""
    if part is None:
        return
    store, _ = file_system(root)
    for path, begin, end in part.spans:
        with store.open_input_file(path) as file:
            start = member_end(file, begin)
            some = False
            held: list[tuple[int, bool, bytes | None]] = []
            for member, torn, lines in lines_of(Window(file, start, end), None, begin - start):
                some = some or torn or bool(lines)
                held += [(member, False, x) for x in lines]
                if torn:
                    held.append((member, True, None))
                while len(held) > LINES:
                    yield batch(path, held[:LINES])
                    held = held[LINES:]
            if not some and not begin:
                held.append((0, False, None))
            if held:
                yield batch(path, held)


class Window(io.RawIOBase):
    """A file's bytes from start to end; `seek(0)` goes to start."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end, self.at = file, start, end, start

    def seek(self, place: int, whence: int = 0) -> int:
        self.at = self.start + place
        return place

    def read(self, n: int = -1) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(max(0, min(n if n >= 0 else self.end, self.end - self.at)))
        self.at += len(data)
        return data


def put_files(rows, root: str) -> None:
    """Write the files of (name, content) under a root, each by the task that has it; a file there is replaced."""

    def put(batches):
        store, base = file_system(root)
        for each in batches:
            for name, content in zip(each.column("name").to_pylist(), each.column("content")):
                path = f"{base.rstrip('/')}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{path}.part") as file:
                    file.write(content.as_buffer())
                store.move(f"{path}.part", path)
            yield each.select(["name"])

    rows.select("name", "content").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()


def batch(path: str, rows: list[tuple[int, bool, bytes | None]]) -> pa.RecordBatch:
    text = [x if x is None else x.decode("utf-8", "replace") for _, _, x in rows]
    columns = [pa.array([path] * len(rows), pa.string()), pa.array([m for m, _, _ in rows], pa.int32()), pa.array([t for _, t, _ in rows]), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "member", "torn", "line"])


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStream(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.suffix = options.get("suffix", ".gz")
        self.most = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[Part]:
        return packed([(p, 0, n) for p, n in files(self.root, self.suffix).items()], self.most)

    def read(self, partition: Part):
        yield from read_spans(self.root, partition)


class CaptureStream(DataSourceStreamReader):
    """Offsets: `closed`, the day up to which all has been read, and `open`, the sizes of the files of later days."""

    def __init__(self, options):
        self.root = options["path"]
        self.suffix = options.get("suffix", ".gz")
        self.most = int(options.get("partitionBytes", 64 << 20))
        self.open_days = int(options.get("openDays", 2))

    @staticmethod
    def day(path: str) -> str:
        found = _DAY.search(path)
        return found[1] if found else "9999-99-99"

    def initialOffset(self) -> dict:
        return {"closed": "", "open": "{}"}

    def latestOffset(self) -> dict:
        found = files(self.root, self.suffix)
        days = sorted({self.day(p) for p in found} - {"9999-99-99"})
        closed = days[-self.open_days - 1] if len(days) > self.open_days else ""
        return {"closed": closed, "open": json.dumps({p: n for p, n in sorted(found.items()) if self.day(p) > closed})}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, new = json.loads(start["open"]), json.loads(end["open"])
        if end["closed"] > start["closed"]:  # what those days still got
            new |= {p: n for p, n in files(self.root, self.suffix).items() if start["closed"] < self.day(p) <= end["closed"]}
        return packed([(p, old.get(p, 0), n) for p, n in new.items() if n > old.get(p, 0)], self.most)

    def read(self, partition: Part):
        yield from read_spans(self.root, partition)

    def commit(self, end: dict) -> None:
        pass

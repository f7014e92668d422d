"""Media columns: payloads as 8-bit pictures in archives, read by a Spark data source.

A payload is a text's UTF-8 bytes and zero bytes up to a positive multiple of
64. It is stored as a PNG of 8-bit grey samples, 64 to a row. A task writes its
members one after the other into an archive; a directory of (offset, length,
checksum, doc_id, text bytes) and its place end the file. Beyond ARCHIVE bytes
or MEMBERS members a task goes on in a new archive, so no directory grows with
the input. The writer's commit lists the archives in a manifest, so files of
failed attempts are never read.

The reader plans byte ranges over the archives. A range's partition reads the
archive's directory, takes the members that start in the range, reads them in
runs and streams them as Arrow batches; a member whose bytes are short or whose
checksum is wrong is read again by its offset, alone, and after RETRIES
attempts is given with an error instead of its bytes.

Defined results: a null text is empty, and its payload is 64 zero bytes; null
doc_ids and repeated rows are members of their own; an empty table gives an
archive without members. Columns other than doc_id and text are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from isolume.llm.common import scratch_path, spread

FORMAT = "isolume_media"
WIDTH = 64
RETRIES = 3
#: Bytes and members beyond which an archive is closed.
ARCHIVE, MEMBERS = 64 << 20, 100_000
#: Bytes of a partition's range, and of members that are read and sent at once.
RANGE, RUN = 16 << 20, 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_END = struct.Struct(">QQ8s")
_MARK = b"ISOMEDIA"
MEMBER = "doc_id long, n_bytes long, archive string, offset long, media binary, error string"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
_DIRECTORY = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A grey picture 64 samples wide; every row has filter type 0."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples (rows x 64) of what encode_png makes; raises ValueError if a checksum or the shape is wrong."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a picture")
    at, data, shape = 8, b"", None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if shape is None:
        raise ValueError("the header is missing")
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "hdfs:")) else f"file://{uri}")


@dataclass
class Archives(WriterCommitMessage):
    """(file name, bytes of its members, their number) of each archive that a task has written."""

    written: list[tuple[str, int, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes archives, one after the other in each task, and a manifest of those that were committed."""

    def __init__(self, path: str, most_bytes: int = ARCHIVE, most_members: int = MEMBERS):
        self.path, self.most_bytes, self.most_members = path, most_bytes, most_members

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        members = self._members(iterator)
        written, media = [], next(members, None)
        while media is not None or not written:
            name, media, size, count = self._archive(files, root, media, members)
            written.append((name, size, count))
        return Archives(written)

    def _members(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, bytes of the text, its picture) of each row."""
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text").cast(pa.large_binary()), b""), strict=True):
                body = text.as_py()
                yield doc_id, len(body), encode_png(payload_of(body))

    def _archive(self, files: pyarrow.fs.FileSystem, root: str, member: tuple | None, members: Iterator[tuple]) -> tuple[str, tuple | None, int, int]:
        """Writes members until the archive is full; returns its name, the next member, the members' bytes and number."""
        name, at = f"{uuid.uuid4().hex}.arc", 0
        rows: dict[str, list] = {n: [] for n in _DIRECTORY.names}
        with files.open_output_stream(f"{root}/{name}") as out:
            while member is not None and at < self.most_bytes and len(rows["offset"]) < self.most_members:
                doc_id, n_bytes, media = member
                out.write(media)
                for field, value in zip(_DIRECTORY.names, (at, len(media), zlib.crc32(media), doc_id, n_bytes), strict=True):
                    rows[field].append(value)
                at += len(media)
                member = next(members, None)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DIRECTORY) as stream:
                stream.write_table(pa.table(rows, schema=_DIRECTORY))
            directory = sink.getvalue().to_pybytes()
            out.write(directory)
            out.write(_END.pack(at, len(directory), _MARK))
        return name, member, at, len(rows["offset"])

    def commit(self, messages: list[Archives | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        listed = "".join(json.dumps(x) + "\n" for m in messages if m is not None for x in m.written)
        with files.open_output_stream(f"{root}/_manifest") as out:
            out.write(listed.encode())

    def abort(self, messages: list[Archives | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name, _, _ in m.written if m is not None else ():
                files.delete_file(f"{root}/{name}")


@dataclass
class Range(InputPartition):
    name: str
    first: int
    last: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, span: int):
        self.path, self.span = path, span

    def partitions(self) -> list[Range]:
        files, root = _open(self.path)
        with files.open_input_stream(f"{root}/_manifest") as f:
            listed = [json.loads(x) for x in f.read().decode().splitlines()]
        return [Range(name, a, a + self.span) for name, size, members in listed if members for a in range(0, size, self.span)] or [Range("", 0, 0)]

    def _directory(self, files: pyarrow.fs.FileSystem, path: str) -> pa.Table:
        with files.open_input_file(path) as f:
            size = f.size()
            f.seek(size - _END.size)
            at, length, mark = _END.unpack(f.read(_END.size))
            if mark != _MARK:
                raise ValueError(f"{path} is not a whole archive")
            f.seek(at)
            return pa.ipc.open_stream(f.read(length)).read_all()

    def _again(self, files: pyarrow.fs.FileSystem, path: str, offset: int, length: int, crc: int) -> tuple[bytes | None, str | None]:
        """One member by its offset, over a new handle each time."""
        why = "wrong checksum"
        for attempt in range(RETRIES):
            try:
                with files.open_input_file(path) as f:
                    f.seek(offset)
                    body = f.read(length)
                if zlib.crc32(body) == crc:
                    return body, None
            except OSError as e:
                why = str(e)
            time.sleep(0.05 * attempt)
        return None, f"{path}@{offset}: {why}"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = _open(self.path)
        path = f"{root}/{partition.name}"
        directory = self._directory(files, path)
        at = directory.column("offset").to_numpy()
        a, b = np.searchsorted(at, [partition.first, partition.last])
        rows = directory.slice(a, b - a).to_pydict()
        count, i = int(b - a), 0
        while i < count:
            j, start = i, rows["offset"][i]
            while j < count and (j == i or rows["offset"][j] + rows["length"][j] - start <= RUN):
                j += 1
            try:
                with files.open_input_file(path) as f:
                    f.seek(start)
                    run = f.read(rows["offset"][j - 1] + rows["length"][j - 1] - start)
            except OSError:
                run = b""  # each member is tried alone
            media, errors = [], []
            for m in range(i, j):
                o, n = rows["offset"][m], rows["length"][m]
                body, error = run[o - start : o - start + n], None
                if len(body) != n or zlib.crc32(body) != rows["crc"][m]:
                    body, error = self._again(files, path, o, n, rows["crc"][m])
                media.append(body)
                errors.append(error)
            name = [partition.name] * (j - i)
            columns = [rows["doc_id"][i:j], rows["n_bytes"][i:j], name, rows["offset"][i:j], media, errors]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)
            i = j


class MediaSource(DataSource):
    """format("isolume_media"): options path, range (bytes of a partition), and archive and members (the most of an archive)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive", ARCHIVE)), int(self.options.get("members", MEMBERS)))


def describe(samples: np.ndarray) -> str:
    """Rows, mean and deviation of the samples, distinct values, and a 64-bit hash of which columns are above the mean."""
    total, n = int(samples.sum(dtype=np.int64)), samples.size
    spread = (samples.astype(np.int64) ** 2).sum() / n - (total / n) ** 2
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = int.from_bytes(np.packbits(columns * WIDTH > total).tobytes(), "big")
    return f"{samples.shape[0]}:{total / n:.4f}:{max(spread, 0.0) ** 0.5:.4f}:{len(np.unique(samples))}:{bits:016x}"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for media, error in zip(batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
            if error is not None:
                raise OSError(error)
            samples = decode_png(media)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])


def write_archives(docs: DataFrame, path: str, archive: int = ARCHIVE, members: int = MEMBERS) -> str:
    docs.sparkSession.dataSource.register(MediaSource)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows.write.format(FORMAT).option("archive", archive).option("members", members).mode("append").save(path)
    return path


def read_archives(spark, path: str, span: int = RANGE) -> DataFrame:
    """Returns doc_id, n_bytes, archive, offset, media, error of every member."""
    spark.dataSource.register(MediaSource)
    return spark.read.format(FORMAT).option("range", span).load(path)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every row's payload, reads it back and describes it; a member that can't be read fails its task."""
    path = write_archives(spread(docs), scratch_path(docs.sparkSession, "media"))
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_archives(docs.sparkSession, path).mapInArrow(_described, ddl)

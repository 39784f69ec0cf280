"""Token ids in seekable Zstandard files: independent frames, a trailing seek table, checksums.

A file is a sequence of Zstandard frames, each with ids of one document (a long document
has several), as little-endian unsigned numbers of 2 or 4 bytes.  A skippable frame with
the ids and lengths of the documents follows, and the file ends with the seek table of
the Zstandard seekable format: for each frame its compressed and raw size and the lower
32 bits of the raw data's XXH64.  Any Zstandard reader decompresses a file to its ids in
order; a reader of single documents takes the tail and then only the frames it wants,
and checks each against its checksum.

Documents are dealt to files by ranges of (id, hash of the text, row), so that the files
in order hold ascending ids and rows of one repeated id are spread.  A task writes one file beside its final name and
renames it, so a repeated task replaces a file by the same one.  The folder's manifest has a
row for each file; ids before a document are those of the files before it and those
before it in its file.

Cases: a null text counts as empty and is the end id alone; null ids come first; repeated
rows are written one by one; an empty table makes no files; very long texts are cut into
frames of a fixed number of ids; other columns are ignored.  The folder has to be
reachable from tasks as a path or a URI that pyarrow opens.
"""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import open_fs, partitions_for, text_or_empty, wide_partitions

# fixed values of the Zstandard seekable format
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SKIPPABLE_FIRST = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_HEAD = struct.Struct("<4sBBxxIQ")  # mark, version, bytes an id, ids a frame, documents
_MARK = b"TIDX"
_READ = 8 << 20

MANIFEST = "file string, part int, n_docs long, n_ids long, n_bytes long"


class Writer:
    """Adds documents to an open stream; ``close`` writes the document table and the seek table."""

    def __init__(self, stream, id_bytes: int = 4, frame_ids: int = 1 << 20, level: int = 3):
        self.stream, self.id_bytes, self.frame_ids = stream, id_bytes, frame_ids
        self.dtype = np.dtype(f"<u{id_bytes}")
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = self.n_bytes = 0

    def _frame(self, data: bytes, raw: int, checksum: int) -> None:
        self.stream.write(data)
        self.frames.append((len(data), raw, checksum))
        self.n_bytes += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.id_bytes:
            raise ValueError(f"an id does not fit into {self.id_bytes} bytes")
        ids = ids.astype(self.dtype)
        for at in range(0, len(ids), self.frame_ids):
            raw = ids[at : at + self.frame_ids].tobytes()
            self._frame(self.compressor.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)

    def close(self) -> None:
        table = b"".join(
            [
                _HEAD.pack(_MARK, 1, self.id_bytes, self.frame_ids, len(self.docs)),
                np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(),
                np.array([n for _, n in self.docs], "<i8").tobytes(),
                np.array([d is None for d, _ in self.docs], np.uint8).tobytes(),
            ]
        )
        self._frame(struct.pack("<II", SKIPPABLE_FIRST, len(table)) + table, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        seek = np.array(self.frames, "<u4").tobytes()
        end = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self._frame(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek) + len(end)) + seek + end, 0, 0)


class Reader:
    """Reads the tail of an open file, and documents by their number in the file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * n - 8
        file.seek(start)
        kind, length = struct.unpack("<II", file.read(8))
        if kind != SKIPPABLE_SEEK_TABLE or length != 12 * n + 9:
            raise ValueError("broken seek table")
        entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.raw, self.checksums = entries[:, 1], entries[:, 2]
        if self.offsets[-1] != start:
            raise ValueError("frames and seek table do not agree")
        file.seek(int(self.offsets[-2]))
        kind, length = struct.unpack("<II", file.read(8))
        table = file.read(length)
        mark, version, self.id_bytes, self.frame_ids, docs = _HEAD.unpack_from(table)
        if kind != SKIPPABLE_FIRST or mark != _MARK or version != 1:
            raise ValueError("no table of documents")
        ids, counts = (np.frombuffer(table, "<i8", docs, _HEAD.size + k * 8 * docs) for k in (0, 1))
        null = np.frombuffer(table, np.uint8, docs, _HEAD.size + 16 * docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.counts = counts
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.first_frame = np.concatenate([[0], np.cumsum(-(-counts // self.frame_ids))])
        self.decompressor = zstandard.ZstdDecompressor()

    def _ids(self, data: memoryview, base: int, doc: int) -> np.ndarray:
        parts = []
        for frame in range(int(self.first_frame[doc]), int(self.first_frame[doc + 1])):
            a, b = int(self.offsets[frame]) - base, int(self.offsets[frame + 1]) - base
            raw = self.decompressor.decompress(data[a:b], max_output_size=int(self.raw[frame]))
            if len(raw) != self.raw[frame] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[frame]:
                raise ValueError(f"frame {frame} is damaged")
            parts.append(raw)
        return np.frombuffer(b"".join(parts), f"<u{self.id_bytes}")

    def read(self, docs: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of documents by ascending number; neighbours are fetched in one piece of some megabytes."""
        at = 0
        while at < len(docs):
            stop, base = at + 1, int(self.offsets[self.first_frame[docs[at]]])
            while stop < len(docs) and docs[stop] == docs[stop - 1] + 1 and self.offsets[self.first_frame[docs[stop] + 1]] - base <= _READ:
                stop += 1
            self.file.seek(base)
            data = memoryview(self.file.read(int(self.offsets[self.first_frame[docs[stop - 1] + 1]]) - base))
            for doc in docs[at:stop]:
                yield doc, self._ids(data, base, doc)
            at = stop


def write_tokens(
    documents: DataFrame,
    folder: str,
    make_encoder: Callable[[], Callable[[str], list[int]]],
    end_id: int | None = None,
    id_bytes: int = 4,
    frame_ids: int = 1 << 20,
    file_bytes: int = 128 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes the documents' ids to files of about ``file_bytes`` of text; returns the manifest (a row for each file).

    ``make_encoder`` is called once in each task and gives a function of text to ids;
    ``end_id`` ends every document.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    files = partitions_for(docs, F.octet_length("text") + 16, file_bytes)
    order = ["doc_id", "h", "row"]
    ordered = (
        docs.withColumn("h", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    names = ["file", "part", "n_docs", "n_ids", "n_bytes"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        context = TaskContext.get()
        part = context.partitionId()
        fs, root = open_fs(f"{folder}/data")
        final = f"{root}/part-{part:06d}.zst"
        staged = f"{root}/.part-{part:06d}-{context.taskAttemptId()}"
        end = [] if end_id is None else [end_id]
        writer = stream = None
        try:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    if writer is None:
                        fs.create_dir(root)
                        stream = fs.open_output_stream(staged)
                        writer = Writer(stream, id_bytes, frame_ids)
                    writer.add(doc, np.array([*encode(text.as_py()), *end], np.uint32))
            if writer is not None:
                writer.close()
                stream.close()
                fs.move(staged, final)
        except BaseException:
            if stream is not None:
                with contextlib.suppress(OSError):
                    stream.close()
                    fs.delete_file(staged)
            raise
        if writer is not None:
            row = (f"part-{part:06d}.zst", part, len(writer.docs), writer.n_ids, writer.n_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(documents.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, part, n_docs, n_ids, n_bytes, before): the files of a folder and the ids of all files before each."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return files.withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))


def document_table(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, before, number, start, n_ids) of each document, from the tails of the files alone."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "file", "before", "number", "start", "n_ids"]

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = open_fs(f"{folder}/data/{file}")
                with fs.open_input_file(path) as f:
                    r = Reader(f)
                n = len(r.doc_ids)
                cols = [r.doc_ids, [file] * n, [before] * n, np.arange(n), r.starts[:-1] + before, r.counts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return _dealt(manifest(spark, folder).select("file", "before")).mapInArrow(
        tails, "doc_id long, file string, before long, number long, start long, n_ids long"
    )


def _dealt(files: DataFrame) -> DataFrame:
    """A few files for each task."""
    return files.repartition(wide_partitions(files.sparkSession) * 2, "file")


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of those whose id is in ``wanted`` (doc_id).

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit
    numbers.  For single documents the tails and their own frames are read, nothing else.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def rows(reader: Reader, numbers: list[int], before: int) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for k, ids in reader.read(numbers):
            out.append((reader.doc_ids[k], int(reader.starts[k]) + before, ids.astype("<u4").tobytes()))
            size += len(out[-1][2])
            if size > _READ:
                yield _batch(out, kinds)
                out, size = [], 0
        yield _batch(out, kinds)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = open_fs(f"{folder}/data/{file}")
                with fs.open_input_file(path) as f:
                    r = Reader(f)
                    yield from rows(r, list(range(len(r.doc_ids))), before)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, before, numbers = (b.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(files):
                stop = at
                while stop < len(files) and files[stop] == files[at]:
                    stop += 1
                fs, path = open_fs(f"{folder}/data/{files[at]}")
                with fs.open_input_file(path) as f:
                    yield from rows(Reader(f), numbers[at:stop], before[at])
                at = stop

    if wanted is None:
        return _dealt(manifest(spark, folder).select("file", "before")).mapInArrow(whole, "doc_id long, start long, ids binary")
    asked = document_table(spark, folder).join(wanted.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    placed = asked.select("file", "before", "number").repartition("file").sortWithinPartitions("file", "number")
    return placed.mapInArrow(some, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back."""
    return tokens.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )

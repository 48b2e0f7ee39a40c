"""Token ids in seekable files: independent zstandard frames, a document directory and a trailing seek table.

A file is a run of zstandard frames, each of whole documents (about FRAME_IDS ids, more if one document has more);
then a skippable frame with the documents' ids and numbers of tokens, itself compressed; then the seek table of the
public zstd seekable format: a skippable frame with compressed size, decompressed size and the low 32 bits of the
XXH64 of the decompressed bytes for every frame, and a footer. Any zstd tool decompresses the whole file; `read`
fetches only the frames that hold the wanted documents and checks them.

Spark sorts the documents into ranges of doc_id and each task writes the file of its range under a name of its own,
then renames it; a task that runs again writes the same bytes. The files go to the cluster's shared folder by
pyarrow's file systems, so that it may be a local, network or object store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import new_path, table, written
from vellumine.llm.tokens import encoder

FRAME_IDS = 1 << 16
ZSTD_LEVEL = 3

#: Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC, DIRECTORY_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80

#: No doc_id: how the directory marks a null.
NULL_ID = -(1 << 63)


class FileWriter:
    """Writes one file, document by document."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.in_frame: list[int] = []
        self.open: list[bytes] = []
        self.held = 0
        self.written = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.sizes.append(len(tokens) // 4)
        self.in_frame.append(len(self.frames))
        self.open.append(tokens)
        self.held += len(tokens)
        if self.held >= 4 * FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.written += len(packed)
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        columns = np.array(self.ids, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + np.array(self.in_frame, "<u4").tobytes()
        directory = struct.pack("<I", len(self.ids)) + self.packer.compress(columns)
        self.sink.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        table_ = np.array(self.frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table_)) + table_)


class FileReader:
    """Reads one file by its seek table; decompresses a frame only when one of its documents is asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file: its seek table is missing")
        self.frames = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", source.read_at(8, at))
        if magic != DIRECTORY_MAGIC:
            raise ValueError("not a token file: its directory is missing")
        directory = source.read_at(length, at + 8)
        (docs,) = struct.unpack("<I", directory[:4])
        columns = self.unpacker.decompress(directory[4:])
        self.ids = np.frombuffer(columns, "<i8", docs)
        self.sizes = np.frombuffer(columns, "<u4", docs, 8 * docs)
        self.in_frame = np.frombuffer(columns, "<u4", docs, 12 * docs)

    def frame(self, number: int) -> bytes:
        import xxhash

        packed, raw_size, check = (int(x) for x in self.frames[number])
        raw = self.unpacker.decompress(self.source.read_at(packed, int(self.starts[number])), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids as bytes) in the file's order: of all documents, or of those with a wanted doc_id."""
        some = None if wanted is None else np.isin(self.ids, np.array(sorted(wanted), "<i8"))
        for number in range(len(self.frames)):
            here = np.flatnonzero(self.in_frame == number) if some is None or len(self.frames) > 1 else np.arange(len(self.ids))
            if some is not None and not some[here].any():
                continue
            raw, at = self.frame(number), 0
            for i in here:
                end = at + 4 * int(self.sizes[i])
                if some is None or some[i]:
                    yield (None if self.ids[i] == NULL_ID else int(self.ids[i])), raw[at:end]
                at = end


MANIFEST = "part int, path string, n_docs long, n_ids long, bytes long"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes the documents (doc_id long, text string) as token files below folder, in ascending doc_id order.

    Returns one row for each file, part ascending with doc_id: part, path, n_docs, n_ids, bytes. A null text is
    empty and gives end_id alone; null doc_ids come first; rows of one doc_id are all written, ordered by their text's
    hash; other columns of docs are ignored. An empty table gives no file.
    """
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))  # the hash parts rows of one doc_id, or of none
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part = task.partitionId()
        own, final = f"{base}/.part-{part:06d}-{task.taskAttemptId()}", f"{base}/part-{part:06d}.zst"
        sink = out = None
        for batch in batches:
            if sink is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(own)
                out = FileWriter(sink)
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(tokenizer, True).encode(some.column(1).to_pylist()), strict=True):
                    out.add(doc_id, ids + end)
        if sink is not None:
            out.close()
            size = sink.tell()
            sink.close()
            store.move(own, final)
            row = {"part": [part], "path": [f"{folder}/part-{part:06d}.zst"], "n_docs": [len(out.ids)], "n_ids": [sum(out.sizes)], "bytes": [size]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())]))

    return written(ordered.mapInArrow(encode, MANIFEST), "token-files")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The documents in the files that write() returned: doc_id, start (ids of all documents before), n_tokens, ids_crc32, tokens.

    The driver adds up the files' sizes, one number for each file; a task reads each file, frame by frame.
    """
    rows, start = [], 0
    for f in files.select("part", "path", "n_ids").orderBy("part").collect():
        rows.append((f["path"], start))
        start += f["n_ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("tokens", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    held, size = [], 0
                    for doc_id, raw in FileReader(source).documents():
                        held.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), raw))
                        at += len(raw) // 4
                        size += len(raw)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    listed = spark.createDataFrame(rows, "path string, start long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, tokens binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    files = write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, new_path(spark, "tokens"))
    return read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}

"""Token-ID files: independent zstandard frames, an index of documents, and a trailing seek table with a checksum for each frame.

A file is: data frames (each decompresses alone) | skippable frame with the index of
documents | skippable frame with the seek table. The seek table is the public zstd
seekable format: for each data frame its compressed size, its raw size and the low 32
bits of the raw bytes' XXH64; then the number of frames, a descriptor and a magic number.
The raw bytes of all frames, one after the other, are the ids as little-endian unsigned
32-bit integers, document after document; the index has each document's id and token
count. So a reader of some documents decompresses only the frames that their bytes touch.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import scratch, table
from holdfast.llm.tokens import encoder, tokenizer_path
from holdfast.sources.shared import make_folder, read_json, write_json

# Fixed values of the public zstd formats.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
DOCS_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Schemes of Hadoop's file systems, and what pyarrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def worker_uri(path: str) -> str:
    """A path as pyarrow names it."""
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else path


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, on a worker: files, HDFS, S3, GCS and Azure by their URIs as Spark writes them. Files must lie in a folder that all executors see."""
    path = worker_uri(path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def write_file(path: str, docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 1) -> tuple[int, int]:
    """docs: (doc_id, ids as bytes) in the order to keep. Returns the numbers of documents and tokens."""
    where, name = open_at(path)
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    table_, ids, counts, known = [], [], [], []
    with where.open_output_stream(name) as out:
        held = bytearray()

        def flush() -> None:
            raw = bytes(held[:frame_bytes])
            del held[:frame_bytes]
            out.write(data := press.compress(raw))
            table_.append(struct.pack("<III", len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

        for doc_id, data in docs:
            known.append(doc_id is not None)
            ids.append(doc_id or 0)
            counts.append(len(data) // 4)
            held += data
            while len(held) >= frame_bytes:
                flush()
        if held:
            flush()
        index = press.compress(np.array(ids, "<i8").tobytes() + np.array(counts, "<i8").tobytes() + np.array(known, "u1").tobytes())
        out.write(struct.pack("<III", INDEX_MAGIC, len(index) + 4, len(ids)) + index)
        body = b"".join(table_) + struct.pack("<IBI", len(table_), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)
    return len(ids), sum(counts)


class TokenFile:
    """Reads one file. frames_read counts the frames decompressed."""

    def __init__(self, path: str):
        where, name = open_at(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        n, flag, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(entries[:, 1])])
        magic, length, docs = struct.unpack("<III", self.file.read_at(12, int(self.at[-1])))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path} has no index of documents")
        self.press = zstandard.ZstdDecompressor()
        index = self.press.decompress(self.file.read_at(length - 4, int(self.at[-1]) + 12), max_output_size=17 * docs)
        self.ids, self.counts = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<i8", docs, 8 * docs)
        self.known = np.frombuffer(index, "u1", docs, 16 * docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self.press.decompress(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: its checksum is wrong")
            self.frames_read += 1
            self._last = (k, raw)
        return self._last[1]

    def pieces(self, i: int) -> Iterator[bytes]:
        """The bytes of document number i, frame by frame."""
        begin, end = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        k = int(np.searchsorted(self.raw_at, begin, "right")) - 1
        while begin < end:
            raw, first = self.frame(k), int(self.raw_at[k])
            yield raw[begin - first : end - first]
            begin, k = int(self.raw_at[k + 1]), k + 1

    def tokens(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(i)), "<u4")

    def find(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the given documents; only their frames are decompressed."""
        wanted = set(doc_ids)
        return {int(d): self.tokens(i) for i, d in enumerate(self.ids) if self.known[i] and int(d) in wanted}

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Written:
    """A file of a folder, with its documents and tokens."""

    name: str
    docs: int
    tokens: int


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_bytes: int = FRAME_BYTES) -> list[Written]:
    """Write all documents, in ascending doc_id order over the files and inside each, and return the files in order; the folder's files.json lists them too.

    documents: doc_id, text; other columns are not looked at. A null text counts as empty,
    a null doc_id comes first, rows with equal doc_id are ordered by a hash of the text and
    the text (so that many of them are dealt over files), and equal rows are all written. A
    very long text may span frames. Empty tables give no file or files without documents.
    Every attempt of a task writes a file of its own name, and only those of the attempts
    that Spark took are listed. What comes to the driver is a row for each file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId(), encoder(tokenizer)
        end = struct.pack("<I", end_id)

        def docs() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    yield doc_id, own.encode(text.as_py()) + end

        name = f"{number:08d}-{uuid.uuid4().hex}.tokens"
        n, tokens = write_file(f"{folder}/{name}", docs(), frame_bytes)
        yield pa.RecordBatch.from_pydict({"name": [name], "docs": [n], "tokens": [tokens]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    files = sorted((Written(r.name, r.docs, r.tokens) for r in ordered.mapInArrow(write, "name string, docs long, tokens long").collect()), key=lambda f: f.name)
    write_json(documents.sparkSession, f"{folder}/files.json", {"files": [asdict(f) for f in files]})
    return files


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files that the folder's files.json lists: doc_id, start, n_tokens, ids_crc32. One task for each file."""
    files = [Written(**f) for f in read_json(spark, f"{folder}/files.json")["files"]]
    bases = np.concatenate([[0], np.cumsum([f.tokens for f in files])]).astype(np.int64)
    names = [f.name for f in files]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"]:
                got = TokenFile(f"{folder}/{names[k]}")
                for lo in range(0, len(got.ids), 10_000):
                    span = range(lo, min(lo + 10_000, len(got.ids)))
                    crcs = []
                    for i in span:
                        crc = 0
                        for data in got.pieces(i):
                            crc = zlib.crc32(data, crc)
                        crcs.append(crc)
                    own = slice(lo, lo + len(span))
                    ids = pd.Series(got.ids[own], dtype="Int64").mask(~got.known[own])
                    yield pd.DataFrame({"doc_id": ids, "start": got.starts[own] + bases[k], "n_tokens": got.counts[own], "ids_crc32": np.array(crcs, np.int64)})
                got.close()

    if not files:
        return spark.createDataFrame([], DOCS_SCHEMA)
    return spark.range(0, len(files), 1, len(files)).mapInPandas(read, DOCS_SCHEMA)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    make_folder(spark, folder)
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, folder)

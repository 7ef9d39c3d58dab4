"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds the ids of a run of documents, in ascending doc_id order, cut into
sequences of equal length: ids (fixed_size_list<uint16 or uint32>) and mask
(fixed_size_list<bool>, false on the padding that ends a file). Sequence r of a
mapped file is a view of its buffers, found by arithmetic. A table beside the
files, one row a document, says where each document's ids begin.
"""

from __future__ import annotations

import bisect
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.llm.common import new_path, small, staged
from cuelight.llm.tokens import BYTE_BPE, default_path, encoder, slices

SEQ_LEN = 2048
#: Sequences of a record batch.
BATCH = 256
END_ID = 0

PLACES = "doc_id long, file string, part long, at long, n_tokens long"


def file_schema(width: int, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def record_batch(ids: np.ndarray, used: int, schema: pa.Schema) -> pa.RecordBatch:
    seq_len = schema.field("ids").type.list_size
    mask = np.arange(len(ids)) < used
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)], schema=schema)


class StreamWriter:
    """Ids of any number of documents into one file; holds one batch at most."""

    def __init__(self, sink, width: int, seq_len: int = SEQ_LEN, batch: int = BATCH):
        self.schema = file_schema(width, seq_len)
        self.dtype = np.uint16 if width == 2 else np.uint32
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.seq_len = seq_len
        self.buffer = np.zeros(seq_len * batch, self.dtype)
        self.used = self.total = 0

    def add(self, ids: np.ndarray) -> int:
        """Where these ids begin in the file."""
        at = self.total
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), len(self.buffer) - self.used)
            self.buffer[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if self.used == len(self.buffer):
                self._flush()
        return at

    def _flush(self) -> None:
        rows = -(-self.used // self.seq_len)
        if rows:
            self.buffer[self.used : rows * self.seq_len] = 0
            self.out.write_batch(record_batch(self.buffer[: rows * self.seq_len].copy(), self.used, self.schema))
        self.used = 0

    def close(self) -> None:
        self._flush()
        self.out.close()


class StreamReader:
    """Access to a file's ids by place. Batches are read as they are asked for;
    of a mapped file, or one in memory, they are views of its buffers. forward:
    places only rise, and batches that were passed are let go, so no more is held
    than a batch and what one call returns."""

    def __init__(self, source, forward: bool = False):
        self.stream, self.forward = pa.ipc.open_stream(source), forward
        self.ids: list[np.ndarray] = []
        self.starts = [0]

    def _reach(self, at: int, end: int) -> None:
        while self.starts[-1] < end:
            ids = self.stream.read_next_batch().column("ids").flatten().to_numpy(zero_copy_only=True)
            self.ids.append(ids)
            self.starts.append(self.starts[-1] + len(ids))
        while self.forward and self.ids and self.starts[1] <= at:
            del self.ids[0], self.starts[0]

    def tokens(self, at: int, n: int) -> np.ndarray:
        """n ids from place `at`; a view when they lie in one batch."""
        self._reach(at, at + n)
        k = bisect.bisect_right(self.starts, at) - 1
        if at + n <= self.starts[k + 1]:
            return self.ids[k][at - self.starts[k] : at - self.starts[k] + n]
        last = bisect.bisect_left(self.starts, at + n)
        return np.concatenate([a[max(0, at - s) : max(0, at + n - s)] for a, s in zip(self.ids[k:last], self.starts[k:last])])

    def sequence(self, row: int, seq_len: int) -> np.ndarray:
        return self.tokens(row * seq_len, seq_len)


#: Names that Hadoop gives stores, and those pyarrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "file": "file"}


def open_store(uri: str):
    """File system and path of a folder that all executors share: a shared disk,
    or a store that pyarrow reaches (S3, Google's, HDFS with its native library),
    under Hadoop's name or its own. Credentials come from the environment."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    if scheme not in SCHEMES.keys() | SCHEMES.values():
        raise ValueError(f"token files can't be kept in {scheme}://; known are {', '.join(SCHEMES)}")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def opened(store, path: str):
    """A file to read: mapped where it lies on a disk, else a stream."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(path)


def _write_part(uri: str, tokenizer: str, end_id: int, width: int, seq_len: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(uri)
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrows"  # a retried task writes another file; the places name the one that counts
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        rows, writer, sink = [], None, None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = 0
            for run in slices(texts):
                for raw in enc.encode(run):
                    if writer is None:
                        sink = store.open_output_stream(f"{root}/{name}")
                        writer = StreamWriter(sink, width, seq_len)
                    tokens = np.concatenate([np.frombuffer(raw, "<u4"), end])
                    at = writer.add(tokens.astype(writer.dtype))
                    rows.append((ids[done], name, part, at, len(tokens)))
                    done += 1
        if writer is not None:
            writer.close()
            sink.close()
        enc.rest()
        for k in range(0, len(rows), 10_000):
            cols = list(zip(*rows[k : k + 10_000]))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "file", "part", "at", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN, uri: str | None = None) -> tuple[str, DataFrame]:
    """Writes the ids of every text, each ended by end_id, and returns the
    folder and the places: doc_id, file, part, at, n_tokens, start.

    Texts are ranged by doc_id, and each task encodes and writes its range, so
    only the text moves, once. start counts the ids of all documents before, from
    one sum per file. Null text: the end id alone. Rows with one doc_id follow
    each other, in the order of the scan; null doc_ids come first. Empty table: no file.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    tokenizer = tokenizer or default_path(BYTE_BPE)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    uri = uri or new_path(spark, "token-files")
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    places = staged(rows.mapInArrow(_write_part(uri, tokenizer, end_id, width, seq_len), PLACES), "places")
    files = staged(places.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n")).select(F.col("file").alias("_f"), F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "files")
    places = places.join(small(files), F.col("file") == F.col("_f")).select("doc_id", "file", "part", "at", "n_tokens", (F.col("_before") + F.col("at")).alias("start"))
    return uri, places


def read_digests(uri: str, places: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids), file,
    at, read from the files. Places of one file stand together and rise, as they
    were staged, so a task reads the files of its rows one after another, a batch
    at a time. A place that repeats or falls back opens its file anew. Texts that
    were null or empty have their end id alone; no places: no rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(uri)
        name, reader, last = None, None, 0
        for batch in batches:
            crcs = []
            for file, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist()):
                if file != name or at < last:
                    name = file
                    reader = StreamReader(opened(store, f"{root}/{file}"), forward=True)
                last = at
                crcs.append(zlib.crc32(reader.tokens(at, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crcs, pa.int64())] + [batch.column(c) for c in ("file", "at")], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "at"])

    return places.select("doc_id", "start", "n_tokens", "file", "at").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, at long")


def encode_to_bytes(ids: np.ndarray, width: int = 4, seq_len: int = SEQ_LEN) -> bytes:
    """A whole file in memory, for tests and small exports."""
    sink = io.BytesIO()
    writer = StreamWriter(sink, width, seq_len)
    writer.add(ids)
    writer.close()
    return sink.getvalue()

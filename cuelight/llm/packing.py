"""Packing by powers of two.

A document of n ids is cut into pieces of the capacity and then, for what is
left, into pieces whose lengths are the binary digits of that number, longest
first. Every piece is a sequence of its own: none crosses documents and none
needs padding. Sequences are numbered by length, so that equal lengths form a
bucket of neighbours from which batches of one shape are taken; numbers follow
from counts, so the ids themselves are written once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.llm.common import small, staged
from cuelight.llm.tokens import WORD_BPE, default_path, encoder, slices

CAPACITY = 4096
END_ID = 2

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, place long"


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids, in order; capacity is a power of two."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian 32-bit),
    doc_tokens, part (its task) and place (among its task's of that length).
    Texts are encoded where they are read; nothing is shuffled.

    Null and empty texts: the end id alone, one piece of length 1. Repeated rows
    are documents of their own. Empty table: no rows. Other columns of docs are
    not read.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    tokenizer = tokenizer or default_path(WORD_BPE)
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        places = dict.fromkeys((1 << b for b in range(capacity.bit_length())), 0)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = 0
            for run in slices(texts):
                cols: list[list] = [[] for _ in names]
                for raw in enc.encode(run):
                    raw += end
                    n, start = len(raw) // 4, 0
                    for length in piece_lengths(n, capacity):
                        for c, v in zip(cols, (ids[done], start, length, raw[start * 4 : (start + length) * 4], n, part, places[length])):
                            c.append(v)
                        start += length
                        places[length] += 1
                    done += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        enc.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def with_sequences(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id, gapless from 0, longest sequences first, and offset, 0,
    as each piece fills a sequence. pieces: staged, with part and place.

    Ids are not moved: a piece's number is what shorter parts of the table hold
    before it, its length's base plus the counts of earlier parts, plus its own
    place among those of its length in its part."""
    counts = pieces.groupBy("length", "part").agg((F.max("place") + 1).alias("_n"))
    counts = staged(counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "piece-counts")
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_all"))
    # a row a length: log2 of the capacity at most
    bases = totals.withColumn("_base", F.coalesce(F.sum("_all").over(W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    shift = counts.join(F.broadcast(bases), "length").select(F.col("length").alias("_l"), F.col("part").alias("_p"), (F.col("_base") + F.col("_before")).alias("_shift"))
    rows = pieces.join(small(staged(shift, "piece-shifts")), (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p")))
    return rows.withColumns({"sequence_id": F.col("_shift") + F.col("place"), "offset": F.lit(0).cast("long")}).drop("_l", "_p", "_shift", "part", "place")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """What a trainer reads, a row a sequence: doc_id, start, length, ids (bytes
    of little-endian 32-bit integers), doc_tokens, sequence_id, offset.

    Nulls, empty texts, repeated rows and empty tables as for pieces(). Reruns
    number the sequences of one length alike as long as the table's splits are
    the same; their contents always agree.
    """
    return with_sequences(staged(pieces(docs, tokenizer, end_id, capacity), "pieces"))


def packed_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """pack() with the ids replaced by their crc32, before rows are staged; takes
    nulls, empty texts, repeated rows and empty tables as pack() does."""
    rows = staged(pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return with_sequences(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks, in the precision they come in. A strip of query
blocks meets a shard of candidate blocks in one task, which makes int8 codes of
both: their product gives every inner product of the tile within a bound that
follows from the parts the codes leave out. Pairs whose upper bound falls short
of the query's k-th lower bound are done with; the others are computed in double
precision. Vectors travel with their block, not joined to survivors afterwards:
of many equal or nearly equal vectors all survive, and only in the tile can all
but k of them be dropped at once. The best of each tile are merged by heaps, shard
by shard and then in rounds of a bounded number of shards, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import staged

#: Rows of a block; blocks of a side of a tile; shards merged at once; queries of a merge.
BLOCK = 1024
SIDE_BLOCKS = 8
FAN_IN = 64
MERGE_QUERIES = 64
#: Surviving pairs that are computed at once.
PAIRS = 1 << 16
#: Dimensions whose int8 products a float32 sums without rounding: 1024 * 127 * 127 < 2 ** 24.
EXACT_DIMS = 1024

BLOCKS = "block long, dim int, ids binary, vectors binary"


def quantize(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes of the rows of x, their scale, and the norms of what the codes
    stand for and of what they leave out."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, by float32 matrix products."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T
    return out


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, added in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


class Block:
    def __init__(self, row):
        self.block, self.ids = int(row.block), np.frombuffer(row.ids, np.int64)
        width = len(row.vectors) // (len(self.ids) * int(row.dim))
        self.vectors = np.frombuffer(row.vectors, np.float32 if width == 4 else np.float64).reshape(len(self.ids), -1).astype(np.float64)
        self.codes, self.scale, self.norm, self.lost = quantize(self.vectors)


def _pack(id_col: str):
    """Blocks of the valid rows of a partition, by dimension, as they are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 40
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal at
            rows = held.pop(dim)
            parts = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows])
            at += 1
            return pa.record_batch([pa.array([at - 1], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for i, v in zip(batch.column(id_col).to_pylist(), batch.column("vector")):
                x = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == BLOCK:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return pack


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _tile(k: int):
    """The k best candidates of a shard for every query of a strip."""

    def search(key, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        cols: list[list] = [[], [], [], [], []]
        shard = key[1] if len(key) > 1 else 0
        strip = [(q, [[] for _ in q.ids]) for q in map(Block, queries.itertuples())]  # heaps of (score, -id), the worst of the k best first
        for c in map(Block, blocks.itertuples()):
            for q, heaps in strip:
                about = code_products(q.codes, c.codes) * q.scale[:, None] * c.scale[None, :]
                size_q, size_c = q.norm + q.lost, c.norm + c.lost
                bound = q.norm[:, None] * c.lost[None, :] + q.lost[:, None] * size_c[None, :] + 1e-12 * size_q[:, None] * size_c[None, :]
                own = q.ids[:, None] == c.ids[None, :]
                low = np.where(own, -np.inf, about - bound)
                need = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q.ids), -np.inf)
                held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                qi, ci = np.nonzero((about + bound >= np.maximum(need, held)[:, None]) & ~own)
                score = np.concatenate([inner_products(q.vectors[qi[at : at + PAIRS]], c.vectors[ci[at : at + PAIRS]]) for at in range(0, len(qi), PAIRS)] or [np.zeros(0)])
                for i, s, d in zip(qi.tolist(), score.tolist(), c.ids[ci].tolist()):
                    h = heaps[i]
                    if len(h) < k:
                        heapq.heappush(h, (s, -d))
                    elif (s, -d) > h[0]:
                        heapq.heapreplace(h, (s, -d))
        for q, heaps in strip:
            for place, (i, h) in enumerate(zip(q.ids.tolist(), heaps)):
                for s, d in h:
                    for col, v in zip(cols, ((q.block << 11) + place, i, shard, -d, s)):
                        col.append(v)
        return pd.DataFrame(dict(zip(("row", "query_id", "shard", "vec_id", "score"), cols))).astype({"row": "int64", "query_id": "int64", "shard": "int64", "vec_id": "int64", "score": "float64"})

    return search


def _merge(k: int):
    """The k best of each query's runs, one run a shard, by a heap over the runs."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "shard", "score", "vec_id"], ascending=[True, True, False, True])
        out = []
        for (row, query), of_query in pdf.groupby(["row", "query_id"], sort=False):
            runs = [list(zip((-run["score"]).tolist(), run["vec_id"].tolist())) for _, run in of_query.groupby("shard", sort=False)]
            for rank, (s, d) in enumerate(heapq.merge(*runs)):
                if rank == k:
                    break
                out.append((row, query, int(of_query["shard"].iat[0]) // FAN_IN, rank + 1, d, -s))
        return pd.DataFrame(out, columns=["row", "query_id", "shard", "rank", "vec_id", "score"]).astype({"row": "int64", "query_id": "int64", "shard": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    return merge


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of
    each query with the vectors of other ids, ties to the smaller vec_id.

    Vectors that are null, zero, or hold a null or non-finite component, and
    rows without an id, take no part. Vectors of another length than the query's
    have no product with it. Repeated rows each stand for themselves, as query
    and as candidate; rows of the query's own id are never its neighbours. Fewer
    than k candidates: all. Empty tables: no rows. Other columns are not read.

    Candidates are packed where they are read. The number of shards and strips
    follows from row counts; a strip meets a shard in one task, whose memory is
    bounded by their sizes, and no task sees the candidates of a whole query.
    """
    cand, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    n_asked = asked.count()
    shards = max(1, -(-cand.count() // (BLOCK * SIDE_BLOCKS)))
    strips = max(1, -(-n_asked // (BLOCK * SIDE_BLOCKS)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    c = cand.mapInArrow(_pack("id"), BLOCKS).withColumn("shard", group(shards)).withColumn("strip", F.explode(upto(strips)))
    q = asked.mapInArrow(_pack("id"), BLOCKS).withColumn("strip", group(strips)).withColumn("shard", F.explode(upto(shards)))
    by = ["strip", "shard", "dim"]
    best = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_tile(k), "row long, query_id long, shard long, vec_id long, score double")
    merges = max(1, -(-n_asked // MERGE_QUERIES))
    while True:
        best = best.withColumn("_to", F.floor(F.col("shard") / FAN_IN)).withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(merges)))
        best = best.groupBy("_to", "_part").applyInPandas(_merge(k), "row long, query_id long, shard long, rank int, vec_id long, score double")
        shards = -(-shards // FAN_IN)
        if shards == 1:
            return best.select("query_id", "rank", "vec_id", "score")
        best = staged(best, "merged")


def oracle(k: int = 20, every: int = 20) -> str:
    return f"""
with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e) score from v q join v c on q.vec_id % {every} = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= {k}"""

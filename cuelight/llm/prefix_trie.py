"""Conversations as a trie of their beginnings.

A node is a distinct sequence of first turns; its key is the xor of a digest of
each turn with its place, so the keys of all beginnings of a conversation are
running xors, however long it is. What a node's subtree holds is summed by
pointer jumping: in round k every node adds what lies less than 2**k below it to
its ancestor 2**k above, and the pointers double. Rounds are the logarithm of the
depth, and a round reads only nodes that have such an ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.llm.common import crc32_sql, numbered, scratch, small, staged

#: Conversations whose ids differ below FAMILY share a root conversation, of which each takes fewer than HEADS turns.
FAMILY, HEADS = 100, 6
#: Turns of one conversation that are digested in a row; longer ones are digested in chunks.
CHUNK = 1024
#: Characters of ids that are hashed at once.
IDS = 1 << 20


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, nulls first, then role, then text), digest
    (of role and text) and chars. Rows without a conv_id are of no conversation."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turn = F.col("turn").asc_nulls_first()
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit("|"), "text"), 256)
    # texts are compared in the sort, and only their beginnings in the ranges
    return numbered(rows, ["conv_id"], [turn, F.col("role"), F.left("text", F.lit(32))], "pos", [turn, F.col("role"), F.col("text")], ["conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars")])


def rebuilt(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, size; their turns: conv_id, pos, digest, chars),
    each with the first h turns of its family's root in place of its own."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    lengths = of.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = of.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1))
    roots = heads.groupBy(F.col("conv_id").alias("root")).agg(F.count(F.lit(1)).alias("there"))
    convs = lengths.withColumns({"h": h, "root": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(roots, "root", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv_id", "root", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("size")), "convs")
    own = of.join(convs, "conv_id").where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    # a root's few first turns go to at most two families of ids
    lent = convs.select("conv_id", "root", "taken").join(heads.select(F.col("conv_id").alias("root"), "pos", "digest", "chars"), "root").where(F.col("pos") < F.col("taken")).select("conv_id", "pos", "digest", "chars")
    return convs.select("conv_id", "size"), own.unionByName(lent)


def lane(text: Column, k: int) -> Column:
    """60 bits of a hex digest as a long."""
    return F.conv(F.substring(text, 15 * k + 1, 15), 16, 10).cast("long")


def beginnings(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the key of the first `depth` turns), pa, pb (the key
    of all but the last of these) and chars of the last. Runs of CHUNK turns are
    digested apart and shifted by the runs before them, so no conversation is
    one task's."""
    placed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "digest"), 256)
    rows = rows.withColumn("_d", placed).select("conv_id", "pos", "chars", F.floor(F.col("pos") / CHUNK).alias("run"), lane(F.col("_d"), 0).alias("za"), lane(F.col("_d"), 1).alias("zb"))
    run = W.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = staged(rows.withColumns({"a": F.bit_xor("za").over(run), "b": F.bit_xor("zb").over(run)}), "beginnings")
    runs = rows.groupBy("conv_id", "run").agg(F.bit_xor("za").alias("xa"), F.bit_xor("zb").alias("xb"))
    before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    shift = runs.select("conv_id", "run", F.bit_xor("xa").over(before).alias("xa"), F.bit_xor("xb").over(before).alias("xb")).where("run > 0")
    rows = rows.join(small(staged(shift, "runs")), ["conv_id", "run"], "left")
    a, b = F.col("a").bitwiseXOR(F.coalesce("xa", F.lit(0))), F.col("b").bitwiseXOR(F.coalesce("xb", F.lit(0)))
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("za")).alias("pa"), b.bitwiseXOR(F.col("zb")).alias("pb"), "chars")


def ends_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the sha-256 of a node's conv_ids in order, joined by
    commas. ends: a, b, conv_id. Ids are dealt by ranges, so that many of one
    node are joined in many tasks; their pieces, a few for each task, are hashed
    one after another, and nothing of a node is held but one piece."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, chars = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (a, b) != key or chars > IDS:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, chars = (a, b), c, [], 0
                ids.append(str(c))
                chars += len(ids[-1]) + 1
            if out:
                yield _batch(out, ("a", "b", "first", "ids"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))
                out = []
        if ids:
            yield _batch([(*key, first, ",".join(ids))], ("a", "b", "first", "ids"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        out: list[tuple] = []
        names, kinds = ("a", "b", "ends_sha256"), (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield _batch(out, names, kinds)
                out = []
        if key:
            yield _batch([(*key, digest.hexdigest())], names, kinds)

    order = ["a", "b", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "a long, b long, first long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """a, b and, for each node that has descendants, the sums of their values.
    nodes: a, b, depth, pa, pb (pointer to the parent) and values.

    A round hands each node's sum of what lies less than `reach` below it (itself
    included) to the ancestor `reach` above, whose reach so doubles."""
    live = staged(nodes.where("depth > 0").select("a", "b", "depth", "pa", "pb", *values), "jump")
    deepest = live.agg(F.max("depth")).first()[0] or 0
    got, reach = [], 1
    while reach <= deepest:
        gained = live.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*[F.sum(v).alias(v) for v in values])
        gained = staged(gained, "gained")
        got.append(gained)
        if 2 * reach > deepest:
            break
        above = live.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("_ua"), F.col("pb").alias("_ub"))
        more = gained.select("a", "b", *[F.col(v).alias(f"_{v}") for v in values])
        rows = live.where(F.col("depth") >= 2 * reach).join(small(more), ["a", "b"], "left").join(above, ["pa", "pb"])
        live = staged(rows.select("a", "b", "depth", F.col("_ua").alias("pa"), F.col("_ub").alias("pb"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "jump")
        reach *= 2
    if not got:
        return live.select("a", "b", *values).limit(0)
    out = got[0]
    for more in got[1:]:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(*[F.sum(v).alias(v) for v in values])


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id take no part; null roles and texts are empty ones; turns
    of one number come by role, then by text, and repeated rows are turns of
    their own. Very long texts count whole. An empty table has no node, not even
    the root. Other columns aren't read.
    """
    with scratch() as keep:
        convs, rows = rebuilt(turns(conversations))
        convs = convs.select("conv_id", F.col("size").alias("depth"))
        rows = beginnings(rows).select("conv_id", "depth", "a", "b", "pa", "pb", "chars")
        root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b")], *[F.lit(None).cast("long").alias(c) for c in ("pa", "pb")], F.lit(0).cast("long").alias("chars"))
        rows = staged(rows.unionByName(root), "prefixes")
        nodes = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "pa", "pb", "chars")])
        nodes = staged(nodes, "nodes")
        kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        nodes = staged(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
        ends = ends_digests(rows.join(convs, ["conv_id", "depth"], "left_semi"))
        below = subtree_sums(nodes, ["leaves", "saved"])
        none = F.lit(None)
        beside = below.select("a", "b", F.col("leaves").alias("_l"), F.col("saved").alias("_s"), none.cast("string").alias("_e")).unionByName(ends.select("a", "b", none.cast("long").alias("_l"), none.cast("long").alias("_s"), F.col("ends_sha256").alias("_e")))
        beside = beside.groupBy("a", "b").agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"), F.max("_e").alias("_e"))
        parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(beside, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
        zero = F.lit(0).cast("long")
        return keep(staged(out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("_l", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("_s", zero)).alias("saved_tokens"),
            F.coalesce("_e", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie"))


def oracle() -> str:
    """Every beginning of every conversation as a digest of its own, and every pair of a node and an ancestor."""
    return f"""
with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos from conversations where conv_id is not null),
z as (select conv_id, pos, md5(length(r) || ':' || r || '|' || x) m, length(x) chars from t),
c as (select conv_id, conv_id - conv_id % {FAMILY} as root, h from (select conv_id, {crc32_sql('conv_id::varchar')} % {HEADS} h from (select distinct conv_id from t))),
n as (select root, count(*) there from (select conv_id root from z where conv_id % {FAMILY} = 0) group by root),
k as (select c.conv_id, c.root, h, least(h, coalesce(there, 0)) taken from c left join n using (root)),
s as (select k.conv_id, z.pos - h + taken pos, m, chars from k join z on z.conv_id = k.conv_id and z.pos >= h
  union all select k.conv_id, z.pos, m, chars from k join z on z.conv_id = k.root and z.pos < taken),
p as (select conv_id, pos + 1 depth, md5(string_agg(m, ',') over w) id, coalesce(md5(string_agg(m, ',') over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding)), '') up, chars from s window w as (partition by conv_id order by pos)),
a as (select conv_id, depth::bigint depth, id, up, chars from p union all select conv_id, 0, '', null, 0 from k),
e as (select conv_id, max(depth) depth from a group by conv_id),
nodes as (select id, min(conv_id) conv_id, count(*) n_convs, any_value(depth) depth, any_value(up) up, any_value(chars) chars from a group by id),
ends as (select id, sha256(string_agg(a.conv_id::varchar, ',' order by a.conv_id)) s from a join e using (conv_id, depth) group by id),
kids as (select up id, count(*) n from nodes where up is not null group by up),
val as (select nodes.*, coalesce(kids.n, 0) n_children, (n_convs - 1) * chars saved from nodes left join kids using (id)),
sums as (select a.id, count(*) filter (val.n_children = 0) leaves, sum(val.saved)::bigint saved from val join a on a.conv_id = val.conv_id and a.depth <= val.depth group by a.id)
select val.conv_id, val.depth, par.conv_id parent_conv_id, val.n_convs, val.n_children, sums.leaves n_leaves, sums.saved saved_tokens, coalesce(ends.s, sha256('')) ends_sha256
from val join sums using (id) left join ends using (id) left join nodes par on par.id = val.up"""

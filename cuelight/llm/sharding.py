"""Sharding over fixed virtual slots.

Every record hashes to one of SLOTS virtual slots, for good. The bytes of each
slot are summed, and a versioned slot-to-shard map, a small table, is made from
them: heaviest slot first, each to the lightest shard. A later call goes on from
a kept version: it moves the few slots that are out of balance, splits slots that
became heavy, and writes the next version; records never hash anew.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import new_path, numbered, small, staged

#: Virtual slots, thousands of times a shard's fair share is split into.
SLOTS = 16384
#: A slot heavier than this part of a shard's fair share is split into sub-slots.
HEAVY = 1 / 8

MAP_SCHEMA = "version int, slot int, sub int, subs int, bytes long, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8; a null text has none), text_crc32, the
    virtual slot of the record, and its place in the scan, which only breaks
    ties. A null doc_id hashes like any other value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("_row"))


def slot_bytes(recs: DataFrame) -> list[tuple[int, int]]:
    """(slot, bytes), at most SLOTS of them: a fixed bound whatever the input."""
    return [(r[0], r[1]) for r in recs.groupBy("virtual_slot").agg(F.sum("size")).orderBy("virtual_slot").collect()]


def sub_slots(loads: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Slots that one key or document fills beyond a part of a shard's fair
    share, and into how many sub-slots their rows go: shards / HEAVY at most."""
    part = max(1.0, HEAVY * sum(b for _, b in loads) / shards)
    return {slot: -int(-b // part) for slot, b in loads if b > part}


def with_sub_slots(recs: DataFrame, subs: dict[int, int]) -> DataFrame:
    """Adds sub_slot, by a hash of the record, so other splits of the table deal
    records alike. Only rows that nothing tells apart go by their place: which of
    them lies where makes no difference."""
    if not subs:
        return recs.withColumn("sub_slot", F.lit(0))
    n = F.lit(1)
    for slot, count in sorted(subs.items()):
        n = F.when(F.col("virtual_slot") == slot, count).otherwise(n)
    same = recs.where(F.col("virtual_slot").isin(*subs)).groupBy(F.col("doc_id").alias("_d"), F.col("text_crc32").alias("_t"), F.col("size").alias("_s")).count().where("count > 1").drop("count")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_crc32") == F.col("_t")) & (F.col("size") == F.col("_s"))
    rows = recs.join(small(staged(same, "same-records")), on, "left")
    which = F.when(F.col("_t").isNull(), F.xxhash64("doc_id", "text_crc32", "size")).otherwise(F.xxhash64("_row"))
    return rows.withColumn("sub_slot", F.pmod(which, n).cast("int")).drop("_d", "_t", "_s")


def sub_slot_bytes(recs: DataFrame) -> dict[tuple[int, int], int]:
    """Bytes by (slot, sub-slot): SLOTS + shards / HEAVY entries at most."""
    return {(r[0], r[1]): r[2] for r in recs.groupBy("virtual_slot", "sub_slot").agg(F.sum("size")).collect()}


def plan_map(loads: dict[tuple[int, int], int], subs: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple]:
    """Version 1 of the map: heaviest entry first, each to the lightest shard."""
    items = [(loads.get((slot, sub), 0), slot, sub, subs.get(slot, 1)) for slot in range(slots) for sub in range(subs.get(slot, 1))]
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, slot, sub, n in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        out.append((1, slot, sub, n, size, shard))
    return out


def rebalance(current: list[tuple], loads: dict[tuple[int, int], int], shards: int, slack: float = 0.01) -> list[tuple]:
    """The next version of the map after loads or the number of shards changed:
    entries move one by one from the heaviest to the lightest shard until none
    is over its fair share by more than slack; all other entries stay."""
    rows = [[v, s, sub, subs, loads.get((s, sub), 0), sh] for v, s, sub, subs, _, sh in current]
    own = {s: [] for s in range(shards)}
    load = dict.fromkeys(own, 0)
    homeless = []
    for r in rows:
        r[0] += 1
        if r[5] in own:
            own[r[5]].append(r)
            load[r[5]] += r[4]
        else:
            homeless.append(r)
    for r in sorted(homeless, key=lambda r: (-r[4], r[1], r[2])):
        r[5] = min(load, key=lambda s: (load[s], s))
        own[r[5]].append(r)
        load[r[5]] += r[4]
    fair = sum(load.values()) / shards
    while True:
        top = max(load, key=lambda s: (load[s], -s))
        low = min(load, key=lambda s: (load[s], s))
        room = min(load[top] - fair, fair - load[low])
        fit = [r for r in own[top] if 0 < r[4] <= max(room, 0)]
        if load[top] <= fair * (1 + slack) or not fit:
            return [tuple(r) for r in rows]
        r = max(fit, key=lambda r: (r[4], -r[1], -r[2]))
        own[top].remove(r)
        own[low].append(r)
        load[top] -= r[4]
        load[low] += r[4]
        r[5] = low


def split(current: list[tuple], subs: dict[int, int]) -> list[tuple]:
    """The map with slots in more sub-slots where subs has more; new ones have no
    shard (-1) yet, which rebalance gives them. Only a split slot's records move."""
    known = {slot: n for _, slot, _, n, _, _ in current}
    out = [(v, slot, sub, max(n, subs.get(slot, 1)), b, sh) for v, slot, sub, n, b, sh in current]
    return out + [(current[0][0], slot, sub, subs[slot], 0, -1) for slot in sorted(subs) for sub in range(known[slot], subs[slot])]


def versions(spark, path: str) -> list[int]:
    """Versions of the map that are kept under path and were written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
    whole = lambda x: store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))
    return sorted(int(x.removeprefix("version=")) for x in found if x.startswith("version=") and whole(x))


def store_map(spark, rows: list[tuple], path: str | None = None) -> str:
    """Adds one version to the map's table in the shared folder; its path. What a
    lost driver left of that version, which isn't whole, is written over."""
    path = path or new_path(spark, "slot-map")
    table = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    table.drop("version").write.mode("overwrite").parquet(f"{path}/version={rows[0][0]}")
    return path


def load_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Each row's shard under the `bytes` law: sizes near equal.

    Columns doc_id, size, text_crc32, law, shard, slot (the row's place in its
    shard, gapless from 0, by virtual slot and doc_id), grown_shard (null under
    this law), virtual_slot, sub_slot, map_version.

    map_path: the folder that keeps the map's versions; without it the map lives
    as long as the session. A call goes on from `version`, the newest one by
    default, and writes the next if any entry changes: for other shards, bytes
    that grew, or slots that became heavy.

    Null text: 8 bytes, crc32 0. Null doc_id: one virtual slot, split when
    heavy. Equal doc_ids share a virtual slot, and the records of a heavy one are
    dealt over its sub-slots. Equal texts of different doc_ids are records of
    their own and may lie in different shards. Empty table: no rows. Other
    columns of docs are not read.
    """
    spark = docs.sparkSession
    recs = staged(records(docs, slots), "records")
    subs = sub_slots(slot_bytes(recs), shards)
    kept = versions(spark, map_path) if map_path else []
    if version is not None and version not in kept:
        raise ValueError(f"no version {version} of the slot map under {map_path}")
    if kept:
        # at most slots + shards / HEAVY rows
        old = [tuple(r) for r in load_map(spark, map_path, kept[-1] if version is None else version).select(*(f.split()[0] for f in MAP_SCHEMA.split(", "))).orderBy("slot", "sub").collect()]
        if len({slot for _, slot, *_ in old}) != slots:
            raise ValueError("the kept map has another number of virtual slots")
        before = split(old, subs)
        subs = {slot: n for _, slot, _, n, _, _ in before if n > 1}
    recs = with_sub_slots(recs, subs)
    loads = sub_slot_bytes(recs)
    if kept:
        rows = [(kept[-1] + 1, *r[1:]) for r in rebalance(before, loads, shards)]
        changed = [r[1:4] + r[5:] for r in rows] != [r[1:4] + r[5:] for r in old]
        rows, path = (rows, store_map(spark, rows, map_path)) if changed else (old, map_path)
    else:
        rows = plan_map(loads, subs, shards, slots)
        path = store_map(spark, rows, map_path)
    table = load_map(spark, path, rows[0][0])
    # the map has at most slots + shards / HEAVY rows
    placed = recs.join(F.broadcast(table.select(F.col("slot").alias("virtual_slot"), F.col("sub").alias("sub_slot"), "shard")), ["virtual_slot", "sub_slot"])
    out = numbered(placed, ["shard"], ["virtual_slot", "doc_id", "text_crc32", "_row"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "sub_slot", F.lit(rows[0][0]).alias("map_version"))

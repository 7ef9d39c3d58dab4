"""Joins by time: the last row before a time, and intervals that overlap.

Neither gathers a key's rows in one task: time is cut into ranges, and what a
range needs of others is brought to it, a row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of a range.
DAY = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str], range_us: int = DAY) -> DataFrame:
    """left with `columns` of the last row of right of the same key at or before
    its time; of rows at one time the greatest by `columns`. Nulls where there is
    none, and for null keys and times.

    Both sides share one exchange by key and range of time. Inside a range the
    last value is carried along; where a range has none yet, the last of the
    ranges before is joined, which is a row for each key and range."""
    own = [c for c in left.columns]
    us = lambda df: F.unix_micros(df[at].cast("timestamp"))
    ls = left.select(F.struct(*[left[c] for c in own]).alias("_row"), left[key].alias("_k"), us(left).alias("_t"), F.lit(1).alias("_side"))
    rs = right.where(right[key].isNotNull() & right[at].isNotNull()).select(right[key].alias("_k"), us(right).alias("_t"), F.lit(0).alias("_side"), F.struct(*[right[c].alias(f"_{k}") for k, c in enumerate(columns)]).alias("_v"))
    rs = rs.groupBy("_k", "_t", "_side").agg(F.max("_v").alias("_v"))
    rows = ls.unionByName(rs, allowMissingColumns=True).withColumn("_range", F.floor(F.col("_t") / range_us))
    inside = W.partitionBy("_k", "_range").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    ends = rs.withColumn("_range", F.floor(F.col("_t") / range_us)).groupBy("_k", "_range").agg(F.max_by("_v", "_t").alias("_end"))
    # a range may have rows of left only: each range's own end, and the ranges that ask
    asks = ls.where("_k is not null and _t is not null").select("_k", F.floor(F.col("_t") / range_us).alias("_range")).distinct()
    steps = asks.unionByName(ends.select("_k", "_range")).distinct().join(ends, ["_k", "_range"], "left")
    before = W.partitionBy("_k").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).where("_carry is not null").select("_k", "_range", "_carry")
    out = found.join(carried, ["_k", "_range"], "left").withColumn("_got", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_last", "_carry")))
    return out.select(*[F.col("_row")[c].alias(c) for c in own], *[F.col("_got")[f"_{k}"].alias(c) for k, c in enumerate(columns)])


def overlapping(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose half-open spans overlap, as structs l and r;
    each pair once. Spans are whole numbers; empty and null ones overlap nothing.

    A span lies in two cells at most of a grid as wide as itself. It is put there,
    and looked up in the coarser grids that any span has, so pairs of any lengths
    meet without a span being spelled out cell by cell. Of the cells that two
    spans share, the one with the later start reports them."""

    def gridded(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        a, b = df[span[0]].cast("long"), df[span[1]].cast("long")
        rows = df.where(df[key].isNotNull() & (a < b)).select(df[key].alias("_k"), F.struct(*[df[c] for c in df.columns]).alias(name), a.alias(f"{name}_a"), b.alias(f"{name}_b"))
        return rows.withColumn(f"{name}_size", F.length(F.bin(F.col(f"{name}_b") - F.col(f"{name}_a") - 1)))

    ls, rs = gridded(left, left_span, "l"), gridded(right, right_span, "r")
    sizes = ls.select(F.col("l_size").alias("_size")).union(rs.select(F.col("r_size").alias("_size"))).agg(F.sort_array(F.collect_set("_size")).alias("_grids"))  # 63 at most

    def cells(rows: DataFrame, name: str) -> DataFrame:
        a, b, size = F.col(f"{name}_a"), F.col(f"{name}_b"), F.col(f"{name}_size")
        rows = rows.join(F.broadcast(sizes)).withColumn("_grid", F.explode(F.filter("_grids", lambda g: g >= size))).drop("_grids")  # one row of grids
        wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_grid"))
        return rows.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(a / wide), F.floor((b - 1) / wide)))))

    both = cells(ls, "l").join(cells(rs, "r"), ["_k", "_grid", "_cell"])
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_grid"))
    tests: list[Column] = [F.col("l_a") < F.col("r_b"), F.col("r_a") < F.col("l_b"), F.col("_grid") == F.greatest("l_size", "r_size"), F.col("_cell") == F.floor(F.greatest("l_a", "r_a") / wide)]
    return both.where(reduce(lambda x, y: x & y, tests)).select("l", "r")

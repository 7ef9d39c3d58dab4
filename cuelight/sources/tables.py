"""Tables of jobs and cues: schema probes, point lookups, latest-wins upserts, appends."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    pass


class NotOneRow(LookupError):
    pass


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def scan(df: DataFrame, order: str | None = None, columns: list[str] | None = None, **equal) -> DataFrame:
    """Rows whose columns have the given values, projected and ordered."""
    for name, value in equal.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    df = df.select(*columns) if columns else df
    return df.orderBy(F.col(order).asc_nulls_last()) if order else df


def single(df: DataFrame, **equal) -> DataFrame:
    """The one row with these values; an error when there is none, or several."""
    found = scan(df, **equal)
    if len(found.take(2)) != 1:
        raise NotOneRow(f"not one row with {equal}")
    return found


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """current with the rows of updates: for each key the row of the highest
    version wins, an update over a current row of the same version."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("_new"), *[F.col(c).desc_nulls_last() for c in current.columns if c not in keys and c != version])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def apply_changes(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], version: str | None = None, nulls: bool = False) -> DataFrame:
    """Partial updates, a row in and a row out. Of several changes of one key the
    later version counts, for each column on its own, as if they had been made one
    after another; without a version, or at equal ones, the greater value. A null
    leaves a column as it is, or, with `nulls`, is what the last change sets."""
    at = F.col(version) if version else F.lit(0)
    last = lambda x: F.max_by(F.col(x), F.struct(at, F.col(x))) if nulls else F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.struct(at, F.col(x))))
    c = changes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[last(x).alias(f"_c_{x}") for x in columns]).withColumn("_changed", F.lit(True))
    on = [rows[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond: Column = on[0]
    for o in on[1:]:
        cond = cond & o
    out = rows.join(c, cond, "left")
    new = lambda x: F.when(F.col("_changed"), F.col(f"_c_{x}")).otherwise(rows[x]) if nulls else F.coalesce(F.col(f"_c_{x}"), rows[x])
    return out.select(*[new(x).alias(x) if x in columns else rows[x] for x in rows.columns])


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def append_events(events: DataFrame, path: str, fatal: bool = False) -> bool:
    """Adds to the event log, never rewriting it. A log that can't be written is
    no reason to stop, so errors are warned of unless they are to be fatal."""
    try:
        events.write.mode("append").parquet(path)
    except Exception as e:
        if fatal:
            raise
        warnings.warn(f"event log not written: {e}", stacklevel=2)
        return False
    return True


def persisted(batch: DataFrame, write: Callable[[DataFrame], None], each: Callable[[Row], None]) -> bool:
    """Writes a batch at once; where that fails, row by row, on the executors.
    Was it written at once? For foreachBatch, whose batches are small."""
    try:
        write(batch)
        return True
    except Exception as e:
        warnings.warn(f"batch not written, now row by row: {e}", stacklevel=2)
    batch.foreach(each)
    return False


def batches(rows: DataFrame, size: int = 500, order: str = "idx") -> DataFrame:
    """Adds the chunk each row of a bulk insert belongs to."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("job_id").orderBy(order)) - 1) / size))

"""Plumbing shared by the corpus operators: the cluster's shared folder, tables
written there to cut lineage, size-checked broadcasts, row numbering, words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from contextvars import ContextVar
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest row count of slim rows (ids, keys, counts) that may be broadcast.
BROADCAST_ROWS = 1_000_000

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local
    session gets one of its own; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cuelight-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_owner: list[tuple] = []


def own_worker(name: str, clear) -> None:
    """Python workers outlive their tasks: the caches that another operator left
    in this one are cleared before `name` fills its own."""
    if _owner and _owner[0][0] != name:
        _owner.pop()[1]()
        give_back()
    if not _owner:
        _owner.append((name, clear))


def give_back() -> None:
    """Memory that Python has freed goes back to the machine, where the C library
    can do that: an idle worker shares its executor's memory with the JVM."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_made: dict[str, SparkSession] = {}
_lock = threading.Lock()
#: The scratch() blocks that the running thread is in, outermost first. Each
#: thread has its own, so operators that run side by side keep their own tables.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the innermost
    scratch(), else when the driver's process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _lock:
        if not _made:
            atexit.register(drop_made)
        _made[path] = spark
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside, by this thread, are deleted at the end, but for those
    handed to the function it gives, which pass to the scratch() around it, if
    there is one."""
    mine: list[str] = []
    kept: set[str] = set()
    outer = _scopes.get()
    token = _scopes.set((*outer, mine))

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        if outer:
            outer[-1].extend(p for p in mine if p in kept)
        for path in mine:
            if path not in kept:
                _drop_made(path)


def _drop_made(path: str) -> None:
    with _lock:
        spark = _made.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have ended
            drop_path(spark, path)


def drop_made() -> None:
    for path in list(_made):
        _drop_made(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """df written once to the shared folder and read back: later steps neither
    recompute it nor depend on executors that may be lost."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def small(df: DataFrame, cap: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it counts at most cap rows; beyond, the join
    shuffles both sides and adaptive execution splits its skewed partitions.
    df must be cheap to count, so stage it first."""
    return F.broadcast(df) if df.count() <= cap else df


def numbered(df: DataFrame, keys: list[str], order: list, name: str, within: list | None = None, columns: list | None = None) -> DataFrame:
    """df with `name`: 0, 1, ... within each group of `keys`, following `order`.

    No group is gathered in a task: rows are range-partitioned by keys and
    order, numbered inside partitions, and shifted by what earlier partitions
    hold of the group. `order` should break ties, as equal rows share a task;
    inside a task rows follow `within`, where it says more than `order`.
    columns: what is kept of the rows once they are sorted; all, unless given.
    """
    by = [*map(F.col, keys), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*map(F.col, keys), *(within or order)).withColumn("_mid", F.monotonically_increasing_id())
    if columns:
        rows = rows.select(*columns, "_mid")
    rows = staged(
        rows.withColumns({"_part": F.shiftright("_mid", 33), "_at": F.col("_mid").bitwiseAND((1 << 33) - 1)})
        .drop("_mid"), "numbered")
    runs = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = staged(runs.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "runs")
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(small(runs), on).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_shift", *[f"_k_{k}" for k in keys])


def crc32_sql(x: str) -> str:
    """DuckDB SQL of the crc32 of a text of ASCII characters, bit by bit."""
    bits = "[" + ", ".join(["0::bigint"] * 8) + "]"
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda y: ord(y)::bigint)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), {bits}), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text, in order; none for null."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")

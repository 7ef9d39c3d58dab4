"""Claims of queued rows by one of several workers, through files that only one can create.

A claim is an empty place in a shared folder: <root>/<id>/<attempt>. Creating it
fails where it exists, so of two workers that see the same row as queued one gets
it. A claim that isn't renewed for as long as the lease has lapsed: then the next
attempt may be claimed, again by one worker only.
"""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators import jobs

LEASE_S = 900


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exclusive(spark: SparkSession, path: str, text: str = "") -> bool:
    """Creates a file, unless there is one: did this call create it? HDFS and
    local disks decide that atomically; object stores without conditional writes don't."""
    at, store = _at(spark, path)
    store.mkdirs(at.getParent())
    jvm = spark._jvm
    try:
        if store.getScheme() == "file":
            file = jvm.java.nio.file.Paths.get(store.makeQualified(at).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(file, bytearray(text.encode()), options)
        else:
            out = store.create(at, False)
            out.write(bytearray(text.encode()))
            out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def held(spark: SparkSession, root: str, key) -> tuple[int, float]:
    """(attempts so far, seconds since the last one was made or renewed)."""
    at, store = _at(spark, f"{root}/{key}")
    files = [(int(f.getPath().getName()), f.getModificationTime()) for f in store.listStatus(at)] if store.exists(at) else []
    attempt, changed = max(files, default=(0, 0))
    return attempt, time.time() - changed / 1000


def renew(spark: SparkSession, root: str, key, attempt: int) -> None:
    """A sign of life: the lease runs anew."""
    at, store = _at(spark, f"{root}/{key}/{attempt}")
    store.setTimes(at, int(time.time() * 1000), -1)


def claim(queue: DataFrame, root: str, worker: str, most: int = 1, lease_s: float = LEASE_S, ahead: int = 20, key: str = "id", order: tuple[str, ...] = ("priority", "created_at", "id")) -> DataFrame:
    """At most `most` queued rows that are now this worker's, in their order, with
    status, worker_label and attempt. The first `ahead` rows beyond them are looked
    at, so that a worker whose every choice was taken meanwhile finds others."""
    spark = queue.sparkSession
    first = jobs.first_queued(queue, order, most + ahead).select(key).collect()  # most + ahead at most
    got: list[tuple[int, int]] = []
    for row in first:
        attempt, idle_s = held(spark, root, row[0])
        if (attempt == 0 or idle_s > lease_s) and exclusive(spark, f"{root}/{row[0]}/{attempt + 1}", worker):
            got.append((row[0], attempt + 1))
            if len(got) == most:
                break
    mine = spark.createDataFrame(got, f"_id {queue.schema[key].dataType.simpleString()}, attempt int")
    rows = queue.join(F.broadcast(mine), F.col(key) == F.col("_id")).drop("_id")  # `most` rows
    return rows.withColumns({"status": F.lit("compiling"), "worker_label": F.lit(worker)})

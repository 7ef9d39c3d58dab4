"""Streams of heartbeats and job rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from cuelight.sources import tables

#: What a job that nobody works on says.
QUIET = ("queued", "done", "failed")


def session_stream(beats: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Runs of beats without a gap, once the watermark has passed them."""
    rows = beats.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = rows.groupBy(F.session_window(ts, gap).alias("_window"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "n")


def kept_beats_stream(beats: DataFrame, key: str, ts: str, least_s: int = 20) -> DataFrame:
    """Beats at least least_s after the last one kept of their worker; the state
    of a worker is that one time."""

    def keep(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf["_us"])
        out = []
        for t in times:
            if last is None or t - last >= least_s * 1_000_000:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "at_us": out})

    kind = beats.schema[key].dataType.simpleString()
    rows = beats.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, at_us long", "last long", "append", "NoTimeout")


def requeue_stream(beats: DataFrame, key: str, ts: str, status: str, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """key, last_at, due_at: of each job whose last beat is older than `minutes`, as
    the stream's own time tells; as jobs.requeued() does for a table. A beat that
    says queued, done or failed ends the watch. A job's state is its last beat,
    and goes when the watch ends or the timer has fired; a beat that comes after
    starts it anew, one that comes later than the watermark is not counted."""

    def watch(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_us": [last], "due_us": [last + minutes * 60_000_000]})
            return
        rows = [(us, s) for pdf in batches for us, s in zip(pdf["_us"], pdf["_status"])]
        if state.exists:
            rows.append((state.get[0], "busy"))
        last, said = max(rows, key=lambda r: (r[0], r[1] in QUIET))
        if said in QUIET:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        # the timer fires once the watermark is past it, so never for a beat it has just let through
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    kind = beats.schema[key].dataType.simpleString()
    rows = beats.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(key, ts, F.unix_micros(ts).alias("_us"), F.coalesce(status, F.lit("")).alias("_status"))
    out = rows.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, last_us long, due_us long", "last long", "append", "EventTimeTimeout")
    return out.select(key, F.timestamp_micros("last_us").alias("last_at"), F.timestamp_micros("due_us").alias("due_at"))


def unique_stream(rows: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Rows without those whose keys came before, as far apart as `within` at most;
    the state of a key goes once the watermark has passed it by as much."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def with_dimension(stream: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """A stream's rows with what a table says of their keys; nulls where it says
    nothing. Each micro-batch reads the table as it then is; of rows of one key
    the first by its columns counts, so that no row of the stream doubles."""
    rest = [c for c in dimension.columns if c not in on]
    one = dimension.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_d")) if rest else dimension.select(*on).distinct()
    return stream.join(one, on, "left").select(*stream.columns, *[F.col("_d")[c].alias(c) for c in rest])


def latest_wins(updates: DataFrame, path: str, keys: list[str], version: str, buckets: int = 64):
    """A streaming writer that keeps, under path, the newest row of each key.

    Rows lie in folders by a hash of their key. A micro-batch rewrites the
    buckets its keys fall in, in a folder of its own, and only then names the new
    ones in a manifest, so a batch costs what it touches and a failed one leaves
    no trace. Nothing hangs on a batch's number, which starts anew with each
    checkpoint: a repeated batch is merged again, which changes nothing. Folders
    that neither the newest manifest nor the one before it names are deleted, so
    a reader of the last one can end. One writer at a time. Read with latest()."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folder = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.withColumn("_bucket", folder).persist()
        try:
            touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # `buckets` at most
            if not touched:
                return
            number, old = _manifest(spark, path)
            rows = batch.drop("_bucket")
            kept = [f"{path}/rows/{old[b]}/_bucket={b}" for b in touched if b in old]
            before = spark.read.schema(rows.schema).parquet(*kept) if kept else rows.limit(0)
            mine = uuid.uuid4().hex
            tables.upsert(before, rows, keys, version).withColumn("_bucket", folder).write.partitionBy("_bucket").parquet(f"{path}/rows/{mine}")
            new = old | dict.fromkeys(touched, mine)
            spark.createDataFrame(list(new.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{path}/manifest/{number + 1:012d}-{mine}")
            _sweep(spark, path, {*old.items(), *new.items()})
        finally:
            batch.unpersist()

    return updates.writeStream.foreachBatch(merge)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, store = _folder(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at, store = _folder(spark, path)
    store.delete(at, True)


def _sweep(spark: SparkSession, path: str, named: set[tuple[int, str]]) -> None:
    """Deletes the buckets that aren't named, what a lost batch has left among them, and all but two manifests."""
    folders = {f for _, f in named}
    for folder in _names(spark, f"{path}/rows"):
        if folder not in folders:
            _remove(spark, f"{path}/rows/{folder}")
            continue
        for name in _names(spark, f"{path}/rows/{folder}"):
            if name.startswith("_bucket=") and (int(name[8:]), folder) not in named:
                _remove(spark, f"{path}/rows/{folder}/{name}")
    for name in _whole(spark, path)[:-2]:
        _remove(spark, f"{path}/manifest/{name}")


def _whole(spark: SparkSession, path: str) -> list[str]:
    """Manifests that were written whole, by number."""
    found = []
    for name in _names(spark, f"{path}/manifest"):
        at, store = _folder(spark, f"{path}/manifest/{name}/_SUCCESS")
        if store.exists(at):
            found.append(name)
    return found


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Number of the newest whole manifest, 0 without one, and the folder of each bucket."""
    whole = _whole(spark, path)
    if not whole:
        return 0, {}
    return int(whole[-1].split("-")[0]), {r.bucket: r.folder for r in spark.read.parquet(f"{path}/manifest/{whole[-1]}").collect()}


def latest(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table that latest_wins() keeps. Before its first batch there is none:
    then an empty one, if its schema is given."""
    _, folders = _manifest(spark, path)
    if not folders:
        if schema is None:
            raise LookupError(f"no batch has been written to {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{path}/rows/{folder}/_bucket={b}" for b, folder in folders.items()])


def drained(writer: DataStreamWriter, once: bool = True, poll: str = "10 seconds", budget_s: float | None = None) -> StreamingQuery:
    """Runs a writer until its input is used up (once), or polls it; either way
    for at most budget_s seconds, after which it stops cleanly."""
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()
    if budget_s is None and once:
        query.awaitTermination()
    elif budget_s is not None and not query.awaitTermination(max(1, round(budget_s))):
        query.stop()
    return query


class Progress(StreamingQueryListener):
    """Tells `say` what each micro-batch did, and of ends and failures; also a
    sign of life, so a job that runs long isn't taken for stalled."""

    def __init__(self, say: Callable[[str], None] = print, alive: Callable[[], None] | None = None):
        self.say, self.alive = say, alive

    def onQueryStarted(self, event) -> None:
        self.say(f"{event.name or event.id} started")

    def onQueryProgress(self, event) -> None:
        if self.alive:
            self.alive()
        p = event.progress
        self.say(f"{p.name or p.id} batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        if self.alive:
            self.alive()

    def onQueryTerminated(self, event) -> None:
        self.say(f"{event.id} {'failed: ' + event.exception if event.exception else 'ended'}")

"""Queues of jobs, resumption, presence, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from cuelight.functions import text as T


def claim_next(queue: DataFrame, per: list[str] | None = None, order: tuple[str, ...] = ("priority", "created_at", "id")) -> DataFrame:
    """The next queued row: lowest priority number, then oldest; nulls last. With
    `per`, one of each queue. Of several workers that see a row as queued
    streaming.claims lets one have it."""
    if not per:
        return first_queued(queue, order, 1)
    rows = queue.where(F.col("status") == "queued")
    by = [F.col(c).asc_nulls_last() for c in order]
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*per).orderBy(*by))).where("_rn = 1").drop("_rn")


def first_queued(queue: DataFrame, order: tuple[str, ...], n: int) -> DataFrame:
    return queue.where(F.col("status") == "queued").orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def needs_render(status: Column, audio_path: Column, studio: bool = False) -> Column:
    """Rows to do again on resumption: sent back, or without audio; in the studio also pending and failed ones."""
    again = status.isin("rerolled", "pending", "failed") if studio else status == "rerolled"
    return F.coalesce(again, F.lit(False)) | F.coalesce(audio_path == "", F.lit(True))


def resumed(cues: DataFrame, studio: bool = False) -> DataFrame:
    return cues.withColumn("render", needs_render(F.col("status"), F.col("audio_path"), studio))


def captions(cues: DataFrame, text: str = "source_text") -> DataFrame:
    """Adds spoken: captions in brackets are skipped unless the job reads them, or is read aloud."""
    return cues.withColumn("spoken", ~T.is_caption(F.col(text)) | F.coalesce(F.col("read_captions"), F.lit(False)) | (F.coalesce(F.col("kind"), F.lit("")) == "tts"))


def pending_translation(cues: DataFrame) -> DataFrame:
    return cues.where(F.coalesce(F.col("translated_at").cast("string"), F.lit("")) == "")


def pending_adaptation(cues: DataFrame) -> DataFrame:
    """Cues without a rewrite: those that have one aren't paid for again."""
    return cues.where(T.non_blank(F.col("final_text")).isNull())


def dispatched(jobs: DataFrame) -> DataFrame:
    """kind with its default, and work: what a worker does with the job."""
    rows = jobs.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("subtitles")))
    return rows.withColumn("work", F.when(F.col("kind") == "transcribe", "transcribe").otherwise("render"))


def inserted(cues: DataFrame) -> DataFrame:
    """status and note of cues new from a transcription; transcript_text is what was heard, which is spoken until it is translated."""
    doubtful = F.coalesce("low_confidence", F.lit(False))
    return cues.withColumns({"source_text": F.col("text"), "transcript_text": F.col("text"), "status": F.when(doubtful, "review").otherwise("pending"), "note": F.when(doubtful, "low confidence transcription — check this line")})


def render_counters(cues: DataFrame) -> DataFrame:
    """Per job, before it is rendered: cues in all, those done already (not
    spoken, or kept from before), and kept ones to review. cues: spoken, render."""
    kept = F.col("spoken") & ~F.col("render")
    return cues.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_cues"), F.count_if(~F.col("spoken") | kept).alias("done_cues"), F.count_if(kept & F.col("status").isin("review", "qc_fail")).alias("review_cues"))


def recombined(kept: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Clips of a job after a second pass: fresh ones, and kept ones that were
    not made again, in order of the keys."""
    old = kept.join(fresh.select(*keys), keys, "left_anti")
    return fresh.unionByName(old.select(*fresh.columns)).orderBy(*keys)


def cue_voice(cue: Column, job: Column) -> Column:
    return F.coalesce(F.nullif(cue, F.lit("")), job)


def studio_voice(line_preset: Column, line_voice: Column, job_preset: Column, job_voice: Column) -> Column:
    """Line before job, preset before recorded voice."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(line_preset), F.concat(F.lit("db-"), some(line_voice)), some(job_preset), F.concat(F.lit("db-"), some(job_voice)))


def preset_known(rows: DataFrame, presets: DataFrame, column: str = "preset") -> DataFrame:
    """Adds known: in presets (name); all are where there are none."""
    names = presets.select(F.col("name").alias("_name")).distinct()
    empty = names.agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return rows.join(names, F.col(column) == F.col("_name"), "left").join(F.broadcast(empty)).withColumn("known", F.col("_empty") | F.col("_name").isNotNull()).drop("_name", "_empty")  # one row


def studio_lines(lines: DataFrame, voices: DataFrame, presets: DataFrame) -> DataFrame:
    """lines (preset, voice_id, job_preset, job_voice_id) with voice and error:
    the voice each is read in, and why it can't be. A preset must be known, a
    recorded voice exist, with consent and a recording."""
    some = lambda c: F.nullif(c, F.lit(""))
    rows = lines.withColumn("voice", studio_voice(F.col("preset"), F.col("voice_id"), F.col("job_preset"), F.col("job_voice_id")))
    # the choice's own source: a line's voice stands before the job's preset
    of_preset = some(F.col("preset")).isNotNull() | (some(F.col("voice_id")).isNull() & some(F.col("job_preset")).isNotNull())
    rows = rows.withColumn("_preset", F.when(of_preset, F.col("voice"))).withColumn("_voice", F.when(~of_preset, F.coalesce(some(F.col("voice_id")), some(F.col("job_voice_id")))))
    rows = preset_known(rows, presets, "_preset")
    v = voice_errors(voices).select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    rows = rows.join(v, F.col("_voice") == F.col("_id"), "left")
    error = F.when(F.col("voice").isNull(), "no voice named").when(F.col("_preset").isNotNull(), F.when(~F.col("known"), "unknown preset")).when(F.col("_id").isNull(), "no such voice").otherwise(F.col("_error"))
    return rows.withColumn("error", error).drop("_preset", "_voice", "known", "_id", "_error")


def voice_errors(voices: DataFrame) -> DataFrame:
    """Adds error: why a voice can't be used."""
    return voices.withColumn("error", F.when(F.col("id").isNull(), "no such voice").when(~F.coalesce("consent_confirmed", F.lit(False)), "no consent").when(F.coalesce(F.nullif("sample_path", F.lit("")), F.lit(None)).isNull(), "no recording"))


def gaps(beats: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Beats of a worker that come over `seconds` after the one before: the job would have been requeued."""
    late = F.lag(ts).over(W.partitionBy(key).orderBy(ts))
    return beats.withColumn("gap_s", F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(late.cast("timestamp"))).where(F.col("gap_s") > seconds)


def _is_stalled(now: Column, minutes: int) -> Column:
    return ~F.col("status").isin("queued", "done", "failed") & (F.col("heartbeat_at") < now - F.make_dt_interval(mins=F.lit(minutes)))


def stalled(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return jobs.where(_is_stalled(now, minutes))


def requeued(jobs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """jobs with the stalled ones back in the queue, without their worker."""
    rows = jobs.withColumn("_stalled", F.coalesce(_is_stalled(now, minutes), F.lit(False)))
    back = rows.withColumn("status", F.when(F.col("_stalled"), "queued").otherwise(F.col("status")))
    return back.withColumn("worker_label", F.when(~F.col("_stalled"), F.col("worker_label"))).drop("_stalled")


def pruned_workers(workers: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """workers seen in the last `hours`; those never seen go too."""
    return workers.where(F.col("last_seen_at").cast("timestamp") >= now - F.make_dt_interval(hours=F.lit(hours)))


def last_beats(beats: DataFrame, key: str, ts: str) -> DataFrame:
    last = beats.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("at"), F.col("status"))).alias("_l"), F.count(F.lit(1)).alias("beats"))
    return last.select(key, "beats", F.col("_l.at").alias("last_seen"), F.col("_l.status").alias("status"))


def liveness(last: DataFrame, now: Column) -> DataFrame:
    """Adds age_s and alive to last beats: 75 seconds when idle, three minutes
    when busy, not at all once stopped. now may be a column of the rows."""
    rows = last.withColumn("age_s", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp")))
    return rows.withColumn("alive", F.when(F.col("status") == "stopped", False).when(F.col("status") == "busy", F.col("age_s") <= 180).otherwise(F.col("age_s") <= 75))


def presence(beats: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """Each worker's last beat, its age, and whether it passes for alive."""
    return liveness(last_beats(beats, key, ts), now)


def until_switched_off(writes: DataFrame, key: str, ts: str, ok: str, most: int = 3) -> DataFrame:
    """Presence writes that are tried: a worker stops for good after `most`
    failures on end, as its table is missing then; a success starts the count anew."""
    w = W.partitionBy(key).orderBy(ts)
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    last = F.count_if(failed).over(w.rowsBetween(-(most - 1), 0)) == most
    rows = writes.withColumn("_off", last.cast("int"))
    return rows.withColumn("_before", F.coalesce(F.max("_off").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("_before = 0").drop("_off", "_before")


def sessions(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Runs of events without a gap of gap_s or more: start, end, n."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(ts)
    rows = events.withColumn("_new", F.coalesce((at - F.lag(at).over(w) >= gap_s * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def render_batches(cues: DataFrame, size: int = 8) -> DataFrame:
    """Adds batch: runs of `size` cues of one voice, in order, never of two voices."""
    return cues.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("job_id", "voice").orderBy("idx")) - 1) / size))


def context_windows(cues: DataFrame, size: int = 25, beside: int = 2, text: str = "source_text") -> DataFrame:
    """job_id, batch, lines, before, after: runs of cues for one call, with their
    neighbours. A cue goes to its own batch and, near an edge, to the next one."""
    rn = F.row_number().over(W.partitionBy("job_id").orderBy("idx")) - 1
    rows = cues.select("job_id", "idx", F.col(text).alias("t"), rn.alias("rn")).withColumn("own", F.floor(F.col("rn") / size))
    to = F.array_distinct(F.array(F.floor((F.col("rn") - beside) / size), "own", F.floor((F.col("rn") + beside) / size)))
    rows = rows.withColumn("batch", F.explode(F.filter(to, lambda b: b >= 0)))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("t", F.lit("")))
    pick = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rn", line.alias("l"))))), lambda x: x["l"]), "\n")
    out = rows.groupBy("job_id", "batch").agg(F.count_if(F.col("batch") == F.col("own")).alias("n"), pick(F.col("batch") == F.col("own")).alias("lines"), pick(F.col("own") < F.col("batch")).alias("before"), pick(F.col("own") > F.col("batch")).alias("after"))
    return out.where("n > 0")


def translate_prompts(cues: DataFrame, language: str, size: int = 25, beside: int = 2, text: str = "source_text") -> DataFrame:
    """job_id, batch, prompt: what a model is asked to translate, `size` cues a
    call, between their neighbours as context, in the order they are spoken in."""
    rn = F.row_number().over(W.partitionBy("job_id").orderBy("idx")) - 1
    rows = cues.select("job_id", "idx", F.coalesce(text, F.lit("")).alias("t"), rn.alias("rn")).withColumn("own", F.floor(F.col("rn") / size))
    to = F.array_distinct(F.array(F.floor((F.col("rn") - beside) / size), "own", F.floor((F.col("rn") + beside) / size)))
    rows = rows.withColumn("batch", F.explode(F.filter(to, lambda b: b >= 0)))
    line = F.concat(F.when(F.col("batch") != F.col("own"), "CONTEXT ").otherwise(""), F.lit("["), F.col("idx").cast("string"), F.lit("]"), F.when(F.col("batch") != F.col("own"), ": ").otherwise(" "), "t")
    g = rows.groupBy("job_id", "batch").agg(F.count_if(F.col("batch") == F.col("own")).alias("n"), F.sort_array(F.collect_list(F.struct("rn", line.alias("l")))).alias("ls"))
    # Fixed value: the first line of a prompt.
    head = F.concat(F.lit(f"Translate these subtitle cues into {language}."), F.lit("\n\n"))
    return g.where("n > 0").select("job_id", "batch", F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("prompt"))


def rewrite_prompt(fit: DataFrame, text: str = "source_text") -> DataFrame:
    """job_id, prompt: a line for each cue to rewrite."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] budget "), F.col("budget").cast("string"), F.lit(" syllables (currently "), F.col("syllables").cast("string"), F.lit("): "), F.coalesce(F.col(text), F.lit("")))
    return fit.where("target").groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def missing_lines(wanted: DataFrame, got: DataFrame, keys=("job_id", "idx"), text: str = "text") -> DataFrame:
    """Wanted rows without a non-blank answer."""
    return wanted.join(got.where(T.non_blank(F.col(text)).isNotNull()).select(*keys).distinct(), list(keys), "left_anti")


def backoff(attempts: DataFrame, waits=(5, 15, 45, 90)) -> DataFrame:
    """Adds wait_s before the next attempt (attempt from 1) and total_s waited; null once given up."""
    ws = F.array(*[F.lit(w) for w in waits])
    return attempts.withColumn("wait_s", F.get(ws, F.col("attempt") - 1)).withColumn("total_s", F.aggregate(F.slice(ws, 1, F.greatest(F.lit(0), F.col("attempt") - 1)), F.lit(0), lambda a, b: a + b))


def kept_beats(beats: DataFrame, key: str, ts: str, least_s: int = 20) -> DataFrame:
    """Beats that pass a limit of one in least_s: each counts from the last kept,
    over midnights too. A worker's beats are read in order of time, a batch at a
    time; all that is held of a worker is the last kept time."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, last = None, None
        for batch in batches:
            mask = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ok = last is None or k != worker or at - last >= least_s * 1_000_000
                if ok:
                    worker, last = k, at
                mask.append(ok)
            yield batch.filter(pa.array(mask, pa.bool_()))

    rows = beats.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us")).where("at_us is not null")
    out = t.StructType([rows.schema[key], t.StructField("at_us", t.LongType())])
    return rows.repartition(key).sortWithinPartitions(key, "at_us").mapInArrow(keep, out)


def realtime_factor(stats: DataFrame) -> DataFrame:
    return stats.groupBy("worker").agg(F.count(F.lit(1)).alias("cues"), (F.sum("audio_s") / F.greatest(F.sum("elapsed_s"), F.lit(1e-9))).alias("rtf"))

"""Further registered queries: joins by time, claims, streams, stretched audio, spectra, reports at several levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import intervals, qc, spectra, stretch, timeline
from cuelight.plans import proxies as P
from cuelight.plans.catalog import PLACED, QUEUE, SQ, _queue, query
from cuelight.plans.proxies import CUES
from cuelight.streaming import claims, liveness


def _events(spark, sf_dir):
    return P.read(spark, sf_dir, "events")


# --- joins by time ---------------------------------------------------------------


@query("""with c as (select user_id, ts, max(event_id) click_id from events where event_type = 'click' group by all)
select e.event_id, c.click_id from events e asof left join c on e.user_id = c.user_id and e.ts >= c.ts where e.event_type in ('purchase', 'error')""")  # fmt: skip
def beats_as_of(spark, sf_dir):
    """The last beat of its worker before each event of a job."""
    e = _events(spark, sf_dir)
    beats = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return intervals.as_of(e.where("event_type in ('purchase', 'error')").select("event_id", "user_id", "ts"), beats, "user_id", "ts", ["click_id"]).select("event_id", "click_id")


@query(PLACED + " select c.job_id, c.idx, p.idx clip, least(c.end_ms, p.placed_end_ms) - greatest(c.start_ms, p.placed_ms) shared_ms from cues c join placed p on p.job_id = c.job_id and p.placed_ms < c.end_ms and c.start_ms < p.placed_end_ms")
def cue_overlaps(spark, sf_dir):
    """All clips that sound while a cue is shown, not its own and the next only."""
    c = P.cues(spark, sf_dir).select("job_id", "idx", "start_ms", "end_ms", "clip_ms")
    both = intervals.overlapping(c, timeline.place(c), "job_id", ("start_ms", "end_ms"), ("placed_ms", "placed_end_ms"))
    return both.select("l.job_id", "l.idx", F.col("r.idx").alias("clip"), (F.least("l.end_ms", "r.placed_end_ms") - F.greatest("l.start_ms", "r.placed_ms")).alias("shared_ms"))


# --- queues and streams -----------------------------------------------------------


@query(f"with q as (select id, row_number() over (order by priority nulls last, created_at nulls last, id) rn from {QUEUE} where status = 'queued') select id, case when rn <= 3 then 'a' else 'b' end worker_label, 1 attempt, 'compiling' status from q where rn <= 5")
def atomic_claims(spark, sf_dir):
    """Two workers that see the same queue: what one has claimed the other passes over."""
    queue, root = _queue(spark, sf_dir), P.scratch_path(spark, "claims")
    rows = claims.claim(queue, root, "a", most=3).unionByName(claims.claim(queue, root, "b", most=2))
    return rows.select("id", "worker_label", "attempt", "status")


def _ran(stream, spark, name):
    """What a stream writes until its input is used up."""
    at = P.scratch_path(spark, name)
    liveness.drained(stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")  # a file, as a pattern: streams read folders


@query("select e.user_id, e.event_type, count(distinct e.event_id) n, any_value(n_name) n_name from events e left join nation on n_nationkey = e.user_id % 30 group by all order by all".replace(" group by all order by all", " group by e.user_id, e.event_type"))
def unique_enriched(spark, sf_dir):
    """A stream in which every third event comes twice, without its repeats, with what a table says of its worker."""
    twice = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = liveness.unique_stream(twice, ["event_id"], "ts", "1 hour").withColumn("n_nationkey", (F.col("user_id") % 30).cast("int"))
    nations = P.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    out = _ran(liveness.with_dimension(rows.select("user_id", "event_id", "event_type", "n_nationkey"), nations, ["n_nationkey"]), spark, "unique-events")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.first("n_name").alias("n_name"))


@query("""with b as (select user_id, ts, case event_type when 'purchase' then 'done' else 'busy' end s from events), l as (select user_id, max(ts) last, bool_or(s = 'done') filter (ts = m) quiet from (select *, max(ts) over (partition by user_id) m from b) group by user_id)
select user_id, epoch_us(last) last_us from l where not coalesce(quiet, false) and last < (select max(ts) from events) - interval 361 minute""")  # fmt: skip
def stalled_stream(spark, sf_dir):
    """Jobs whose last beat is six hours old when the stream ends, found by timers: one run of a stream
    is one batch over the table, the timers fire in the empty one after it."""
    beats = _event_stream(spark, sf_dir).select("user_id", "ts", F.when(F.col("event_type") == "purchase", "done").otherwise("busy").alias("status"))
    return _ran(liveness.requeue_stream(beats, "user_id", "ts", "status", minutes=360), spark, "stalled").select("user_id", F.unix_micros("last_at").alias("last_us"))


# --- audio ---------------------------------------------------------------------------


@query(PLACED + """, t as (select job_id, max(end_ms) s from cues group by job_id), e as (select placed.*, max(placed_end_ms) over (partition by placed.job_id) e, t.s from placed join t on placed.job_id is not distinct from t.job_id), f as (select *, case when e > s and s > 0 then e::double / s else 1.0::double end speed from e)
select job_id, idx, case when speed > 1.001 then round_even((8 * clip_ms)::double / speed, 0) else 8 * clip_ms end::bigint n, round_even(case when speed > 1.001 then placed_ms / speed else placed_ms end * 8000.0::double / 1000, 0)::bigint "at" from f""")  # fmt: skip
def fitted_clips(spark, sf_dir):
    """Tones as long as the clips, stretched to the cues' timecode: their lengths and first samples."""
    t = timeline.fit_to_timecode(timeline.place(timeline.timecode(P.cues(spark, sf_dir))), "timecode_ms")
    # slim rows stand for much work each: dealt out by number, as by their bytes a few tasks would get all
    t = t.select("job_id", "idx", "speed", "fit_ms", F.col("clip_ms").alias("samples")).repartition(8 * spark.sparkContext.defaultParallelism, "job_id", "idx")
    rows = stretch.fitted_clips(t, rate=8000, frame=256, search=96, load=P.tone)
    return rows.select("job_id", "idx", F.size("samples").cast("long").alias("n"), "at")


FRAMES = """with x as (select vec_id, unnest([0, 16, 32]) f, embedding::double[] e from embeddings), w as (select vec_id, f, list_transform(e[f + 1:f + 32], lambda x, j: x * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / 32))) v from x),
b as (select vec_id, f, v, unnest(range(0, 17)) b from w),
m as (select vec_id, b, avg(sqrt(pow(list_sum(list_transform(v, lambda x, j: x * cos(2 * pi() * b * (j - 1) / 32))), 2) + pow(list_sum(list_transform(v, lambda x, j: x * sin(2 * pi() * b * (j - 1) / 32))), 2))) p from b group by vec_id, b)"""


@query(FRAMES + " select vec_id voice, b * 250.0::double hz, round(p, 6) \"power\" from m")
def voice_spectrum(spark, sf_dir):
    s = spectra.spectrum(P.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", rate=8000, frame=32, hop=16)
    return s.select("voice", "hz", F.round("power", 6).alias("power"))


@query(FRAMES + ", r as (select *, sum(p) over (partition by vec_id order by b) r, sum(p) over (partition by vec_id) a from m) select vec_id voice, min(b) * 250.0::double hz from r where a > 1e-9 and round(r / a, 9) >= 0.9 group by vec_id")
def spectral_bandwidth(spark, sf_dir):
    """The bandwidth of voices from their samples."""
    s = spectra.spectrum(P.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", rate=8000, frame=32, hop=16)
    return qc.bandwidth(s, 0.9)


# --- reports ---------------------------------------------------------------------------


@query(f"""with f as (select vec_id % 3 voice, sqrt({SQ.format('embedding')} / len(embedding)) rms from embeddings) select voice, true loud_ok, true quiet_ok, count(*) n from f group by voice""")
def sketched_levels(spark, sf_dir):
    """Levels of loud and quiet frames by sketches of quantiles lie between the exact ones 3 % of the ranks to either side."""
    f = P.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("voice"), T.rms(F.col("embedding")).alias("rms"))
    got = qc.sketched_levels(f)
    by = f.groupBy("voice").agg(F.count(F.lit(1)).alias("n"), *[F.percentile("rms", F.lit(p)).alias(f"c{round(100 * p)}") for p in (0.17, 0.23, 0.57, 0.63)]).withColumnRenamed("voice", "v")
    rows = f.join(by, F.col("voice") == F.col("v"))
    over, under = (lambda c: F.avg(F.when(F.col("rms") > F.col(c), F.col("rms")))), (lambda c: F.avg(F.when(F.col("rms") < F.col(c), F.col("rms"))))
    span = rows.groupBy("v", "n").agg(over("c57").alias("l0"), over("c63").alias("l1"), under("c17").alias("q0"), under("c23").alias("q1"))
    out = got.join(span, F.col("voice") == F.col("v"))
    return out.select("voice", F.col("loud").between(F.col("l0"), F.col("l1")).alias("loud_ok"), F.col("quiet").between(F.col("q0"), F.col("q1")).alias("quiet_ok"), "n")


@query(CUES + """select case when grouping(voice) = 0 then 'voice' when grouping(speaker) = 0 then 'speaker' when grouping(job_id) = 0 then 'job' else 'all' end "level", job_id, voice, speaker, count(*) as lines, count(*) filter (status in ('failed', 'qc_fail')) failed, coalesce(sum(clip_ms), 0)::bigint audio_ms
from cues group by grouping sets ((job_id, voice), (job_id, speaker), (job_id), ())""")  # fmt: skip
def level_reports(spark, sf_dir):
    return qc.level_reports(P.cues(spark, sf_dir))

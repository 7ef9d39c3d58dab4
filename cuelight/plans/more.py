"""Further registered queries: table operations, voices, paths, audio, shaping as a whole.

As in catalog, each runs over whole tables and stands beside its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import jobs, levels, providers, shaping, speakers, timeline, verify
from cuelight.plans import proxies as P
from cuelight.plans.catalog import ASSIGNED, FIT, MARKUP, PLACED, QUEUE, REWRITTEN, SEGS, STRIP, SYLLABLES, TIME, VIET, _queue, query
from cuelight.plans.proxies import CUES
from cuelight.sources import audio, srt, tables


def K():
    return F.col("event_id")


def _events(spark, sf_dir):
    return P.read(spark, sf_dir, "events")


# --- tables ----------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'")
def table_scan(spark, sf_dir):
    return tables.scan(P.read(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_totalprice"], o_orderstatus="O")


@query("select n_nationkey, n_name from nation where n_nationkey = 3")
def table_single(spark, sf_dir):
    return tables.single(P.read(spark, sf_dir, "nation"), n_nationkey=3).select("n_nationkey", "n_name")


@query("select o_orderkey, o_custkey, true has_status, false has_label from orders")
def table_probe(spark, sf_dir):
    o = tables.require_columns(P.read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    return o.select("o_orderkey", "o_custkey", F.lit(tables.has_column(o, "o_orderstatus")).alias("has_status"), F.lit(tables.has_column(o, "label")).alias("has_label"))


@query(f"select id, case when id % 3 = 0 and id % 2 = 0 then 'failed' else status end status, case when id % 3 = 0 then 'w' || id % 7 end worker from {QUEUE}")
def job_updates(spark, sf_dir):
    q = _queue(spark, sf_dir).select("id", "status", F.lit(None).cast("string").alias("worker"))
    changes = q.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "failed").alias("status"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("worker"))
    return tables.apply_changes(q, changes, ["id"], ["status", "worker"])


@query(f"select id, owner_id from {QUEUE} where status <> 'done'")
def job_deletes(spark, sf_dir):
    q = _queue(spark, sf_dir).select("id", "owner_id", "status")
    return tables.delete(q, q.where("status = 'done'"), ["id"]).select("id", "owner_id")


@query("select event_type, count(*) n, count(distinct user_id) users from events group by event_type")
def event_log(spark, sf_dir):
    e, path = _events(spark, sf_dir), P.scratch_path(spark, "event-log")
    for part in range(2):
        tables.append_events(e.where(K() % 2 == part), path, fatal=True)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


STALE = "status = 'rendering' and created_at < (select max(o_orderdate) from orders) - interval 1 year"


@query(f"select id, case when {STALE} then 'queued' else status end status, case when not ({STALE}) then 'w1' end worker_label from {QUEUE}")
def requeue_stalled(spark, sf_dir):
    q = _queue(spark, sf_dir)
    now = q.agg(F.max("created_at").alias("_now"))
    rows = q.select("id", "status", F.col("created_at").alias("heartbeat_at"), F.lit("w1").alias("worker_label")).join(F.broadcast(now))  # one row
    year = F.col("_now") - F.add_months("_now", -12).cast("timestamp")
    return jobs.requeued(rows, F.col("_now") - year, minutes=0).select("id", "status", "worker_label")


@query("with w as (select user_id, max(ts) last from events where event_type = 'error' group by user_id) select user_id from w where last >= (select max(ts) from events) - interval 6 hour")
def prune_workers(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("_now"))
    w = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last_seen_at")).join(F.broadcast(now))  # one row
    return jobs.pruned_workers(w, F.col("_now"), hours=6).select("user_id")


@query("""with w as (select event_id, user_id, ts, event_type not in ('error', 'purchase') ok from events),
f as (select *, not ok and not coalesce(lag(ok) over u, true) and not coalesce(lag(ok, 2) over u, true) off from w window u as (partition by user_id order by ts)),
b as (select *, coalesce(bool_or(off) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), false) gone from f) select event_id from b where not gone""")  # fmt: skip
def presence_off(spark, sf_dir):
    w = _events(spark, sf_dir).withColumn("ok", ~F.col("event_type").isin("error", "purchase"))
    return jobs.until_switched_off(w, "user_id", "ts", "ok").select("event_id")


@query("""with recursive k as (select user_id, min(ts) t from events group by user_id
 union all select k.user_id, min(e.ts) t from k join events e on e.user_id = k.user_id and e.ts >= k.t + interval 1 hour group by k.user_id)
select user_id, epoch_us(t) at_us from k""")  # fmt: skip
def kept_beats(spark, sf_dir):
    return jobs.kept_beats(_events(spark, sf_dir), "user_id", "ts", 3600)


@query(CUES + ", l as (select conv_id, string_agg(role, ',' order by role) roles from (select distinct conv_id, role from conversations) group by conv_id) select c.job_id, c.idx, l.roles from cues c left join l on l.conv_id = c.job_id and c.idx % 2 = 0")
def lookup_join(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    roles = c.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("roles"))
    return c.select("job_id", "idx").join(roles.withColumnRenamed("job_id", "_job"), (F.col("job_id") == F.col("_job")) & (F.col("idx") % 2 == 0), "left").select("job_id", "idx", "roles")


@query(CUES + "select job_id, idx from cues where job_id in (select conv_id from conversations where turn = 3)")
def batch_members(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    return c.select("job_id", "idx").join(c.where("idx = 3").select("job_id"), "job_id", "left_semi")


@query(CUES + "select distinct job_id, voice from cues where voice is not null")
def enrolled_voices(spark, sf_dir):
    return P.cues(spark, sf_dir).select("job_id", "voice").where("voice is not null").dropDuplicates()


@query(CUES + "select job_id, idx, case when status = 'rerolled' or coalesce(audio_path, '') = '' then 'fresh' else 'kept' end source from cues where clip_ms > 0 or not (status = 'rerolled' or coalesce(audio_path, '') = '')")
def recombined_clips(spark, sf_dir):
    c = jobs.resumed(P.cues(spark, sf_dir))
    fresh = c.where("render and clip_ms > 0").select("job_id", "idx", F.lit("fresh").alias("source"))
    kept = c.where("not render or clip_ms > 0").select("job_id", "idx", F.lit("kept").alias("source"))
    return jobs.recombined(kept, fresh, ["job_id", "idx"])


# --- cues --------------------------------------------------------------------


@query(ASSIGNED + f" select a.job_id, a.idx, case when a.idx % 3 = 0 and {STRIP(chr(39) * 2 + ' || coalesce(cues.answer, repeat(chr(32), 1))')} <> '' then {STRIP(MARKUP('cues.answer'))} else spoken end spoken from a join cues using (job_id, idx)")
def spoken_text(spark, sf_dir):
    a = speakers.assign(P.cues(spark, sf_dir), text="labelled")
    return a.select("job_id", "idx", speakers.spoken_text(F.when(F.col("idx") % 3 == 0, F.col("answer")), F.col("labelled"), F.col("speaker")).alias("spoken"))


@query(CUES + f"select job_id, idx, answer is null untranslated, {STRIP('coalesce(case when idx % 2 = 0 then answer end, repeat(chr(32), 1))')} = '' unadapted from cues")
def pending_work(spark, sf_dir):
    c = P.cues(spark, sf_dir).select("job_id", "idx", F.col("answer").alias("translated_at"), F.when(F.col("idx") % 2 == 0, F.col("answer")).alias("final_text"))
    keys = ["job_id", "idx"]
    waiting = jobs.pending_translation(c).select(*keys, F.lit(True).alias("t"))
    adapting = jobs.pending_adaptation(c).select(*keys, F.lit(True).alias("a"))
    both = c.join(waiting, keys, "left").join(adapting, keys, "left")
    return both.select(*keys, F.coalesce("t", F.lit(False)).alias("untranslated"), F.coalesce("a", F.lit(False)).alias("unadapted"))


@query("with j as (select o_orderkey id, case o_orderkey % 4 when 0 then '' when 1 then 'transcribe' when 2 then 'tts' end kind from orders) select id, case when coalesce(kind, '') = '' then 'subtitles' else kind end kind, case when kind = 'transcribe' then 'transcribe' else 'render' end work from j")
def job_dispatch(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    return jobs.dispatched(P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "").when(k == 1, "transcribe").when(k == 2, "tts").alias("kind")))


@query(CUES + "select job_id, idx, source_text, source_text transcript_text, case when idx % 3 = 1 then 'review' else 'pending' end status, case when idx % 3 = 1 then 'low confidence transcription — check this line' end note from cues")
def inserted_cues(spark, sf_dir):
    c = P.cues(spark, sf_dir).select("job_id", "idx", F.col("source_text").alias("text"), F.when(F.col("idx") % 3 > 0, F.col("idx") % 3 == 1).alias("low_confidence"))
    return jobs.inserted(c).select("job_id", "idx", "source_text", "transcript_text", "status", "note")


@query(CUES + """, s as (select job_id, idx % 6 > 0 spoken, status = 'rerolled' or coalesce(audio_path, '') = '' render, case when status = 'qc_pass' then 'review' else status end status from cues)
select job_id, count(*) total_cues, count(*) filter (not spoken or not render) done_cues, count(*) filter (spoken and not render and status in ('review', 'qc_fail')) review_cues from s group by job_id""")  # fmt: skip
def render_counters(spark, sf_dir):
    c = jobs.resumed(P.cues(spark, sf_dir)).withColumn("spoken", F.col("idx") % 6 > 0)
    return jobs.render_counters(c.withColumn("status", F.when(F.col("status") == "qc_pass", "review").otherwise(F.col("status"))))


@query(CUES + "select job_id, idx, case when idx % 4 = 0 or voice = '' then 'job' || job_id % 5 else voice end voice from cues")
def cue_voices(spark, sf_dir):
    own = F.when(F.col("idx") % 4 == 0, F.when(F.col("idx") % 8 == 0, "")).otherwise(F.col("voice"))
    return P.cues(spark, sf_dir).select("job_id", "idx", jobs.cue_voice(own, F.concat(F.lit("job"), (F.col("job_id") % 5).cast("string"))).alias("voice"))


VOICES = "v as (select 's' || s_suppkey id, case when s_suppkey % 3 > 0 then s_suppkey % 3 = 1 end consent, case when s_suppkey % 5 = 0 then '' when s_suppkey % 5 = 1 then null else 'x.wav' end sample from supplier)"


def _voices(spark, sf_dir):
    k = F.col("s_suppkey")
    return P.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 3 > 0, k % 3 == 1).alias("consent_confirmed"), F.when(k % 5 == 0, "").when(k % 5 > 1, "x.wav").alias("sample_path"))


@query(f"with {VOICES} select id, case when not coalesce(consent, false) then 'no consent' when coalesce(sample, '') = '' then 'no recording' end error from v")
def voice_checks(spark, sf_dir):
    return jobs.voice_errors(_voices(spark, sf_dir)).select("id", "error")


@query(f"""with {VOICES}, l as (select event_id id, case event_id % 4 when 0 then 'p' || event_id % 6 when 1 then '' end lp, case event_id % 3 when 0 then 's' || event_id % 400 end lv, case event_id % 5 when 0 then 'p' || event_id % 7 end jp, case event_id % 7 when 0 then '' else 's' || event_id % 90 end jv from events),
c as (select *, case when lp <> '' then lp when lv is not null then null when jp is not null then jp end preset, case when coalesce(lp, '') <> '' then null when lv is not null then lv when jp is not null then null when jv <> '' then jv end vid from l)
select c.id, coalesce(preset, 'db-' || vid) voice, case when preset is null and vid is null then 'no voice named' when preset is not null then case when preset not in ('p0', 'p1', 'p2', 'p3') then 'unknown preset' end
 when v.id is null then 'no such voice' when not coalesce(consent, false) then 'no consent' when coalesce(sample, '') = '' then 'no recording' end error from c left join v on v.id = vid""")  # fmt: skip
def studio_voices(spark, sf_dir):
    name = lambda p, n: F.concat(F.lit(p), (K() % n).cast("string"))
    lines = _events(spark, sf_dir).select(
        K().alias("id"), F.when(K() % 4 == 0, name("p", 6)).when(K() % 4 == 1, "").alias("preset"), F.when(K() % 3 == 0, name("s", 400)).alias("voice_id"),
        F.when(K() % 5 == 0, name("p", 7)).alias("job_preset"), F.when(K() % 7 == 0, "").otherwise(name("s", 90)).alias("job_voice_id"))
    presets = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p3",)], "name string")
    return jobs.studio_lines(lines, _voices(spark, sf_dir), presets).select("id", "voice", "error")


@query(CUES + "select job_id, idx::int \"index\", answer \"text\" from cues where answer is not null and idx % 3 <> 2")
def reply_parse(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    lines = F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("index"), F.when(F.col("idx") % 3 == 2, " \n").otherwise(F.col("answer")).alias("text"))))
    replies = c.groupBy("job_id").agg(F.to_json(F.struct(lines.alias("cues"))).alias("reply"))
    return providers.parse_reply(replies, "reply")


@query(CUES + f", b as (select *, {FIT('source_text')} from cues), a as (select job_id, idx, source_text, case when ratio > 1.1 or digits then {REWRITTEN} else source_text end final_text from b) select * from a where final_text <> source_text")
def adapt_loop(spark, sf_dir):
    """The model is a stub that keeps a line's first words; what a second pass asks it again, it answers alike."""
    stub = lambda texts, budgets: [" ".join((t or "").split()[:b]) for t, b in zip(texts, budgets)]
    return providers.rewrite(P.cues(spark, sf_dir), stub).select("job_id", "idx", "source_text", "final_text")


@query("""with j as (select o_orderkey id, case when o_orderkey % 3 > 0 then 'a' else 'b' end p, o_orderkey % 4 = 0 own, o_orderkey % 5 > 0 falls from orders),
c as (select *, case when own then ['mine'] when p = 'a' then ['a-fast', 'a-old'] || case when falls then ['b-fast'] else [] end else ['b-fast'] || case when falls then ['a-fast', 'a-old'] else [] end end m from j)
select id, len(m)::int n, array_to_string(m, ' > ') models from c""")  # fmt: skip
def provider_chain(spark, sf_dir):
    """The models that each job tries in turn, by its own choice of provider and model."""
    k = F.col("o_orderkey")
    has, models = {"a": "key", "b": "key"}, {"a": ("a-fast", "a-old"), "b": ("b-fast",)}
    chain = lambda wanted, own, falls: F.lit(" > ".join(m for _, m in providers.model_chain("mine" if own else None, providers.choose_provider(wanted, has, ("a", "b")), models, falls)))
    tried = F.lit(None).cast("string")
    for wanted in ("auto", "b"):  # the eight settings there are, each chosen once on the driver
        for own in (True, False):
            for falls in (True, False):
                of = ((k % 3 > 0) == F.lit(wanted == "auto")) & ((k % 4 == 0) == F.lit(own)) & ((k % 5 > 0) == F.lit(falls))
                tried = F.when(of, chain(wanted, own, falls)).otherwise(tried)
    return P.read(spark, sf_dir, "orders").select(k.alias("id"), F.size(F.split(tried, " > ")).alias("n"), tried.alias("models"))


@query(CUES + """, n as (select job_id, idx, row_number() over (partition by job_id order by idx) - 1 rn, coalesce(source_text, '') t from cues), b as (select distinct job_id, rn // 5 batch from n)
select b.job_id, b.batch::bigint batch, 'Translate these subtitle cues into Vietnamese.' || chr(10) || chr(10) || string_agg(case when rn // 5 = b.batch then '[' || idx || '] ' || t else 'CONTEXT [' || idx || ']: ' || t end, chr(10) order by rn) prompt
from b join n on n.job_id = b.job_id and rn >= b.batch * 5 - 2 and rn < b.batch * 5 + 7 group by b.job_id, b.batch""")  # fmt: skip
def translate_prompts(spark, sf_dir):
    return jobs.translate_prompts(P.cues(spark, sf_dir), "Vietnamese", size=5)


# --- names, paths, numbers ------------------------------------------------------


@query("select vec_id, 'db-' || vec_id enrol, 'cue_' || lpad(vec_id::varchar, greatest(5, length(vec_id::varchar))::int, '0') || '.wav' cue, lpad((vec_id + 1)::varchar, greatest(4, length((vec_id + 1)::varchar))::int, '0') || '.mp3' line, label || '/' || vec_id || '/dub.srt' output from embeddings")
def asset_paths(spark, sf_dir):
    v = F.col("vec_id")
    none = F.lit(None).cast("string")
    return P.read(spark, sf_dir, "embeddings").select("vec_id", jobs.studio_voice(none, v.cast("string"), none, none).alias("enrol"), T.cue_file(v).alias("cue"), T.line_file(v, "mp3").alias("line"), T.job_path(F.col("label"), v, F.lit("dub.srt")).alias("output"))


@query("""select event_id, case when event_id % 5 = 0 then 'mine' when event_id % 4 = 0 then 'Colab' when event_id % 3 = 0 then 'RunPod ' || left(md5(event_id::varchar), 8) when event_id % 2 = 0 then 'host' || event_id % 9 else 'worker' end label,
case when event_id % 3 = 1 then 'cpu' when event_id % 3 = 0 and event_id % 2 = 1 then 'cpu' when event_id % 3 = 0 then 'cuda' else 'cuda' end device, case when event_id % 3 = 0 then (event_id % 8)::int else 0 end idx,
case when event_id % 3 = 1 or (event_id % 3 = 0 and event_id % 2 = 1) or (event_id % 3 = 2 and event_id % 2 = 1) then 'int8' when event_id % 16 < 10 then 'int8_float16' else 'float16' end compute from events""".replace("when event_id % 3 = 0 then 'cuda' else 'cuda' end device", "when event_id % 3 = 2 and event_id % 2 = 1 then 'cpu' else 'cuda' end device"))  # fmt: skip
def worker_setup(spark, sf_dir):
    k, none = K(), F.lit(None).cast("string")
    label = T.worker_label(F.when(k % 5 == 0, "mine").otherwise(""), k % 4 == 0, F.when(k % 3 == 0, F.md5(k.cast("string"))).otherwise(none), F.when(k % 2 == 0, F.concat(F.lit("host"), (k % 9).cast("string"))))
    device = T.device(F.when(k % 3 == 0, F.concat(F.lit("cuda:"), (k % 8).cast("string"))).when(k % 3 == 1, "cpu").otherwise(""), k % 2 == 0)
    rows = _events(spark, sf_dir).select("event_id", label.alias("label"), device.alias("d"))
    return rows.select("event_id", "label", F.col("d.name").alias("device"), F.col("d.index").alias("idx"), T.compute_type(F.col("d.name"), K() % 16).alias("compute"))


@query("select event_id, round(power(10, (event_id % 40 - 20) / 20.0::double), 9) gain, array_to_string(['a', event_type, 'c', 'd' || event_id, 'e'][1:4], ' <- caused by ') why from events")
def gains_and_causes(spark, sf_dir):
    why = T.cause_chain(F.array(F.lit("a"), F.col("event_type"), F.lit("c"), F.concat(F.lit("d"), K().cast("string")), F.lit("e")))
    return _events(spark, sf_dir).select("event_id", F.round(T.gain((K() % 40 - 20).cast("double")), 9).alias("gain"), why.alias("why"))


@query(f"""select doc_id, case when doc_id % 3 > 0 then round((case when {VIET} then greatest(0.6, 0.25 + {SYLLABLES('text')} / 6.0::double) else greatest(0.8, 0.35 + length(coalesce(text, '')) / 15.5::double) end) * (1 + 0.1::double * (doc_id % 3 + 1 - 1)) / 1.12::double, 6) end as "seconds",
case when doc_id * 7 % 3000 < 1200 then '' else lang end heard from documents""")  # fmt: skip
def retries_and_short_clips(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(T.retry_seconds(F.col("text"), F.col("doc_id") % 3 + 1), 6).alias("seconds"), verify.heard_text(F.col("doc_id") * 7 % 3000, F.col("lang")).alias("heard"))


@query("select user_id worker, count(*) cues, sum(value) / greatest(sum(value * 0.5 + 1), 1e-9::double) rtf from events group by user_id".replace("sum(value) / greatest", "round(sum(value) / greatest").replace("double) rtf", "double), 9) rtf"))
def realtime_factor(spark, sf_dir):
    s = _events(spark, sf_dir).select(F.col("user_id").alias("worker"), F.col("value").alias("audio_s"), (F.col("value") * 0.5 + 1).alias("elapsed_s"))
    return jobs.realtime_factor(s).select("worker", "cues", F.round("rtf", 9).alias("rtf"))


@query("with t as (select l_orderkey, 1 - l_discount c, 1 - l_tax s, row_number() over (partition by l_orderkey order by l_discount, l_tax, l_linenumber, l_partkey, l_suppkey) rn from lineitem) select l_orderkey % 100 job_id, count(*) takes, round(avg(round_even(c, 2)), 9) mean_coverage, round(avg(round_even(s, 2)), 9) mean_similarity from t where rn = 1 group by l_orderkey % 100")
def take_means(spark, sf_dir):
    best = verify.best_take(P.takes(spark, sf_dir), ["cue_id"], [F.desc("coverage"), F.desc("similarity"), F.col("attempt"), F.col("part"), F.col("supp")])
    means = verify.take_means(best.withColumn("job_id", F.col("cue_id") % 100), ["job_id"])
    return means.select("job_id", "takes", F.round("mean_coverage", 9).alias("mean_coverage"), F.round("mean_similarity", 9).alias("mean_similarity"))


# --- subtitles and audio -----------------------------------------------------------

NUMBERED = PLACED + ", n as (select job_id, idx, row_number() over (partition by job_id order by idx) n from cues), o as (select placed.*, n.n, row_number() over (partition by job_id order by idx) m from placed join n using (job_id, idx))"
BLOCK = f"|| chr(10) || {TIME('placed_ms')} || ' --> ' || {TIME('placed_end_ms')} || chr(10) || source_text || chr(10)"


@query(NUMBERED + f" select job_id, md5(string_agg(n {BLOCK}, chr(10) order by n)) digest, md5(string_agg(m {BLOCK}, chr(10) order by m)) numbered from o group by job_id")
def srt_placed(spark, sf_dir):
    """As it was numbered before placing, with gaps where there is no clip, and numbered anew."""
    placed = timeline.place(P.cues(spark, sf_dir).withColumn("n", F.row_number().over(srt.W.partitionBy("job_id").orderBy("idx"))))
    out = [srt.render(placed, "source_text", start="placed_ms", end="placed_end_ms", file="job_id", number=n) for n in ("n", None)]
    return out[0].select("job_id", F.md5("content").alias("digest")).join(out[1].select("job_id", F.md5("content").alias("numbered")), "job_id")


@query("with f as (select vec_id % 50 job_id, vec_id // 50 idx from embeddings) select job_id, count(*) n, string_agg(lpad((idx + 1)::varchar, 4, '0') || '.wav', ',' order by idx) names from f group by job_id")
def zip_names(spark, sf_dir):
    import io
    import zipfile

    import pandas as pd

    listed = F.pandas_udf(lambda z: pd.Series([zipfile.ZipFile(io.BytesIO(x)).namelist() for x in z]), "array<string>")
    e = P.read(spark, sf_dir, "embeddings")
    clips = e.select((F.col("vec_id") % 50).alias("job_id"), F.floor(F.col("vec_id") / 50).alias("idx"), F.col("embedding").alias("samples"))
    rows = audio.zip_lines(audio.encode_wav(clips, 8000)).select("job_id", listed("zip").alias("e"))
    return rows.select("job_id", F.size("e").cast("long").alias("n"), F.array_join("e", ",").alias("names"))


@query("with s as (select vec_id, list_transform(embedding, lambda x: trunc(greatest(-1::float, least(1::float, x)) * 32767::float)::bigint) s from embeddings) select vec_id, 8000 rate, len(s)::int n, list_sum(s)::bigint total from s")
def wav_round_trip(spark, sf_dir):
    import pandas as pd

    def back(batches):
        for pdf in batches:
            got = [audio.decode(w) for w in pdf["wav"]]
            totals = [int(round(float((x.astype("float64") * 32768).sum()))) for x, _ in got]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "rate": [r for _, r in got], "n": [len(x) for x, _ in got], "total": totals})

    e = P.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return audio.encode_wav(e, 8000).select("vec_id", "wav").mapInPandas(back, "vec_id long, rate int, n int, total long")


@query("with n as (select event_id i from events) select i::int idx, case when i % 2 = 0 then 'clips/' || i || '.wav' else 'clips/' || lpad(i::varchar, greatest(4, length(i::varchar))::int, '0') || '.wav' end path from n where i % 2 = 0 or i % 3 > 0")
def clip_index(spark, sf_dir):
    k = K().cast("int")
    e = _events(spark, sf_dir)
    plain = e.where("event_id % 2 = 0").select(F.format_string("clips/%d.wav", k).alias("path"))
    padded = e.where("event_id % 3 > 0").select(F.format_string("clips/%04d.wav", k).alias("path"))
    return audio.clip_index(plain.unionByName(padded).unionByName(e.select(F.format_string("clips/x%d.txt", k).alias("path"))).distinct())


@query("""with b as (select vec_id, embedding::double[] e, (list_reverse(embedding)::double[])[1:40] r, vec_id % 3 = 0 thin from embeddings),
m as (select *, list_transform(e, lambda x, i: case when thin and vec_id % 2 = 0 and i <= 40 then x + r[i] * 0.1::double else x end) bed from b),
v as (select *, list_transform(bed, lambda x, i: x * 0.5::double + 3 * e[i]) mix from m), p as (select *, list_max(list_transform(mix, lambda x: abs(x))) peak from v)
select vec_id, round(list_sum(bed), 6) bed, round(list_sum(list_transform(mix, lambda x: case when peak > 0.98 then x * 0.98 / peak else x end)), 6) mix, case when vec_id % 4 = 0 then (vec_id % 9)::double when vec_id % 2 = 0 then 10.0 else 18.0 end::double duck from p""")  # fmt: skip
def bed_mix(spark, sf_dir):
    k = F.col("vec_id")
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = e.withColumn("bed", levels.blended(F.col("e"), F.when(k % 2 == 0, F.slice(F.reverse("e"), 1, 40)), k % 3 == 0))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    mix = levels.mixed(F.col("bed"), F.array_repeat(F.lit(0.5), 64), F.transform("e", lambda x: x * 3))
    rows = rows.withColumn("_mix", mix)
    return rows.select("vec_id", total("bed").alias("bed"), total("_mix").alias("mix"), levels.duck_db(F.when(k % 4 == 0, (k % 9).cast("double")), k % 2 == 0).alias("duck"))


@query("""with recursive h as (select vec_id, unnest(range(0, 8)) k, embedding::double[] e from embeddings), r as (select vec_id, k, sqrt(list_sum(list_transform(e[k * 8 + 1:k * 8 + 8], lambda x: x * x)) / 8) > power(10, -45 / 20.0) said from h),
g as (select vec_id, -1::bigint k, 1.0::double g from embeddings union all
 select g.vec_id, r.k, g.g + (t - g.g) * case when t < g.g then 1 - exp(-0.2::double) else 1 - exp(-0.025::double) end from g join r on r.vec_id = g.vec_id and r.k = g.k + 1, lateral (select case when r.said then power(10, -0.5::double) else 1.0::double end t))
select vec_id, 64 n, round(min(g), 4) least, round(max(g) filter (k = 7), 4) last from g where k >= 0 group by vec_id""")  # fmt: skip
def duck_curve(spark, sf_dir):
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return levels.duck_curve(e, "embedding", 8, 10 ** (-10 / 20)).select("vec_id", F.size("gain").alias("n"), F.round(F.array_min("gain").cast("double"), 4).alias("least"), F.round(F.element_at("gain", -1).cast("double"), 4).alias("last"))


# --- shaping -------------------------------------------------------------------------

#: Repaired words of P.words: those without times start where the last placed one ended.
REPAIRED = SEGS + """,
lens as (select file, seg, count(*)::int total from x group by file, seg),
raw as (select x.*, lens.total, seg * 100.0::double lo, seg * 100.0::double + lens.total * 0.4::double hi, (file + seg + i) % 17 <> 5 has, (seg * 100000 + i * 300 + i // 9 * 700)::double / 1000 s0,
  case when (file + seg + i) % 5 <> 1 then (((file + seg) * 31 + i * 7) % 97 + 3)::double / 100 end score from x join lens using (file, seg)),
pl as (select *, case when has then s0 else coalesce(last_value(case when has then s0 + 0.25 end ignore nulls) over (partition by file, seg order by i rows between unbounded preceding and 1 preceding), lo) end st from raw),
pe as (select *, case when has then s0 + 0.25 else st end en from pl),
bo as (select *, case when en <= st and i < total - 1 then greatest(st, lead(st) over (partition by file, seg order by i)) else en end e1 from pe),
tl as (select *, coalesce(max(case when e1 > st then i end) over (partition by file, seg), -1) + 1 tail from bo),
fi as (select *, max(case when i = tail then st end) over (partition by file, seg) ts from tl),
rp as (select file, language, seg, i, word, st s, case when i >= tail and hi > ts then ts + (hi - ts) / (total - tail) * (i - tail + 1) else e1 end e, score from fi)"""


@query(REPAIRED + " select file, seg, i::int pos, round_even(s * 1000, 0)::bigint start_ms, round_even(e * 1000, 0)::bigint end_ms from rp")
def word_times(spark, sf_dir):
    s = P.words(spark, sf_dir)
    return s.select("file", "seg", F.posexplode(shaping.repaired(F.col("words"), F.col("start"), F.col("end"))).alias("pos", "w")).select("file", "seg", "pos", F.bround(F.col("w.start") * 1000).cast("long").alias("start_ms"), F.bround(F.col("w.end") * 1000).cast("long").alias("end_ms"))


@query(CUES + f"""select job_id, idx, case when idx % 3 = 0 then start_ms / 1000.0::double when idx % 3 = 1 then start_ms / 1000.0::double + 0.5 else start_ms / 1000.0::double end "start", case when idx % 3 = 0 then end_ms / 1000.0::double else start_ms / 1000.0::double + 1 end "end",
 {STRIP("coalesce(source_text, '')")} "text", case when idx % 3 > 0 then (job_id % 10) / 10.0::double end score from cues
 where {STRIP("coalesce(source_text, '')")} <> '' and (idx % 3 = 0 or job_id % 10 >= 2)""")  # fmt: skip
def segments_kept(spark, sf_dir):
    """Segments without words stay whole; those whose one word scores as junk go."""
    word = F.struct(F.col("source_text").alias("word"), F.when(F.col("idx") % 3 == 1, F.col("start_ms") / 1000 + 0.5).otherwise(F.lit(None).cast("double")).alias("start"), (F.col("start_ms") / 1000 + 1).alias("end"), ((F.col("job_id") % 10) / 10).alias("score"))
    c = P.cues(spark, sf_dir)
    s = c.select(F.col("job_id").alias("file"), F.lit("en").alias("language"), F.col("idx").alias("seg"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("source_text").alias("text"), F.when(F.col("idx") % 3 > 0, F.array(word)).otherwise(F.array().cast(f"array<{shaping.WORD}>")).alias("words"))
    r = shaping.rough_cues(s, shaping.Shape(junk=0.15))
    return r.select(F.col("file").alias("job_id"), F.col("seg").alias("idx"), "start", "end", "text", F.get("scores", F.lit(0)).alias("score"))


SLIVERS = """, b as (select job_id file, row_number() over (partition by job_id order by idx) rn, idx * 2.0::double + (idx % 2) * 0.3::double s, idx * 2.0::double + case when idx % 3 = 0 then 0.5 else 1.8 end::double e, coalesce(nullif(trim(left(source_text, (1 + idx * 7 % 60)::int)), ''), 'x') t,
 case when idx % 4 > 0 then (idx % 10) / 10.0::double end sc from cues),
m as (select file, rn, 0 pos, s, e, t, coalesce(sc, 0.0::double) total, (sc is not null)::int n from b where rn = 1 union all
 select b.file, b.rn, m.pos + (not j)::int, case when j then m.s else b.s end, b.e, case when j then m.t || ' ' || b.t else b.t end, case when j then m.total else 0.0::double end + coalesce(b.sc, 0.0::double), case when j then m.n else 0 end + (b.sc is not null)::int
 from m join b on b.file = m.file and b.rn = m.rn + 1, lateral (select (b.e - b.s < 0.7 or length(b.t) < 12) and b.s - m.e < 0.6 and length(m.t || ' ' || b.t) <= 84 and b.e - m.s <= 6.0 j))"""


@query(CUES.replace("with k", "with recursive k") + SLIVERS + " select file, pos, arg_max(s, rn) \"start\", arg_max(e, rn) \"end\", arg_max(t, rn) \"text\", arg_max(case when n > 0 then round_even(total / n, 3) end, rn) score from m group by file, pos".replace("arg_max(case", "max_by(case"))
def sliver_merge(spark, sf_dir):
    i = F.col("idx")
    text = F.coalesce(F.nullif(F.trim(F.substring("source_text", F.lit(1), (i * 7 % 60 + 1).cast("int"))), F.lit("")), F.lit("x"))
    c = P.cues(spark, sf_dir).select(
        F.col("job_id").alias("file"), F.lit("en").alias("language"), i.alias("seg"), F.lit(0).alias("cue"), (i * 2.0 + (i % 2) * 0.3).alias("start"),
        (i * 2.0 + F.when(i % 3 == 0, 0.5).otherwise(1.8)).alias("end"), text.alias("text"), F.when(i % 4 > 0, F.array((i % 10) / 10)).otherwise(F.array().cast("array<double>")).alias("scores"))
    return shaping.merge_slivers(c)


#: Cues of P.words as they are cut; the language's own gap between words.
CUT = REPAIRED + """,
lg as (select *, case when language in ('ja', 'km', 'lo', 'my', 'th', 'yue', 'zh') then 0 else 1 end gap, length(word) len, word[-1] in ('.', '?', '!', '…', '。', '！', '？') fin,
  avg(score) over (partition by file, seg) mean from rp),
gd as (select * from lg where coalesce(round_even(mean, 3) >= 0.2, true)),
ct as (select file, seg, i, e, case when fin and len >= 28 then null else s end since, case when fin and len >= 28 then 0 else len end chars, 0 cue, (fin and len >= 28)::int nxt from gd where i = 0
 union all select g.file, g.seg, g.i, g.e, case when z.ends then null else z.since end, case when z.ends then 0 else z.chars end, z.cue, z.cue + z.ends::int
 from ct join gd g on g.file = ct.file and g.seg = ct.seg and g.i = ct.i + 1,
 lateral (select y.*, g.fin and y.chars >= 28 ends from (select v.cut, ct.nxt + v.cut::int cue, case when ct.since is not null and not v.cut then ct.chars + g.gap + g.len else g.len end chars, case when ct.since is not null and not v.cut then ct.since else g.s end since
   from (select ct.since is not null and (g.s - ct.e >= 0.6 or g.e - ct.since > 6.0 or ct.chars + g.gap + g.len > 84) cut) v) y) z),
ru as (select file, seg, cue, min(s) s, arg_max(gd.e, i) e, string_agg(word, ' ' order by i) t, coalesce(sum(score), 0) total, count(score) n from gd join ct using (file, seg, i) group by file, seg, cue)"""
SHAPED = CUT + """,
b as (select file, row_number() over (partition by file order by seg, cue) rn, s, e, t, total, n from ru),
m as (select file, rn, 0 pos, s, e, t, total, n from b where rn = 1 union all
 select b.file, b.rn, m.pos + (not j)::int, case when j then m.s else b.s end, b.e, case when j then m.t || ' ' || b.t else b.t end, case when j then m.total else 0 end + b.total, case when j then m.n else 0 end + b.n
 from m join b on b.file = m.file and b.rn = m.rn + 1, lateral (select (b.e - b.s < 0.7 or length(b.t) < 12) and b.s - m.e < 0.6 and length(m.t || ' ' || b.t) <= 84 and b.e - m.s <= 6.0 j)),
fl as (select file, pos, arg_max(s, rn) s, arg_max(e, rn) e, arg_max(t, rn) t, max_by(case when n > 0 then round_even(total / n, 3) end, rn) sc from m group by file, pos),
ld as (select *, least(0.04::double, greatest(0.0::double, (s - coalesce(lag(e) over w, 0.0::double)) / 2)) l from fl window w as (partition by file order by pos)), ps as (select *, greatest(0.0::double, s - l) p from ld),
nx as (select *, lead(p) over (partition by file order by pos) nx, case when e + 0.04::double - p < 1.0 then p + 1.0::double else e + 0.04::double end e1 from ps), en as (select *, least(e1, nx) e2 from nx)"""


@query(SHAPED + " select file, (pos + 1)::int idx, round_even(p * 1000, 0)::bigint start_ms, round_even(case when e2 <= p then p + 0.001::double else e2 end * 1000, 0)::bigint end_ms, md5(t) digest, coalesce(sc < 0.5, false) low_confidence from en")
def shape_cues(spark, sf_dir):
    """The whole of shaping; in the stand-in tables no language is written without spaces."""
    return shaping.shape_cues(P.words(spark, sf_dir)).select("file", "idx", "start_ms", "end_ms", F.md5("text").alias("digest"), "low_confidence")

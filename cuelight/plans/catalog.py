"""Every registered query of the timed-text operators, with its SQL.

A query is (spark, sf_dir) -> DataFrame over whole tables; its SQL, where SQL can
say it, runs on the same tables in DuckDB and names the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import fit, jobs, levels, qc, shaping, speakers, timeline, verify
from cuelight.plans import proxies as P
from cuelight.plans.proxies import CUES, TAKES
from cuelight.sources import srt, tables

_queries: dict = {}
_sql: dict[str, str] = {}

# Pieces of SQL
SP = r"[\s\p{Z}]"
STRIP = lambda x: rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"
TOKENS = lambda x: f"list_filter(string_split_regex(coalesce({x}, ''), '{SP}+'), lambda t: t <> '')"
SYLLABLES = lambda x: rf"len(list_filter({TOKENS(x)}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]')))::int"
DIGIT = lambda x: rf"regexp_matches(coalesce({x}, ''), '\p{{Nd}}')"
MARKUP = lambda x: r"regexp_replace(coalesce(" + x + r", ''), '<[^>]+>|\{[^}]+\}', '', 'g')"
LIST = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
BUDGET = "greatest(2, floor((end_ms - start_ms) * 6.0 / 1000)::int)"
FIT = lambda x: f"{SYLLABLES(x)} syllables, {BUDGET} budget, {SYLLABLES(x)}::double / {BUDGET} ratio, {DIGIT(x)} digits"
FOLD = lambda x: f"lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D')))"
TIME = lambda ms: f"lpad(({ms} // 3600000)::varchar, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::varchar, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::varchar, 2, '0') || ',' || lpad(({ms} % 1000)::varchar, 3, '0')"


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- fit -----------------------------------------------------------------


@query(CUES + f""", f as (select job_id, {FIT('source_text')} from cues)
select job_id, count(*) cues, count(*) filter (ratio > 1.1) over_budget, count(*) filter (digits) with_digits, count(*) filter (digits or ratio > 1.1) targets, max(ratio) worst_ratio from f group by job_id""")  # fmt: skip
def cue_fit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.report(fit.analyse(P.cues(spark, sf_dir)))


@query(f"select doc_id, {SYLLABLES('text')} syllables, {DIGIT('text')} digits from documents")
def script_syllables(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.syllables(F.col("text")).alias("syllables"), T.has_digit(F.col("text")).alias("digits"))


REWRITTEN = f"array_to_string(({TOKENS('source_text')})[1:{BUDGET}], ' ')"


@query(CUES + f""", b as (select *, {FIT('source_text')} from cues), a0 as (select * exclude (syllables, budget, ratio, digits), case when ratio > 1.1 or digits then {REWRITTEN} else source_text end final_text from b),
a as (select *, {FIT('final_text')} from a0)
select b.job_id, count(*) lines_considered, count(*) filter (b.ratio > 1.1) lines_over_budget, max(b.ratio) worst_ratio_before, count(*) filter (a.final_text <> a.source_text) lines_rewritten, max(a.ratio) worst_ratio_after,
  count(*) filter (a.ratio > 1.1) still_over_budget from b join a using (job_id, idx) group by b.job_id""")  # fmt: skip
def fit_summary(spark, sf_dir):
    before = fit.analyse(P.cues(spark, sf_dir))
    short = F.array_join(F.slice(T.tokens(F.col("source_text")), F.lit(1), F.col("budget")), " ")
    after = before.withColumn("final_text", F.when(F.col("target"), short).otherwise(F.col("source_text"))).select("job_id", "source_text", "final_text", "start_ms", "end_ms")
    return fit.adapt_summary(before, fit.analyse(after, "final_text"))


@query(CUES + f""", b as (select job_id, idx, source_text o, array_to_string(list_reverse({TOKENS('source_text')})[1:3], ' ') c, {BUDGET} budget from cues)
select job_id, idx, case when greatest(0, {SYLLABLES('c')} - budget) <= greatest(0, {SYLLABLES('o')} - budget) then c else o end best from b""")  # fmt: skip
def best_rewrite(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    other = F.array_join(F.slice(F.reverse(T.tokens(F.col("source_text"))), 1, 3), " ")
    return c.select("job_id", "idx", fit.best_rewrite(F.col("source_text"), other, fit.budget(F.col("end_ms") - F.col("start_ms"))).alias("best"))


@query(CUES + f""", b as (select job_id, idx, {FIT('source_text')}, coalesce(source_text, '') t from cues)
select job_id, string_agg('[' || idx || '] budget ' || budget || ' syllables (currently ' || syllables || '): ' || t, chr(10) order by idx) prompt from b where ratio > 1.1 or digits group by job_id""")  # fmt: skip
def rewrite_prompt(spark, sf_dir):
    return jobs.rewrite_prompt(fit.analyse(P.cues(spark, sf_dir)))


# --- scalar functions ------------------------------------------------------

VIET = f"regexp_matches(coalesce(text, ''), '[{T.SYLLABIC}{T.SYLLABIC.upper()}]')"


@query(f"select doc_id, round(case when {VIET} then greatest(0.6, 0.25 + {SYLLABLES('text')} / 6.0::double) else greatest(0.8, 0.35 + length(coalesce(text, '')) / 15.5::double) end, 6) as seconds from documents")
def spoken_duration(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", F.round(T.natural_seconds(F.col("text")), 6).alias("seconds"))


SPELL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.DIGIT_WORDS.items()) + "}"
PLAIN_WORDS = lambda x: rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g')"
SCRIPT_WORDS = lambda x: f"flatten(list_transform({TOKENS(PLAIN_WORDS(x))}, lambda t: case when regexp_full_match(t, '[0-9]{{1,2}}') then list_transform(string_split(t, ''), lambda d: {SPELL}[d]) else [t] end))"


@query(f"select doc_id, len({SCRIPT_WORDS('text')})::int n, md5(array_to_string({SCRIPT_WORDS('text')}, ' ')) digest from documents")
def token_expand(spark, sf_dir):
    w = T.script_words(F.col("text"))
    return P.read(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"select doc_id, md5({FOLD('text')}) digest from documents")
def tone_fold(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(T.strip_tones(F.col("text")))).alias("digest"))


@query(f"select page_id, md5({MARKUP('html')}) digest, length({MARKUP('html')})::int n from pages")
def markup_strip(spark, sf_dir):
    clean = T.strip_markup(F.col("html"))
    return P.read(spark, sf_dir, "pages").select("page_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


LINES = "(select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents)"


@query(rf"select doc_id, count(*) n_lines, count(*) filter (regexp_full_match(regexp_replace(line, '[^\p{{L}}]', '', 'g'), '\p{{Lu}}+')) shouted from {LINES} group by doc_id")
def shouted_lines(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_shouted(F.col("line"))).alias("shouted"))


@query("with n as (select doc_id, case doc_id % 5 when 0 then lang when 1 then 'Chinese' when 2 then ' AUTO ' when 3 then '' else 'vietnamese' end name from documents) select doc_id, name, case when trim(lower(name)) in ('', 'auto', 'auto-detect', 'detect') then null when lower(name) = 'chinese' then 'zh' when lower(name) = 'vietnamese' then 'vi' else lower(name) end code from n")
def lang_resolve(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, F.col("lang")).when(F.col("doc_id") % 5 == 1, "Chinese").when(F.col("doc_id") % 5 == 2, " AUTO ").when(F.col("doc_id") % 5 == 3, "").otherwise("vietnamese")
    return P.read(spark, sf_dir, "documents").select("doc_id", name.alias("name"), T.language_code(name).alias("code"))


ERRORS = "(select event_id, case event_id % 7 when 0 then 503 when 1 then 404 end code, case event_id % 5 when 0 then '503 UNAVAILABLE High Demand' when 1 then 'bad JSON' when 2 then 'RESOURCE_EXHAUSTED' else event_type end message from events)"


@query(f"select event_id, coalesce(code in (429, 500, 502, 503, 504), false) or regexp_matches(lower(message), '{'|'.join(T.TRANSIENT_MARKS)}') transient, left(message, 9) short from {ERRORS}")
def error_class(spark, sf_dir):
    k = F.col("event_id")
    e = P.read(spark, sf_dir, "events").select("event_id", F.when(k % 7 == 0, 503).when(k % 7 == 1, 404).alias("code"), F.when(k % 5 == 0, "503 UNAVAILABLE High Demand").when(k % 5 == 1, "bad JSON").when(k % 5 == 2, "RESOURCE_EXHAUSTED").otherwise(F.col("event_type")).alias("message"))
    return e.select("event_id", T.is_transient(F.col("code"), F.col("message")).alias("transient"), T.clip_error(F.col("message"), 9).alias("short"))


@query("select event_id, map_entries(map_from_entries(list_filter([{'k': 'temperature', 'v': case when event_id % 2 = 0 then '0' end}, {'k': 'top_k', 'v': event_id::varchar}], lambda e: e.v is not null))) as e from events".replace("map_entries(map_from_entries(", "array_to_string(list_transform(").replace(")) as e", ", lambda e: e.k || '=' || e.v), ',') settings"))
def settings_whitelist(spark, sf_dir):
    k = F.col("event_id")
    m = F.create_map(F.lit("temperature"), F.when(k % 2 == 0, "0"), F.lit("voice"), F.lit("x"), F.lit("top_k"), k.cast("string"))
    kept = F.map_entries(T.model_settings(m))
    return P.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"))


@query("select event_id, (event_id % 6 + 1)::int attempt, [5, 15, 45, 90][event_id % 6 + 1]::int wait_s, list_sum([0, 5, 15, 45, 90][1:least(event_id % 6 + 1, 5)])::int total_s from events")
def backoff_schedule(spark, sf_dir):
    return jobs.backoff(P.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6 + 1).cast("int").alias("attempt")))


# --- cue tables ------------------------------------------------------------


@query(CUES + rf"select job_id, idx, not regexp_matches(coalesce(captioned, ''), '(?s)^{SP}*[\(\[\{{].*[\)\]\}}]{SP}*$') or kind = 'tts' spoken from cues")
def caption_split(spark, sf_dir):
    c = P.cues(spark, sf_dir).withColumn("read_captions", F.lit(None).cast("boolean"))
    return jobs.captions(c, "captioned").select("job_id", "idx", "spoken")


@query(CUES + "select job_id, idx, status = 'rerolled' or coalesce(audio_path, '') = '' render, status in ('rerolled', 'pending', 'failed') or coalesce(audio_path, '') = '' studio_render from cues")
def resume_partition(spark, sf_dir):
    c = jobs.resumed(P.cues(spark, sf_dir))
    return c.select("job_id", "idx", "render", jobs.needs_render(F.col("status"), F.col("audio_path"), True).alias("studio_render"))


@query(CUES + rf"select job_id, count(*) \"rows\", bool_and({STRIP('coalesce(answer, \'\')')} <> '') and count(*) = max(idx) + 1 complete from cues group by job_id".replace('\\"', '"').replace("\\'", "'"))
def transcript_complete(spark, sf_dir):
    c = P.cues(spark, sf_dir).withColumn("transcript_text", F.col("answer"))
    j = c.groupBy("job_id").agg((F.max("idx") + 1).alias("total_cues"))
    return qc.transcript_complete(c, j)


@query(CUES + "select job_id, idx, voice, ((row_number() over (partition by job_id, voice order by idx) - 1) // 8)::bigint batch from cues")
def render_batches(spark, sf_dir):
    return jobs.render_batches(P.cues(spark, sf_dir)).select("job_id", "idx", "voice", "batch")


@query(CUES + """, n as (select job_id, idx, row_number() over (partition by job_id order by idx) - 1 rn, '[' || idx || '] ' || coalesce(source_text, '') l from cues),
b as (select distinct job_id, rn // 5 batch from n)
select b.job_id, b.batch::bigint batch, count(*) filter (rn // 5 = b.batch) n, coalesce(string_agg(l, chr(10) order by rn) filter (rn // 5 = b.batch), '') lines, coalesce(string_agg(l, chr(10) order by rn) filter (rn < b.batch * 5), '') before,
  coalesce(string_agg(l, chr(10) order by rn) filter (rn >= b.batch * 5 + 5), '') "after"
from b join n on n.job_id = b.job_id and rn >= b.batch * 5 - 2 and rn < b.batch * 5 + 7 group by b.job_id, b.batch""")  # fmt: skip
def context_window(spark, sf_dir):
    return jobs.context_windows(P.cues(spark, sf_dir), size=5)


@query(CUES + rf"select job_id, idx from cues where {STRIP('coalesce(answer, repeat(chr(32), 1))')} = ''")
def missing_lines(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    return jobs.missing_lines(c.select("job_id", "idx"), c.select("job_id", "idx", F.col("answer").alias("text")))


@query(CUES + "select job_id, idx, ((row_number() over (partition by job_id order by idx) - 1) // 5)::bigint chunk from cues")
def insert_batches(spark, sf_dir):
    return tables.batches(P.cues(spark, sf_dir), 5).select("job_id", "idx", "chunk")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def latest_upsert(spark, sf_dir):
    e = P.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return tables.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


# --- subtitles ---------------------------------------------------------------


@query(CUES + f"select job_id, idx, {TIME('start_ms')} || ' --> ' || {TIME('end_ms')} timing from cues")
def srt_format(spark, sf_dir):
    return P.cues(spark, sf_dir).select("job_id", "idx", F.concat(T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms"))).alias("timing"))


BLOCKS = f"string_agg(rn || chr(10) || {TIME('start_ms')} || ' --> ' || {TIME('end_ms')} || chr(10) || body || chr(10), chr(10) order by rn)"


@query(CUES + f", n as (select *, row_number() over (partition by job_id order by idx) rn, coalesce(case when {STRIP('answer')} <> '' then answer end, source_text) body from cues) select job_id, md5({BLOCKS}) digest from n group by job_id")
def srt_export(spark, sf_dir):
    c = srt.render(P.cues(spark, sf_dir), "answer", "source_text", file="job_id")
    return c.select("job_id", F.md5("content").alias("digest"))


@query(CUES + f", n as (select *, row_number() over (partition by job_id order by start_ms, idx) rn, {STRIP(MARKUP('labelled'))} t from cues where {STRIP(MARKUP('labelled'))} <> '') select job_id, rn::int idx, start_ms, end_ms, regexp_replace(t, '\\s*\\n\\s*', ' ', 'g') text from n")
def srt_parse(spark, sf_dir):
    files = srt.render(P.cues(spark, sf_dir), "labelled", file="job_id").select(F.col("job_id").alias("file"), "content")
    return srt.parse(files).select(F.col("file").alias("job_id"), "idx", "start_ms", "end_ms", "text")


# --- speakers ----------------------------------------------------------------

LABEL_SQL = []
for _p in (speakers.BRACKET, speakers.COLON):
    LABEL_SQL.append((STRIP(f"regexp_extract(c, '{_p}', 1)"), STRIP(f"regexp_extract(c, '{_p}', 2)")))
PLAUSIBLE = lambda x: (
    rf"({x} <> '' and length({x}) <= 25 and not regexp_matches({x}, '[.!?;,]') and regexp_matches({x}, '\p{{L}}') and {STRIP(FOLD(x))} not in {LIST(speakers.folded_leads())}"
    + "".join(f" and length(replace({x}, '{a}', '')) = length(replace({x}, '{b}', ''))" for a, b in ("()", "[]", "{}"))
    + f" and len({TOKENS(x)}) <= 5)"
)
ASSIGNED = CUES + (
    f", c as (select *, {STRIP(MARKUP('labelled'))} c from cues), m as (select *, {LABEL_SQL[0][0]} l1, {LABEL_SQL[0][1]} s1, {LABEL_SQL[1][0]} l2, {LABEL_SQL[1][1]} s2 from c),"
    f" g as (select *, case when s1 <> '' and {PLAUSIBLE('l1')} then l1 when s2 <> '' and {PLAUSIBLE('l2')} then l2 when regexp_matches(labelled, '(?i)</?i>') and c <> '' then '(voiceover)' end label,"
    f" case when s1 <> '' and {PLAUSIBLE('l1')} then s1 when s2 <> '' and {PLAUSIBLE('l2')} then s2 else c end rest from m),"
    r" h as (select *, label is not null and (count(label) over (partition by job_id, label) >= 2 or regexp_full_match(regexp_replace(label, '[^\p{L}]', '', 'g'), '\p{Lu}+') or label = '(voiceover)') holds from g),"
    " a as (select job_id, idx, labelled, case when holds then label end speaker, case when holds then rest else c end spoken from h)"
)


@query(ASSIGNED + " select job_id, idx, speaker, spoken from a")
def speaker_assign(spark, sf_dir):
    return speakers.assign(P.cues(spark, sf_dir), text="labelled").select("job_id", "idx", "speaker", "spoken")


@query(ASSIGNED + ", n as (select *, count(*) over (partition by job_id) n from a) select job_id, speaker, count(*) lines, 100.0::double * count(*) / max(n) share, min(idx) \"first\" from n where speaker is not null group by job_id, speaker")
def speaker_cast(spark, sf_dir):
    return speakers.cast(speakers.assign(P.cues(spark, sf_dir), text="labelled"))


@query(ASSIGNED + ", n as (select job_id, speaker, count(*) k, min(idx) f from a where speaker is not null group by job_id, speaker) select job_id, count(*) || ' speaker(s): ' || string_agg(speaker || ' (' || k || ')', ', ' order by k desc, f, speaker) as \"cast\" from n group by job_id")
def speaker_describe(spark, sf_dir):
    return speakers.describe(speakers.cast(speakers.assign(P.cues(spark, sf_dir), text="labelled")))


@query(ASSIGNED + " select job_id, idx, spoken line from a")
def strip_label(spark, sf_dir):
    a = speakers.assign(P.cues(spark, sf_dir), text="labelled")
    return a.select("job_id", "idx", speakers.strip_label(F.col("labelled"), F.col("speaker")).alias("line"))


# --- timeline ----------------------------------------------------------------

PLACED = CUES + """, r as (select *, coalesce(sum(clip_ms + 60) over (partition by job_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint p from cues where clip_ms > 0),
pl as (select *, p + greatest(0, max(start_ms - p) over (partition by job_id order by idx))::bigint placed_ms from r), placed as (select *, placed_ms + clip_ms placed_end_ms from pl)"""


@query(PLACED + " select job_id, idx, placed_ms, placed_end_ms, placed_ms - start_ms drift_ms from placed")
def timeline_placement(spark, sf_dir):
    return timeline.drift(timeline.place(P.cues(spark, sf_dir))).select("job_id", "idx", "placed_ms", "placed_end_ms", "drift_ms")


@query(PLACED + " select job_id, idx, p placed_ms from placed")
def timeline_tts(spark, sf_dir):
    return timeline.place(P.cues(spark, sf_dir), follow=True).select("job_id", "idx", "placed_ms")


@query(PLACED + """, e as (select *, max(placed_end_ms) over (partition by job_id) e, max(end_ms) over (partition by job_id) s from placed), f as (select *, case when e > s and s > 0 then e::double / s else 1.0::double end speed from e)
select job_id, idx, round(speed, 9) speed, round(case when speed > 1.001 then placed_ms / speed else placed_ms end, 6)::double fit_ms from f""")  # fmt: skip
def timeline_fit(spark, sf_dir):
    t = timeline.fit_to_timecode(timeline.place(P.cues(spark, sf_dir)))
    return t.select("job_id", "idx", F.round("speed", 9).alias("speed"), F.round("fit_ms", 6).alias("fit_ms"))


@query(CUES + "select job_id, count(*) clips, (sum(clip_ms) + 220 * (count(*) - 1))::bigint joined_ms from cues where clip_ms > 0 group by job_id")
def clip_join_length(spark, sf_dir):
    return timeline.joined_length(P.cues(spark, sf_dir))


MIX = "s as (select label job_id, (vec_id % 32) + unnest(range(0, len(embedding)))::bigint pos, unnest(embedding)::double x from embeddings), t as (select job_id, pos, sum(x) x from s group by all)"


@query(f"with {MIX}, p as (select job_id, max(abs(x)) peak from t group by job_id) select t.job_id, pos, round(x / greatest(1.0, peak), 6) sample from t join p on t.job_id is not distinct from p.job_id")
def timeline_mix(spark, sf_dir):
    e = P.read(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), (F.col("vec_id") % 32).alias("at"), F.col("embedding").alias("samples"))
    return timeline.mix_samples(e).select("job_id", "pos", F.round("sample", 6).alias("sample"))


# --- levels ------------------------------------------------------------------

SQ = "list_sum(list_transform({0}, lambda x: x::double * x::double))"


@query(f"select vec_id, round(greatest(-99, 20 * log10(sqrt({SQ.format('embedding')} / len(embedding)))), 6) level from embeddings")
def level_dbfs(spark, sf_dir):
    return P.read(spark, sf_dir, "embeddings").select("vec_id", F.round(T.dbfs(F.col("embedding")), 6).alias("level"))


@query(f"select vec_id, unnest(range(0, 4))::int hop, unnest(list_transform(range(0, 4), lambda k: round(sqrt({SQ.format('embedding[k * 20 + 1:k * 20 + 20]')} / 20), 6))) rms from embeddings")
def hop_rms(spark, sf_dir):
    e = P.read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(levels.hops(F.col("embedding"), 20)).alias("hop", "r")).select("vec_id", "hop", F.round("r", 6).alias("rms"))


HOPS = f"(select vec_id, list_transform(range(0, 4), lambda k: sqrt({SQ.format('embedding[k * 20 + 1:k * 20 + 20]')} / 20)) r from embeddings)"


@query(f"select vec_id, round(case when len(s) > 0 then least(power(10, 0.6), 0.1 / greatest(list_sum(s) / len(s), 1e-9)) else 1.0 end, 6)::double gain from (select vec_id, list_filter(r, lambda x: x > power(10, -45 / 20.0)) s from {HOPS})")
def speech_normalise(spark, sf_dir):
    e = P.read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(levels.speech_gain(levels.hops(F.col("embedding"), 20)), 6).alias("gain"))


@query(f"""with l as (select vec_id, greatest(-120, 20 * log10(sqrt({SQ.format('embedding')} / len(embedding)))) a, greatest(-120, 20 * log10(sqrt({SQ.format('list_transform(embedding, lambda x: x / 4)')} / len(embedding)))) b from embeddings)
select vec_id, round(a - b, 6) removed_db, b <= -50 or a - b >= 20 thin from l""")  # fmt: skip
def bed_level(spark, sf_dir):
    quiet = F.transform("embedding", lambda x: x / F.lit(4).cast("float"))
    e = P.read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(levels.level_delta(F.col("embedding"), quiet), 6).alias("removed_db"), levels.thin_bed(T.dbfs(quiet, -120.0), T.dbfs(F.col("embedding"), -120.0)).alias("thin"))


# --- verification --------------------------------------------------------------


@query(TAKES + ", d as (select *, min(case when coverage >= 1 and similarity >= 0.9 then attempt end) over (partition by cue_id) f from takes), r as (select *, row_number() over (partition by cue_id order by coverage desc, similarity desc, attempt, part, supp, price) rn from d where f is null or attempt <= f) select cue_id, attempt, coverage, similarity, part, supp from r where rn = 1")
def best_take(spark, sf_dir):
    t = verify.needed_attempts(P.takes(spark, sf_dir), ["cue_id"], (F.col("coverage") >= 1) & (F.col("similarity") >= 0.9))
    best = verify.best_take(t, ["cue_id"], [F.desc("coverage"), F.desc("similarity"), F.col("attempt"), F.col("part"), F.col("supp"), F.col("price")])
    return best.select("cue_id", "attempt", "coverage", "similarity", "part", "supp")


@query(TAKES + ", r as (select *, row_number() over (partition by cue_id order by coverage desc, similarity desc, attempt, part, supp, price) rn from takes) select cue_id, case when clip_ms <= 0 then 'qc_fail' when coverage >= 1 then 'qc_pass' when coverage >= 0.9 then 'review' else 'qc_fail' end status, case when clip_ms <= 0 then 1.0::double else round_even(1 - coverage, 4) end cer, case when clip_ms <= 0 then 'no audio' when coverage < 1 then 'missing: w' || part % 7 || case when part % 2 = 0 then ', w' || supp % 5 else '' end when part % 3 = 0 then 'tone check: t' || part % 4 end note from r where rn = 1")
def cue_verdict(spark, sf_dir):
    best = verify.best_take(P.takes(spark, sf_dir), ["cue_id"], [F.desc("coverage"), F.desc("similarity"), F.col("attempt"), F.col("part"), F.col("supp"), F.col("price")])
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    missing = F.array_compact(F.array(F.when(F.col("coverage") < 1, name("w", "part", 7)), F.when((F.col("coverage") < 1) & (F.col("part") % 2 == 0), name("w", "supp", 5))))
    tonal = F.array_compact(F.array(F.when(F.col("part") % 3 == 0, name("t", "part", 4))))
    return verify.verdict(best.withColumns({"missing": missing, "tonal": tonal})).select("cue_id", "status", "cer", "note")


WORDS_OF = lambda x: f"(select job_id, idx, unnest({SCRIPT_WORDS(x)}) w from cues)"


@query(CUES + f""", a as (select job_id, w, count(*) n from {WORDS_OF('source_text')} group by all), b as (select job_id, w, count(*) n from {WORDS_OF('case when idx % 2 = 0 then source_text else answer end')} group by all)
select a.job_id, sum(a.n)::bigint wanted, sum(least(a.n, coalesce(b.n, 0)))::bigint matched from a left join b on a.job_id = b.job_id and a.w = b.w group by a.job_id""")  # fmt: skip
def coverage_exact(spark, sf_dir):
    c = P.cues(spark, sf_dir).withColumn("heard", F.when(F.col("idx") % 2 == 0, F.col("source_text")).otherwise(F.col("answer")))
    return verify.exact_coverage(c, "source_text", "heard", "job_id")


@query()
def coverage_fuzzy(spark, sf_dir):
    """SQL has no such likeness of words; tests compare with the greedy rule, word by word, on random texts."""
    heard = F.regexp_replace(F.reverse(F.reverse(F.col("source_text"))), "e", "a")
    c = verify.coverage(P.cues(spark, sf_dir).withColumn("heard", heard), "source_text", "heard")
    return c.select("job_id", "idx", F.round("coverage", 6).alias("coverage"), F.size("missing").alias("n_missing"), F.size("tonal").alias("n_tonal"))


@query("""with v as (select vec_id, label, embedding e from embeddings), r as (select label, arg_min(e, vec_id) e from v group by label)
select vec_id, round(list_dot_product(v.e::double[], r.e::double[]) / (sqrt(list_dot_product(v.e::double[], v.e::double[])) * sqrt(list_dot_product(r.e::double[], r.e::double[]))), 6) similarity,
 list_dot_product(v.e::double[], r.e::double[]) / (sqrt(list_dot_product(v.e::double[], v.e::double[])) * sqrt(list_dot_product(r.e::double[], r.e::double[]))) < 0.9 warn from v join r on v.label is not distinct from r.label""")  # fmt: skip
def voice_similarity(spark, sf_dir):
    e = P.read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref")).withColumnRenamed("label", "_l")
    s = T.cosine(F.col("embedding"), F.col("ref"))
    return e.join(ref, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", F.round(s, 6).alias("similarity"), (s < 0.9).alias("warn"))


# --- roll-ups ------------------------------------------------------------------


@query(PLACED + """, q as (select job_id, count(*) n, max(placed_end_ms) e from placed group by job_id), c as (select job_id, avg(case when idx % 5 > 0 then (idx % 5) / 8.0::double end) cer, count(*) n, count(*) filter (status in ('review', 'qc_fail', 'failed')) bad, max(end_ms) s, max(kind) kind from cues group by job_id)
select c.job_id, coalesce(round_even((1 - cer) * 100, 2), 0.0) word_coverage, c.n cues_total, coalesce(q.n, 0) cues_spoken, bad cues_needing_review, coalesce(q.e, 0)::bigint audio_ms, case when kind <> 'tts' then greatest(0, coalesce(q.e, 0) - s)::bigint end overrun_ms from c left join q using (job_id)""")  # fmt: skip
def render_qc(spark, sf_dir):
    c = P.cues(spark, sf_dir)
    rated = c.withColumn("cer", F.when(F.col("idx") % 5 > 0, (F.col("idx") % 5) / 8)).withColumn("status", F.when(F.col("status") == "failed", "qc_fail").otherwise(F.col("status")))
    return qc.render_qc(rated, timeline.place(c))


@query(CUES + "select job_id, speaker, count(*) lines, arg_max(voice, idx) voice from cues where speaker <> '' group by job_id, speaker")
def cast_rollup(spark, sf_dir):
    return qc.cast_rollup(P.cues(spark, sf_dir))


@query(CUES + "select job_id, count(*) cues_total, count(answer) cues_translated, count(*) - count(answer) cues_untranslated, count(*) filter (status = 'failed') cues_needing_review, max(end_ms) srt_ms from cues group by job_id")
def transcribe_qc(spark, sf_dir):
    c = P.cues(spark, sf_dir).withColumn("translated_at", F.col("answer")).withColumn("status", F.when(F.col("status") == "failed", "review").otherwise(F.col("status")))
    return qc.transcribe_qc(c)


@query(CUES + "select job_id, count(*) chunks, count(*) filter (status = 'qc_pass') rendered, count(*) filter (status = 'failed') failed, coalesce(sum(clip_ms) filter (status = 'qc_pass'), 0)::bigint audio_ms from cues group by job_id")
def studio_summary(spark, sf_dir):
    c = P.cues(spark, sf_dir).select("job_id", F.when(F.col("status") == "qc_pass", "done").otherwise(F.col("status")).alias("status"), F.col("clip_ms").alias("duration_ms"))
    return qc.studio_summary(c)


@query(f"""with f as (select vec_id % 40 voice, sqrt({SQ.format('embedding')} / len(embedding)) rms from embeddings), c as (select voice, quantile_cont(rms, 0.6) hi, quantile_cont(rms, 0.2) lo from f group by voice),
g as (select f.voice, avg(rms) filter (rms > hi) loud, avg(rms) filter (rms < lo) quiet from f join c using (voice) group by f.voice) select voice, round(loud, 6) loud, round(quiet, 6) quiet, round(case when quiet is not null and loud > 0 then 20 * log10(loud / greatest(quiet, 1e-9)) else 0.0 end, 6) snr_db from g""")  # fmt: skip
def voice_qc(spark, sf_dir):
    f = P.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("voice"), T.rms(F.col("embedding")).alias("rms"))
    return qc.voice_levels(f).select("voice", *[F.round(c, 6).alias(c) for c in ("loud", "quiet", "snr_db")])


@query("with s as (select vec_id voice, unnest(range(0, len(embedding))) * 100 hz, abs(unnest(embedding))::double p from embeddings), r as (select *, sum(p) over (partition by voice order by hz) r, sum(p) over (partition by voice) a from s) select voice, min(hz)::bigint hz from r where a > 1e-9 and round(r / a, 9) >= 0.95 group by voice")
def voice_bandwidth(spark, sf_dir):
    s = P.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("voice"), F.posexplode("embedding").alias("k", "x"))
    return qc.bandwidth(s.select("voice", (F.col("k") * 100).cast("long").alias("hz"), F.abs("x").cast("double").alias("power")), 0.95)


WARN = "list_filter([{0}], lambda x: x is not null)"


@query("select vec_id, array_to_string(" + WARN.format("case when vec_id % 30 < 3 then 'short' when vec_id % 30 > 20 then 'long' when vec_id % 30 < 5 or vec_id % 30 > 12 then 'not ideal' end, case when abs(embedding[1]) >= 0.2 then 'clipping' end, case when vec_id % 17 < 15 then 'noisy' end, case when vec_id % 9 < 6 then 'muffled' end") + ", ',') warnings, array_to_string(" + WARN.format("case when vec_id % 30 < 2.5 then 'under 3s' end, case when vec_id % 30 > 12 then 'over 8s' end, case when vec_id % 3 > 1 then (vec_id % 3)::varchar || ' channels' end, case when vec_id % 50 > 35 then 'very quiet' end") + ", ',') reference from embeddings")
def voice_verdict(spark, sf_dir):
    k = F.col("vec_id")
    w = qc.voice_warnings(k % 30, F.abs(F.get("embedding", F.lit(0))).cast("double"), k % 17, (k % 9) * 1000, F.lit(None).cast("int"), clip=0.2)
    r = qc.reference_warnings(k % 30, k % 3, -(k % 50))
    return P.read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(w, ",").alias("warnings"), F.array_join(r, ",").alias("reference"))


@query("select event_id, case when event_id % 2 = 0 and event_id % 3 = 0 then 'mix ducked: separation off' when event_id % 2 = 0 then 'mix ducked: no separation tool' when event_id % 5 > 1 then 'voices removed' when event_id % 7 = 0 then 'bed silent: no blend' else 'bed blended at ' || (-(event_id % 7) * 5)::int || ' dB' end note from events")
def mux_note(spark, sf_dir):
    k = F.col("event_id")
    return P.read(spark, sf_dir, "events").select("event_id", qc.mux_note(k % 2 == 1, k % 3 != 0, k % 5 <= 1, F.when(k % 7 != 0, -(k % 7) * 5)).alias("note"))


# --- queues and presence ---------------------------------------------------------

QUEUE = "(select o_orderkey id, o_custkey owner_id, o_orderpriority priority, o_orderdate created_at, case o_orderstatus when 'O' then 'queued' when 'F' then 'done' else 'rendering' end status from orders)"


def _queue(spark, sf_dir):
    o = P.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("rendering").alias("status"))


@query(f"select id, priority from {QUEUE} where status = 'queued' order by priority nulls last, created_at nulls last, id limit 1")
def claim_next(spark, sf_dir):
    return jobs.claim_next(_queue(spark, sf_dir)).select("id", "priority")


@query(f"select owner_id, id from (select *, row_number() over (partition by owner_id order by priority nulls last, created_at nulls last, id) rn from {QUEUE} where status = 'queued') where rn = 1")
def claim_per_owner(spark, sf_dir):
    return jobs.claim_next(_queue(spark, sf_dir), ["owner_id"]).select("owner_id", "id")


NOW = "(select max(ts) from events)"


@query("with g as (select event_id, user_id, epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', lag(ts) over (partition by user_id order by ts)))::bigint gap_s from events) select event_id, user_id, gap_s from g where gap_s > 900")
def stalled_jobs(spark, sf_dir):
    return jobs.gaps(P.read(spark, sf_dir, "events"), "user_id", "ts", 900).select("event_id", "user_id", "gap_s")


STATUS = "case event_type when 'purchase' then 'stopped' when 'click' then 'busy' else 'idle' end"


@query(f"""with b as (select user_id, ts, {STATUS} status from events), l as (select user_id, count(*) beats, max({{'ts': ts, 's': status}}) m from b group by user_id)
select user_id, beats, m.s status, epoch(date_trunc('second', {NOW}))::bigint - epoch(date_trunc('second', m.ts))::bigint age_s,
 case when m.s = 'stopped' then false when m.s = 'busy' then epoch(date_trunc('second', {NOW}))::bigint - epoch(date_trunc('second', m.ts))::bigint <= 180 else epoch(date_trunc('second', {NOW}))::bigint - epoch(date_trunc('second', m.ts))::bigint <= 75 end alive from l""")  # fmt: skip
def worker_presence(spark, sf_dir):
    e = P.read(spark, sf_dir, "events")
    beats = e.select("user_id", "ts", F.when(F.col("event_type") == "purchase", "stopped").when(F.col("event_type") == "click", "busy").otherwise("idle").alias("status"))
    now = e.agg(F.max("ts").alias("_now"))
    last = jobs.last_beats(beats, "user_id", "ts").join(F.broadcast(now))  # one row
    return jobs.liveness(last, F.col("_now")).select("user_id", "beats", "status", "age_s", "alive")


@query("""with n as (select user_id, ts, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) >= 1800000000 then 1 else 0 end s from events window w as (partition by user_id order by ts)),
g as (select *, sum(s) over (partition by user_id order by ts) k from n) select user_id, k::bigint "session", count(*) n, epoch_us(max(ts)) - epoch_us(min(ts)) span_us from g group by user_id, k""")  # fmt: skip
def sessions(spark, sf_dir):
    s = jobs.sessions(P.read(spark, sf_dir, "events"), "user_id", "ts", 1800)
    return s.select("user_id", "session", "n", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("span_us"))


# --- shaping ---------------------------------------------------------------------


SEGS = """
with recursive l as (select doc_id file, lang language, unnest(range(0, len(s)))::int seg, unnest(s) line from (select doc_id, lang, string_split(coalesce(text, ''), chr(10)) s from documents)),
w as (select file, language, seg, list_filter(string_split(line, ' '), lambda x: x <> '') ws from l),
x as (select file, language, seg, unnest(range(0, len(ws))) i, unnest(ws) word from w),
t as (select *, (seg * 100000 + i * 300 + i // 9 * 700)::double / 1000 s, (seg * 100000 + i * 300 + i // 9 * 700)::double / 1000 + 0.25 e, length(word) n, word[-1] in ('.', '?', '!', '…', '。', '！', '？') fin from x)"""


@query(SEGS + """,
r as (select file, seg, i, s, e, case when fin and n >= 28 then null else s end s0, e e0, case when fin and n >= 28 then 0 else n end c, 0 cue, case when fin and n >= 28 then 1 else 0 end nxt from t where i = 0
 union all select t.file, t.seg, t.i, t.s, t.e, case when z.ends then null else z.start end, t.e, case when z.ends then 0 else z.total end, z.cue, z.cue + z.ends::int
 from r join t on t.file = r.file and t.seg = r.seg and t.i = r.i + 1,
 lateral (select y.*, fin and y.total >= 28 ends from (select v.cut, r.nxt + v.cut::int cue, case when r.s0 is not null and not v.cut then r.c + 1 + t.n else t.n end total, case when r.s0 is not null and not v.cut then r.s0 else t.s end start
   from (select r.s0 is not null and (t.s - r.e0 >= 0.6 or t.e - r.s0 > 6.0 or r.c + 1 + t.n > 84) cut) v) y) z)
select file, seg, cue, count(*) n_words, (round_even(min(s) * 1000, 0))::bigint start_ms from r group by file, seg, cue""")  # fmt: skip
def word_cut(spark, sf_dir):
    cut = shaping.cut_up(P.words(spark, sf_dir, every=True).withColumn("language", F.lit("en")))
    return cut.select("file", "seg", "cue", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.bround(F.col("start") * 1000).cast("long").alias("start_ms"))


@query(SEGS + """, g as (select file, language, seg, i // 7 cue, string_agg(word, ' ' order by i) t, min(s) s, max(e) e, round_even(avg(case when (file + seg + i) % 5 <> 1 then ((file + seg) * 31 + i * 7) % 97 + 3 end) / 100.0, 3) score from t group by all)
select file, seg, cue::int cue, md5(t) digest, round_even(s * 1000, 0)::bigint start_ms, round_even(e * 1000, 0)::bigint end_ms from g""")  # fmt: skip
def cue_rollup(spark, sf_dir):
    cues = F.transform("words", lambda w, i: F.floor(i / 7).cast("int"))
    r = shaping.rolled_up(P.words(spark, sf_dir, every=True).withColumns({"language": F.lit("en"), "cues": cues}))
    return r.select("file", "seg", "cue", F.md5("text").alias("digest"), F.bround(F.col("start") * 1000).cast("long").alias("start_ms"), F.bround(F.col("end") * 1000).cast("long").alias("end_ms"))


FINAL = CUES + """, c as (select job_id, idx, start_ms / 1000.0::double s, (start_ms + least(clip_ms, 5000)) / 1000.0::double e, source_text t, case when idx % 3 > 0 then (idx % 10) / 10.0::double end score from cues),
a as (select *, least(0.04::double, greatest(0.0::double, (s - coalesce(lag(e) over w, 0.0::double)) / 2)) l from c window w as (partition by job_id order by idx)), b as (select *, greatest(0.0::double, s - l) ps from a),
d as (select *, lead(ps) over (partition by job_id order by idx) nx, case when e + 0.04::double - ps < 1.0 then ps + 1.0::double else e + 0.04::double end e1 from b), f as (select *, least(e1, nx) e2 from d), g as (select *, case when e2 <= ps then ps + 0.001::double else e2 end pe from f),
fin as (select job_id, (row_number() over (partition by job_id order by idx))::int idx, round_even(ps * 1000, 0)::bigint start_ms, round_even(pe * 1000, 0)::bigint end_ms, t text, coalesce(score < 0.5, false) low_confidence from g)"""


def _rough(spark, sf_dir):
    return P.cues(spark, sf_dir).select(F.col("job_id").alias("file"), F.col("idx").alias("pos"), (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + F.least(F.col("clip_ms"), F.lit(5000))) / 1000).alias("end"), F.col("source_text").alias("text"), F.when(F.col("idx") % 3 > 0, (F.col("idx") % 10) / 10).alias("score"))


@query(FINAL + " select job_id, idx, start_ms, end_ms, low_confidence from fin")
def cue_finalise(spark, sf_dir):
    return shaping.finalise(_rough(spark, sf_dir)).select(F.col("file").alias("job_id"), "idx", "start_ms", "end_ms", "low_confidence")


@query(FINAL + rf", v as (select *, lag(end_ms) over (partition by job_id order by idx) p from fin) select job_id, idx, array_to_string({WARN.format('''case when end_ms <= start_ms then 'length' end, case when start_ms < 0 then 'start' end, case when ''' + STRIP("coalesce(text, '')") + ''' = '' then 'text' end, case when p > start_ms then 'overlap' end''')}, ',') broken from v where end_ms <= start_ms or start_ms < 0 or {STRIP("coalesce(text, '')")} = '' or p > start_ms")
def cue_invariants(spark, sf_dir):
    v = shaping.violations(shaping.finalise(_rough(spark, sf_dir)))
    return v.select(F.col("file").alias("job_id"), "idx", F.array_join("broken", ",").alias("broken"))


from cuelight.plans import more as more  # noqa: E402  registers further queries
from cuelight.plans import timed as timed  # noqa: E402

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import jobs, levels, providers, qc, verify
from cuelight.sources import tables
from cuelight.streaming import claims, liveness


@pytest.mark.parametrize("want,heard,ratio,missing,tonal", [
    ("a b c", "a b c", 1.0, [], []), ("gặp em", "gập em", 1.0, [], ["gặp"]), ("hello world", "helo", 0.5, ["world"], []), ("a a", "a", 0.5, ["a"], []), ("", "x", 0.0, [], []), ("tám", "8", 1.0, [], []), ("testing", "testin", 1.0, [], [])])
def test_coverage(spark, want, heard, ratio, missing, tonal):
    r = verify.coverage(spark.createDataFrame([(want, heard)], "s string, h string"), "s", "h").first()
    assert (r.coverage, r.missing, r.tonal) == (ratio, missing, tonal)


def test_exact_coverage(spark):
    r = verify.exact_coverage(spark.createDataFrame([(1, "a b b c", "b b b a")], "k int, s string, h string"), "s", "h", "k").first()
    assert (r.wanted, r.matched) == (4, 3)


def test_take_ties_and_verdict(spark):
    takes = spark.createDataFrame([(1, 1, 0.9, 0.8), (1, 2, 0.9, 0.95), (1, 3, 0.9, 0.95), (2, 1, 1.0, 0.5), (2, 2, 1.0, 0.9)], "cue int, attempt int, coverage double, sim double")
    order = [F.desc("coverage"), F.desc("sim"), F.col("attempt")]
    assert {r.cue: r.attempt for r in verify.best_take(takes, ["cue"], order).collect()} == {1: 2, 2: 2}
    needed = verify.needed_attempts(takes, ["cue"], F.col("coverage") >= 1)
    assert {r.cue: r.attempt for r in verify.best_take(needed, ["cue"], order).collect()} == {1: 2, 2: 1}
    rows = spark.createDataFrame([(1, 1.0, 10, [], ["x"]), (2, 0.95, 10, ["a", "b"], []), (3, 0.5, 10, ["q"], []), (4, None, None, [], []), (5, 1.0, 0, [], [])], "k int, coverage double, clip_ms int, missing array<string>, tonal array<string>")
    got = {r.k: (r.status, r.cer, r.note) for r in verify.verdict(rows).collect()}
    assert got == {1: ("qc_pass", 0.0, "tone check: x"), 2: ("review", 0.05, "missing: a, b"), 3: ("qc_fail", 0.5, "missing: q"), 4: ("qc_fail", 1.0, "no take"), 5: ("qc_fail", 1.0, "no audio")}


def test_claim_order(spark, tmp_path):
    q = spark.createDataFrame([(1, None, 1, "queued"), (2, 1, 5, "queued"), (3, 1, 5, "queued"), (4, 0, 0, "done"), (5, 1, None, "queued")], "id int, priority int, created_at int, status string")
    assert jobs.claim_next(q).first().id == 2
    assert claims.claim(q, str(tmp_path), "w1").first().asDict() == {"id": 2, "priority": 1, "created_at": 5, "status": "compiling", "attempt": 1, "worker_label": "w1"}
    assert jobs.claim_next(q.where("status = 'x'")).count() == 0


def test_heartbeat_gaps(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = [0, 899, 899 + 900, 899 + 900 + 901]
    beats = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=s)) for s in at], "w int, ts timestamp")
    assert [r.gap_s for r in jobs.gaps(beats, "w", "ts", 900).collect()] == [901]
    j = spark.createDataFrame([(1, "rendering", t0), (2, "queued", t0), (3, "qc", t0 + dt.timedelta(minutes=10))], "id int, status string, heartbeat_at timestamp")
    assert [r.id for r in jobs.stalled(j, F.lit(t0 + dt.timedelta(minutes=16))).collect()] == [1]


def test_presence_and_kept_beats(spark):
    t0 = dt.datetime(2026, 1, 1)
    s = lambda k: t0 + dt.timedelta(seconds=k)
    beats = spark.createDataFrame([("a", s(0), "idle"), ("b", s(0), "busy"), ("c", s(90), "stopped"), ("a", s(10), "idle"), ("a", s(20), "idle")], "w string, ts timestamp, status string")
    got = {r.w: r.alive for r in jobs.presence(beats, "w", "ts", F.lit(s(100))).collect()}
    assert got == {"a": False, "b": True, "c": False}
    kept = jobs.kept_beats(beats.where("w = 'a'"), "w", "ts", 20).collect()
    assert len(kept) == 2


def test_batches_context_missing(spark):
    c = spark.createDataFrame([("j", i, f"v{i % 2}", f"t{i}") for i in range(59)], "job_id string, idx int, voice string, source_text string")
    b = jobs.render_batches(c, 8).groupBy("voice", "batch").count().collect()
    assert max(r["count"] for r in b) == 8 and len(b) == 8
    w = {r.batch: r for r in jobs.context_windows(c).collect()}
    assert [w[k].n for k in range(3)] == [25, 25, 9]
    assert w[1].before == "[23] t23\n[24] t24" and w[1].after == "[50] t50\n[51] t51" and w[0].before == "" and w[2].after == ""
    got = spark.createDataFrame([("j", 0, "x"), ("j", 1, " ")], "job_id string, idx int, text string")
    assert jobs.missing_lines(c, got).count() == 58


def test_voices_captions_presets(spark):
    v = lambda *x: spark.range(1).select(jobs.studio_voice(*[F.lit(y).cast("string") for y in x]).alias("v")).first().v
    assert (v("p", "1", "q", "2"), v("", "1", "q", "2"), v(None, None, "q", "2"), v(None, None, None, "2"), v(None, None, None, None)) == ("p", "db-1", "q", "db-2", None)
    rows = spark.createDataFrame([("(x)", None, None), ("(x)", True, None), ("(x)", None, "tts"), ("x", None, None)], "source_text string, read_captions boolean, kind string")
    assert [r.spoken for r in jobs.captions(rows).collect()] == [False, True, True, True]
    p = spark.createDataFrame([("a",), ("z",)], "preset string")
    names = spark.createDataFrame([("a",)], "name string")
    assert {r.preset: r.known for r in jobs.preset_known(p, names).collect()} == {"a": True, "z": False}
    assert all(r.known for r in jobs.preset_known(p, names.limit(0)).collect())
    e = spark.createDataFrame([(1, True, "p"), (2, False, "p"), (3, True, ""), (None, None, None)], "id int, consent_confirmed boolean, sample_path string")
    assert [r.error for r in jobs.voice_errors(e).collect()] == [None, "no consent", "no recording", "no such voice"]


def test_rollups(spark):
    c = spark.createDataFrame([("j", "subtitles", 0.0, "qc_pass", 1000), ("j", "subtitles", 0.5, "review", 2000), ("j", "subtitles", None, "pending", 3000)], "job_id string, kind string, cer double, status string, end_ms long")
    p = spark.createDataFrame([("j", 3500)], "job_id string, placed_end_ms long")
    assert tuple(qc.render_qc(c, p).first()) == ("j", 75.0, 3, 1, 1, 3500, 500)
    cast = spark.createDataFrame([("j", 1, "A", "v1"), ("j", 2, "A", None), ("j", 3, "", "v")], "job_id string, idx int, speaker string, voice string")
    assert [tuple(r) for r in qc.cast_rollup(cast).collect()] == [("j", "A", 2, "v1")]
    t = spark.createDataFrame([("j", "x"), ("j", " ")], "job_id string, transcript_text string")
    assert not qc.transcript_complete(t, spark.createDataFrame([("j", 2)], "job_id string, total_cues int")).first().complete


def test_levels(spark):
    x = np.concatenate([np.zeros(80), np.full(80, 0.5), np.zeros(77)]).astype("float32").tolist()
    df = spark.createDataFrame([(x,)], "s array<float>")
    r = df.select(levels.hops(F.col("s"), 8).alias("h")).first().h
    assert len(r) == 30 and r[9] == 0 and r[10] == pytest.approx(0.5)
    g = levels.duck_curve(df, "s", 8, 0.3).first().gain
    assert len(g) == len(x) and g[0] == pytest.approx(1.0) and 0.3 < min(g) < 0.6 and g[-1] > min(g)
    want, cur = [], 1.0
    for v in r:
        target = 0.3 if v > 10 ** (-45 / 20) else 1.0
        cur += (target - cur) * (1 - np.exp(-1 / 5) if target < cur else 1 - np.exp(-1 / 40))
        want.append(cur)
    assert df.select(levels.duck_hops(levels.hops(F.col("s"), 8), 0.3).alias("g")).first().g == pytest.approx(want)
    m = df.select(levels.mixed(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(1.0))).alias("m")).first().m
    assert m == pytest.approx([0.98, 0.245])
    j = df.select(levels.joined(F.array(F.array(F.lit(1.0).cast("float")), F.array(F.lit(2.0).cast("float"))), 2).alias("j")).first().j
    assert j == [1, 0, 0, 2]


class Busy(Exception):
    status_code = 503


def test_retries_and_providers():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Busy("overloaded")
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and waits == [5, 15]
    with pytest.raises(providers.ProviderUnavailable):
        providers.with_retries(lambda: (_ for _ in ()).throw(Busy("x")), sleep=lambda s: None)
    with pytest.raises(ValueError):
        providers.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad JSON")), sleep=lambda s: None)
    assert providers.choose_provider("auto", {"b": "k"}, ("a", "b")) == "b"
    with pytest.raises(providers.NoCredentials):
        providers.choose_provider("auto", {}, ("a",))
    with pytest.raises(providers.BadModel):
        providers.choose_provider("z", {}, ("a",))
    assert providers.model_chain("m", "a", {"a": ("x",), "b": ("y",)}, True) == [("a", "m")]
    assert providers.model_chain(None, "a", {"a": ("x",), "b": ("y",)}, True) == [("a", "x"), ("b", "y")]
    assert providers.model_chain(None, "a", {"a": ("x",), "b": ("y",)}, False) == [("a", "x")]
    assert providers.strict_schema({"type": "object", "p": [{"type": "object"}]}) == {"type": "object", "p": [{"type": "object", "additionalProperties": False}], "additionalProperties": False}


def test_rewrite_loop_and_reply(spark):
    c = spark.createDataFrame([("j", 1, 0, 500, "a b c d e f g h"), ("j", 2, 0, 5000, "a b")], "job_id string, idx int, start_ms long, end_ms long, source_text string")
    out = providers.rewrite(c, lambda texts, budgets: [" ".join(t.split()[: b + 1]) for t, b in zip(texts, budgets)]).collect()
    assert [(r.idx, r.final_text) for r in out] == [(1, "a b c d")]
    reply = spark.createDataFrame([('{"cues": [{"index": 1, "text": "x"}, {"index": 2, "text": " "}]}',), ("broken",)], "reply string")
    assert [tuple(r) for r in providers.parse_reply(reply, "reply").collect()] == [(1, "x")]


def test_tables(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ver int")
    with pytest.raises(tables.MissingColumns, match="nope"):
        tables.require_columns(rows, "id", "nope")
    assert tables.has_column(rows, "v") and not tables.has_column(rows, "w")
    assert tables.single(rows, id=2).first().v == "b"
    with pytest.raises(tables.NotOneRow):
        tables.single(rows, id=3)
    new = spark.createDataFrame([(1, "z", 2), (3, "c", 1), (2, "old", 0)], "id int, v string, ver int")
    assert {r.id: r.v for r in tables.upsert(rows, new, ["id"], "ver").collect()} == {1: "z", 2: "b", 3: "c"}
    assert {r.id: r.v for r in tables.apply_changes(rows, spark.createDataFrame([(1, "q")], "id int, v string"), ["id"], ["v"]).collect()} == {1: "q", 2: "b"}
    assert tables.delete(rows, spark.createDataFrame([(1,)], "id int"), ["id"]).count() == 1


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    beats = pd.DataFrame({"w": ["a"] * 6 + ["b"], "ts": [t0 + dt.timedelta(seconds=s) for s in (0, 10, 25, 30, 4000, 4005)] + [t0]})
    for k in range(2):
        spark.createDataFrame(beats[k::2]).write.parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema("w string, ts timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = liveness.kept_beats_stream(src, "w", "ts", 20).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select w, count(*) n from kept group by w").collect()
    assert {r.w: r.n for r in got} == {"a": 3, "b": 1}
    ends = spark.createDataFrame([("z", t0 + dt.timedelta(days=1))], "w string, ts timestamp")
    ends.write.parquet(str(tmp_path / "in/9"))
    q = liveness.session_stream(spark.readStream.schema("w string, ts timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "w", "ts", "30 minutes", "1 minute").writeStream.format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream = {(r.w, r.n) for r in spark.sql("select w, n from sess").collect()}
    batch = {(r.w, r.n) for r in jobs.sessions(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "w", "ts", 1800).where("w <> 'z'").collect()}
    assert stream == batch == {("a", 4), ("a", 2), ("b", 1)}
    up = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, ver int")
    up.write.parquet(str(tmp_path / "up"))
    liveness.latest_wins(spark.readStream.schema(up.schema).parquet(str(tmp_path / "up")), str(tmp_path / "out"), ["id"], "ver").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in liveness.latest(spark, str(tmp_path / "out")).collect()] == [(1, "b", 2)]


def test_kept_beats_pass_midnight(spark):
    t0 = dt.datetime(2026, 1, 1, 23, 59, 50)
    at = [0, 15, 20, 39, 86_400, 86_410, 86_420]
    rows = [(w, t0 + dt.timedelta(seconds=s)) for s in at for w in ("a", "b", None)] + [("a", None)]
    beats = spark.createDataFrame(rows, "w string, ts timestamp").repartition(3)
    first = int(t0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r.w or "", r.at_us // 1_000_000 - first) for r in jobs.kept_beats(beats, "w", "ts", 20).collect())
    base = min(s for _, s in got)  # the session's time zone
    assert [(w, s - base) for w, s in got] == [(w, s) for w in ("", "a", "b") for s in (0, 20, 86_400, 86_420)]


def test_rewrite_asks_for_targets_only(spark, tmp_path):
    """Of 120 lines 61 need a rewrite; each is sent once a pass, in calls of 25 at most."""
    data = [(job, i, i * 1000, i * 1000 + 900, "one two three four five six seven eight nine" if i % 2 == 0 else "fine") for job in (1, 2) for i in range(60)] + [(3, 0, 0, 900, "only 7")]
    cues = spark.createDataFrame(data, "job_id int, idx int, start_ms long, end_ms long, source_text string")
    log = str(tmp_path / "calls")

    def model(texts, budgets):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [" ".join(t.split()[:b]) for t, b in zip(texts, budgets)]

    out = providers.rewrite(cues, model, passes=1).collect()
    calls = [int(x) for x in open(log)]
    assert len(out) == 60 and sum(calls) == 61 and sorted(calls) == [1, 5, 5, 25, 25]


def test_translation_failures_say_what_is_saved():
    class Busy(Exception):
        code = 503

    def busy():
        raise Busy("later")

    with pytest.raises(providers.ProviderUnavailable, match="later .*transcript is saved"):
        providers.translation(busy, waits=(), sleep=lambda s: None)
    assert providers.transient(Busy()) and providers.transient(RuntimeError("Model OVERLOADED")) and not providers.transient(ValueError("bad JSON"))


def test_stream_runs_and_updates(spark, tmp_path):
    """Buckets are rewritten where they are touched; a listener hears of it."""
    said = []
    listener = liveness.Progress(said.append)
    spark.streams.addListener(listener)
    try:
        schema = "id int, v string, ver int"
        for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 1)], [(2, "old", 1)]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
            source = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
            writer = liveness.latest_wins(source, str(tmp_path / "out"), ["id"], "ver", buckets=4).option("checkpointLocation", str(tmp_path / "check"))
            liveness.drained(writer)
        got = sorted(map(tuple, liveness.latest(spark, str(tmp_path / "out")).collect()))
        assert got == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
        poll = liveness.drained(liveness.latest_wins(source, str(tmp_path / "out2"), ["id"], "ver").option("checkpointLocation", str(tmp_path / "check2")), once=False, poll="1 second", budget_s=15)
        assert not poll.isActive
    finally:
        spark.streams.removeListener(listener)
    assert any("batch" in x for x in said)


def test_fallbacks_of_sinks(spark, tmp_path):
    from cuelight.sources import audio

    assert audio.encoded([0.0, 0.5], 8000, "mp3", lambda x, r: b"mp3")[1:] == ("mp3", "audio/mpeg")
    with pytest.warns(UserWarning, match="wav instead"):
        assert audio.encoded([0.0, 0.5], 8000, "mp3", lambda x, r: 1 / 0)[1] == "wav"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")

    def each(row):
        (tmp_path / f"row-{row.id}").write_text(row.v)

    assert tables.persisted(rows, lambda b: None, each)
    with pytest.warns(UserWarning, match="row by row"):
        assert not tables.persisted(rows, lambda b: 1 / 0, each)
    assert sorted(p.name for p in tmp_path.glob("row-*")) == ["row-1", "row-2"]
    with pytest.warns(UserWarning, match="event log"):
        assert not tables.append_events(rows.withColumnRenamed("v", "id"), str(tmp_path / "log"))


def test_fuzzy_coverage_equals_the_greedy_rule(spark):
    """Likenesses by distinct pairs give what comparing each word with each gives."""
    import random

    rng = random.Random(11)
    stem = lambda: "".join(rng.choice("abcdeghnoạảâ") for _ in range(rng.randrange(1, 9)))
    pool = [stem() for _ in range(60)]

    def bent(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w[:k] + rng.choice("abxạ") + w[k + 1 :], w + rng.choice("ab"), w[:k] + w[k + 1 :] or "z", w[::-1], w.upper()])

    rows = []
    for i in range(120):
        want = [rng.choice(pool) for _ in range(rng.randrange(0, 25))]
        heard = [bent(w) for w in want if rng.random() < 0.9]
        rng.shuffle(heard) if i % 3 == 0 else None
        rows.append((i % 100, " ".join(want), " ".join(heard), 1.5))
    rows += [(None, None, "a b", 1.0), (1, "a b", None, 1.0), (2, "", "", 1.0), rows[3], (7, "12 cats", "một hai cats", 0.0)]
    df = spark.createDataFrame(rows, "id long, script string, heard string, w double").repartition(3)
    words = df.select("id", "w", T.script_words(F.col("script")).alias("a"), T.script_words(F.col("heard")).alias("b")).collect()
    want = sorted(((r.id, r.w, *verify.match_words(r.a, r.b)) for r in words), key=str)
    got = sorted(((r.id, r.w, r.coverage, r.missing, r.tonal) for r in verify.coverage(df, "script", "heard").collect()), key=str)
    assert got == want and any(r[4] for r in got) and any(r[3] for r in got)


def test_mix_is_linear_in_samples(spark):
    """100,000 samples a row take seconds, and what is computed is the same."""
    import time

    import numpy as np

    n = 100_000
    wave = lambda k: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.sin((x * k).cast("double")))
    rows = spark.range(4).select("id", wave(1).alias("bed"), wave(2).alias("gain"), wave(3).alias("voice"))
    start = time.perf_counter()
    m = levels.mixed(levels.blended(F.col("bed"), F.slice(F.reverse("voice"), 1, n - 5), F.col("id") >= 0), F.col("gain"), F.col("voice"), 3.0)
    got = np.array(rows.select(m.alias("m")).where("id = 3").first().m)
    assert rows.select(F.size(m).alias("n")).agg(F.sum("n")).first()[0] == 4 * n
    assert time.perf_counter() - start < 30
    x = np.arange(1, n + 1.0)
    bed, voice = np.sin(x), np.sin(3 * x)
    bed[: n - 5] += voice[::-1][: n - 5] * 10 ** (levels.RESIDUAL_DB / 20)
    want = bed * np.sin(2 * x) * 10 ** (3 / 20) + voice
    assert np.allclose(got, want * 0.98 / np.abs(want).max(), atol=1e-9)


def test_changes_of_one_key_are_one_change(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id int, v string, w int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, "y", 7, 2), (1, None, None, 3), (None, "m", None, 1), (9, "new", 1, 1)], "id int, v string, w int, ver int")
    one = {r.id: (r.v, r.w) for r in tables.apply_changes(rows, changes, ["id"], ["v", "w"], "ver").collect()}
    assert one == {1: ("y", 7), 2: ("b", 2), None: ("m", 3)}
    other = {r.id: (r.v, r.w) for r in tables.apply_changes(rows, changes, ["id"], ["v", "w"], "ver", nulls=True).collect()}
    assert other == {1: (None, None), 2: ("b", 2), None: ("m", None)}
    assert tables.apply_changes(rows, changes, ["id"], ["v"]).count() == 3


def test_latest_wins_over_checkpoints_and_lost_batches(spark, tmp_path):
    """A new checkpoint counts batches anew; none of its updates is lost. Nor does a lost batch's folder stay."""
    schema, out = "id int, v string, ver int", str(tmp_path / "out")
    assert liveness.latest(spark, out, schema).count() == 0
    with pytest.raises(LookupError):
        liveness.latest(spark, out)
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 1)], [(4, "e", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}/x"))
        for again in range(2):  # the second run finds nothing new, or, with another checkpoint, everything
            source = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}/*"))
            liveness.drained(liveness.latest_wins(source, out, ["id"], "ver", buckets=4).option("checkpointLocation", str(tmp_path / f"check{k}-{again if k == 1 else 0}")))
        if k == 0:
            spark.createDataFrame(rows, schema).write.parquet(out + "/rows/lost/_bucket=1")
            spark.createDataFrame([(0, "lost")], "bucket int, folder string").write.parquet(out + "/manifest/000000000099-lost/_temporary")
    assert sorted(map(tuple, liveness.latest(spark, out).collect())) == [(1, "c", 2), (2, "b", 1), (3, "d", 1), (4, "e", 1)]
    assert not (tmp_path / "out/rows/lost").exists()


def test_errors_say_why():
    try:
        try:
            raise ValueError("first\nlast line" + "x" * 300)
        except ValueError as e:
            raise RuntimeError("") from e
    except RuntimeError as e:
        said = providers.why(e)
    assert said == "RuntimeError: (no message) <- caused by ValueError: " + ("last line" + "x" * 300)[:200]
    a, b = ValueError("a"), ValueError("b")
    a.__cause__, b.__cause__ = b, a
    assert providers.why(a) == "ValueError: a <- caused by ValueError: b"
    odd = RuntimeError("strange")
    odd.code = [1, 2]
    assert providers.transient(odd) is False
    odd.code = 503
    assert providers.transient(odd) is True


def test_marks_are_taken_off_heard_words_once():
    taken = []

    class Word(str):
        def translate(self, table):
            taken.append(self)
            return str(self).translate(table)

    heard = [Word(f"q{i}") for i in range(50)] + [Word("má")]
    found = verify.match_words([*(f"zzzz{i}yyyy" for i in range(60)), "ma"], heard, lambda word, left: None)
    assert found[1:] == ([f"zzzz{i}yyyy" for i in range(60)], ["ma"]) and len(taken) == len(heard)

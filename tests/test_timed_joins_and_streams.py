"""Joins by time, claims, timers of streams, stretched audio and spectra."""

import datetime as dt
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import intervals, jobs, qc, spectra, stretch
from cuelight.streaming import claims, liveness

T0 = dt.datetime(2026, 1, 1, 23, 50)


def at(s):
    return T0 + dt.timedelta(seconds=s)


# --- joins by time ---------------------------------------------------------------


def test_as_of_takes_the_last_row_before(spark):
    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "b", None, "none"]), rng.choice([None, *map(at, range(0, 4000, 7))]), "x") for i in range(300)]
    right = [(rng.choice(["hot", "b", None]), rng.choice([None, *map(at, range(0, 4000, 13))]), k, "n") for k in range(200)]
    ls = spark.createDataFrame([*left, left[0]], "i long, key string, ts timestamp, v string")
    rs = spark.createDataFrame(right, "key string, ts timestamp, v long, w string")

    def last(key, ts):
        found = [(t, v, w) for k, t, v, w in right if k is not None and t is not None and k == key and ts is not None and t <= ts]
        return max(found)[1:] if found else (None, None)

    for minute in (1, 10, 100_000):
        got = intervals.as_of(ls.drop("v"), rs, "key", "ts", ["v", "w"], range_us=minute * 60_000_000)
        assert got.columns == ["i", "key", "ts", "v", "w"]
        assert sorted((r.i, r.v, r.w) for r in got.collect()) == sorted((i, *last(k, t)) for i, k, t, _ in [*left, left[0]]), minute
    assert intervals.as_of(ls.limit(0), rs, "key", "ts", ["w"]).count() == 0


def test_overlapping_finds_nested_and_long_spans_once(spark):
    rng = random.Random(4)
    span = lambda: (a := rng.randrange(-500, 500), a + rng.choice([0, 1, 2, 7, 64, 65, 300, 5000, -3]))
    left = [(i, rng.choice(["j", "k", None]), *span()) for i in range(120)] + [(900, "j", None, 4), (901, "j", -(10**9), 10**9)]
    right = [(i, rng.choice(["j", "k", None]), *span()) for i in range(120)] + [(900, "j", 4, None), (901, "j", 3, 4)]
    ls, rs = spark.createDataFrame(left, "i int, job string, a long, b long"), spark.createDataFrame(right, "i int, job string, a long, b int")
    got = sorted(map(tuple, intervals.overlapping(ls, rs, "job", ("a", "b"), ("a", "b")).select("l.i", F.col("r.i").alias("n")).collect()))
    whole = lambda r: r[1] is not None and None not in r and r[2] < r[3]
    want = sorted((x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 400


# --- claims ------------------------------------------------------------------------


def test_of_two_workers_one_has_a_row(spark, tmp_path):
    rows = [(i, i % 3, i, "queued" if i % 4 else "done", None) for i in range(24)]
    queue = spark.createDataFrame(rows, "id int, priority int, created_at int, status string, worker_label string").cache()
    root, got = str(tmp_path / "claims"), {}

    def work(name):
        got[name] = [r.id for _ in range(6) for r in claims.claim(queue, root, name, ahead=30).collect()]

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    all_ = [i for ids in got.values() for i in ids]
    assert sorted(all_) == [r[0] for r in rows if r[3] == "queued"]
    assert claims.claim(queue, root, "d").count() == 0


def test_a_lost_winner_times_out(spark, tmp_path):
    queue = spark.createDataFrame([(7, 1, 1, "queued")], "id long, priority int, created_at int, status string")
    root = str(tmp_path / "claims")
    first = claims.claim(queue, root, "a", lease_s=60).first()
    assert (first.id, first.attempt, first.status, first.worker_label) == (7, 1, "compiling", "a")
    assert claims.claim(queue, root, "b", lease_s=60).count() == 0
    claim = tmp_path / "claims/7/1"
    import os

    os.utime(claim, (claim.stat().st_mtime - 100,) * 2)
    assert claims.held(spark, root, 7)[1] > 60
    claims.renew(spark, root, 7, 1)
    assert claims.claim(queue, root, "b", lease_s=60).count() == 0
    os.utime(claim, (claim.stat().st_mtime - 100,) * 2)
    again = claims.claim(queue, root, "b", lease_s=60).first()
    assert (again.attempt, again.worker_label) == (2, "b") and claims.claim(queue, root, "c", lease_s=60).count() == 0
    assert not claims.exclusive(spark, f"{root}/7/2") and claim.read_text() == "a"


# --- streams -------------------------------------------------------------------------


def run(spark, tmp_path, name, schema, batches, of):
    """Each batch is a file and a run of the stream from its checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/in/{k}"))
        source = of(spark.readStream.schema(schema).parquet(str(tmp_path / f"{name}/in/*")))
        liveness.drained(source.writeStream.format("parquet").option("path", str(tmp_path / f"{name}/out")).option("checkpointLocation", str(tmp_path / f"{name}/check")))
    return spark.read.parquet(str(tmp_path / f"{name}/out"))


def test_timers_requeue_what_a_table_would(spark, tmp_path):
    schema = "job string, ts timestamp, status string"
    batches = [
        [("lost", at(0), "busy"), ("ends", at(0), "busy"), ("lives", at(0), "busy"), ("back", at(10), "busy"), (None, at(0), "busy"), ("lost", None, "busy")],
        [("ends", at(60), "done"), ("lives", at(700), "busy"), ("lost", at(30), None)],
        [("clock", at(1200), "busy")],
        [("lives", at(1300), "busy"), ("back", at(1210), "busy"), ("lost", at(40), "busy")],  # the last one is older than the watermark
        [("lives", at(2000), "busy"), ("clock", at(2400), "busy")],
    ]
    got = run(spark, tmp_path, "timers", schema, batches, lambda s: liveness.requeue_stream(s, "job", "ts", "status", minutes=15))
    rows = sorted((r.job, r.last_at, r.due_at) for r in got.collect())
    assert rows == [("back", at(10), at(910)), ("back", at(1210), at(2110)), ("clock", at(1200), at(2100)), ("lost", at(30), at(930))] or rows == [("back", at(10), at(910)), ("back", at(1210), at(2110)), ("lost", at(30), at(930))]
    # the same by the table of last beats, at the stream's time when it ended
    last = {}
    for j, t, s in (r for b in batches for r in b if r[0] and r[1]):
        if (j, t) != ("lost", at(40)):
            last[j] = max(last.get(j, (t, s)), (t, s), key=lambda x: x[0])
    table = spark.createDataFrame([(j, s or "busy", t, "w") for j, (t, s) in last.items()], "id string, status string, heartbeat_at timestamp, worker_label string")
    back = {r.id for r in jobs.requeued(table, F.lit(at(2400 - 60)), minutes=15).where("status = 'queued'").collect()}
    assert back == {"lost", "back"} == {r[0] for r in rows} - {"clock"}


def test_late_repeats_go_and_rows_learn_of_their_keys(spark, tmp_path):
    schema = "id long, ts timestamp, k int"
    batches = [[(1, at(0), 1), (1, at(5), 1), (2, at(10), 2)], [(2, at(12), 2), (3, at(20), 9), (1, at(30), 1)], [(4, at(40), None)]]
    names = spark.createDataFrame([(1, "one", 1), (1, "a second row of one", 2), (2, "two", 0), (5, "five", 0)], "k int, name string, n int")
    got = run(spark, tmp_path, "unique", schema, batches, lambda s: liveness.with_dimension(liveness.unique_stream(s, ["id"], "ts", "10 minutes"), names, ["k"]))
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "a second row of one"), (2, "two"), (3, None), (4, None)]


# --- audio ------------------------------------------------------------------------------


def peak_hz(x, rate):
    power = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    return np.argmax(power) * rate / len(x)


@pytest.mark.parametrize("speed", [1.05, 1.3, 1.96])
def test_stretched_tones_keep_their_pitch(speed):
    rate = 24_000
    t = np.arange(rate * 2) / rate
    for hz in (110, 440, 1234):
        x = 0.5 * np.sin(2 * np.pi * hz * t)
        y = stretch.stretched_samples(x, speed)
        assert len(y) == round(len(x) / speed)
        assert abs(peak_hz(y, rate) - hz) < 3
        assert 0.45 < np.abs(y[2000:-2000]).max() < 0.6 and np.sqrt((y[2000:-2000] ** 2).mean()) == pytest.approx(0.5 / 2**0.5, rel=0.05)


def test_stretched_rows(spark):
    rows = spark.createDataFrame([(1, [0.5] * 1000, 1.25), (2, [], 1.5), (3, None, 1.5), (4, [1.0, None, 0.5], 1.2), (5, [0.1] * 10, 1.0), (6, [0.2] * 50, None), (7, [1.0], 1.9)], "id int, x array<float>, s double")
    got = {r.id: r.y for r in rows.select("id", stretch.stretched(F.col("x"), F.col("s")).alias("y")).collect()}
    assert {k: None if v is None else len(v) for k, v in got.items()} == {1: 800, 2: 0, 3: None, 4: 2, 5: 10, 6: 50, 7: 1}
    assert all(x == pytest.approx(0.5, abs=1e-5) for x in got[1][200:600])


def test_spectrum_of_tones_in_one_row_or_in_chunks(spark):
    rate, frame, hop = 8000, 256, 64
    t = np.arange(4000) / rate
    clips = {"low": np.sin(2 * np.pi * 500 * t), "high": np.sin(2 * np.pi * 3000 * t), "silent": np.zeros(4000)}
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in clips.items()] + [("short", [0.5] * 100), ("null", None)], "v string, x array<double>")
    one = {(r.voice, r.hz): r.power for r in spectra.spectrum(rows, "v", "x", rate=rate, frame=frame, hop=hop).collect()}
    assert {v for v, _ in one} == set(clips)
    assert max((p, hz) for (v, hz), p in one.items() if v == "low")[1] == 500 and max((p, hz) for (v, hz), p in one.items() if v == "high")[1] == 3000
    cuts = [(k, c, x[a : a + 640].tolist()) for k, x in clips.items() for c, a in enumerate(range(0, 4000, 640))]
    chunked = spectra.spectrum(spark.createDataFrame(cuts, "v string, c int, x array<double>").repartition(3), "v", "x", chunk="c", rate=rate, frame=frame, hop=hop)
    other = {(r.voice, r.hz): r.power for r in chunked.collect()}
    assert other.keys() == one.keys() and all(other[k] == pytest.approx(one[k], abs=1e-9) for k in one)
    widths = {r.voice: r.hz for r in qc.bandwidth(chunked, 0.9).collect()}
    assert widths["low"] < 800 < 2800 < widths["high"] and "silent" not in widths


def test_timbre_tells_voices_apart(spark):
    rng = np.random.default_rng(3)
    rate = 24_000
    t = np.arange(rate) / rate

    def voice(pitch, tilt):
        return sum(np.sin(2 * np.pi * pitch * k * t + rng.uniform(0, 6)) / k**tilt for k in range(1, 30)) * 0.1 + rng.normal(0, 1e-3, rate)

    rows = spark.createDataFrame([("a1", voice(120, 1).tolist()), ("a2", voice(122, 1).tolist()), ("b", voice(240, 0.2).tolist()), ("noise", rng.normal(0, 0.1, rate).tolist()), ("short", [0.1] * 100), ("null", None)], "v string, x array<double>")
    m = {r.v: r.m for r in rows.select("v", spectra.timbre(F.col("x")).alias("m")).collect()}
    assert len(m["a1"]) == 20 and m["short"] == [0.0] * 20 and m["null"] is None
    pairs = spark.createDataFrame([(m["a1"], m["a2"], m["b"], m["noise"])], "a array<double>, b array<double>, c array<double>, d array<double>")
    r = pairs.select(*[T.cosine(F.col("a"), F.col(x)).alias(x) for x in "bcd"]).first()
    assert r.b > 0.99 > r.c and r.b > r.d
    bands = spectra.mel_bands(rate, 2048, 128)
    assert bands.shape == (128, 1025) and (bands.sum(1) > 0).all() and (bands >= 0).all()


def test_sketches_keep_their_bound_when_merged(spark):
    f = spark.range(60_000).repartition(12).select((F.col("id") % 2).alias("voice"), (F.hash("id") % 100_000 / 1e5 + 1).alias("rms"))
    got, want = ({r.voice: r for r in x.collect()} for x in (qc.sketched_levels(f), qc.voice_levels(f)))
    for v in got:
        assert got[v].loud == pytest.approx(want[v].loud, rel=0.02) and got[v].quiet == pytest.approx(want[v].quiet, rel=0.02)


def test_clips_are_stretched_by_many_tasks(spark):
    from cuelight.plans import catalog

    assert catalog.queries()["fitted_clips"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_every_clip_is_fitted_to_the_end_of_all_cues(spark, tmp_path):
    from cuelight.plans import catalog, proxies

    # clips of seconds and of minutes; the last cues of jobs 2 and 7 have none
    rows = [(j, t, "user", "word " * n) for j, ns in {1: [1, 200, 3000], 2: [400, 300, 20, 500], 3: [2, 1], 7: [900, 800, 0, 5, 40, 30, 20, 9]}.items() for t, n in enumerate(ns)]
    spark.createDataFrame([r for r in rows if r[:2] != (2, 3)] + [(2, 7, "user", "no clip"), (4, 0, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    cues, want = {}, {}
    for r in proxies.cues(spark, str(tmp_path)).orderBy("job_id", "idx").collect():
        cues.setdefault(r.job_id, []).append(r)
    assert not cues[2][-1].clip_ms and not cues[7][-1].clip_ms and max(r.clip_ms for r in cues[1]) > 60_000
    for job, own in cues.items():
        cursor, placed = 0, []
        for r in own:
            if r.clip_ms:
                placed.append((r, max(r.start_ms, cursor)))
                cursor = placed[-1][1] + r.clip_ms + 60
        ends, cued = max((a + r.clip_ms for r, a in placed), default=0), max(r.end_ms for r in own)
        speed = ends / cued if ends > cued > 0 else 1.0
        speed = speed if speed > 1.001 else 1.0
        want |= {(job, r.idx): (round(8 * r.clip_ms / speed), round(a / speed * 8000 / 1000)) for r, a in placed}
    got = catalog.queries()["fitted_clips"](spark, str(tmp_path)).collect()
    assert {(r.job_id, r.idx): (r.n, r["at"]) for r in got} == want and len(got) == len(want)


def test_loaded_clips_are_stretched_as_those_of_a_column(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k * 700 if k != 5 else None, [1.0, 1.5, 2.2, None][k % 4], 10.0 * k) for k in range(24)], "k int, samples long, speed double, fit_ms double").coalesce(1)

    def load(n):
        return np.sin(0.2 * np.arange(n)).astype("float32")

    column = F.udf(lambda n: None if n is None else load(n).tolist(), "array<float>")
    want = stretch.fitted_clips(rows.withColumn("samples", column("samples")), rate=8000, frame=256, search=96)
    for most in (1, 20_000, 1 << 20):
        monkeypatch.setattr(stretch, "BATCH", most)
        got = stretch.fitted_clips(rows, rate=8000, frame=256, search=96, load=load)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

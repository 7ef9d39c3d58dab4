import unicodedata

import pytest
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import fit, speakers
from cuelight.sources import srt


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


def test_syllables_and_digits(spark):
    assert one(spark, T.syllables(F.col("s")), s=" xin  chào — 12! ... ") == 3
    assert one(spark, T.syllables(F.col("s")), s="") == 0
    assert one(spark, T.has_digit(F.col("s")), s="số ٣") is True
    assert one(spark, T.has_digit(F.col("s")), s="số ba") is False


@pytest.mark.parametrize("s,want", [("tám người", 0.25 + 2 / 6), ("a", 0.8), ("Việt Nam ơi đi thôi nào em", 0.25 + 7 / 6), ("x" * 31, 0.35 + 2.0)])
def test_natural_seconds(spark, s, want):
    assert one(spark, T.natural_seconds(F.col("s")), s=s) == pytest.approx(max(want, 0.6 if "ạ" in s or "ờ" in s else want), abs=1e-9)


def test_retry_seconds(spark):
    assert one(spark, T.retry_seconds(F.lit("x" * 31), F.lit(1))) is None
    assert one(spark, T.retry_seconds(F.lit("x" * 31), F.lit(3))) == pytest.approx(2.35 * 1.2 / 1.12)


@pytest.mark.parametrize("s,want", [("Số 8, 12 và 123!", ["số", "tám", "một", "hai", "và", "123"]), ("", []), ("A_b-c", ["a_b", "c"])])
def test_script_words(spark, s, want):
    assert one(spark, T.script_words(F.col("s")), s=s) == want


def test_strip_tones_matches_unicode(spark):
    s = "Đường ấy ĐẸP quá ñandú Ångström ệ"
    want = "".join(c for c in unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
    assert one(spark, T.strip_tones(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [("MINH!", True), ("ĐỨC 2", True), ("Minh", False), ("测试", False), ("123", False)])
def test_is_shouted(spark, s, want):
    assert one(spark, T.is_shouted(F.col("s")), s=s) is want


@pytest.mark.parametrize("s,want", [("(nhạc)", True), (" [x\ny} ", True), ("(a) b", False), ("", False)])
def test_is_caption(spark, s, want):
    assert one(spark, T.is_caption(F.col("s")), s=s) is want


@pytest.mark.parametrize("name,code", [("Chinese", "zh"), ("chinese", "zh"), ("Vietnamese", "vi"), ("Korean", "ko"), ("ZH", "zh"), ("yue", "yue"), ("haw", "haw"), ("", None), ("auto", None), ("Auto-Detect", None)])
def test_language_code(spark, name, code):
    assert one(spark, T.language_code(F.col("s")), s=name) == code


def test_unknown_language_is_refused(spark):
    with pytest.raises(Exception, match="Klingon"):
        one(spark, T.language_code(F.col("s")), s="Klingon")


@pytest.mark.parametrize("code,message,want", [(None, "503 UNAVAILABLE high demand", True), (503, "x", True), (None, "RESOURCE_EXHAUSTED", True), (None, "bad JSON", False), (404, "no", False)])
def test_transient(spark, code, message, want):
    assert one(spark, T.is_transient(F.col("c").cast("int"), F.col("m")), c=code, m=message) is want


def test_model_settings(spark):
    m = F.create_map(F.lit("temperature"), F.lit(None).cast("string"), F.lit("apply_watermark"), F.lit("false"), F.lit("join_gap_ms"), F.lit("220"))
    assert one(spark, T.model_settings(m)) == {"apply_watermark": "false"}


def test_srt_time(spark):
    assert one(spark, T.srt_time(F.lit(3_723_004))) == "01:02:03,004"
    assert one(spark, T.srt_time(F.lit(360_000_000 + 5))) == "100:00:00,005"


def test_cosine_and_levels(spark):
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, T.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(1.0)
    assert one(spark, T.dbfs(F.array(F.lit(0.0)), -120.0)) == -120
    assert one(spark, T.dbfs(F.array().cast("array<double>"), -120.0)) == -120
    assert one(spark, T.dbfs(F.array(F.lit(1.0), F.lit(1.0)))) == 0
    assert one(spark, T.dbfs(F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(-6.02, abs=0.01)


SRT = """﻿1\r
00:00:05,000 --> 00:00:07,500\r
Second <i>line</i>\r
goes on\r
\r
00:00:01.5 --> 00:00:02,000
No number

3
00:00:09,000 --> 00:00:08,000
Backwards

4
00:00:10,000 --> 00:00:11,000
<b></b>

x
y
00:00:12,000 --> 00:00:13,000
Timing too late

5
00:00:05,000 --> 00:00:06,000
Same start
"""


def test_srt_parse(spark):
    got = srt.parse(spark.createDataFrame([("a", SRT), ("b", ""), ("c", None)], "file string, content string")).orderBy("idx").collect()
    assert [tuple(r)[:5] for r in got] == [("a", 1, 1005, 2000, "No number"), ("a", 2, 5000, 7500, "Second line goes on"), ("a", 3, 5000, 6000, "Same start")]
    assert got[1].raw == "Second <i>line</i> goes on"


def test_srt_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("f", 1, 0, 900, "one", ""), ("f", 2, 1000, 1900, "two", "deux")], "file string, idx int, start_ms long, end_ms long, text string, tr string")
    srt.write(srt.render(cues, "tr", "text"), str(tmp_path / "out"))
    back = srt.read(spark, str(tmp_path / "out/file=f/*.txt")).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in back] == [(0, 900, "one"), (1000, 1900, "deux")]


LINES = ["MINH: chào", "[LAN] hi", "(Hoa) a", "Hoa: b", "Hoa: c", "Chú ý: x", "Chú ý: y", "<i>xa xa</i>", "Note: z", "Note: z", "(Kim: b", "one two three four five six: no", "Hoa:", "A (VO): t", "A (VO): u", "", None, "Once: only"]


def test_speakers(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(LINES)], "job_id string, idx int, source_text string")
    got = {r.idx: (r.speaker, r.spoken) for r in speakers.assign(df).collect()}
    assert got[0] == ("MINH", "chào") and got[1] == ("LAN", "hi")
    assert got[2] == ("Hoa", "a") and got[3] == ("Hoa", "b")
    assert got[5] == (None, "Chú ý: x") and got[7] == ("(voiceover)", "xa xa")
    assert got[8] == (None, "Note: z") and got[10] == (None, "(Kim: b") and got[11][0] is None
    assert got[12] == (None, "Hoa:") and got[13] == ("A (VO)", "t") and got[15] == (None, "") and got[16] == (None, "") and got[17] == (None, "Once: only")
    legacy = {r.idx: r.speaker for r in speakers.assign(df, legacy=True).collect()}
    assert legacy[5] == "Chú ý"
    cast = {r.speaker: (r.lines, r.share) for r in speakers.cast(speakers.assign(df)).collect()}
    assert cast["Hoa"] == (3, pytest.approx(100 * 3 / len(LINES)))
    assert speakers.describe(speakers.cast(speakers.assign(df))).first().cast.startswith("5 speaker(s): Hoa (3), A (VO) (2)")


@pytest.mark.parametrize("text,who,want", [("Hoa: chào", "Hoa", "chào"), ("Hoa: chào", "Lan", "Hoa: chào"), ("[Hoa] x", "Hoa", "x"), ("Hoa:", "Hoa", "Hoa:"), ("<i>x</i>", "(voiceover)", "x"), ("Hoa: x", None, "Hoa: x"), (None, "Hoa", "")])
def test_strip_label(spark, text, who, want):
    assert one(spark, speakers.strip_label(F.col("t").cast("string"), F.col("w").cast("string")), t=text, w=who) == want


def test_fit(spark):
    df = spark.createDataFrame([("j", 1, 0, 100, "a b"), ("j", 2, 0, 1000, "a b c d e f g"), ("j", 3, 0, 1000, "a 5"), ("j", 4, 0, 1700, "a b c d e f g h i j k")], "job_id string, idx int, start_ms long, end_ms long, source_text string")
    got = {r.idx: r for r in fit.analyse(df).collect()}
    assert got[1].budget == 2 and not got[1].over
    assert got[2].budget == 6 and got[2].over
    assert got[3].digits and got[3].target and not got[3].over
    assert got[4].budget == 10 and got[4].ratio == 1.1 and not got[4].over
    r = fit.report(fit.analyse(df)).first()
    assert (r.cues, r.over_budget, r.with_digits, r.targets) == (4, 1, 1, 2)

"""Who speaks: labels before a line, kept when they recur in their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.functions import text as T

# Words that lead prose and never name a speaker.
PROSE_LEADS = (
    "cảnh báo", "chú thích", "chú ý", "dịch", "ghi chú", "gợi ý", "kết luận", "lưu ý", "lưu ý rằng", "nguồn", "tóm lại", "ví dụ",
    "caption", "captions", "caution", "example", "narrator's note", "note", "source", "subtitle", "subtitles", "tip", "translation", "warning",
)
VOICEOVER = "(voiceover)"
LEAST, MOST_CHARS, MOST_WORDS = 2, 25, 5

# The two label styles. The last character consumed is the first of the spoken text, as the label must leave some.
BRACKET = r"^[\s\p{Z}]*[\[\(][\s\p{Z}]*([^\]\)\n]{1,25}?)[\s\p{Z}]*[\]\)][\s\p{Z}]*([^\s\p{Z}](?s:.*))$"
COLON = r"^[\s\p{Z}]*([^\s\p{Z}:][^:\n]{0,24}):[\s\p{Z}]+([^\s\p{Z}](?s:.*))$"


def folded_leads() -> list[str]:
    src, dst = T.accent_table()
    table = str.maketrans(src, dst)
    return [w.translate(table).lower() for w in PROSE_LEADS]


def plausible(label: Column, legacy: bool = False) -> Column:
    """Could this be a name? legacy keeps the flaw that accented leads are compared with folded labels."""
    count = lambda c: F.length(label) - F.length(F.replace(label, F.lit(c), F.lit("")))
    even = (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))
    leads = list(PROSE_LEADS) if legacy else folded_leads()
    return (label != "") & (F.length(label) <= MOST_CHARS) & ~label.rlike("[.!?;,]") & label.rlike(r"\p{L}") & ~T.fold(label).isin(*leads) & even & (F.size(T.tokens(label)) <= MOST_WORDS)


def candidate(text: Column, legacy: bool = False) -> Column:
    """struct(label, spoken): bracket style before colon style, else italics as a voice-over; label null otherwise."""
    raw = F.coalesce(text, F.lit(""))
    clean = T.strip(T.strip_markup(raw))
    found = []
    for pattern in (BRACKET, COLON):
        label, rest = T.strip(F.regexp_extract(clean, pattern, 1)), T.strip(F.regexp_extract(clean, pattern, 2))
        found.append(F.when((rest != "") & plausible(label, legacy), F.struct(label.alias("label"), rest.alias("spoken"))))
    over = F.when(raw.rlike("(?i)</?i>") & (clean != ""), F.struct(F.lit(VOICEOVER).alias("label"), clean.alias("spoken")))
    return F.coalesce(*found, over, F.struct(F.lit(None).cast("string").alias("label"), clean.alias("spoken")))


def assign(cues: DataFrame, file: str = "job_id", text: str = "source_text", least: int = LEAST, legacy: bool = False) -> DataFrame:
    """Adds speaker and spoken: a label holds if it recurs in its file, is
    shouted, or marks a voice-over; other lines keep all their words."""
    out = cues.drop("speaker", "spoken").withColumn("_c", candidate(F.col(text), legacy))
    label = F.col("_c.label")
    holds = label.isNotNull() & ((F.count(label).over(W.partitionBy(file, label)) >= least) | T.is_shouted(label) | (label == VOICEOVER))
    out = out.withColumn("speaker", F.when(holds, label))
    return out.withColumn("spoken", F.when(F.col("speaker").isNotNull(), F.col("_c.spoken")).otherwise(T.strip(T.strip_markup(F.col(text))))).drop("_c")


def cast(assigned: DataFrame, file: str = "job_id", order: str = "idx") -> DataFrame:
    """Lines of each speaker of a file, their share of its cues in percent, and
    the first cue they speak."""
    n = F.count(F.lit(1)).over(W.partitionBy(file))
    rows = assigned.withColumn("_n", n).where("speaker is not null")
    return rows.groupBy(file, "speaker").agg(F.count(F.lit(1)).alias("lines"), (100 * F.count(F.lit(1)) / F.max("_n")).alias("share"), F.min(order).alias("first"))


def describe(cast_rows: DataFrame, file: str = "job_id") -> DataFrame:
    """One line a file: its speakers, most lines first, and who speaks first where equal."""
    return cast_rows.groupBy(file).agg(F.expr("concat(count(1), ' speaker(s): ', listagg(concat(speaker, ' (', lines, ')'), ', ') within group (order by lines desc, first, speaker))").alias("cast"))


def spoken_text(final: Column, source: Column, speaker: Column) -> Column:
    """What is spoken for a cue: its rewrite, or where that is blank its source, without its speaker's label."""
    return strip_label(F.coalesce(T.non_blank(final), source), speaker)


def strip_label(text: Column, speaker: Column) -> Column:
    """text without exactly the stored label; untouched where it has another, or nothing would be left."""
    clean = T.strip(T.strip_markup(text))
    out = clean
    for pattern in (COLON, BRACKET):
        label, rest = T.strip(F.regexp_extract(clean, pattern, 1)), T.strip(F.regexp_extract(clean, pattern, 2))
        out = F.when((label == speaker) & (label != "") & (rest != ""), rest).otherwise(out)
    return F.when(speaker.isNull() | (speaker == "") | (speaker == VOICEOVER), clean).otherwise(out)

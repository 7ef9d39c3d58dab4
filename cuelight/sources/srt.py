"""Subtitle files: a source and sinks, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelight.functions import text as T

# Fixed value: the timing line of the format.
TIMING = r"([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})\s*-->\s*([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})"


def _ms(line, first: int):
    part = lambda k: F.regexp_extract(line, TIMING, k).cast("long")
    # digits after the mark are milliseconds as they stand: ',5' is 5 ms
    return part(first) * 3_600_000 + part(first + 1) * 60_000 + part(first + 2) * 1000 + part(first + 3)


def parse(files: DataFrame) -> DataFrame:
    """Cues of files (file, content): file, idx, start_ms, end_ms, text, raw.

    Blocks are parted by blank lines; the timing stands in the first or second
    non-blank line; the lines after it are joined by spaces. Blocks without
    timing or text, or that end before they start, are dropped; the rest are
    sorted by start, in file order where equal, and numbered from 1.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "^﻿", ""), "\r\n?", "\n")
    rows = files.select("file", F.posexplode(F.split(clean, r"\n[\s\p{Z}]*\n")).alias("_pos", "_block"))
    lines = F.filter(F.transform(F.split("_block", "\n"), T.strip), lambda x: x != "")
    rows = rows.withColumn("_l", lines).withColumn("_at", F.when(F.get("_l", F.lit(0)).rlike(TIMING), 1).when(F.get("_l", F.lit(1)).rlike(TIMING), 2)).where("_at is not null")
    timing = F.get("_l", F.col("_at") - 1)
    raw = F.array_join(F.slice("_l", F.col("_at") + 1, F.size("_l")), " ")
    rows = rows.select("file", "_pos", _ms(timing, 1).alias("start_ms"), _ms(timing, 5).alias("end_ms"), raw.alias("raw")).withColumn("text", T.strip(T.strip_markup(F.col("raw"))))
    rows = rows.where((F.col("text") != "") & (F.col("end_ms") > F.col("start_ms")))
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("file").orderBy("start_ms", "_pos"))).select("file", "idx", "start_ms", "end_ms", "text", "raw")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every subtitle file under path; bytes that aren't UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").load(path)
    return parse(rows.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content")))


def render(cues: DataFrame, text: str = "text", fallback: str | None = None, start: str = "start_ms", end: str = "end_ms", file: str = "file", number: str | None = None) -> DataFrame:
    """file, content: cues as a subtitle file. An empty text falls back on another
    column; number names the column of cue numbers, else cues count from 1."""
    body = F.coalesce(T.non_blank(F.col(text)), F.col(fallback)) if fallback else F.col(text)
    rows = cues.withColumn("_n", F.col(number).cast("int") if number else F.row_number().over(W.partitionBy(file).orderBy("idx")))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), T.srt_time(F.col(start)), F.lit(" --> "), T.srt_time(F.col(end)), F.lit("\n"), body, F.lit("\n"))
    parts = F.sort_array(F.collect_list(F.struct("_n", block.alias("b"))))
    return rows.groupBy(file).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n").alias("content"))


def write(rendered: DataFrame, path: str, file: str = "file") -> None:
    """One folder a file, each with its text."""
    rendered.select(F.col(file).alias("file"), F.col("content").alias("value")).write.mode("overwrite").partitionBy("file").text(path)

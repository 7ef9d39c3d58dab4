"""Stand-ins, from the driver's tables, for the tables of a dubbing studio, in Spark and in SQL.

conversations are cues (4 s apart, 3.5 s long), orders a queue, events heartbeats,
lineitem takes, embeddings timbre vectors and short waveforms. What they lack
(labels, captions, clip lengths) is made from their keys by the same rule in both.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share; in a local session without
    one, in a temporary folder of the process. It is deleted when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_deleted, spark, path)
    return path


@lru_cache(maxsize=1)
def _local_root() -> str:
    folder = tempfile.mkdtemp(prefix="cuelight-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def _deleted(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn") * 13
    label = F.when(k % 5 == 0, F.concat(F.lit("["), F.upper("role"), F.lit("] "))).when(k % 5 == 1, F.concat(F.initcap("role"), F.lit(": "))).when(k % 5 == 2, F.lit("<i>")).when(k % 11 == 3, F.lit("Note: ")).otherwise("")
    return c.select(
        F.col("conv_id").alias("job_id"), F.col("turn").cast("long").alias("idx"), F.col("role").alias("speaker"), F.col("text").alias("source_text"),
        (F.col("turn") * 4000).cast("long").alias("start_ms"), (F.col("turn") * 4000 + 3500).cast("long").alias("end_ms"),
        F.concat(label, F.coalesce("text", F.lit(""))).alias("labelled"),
        F.when(k % 6 == 0, F.concat(F.lit(" ("), "text", F.lit(")"))).otherwise(F.col("text")).alias("captioned"),
        F.when(k % 7 == 0, 0).otherwise(F.length(F.coalesce("text", F.lit(""))) * 11 + k % 900).cast("long").alias("clip_ms"),
        F.when(k % 4 == 0, "rerolled").when(k % 4 == 1, "pending").when(k % 9 == 2, "failed").otherwise("qc_pass").alias("status"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 10 == 1, "").otherwise(F.format_string("cue_%05d.wav", F.col("turn").cast("int"))).alias("audio_path"),
        F.when(k % 8 != 3, F.concat(F.col("text"), F.lit("~"))).alias("answer"),
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("voice"), F.when(k % 13 == 0, "tts").otherwise("subtitles").alias("kind"))


#: cues() in DuckDB SQL, to be put first in a query.
CUES = """
with k as (select *, conv_id * 7 + turn * 13 as k from conversations),
cues as (select conv_id job_id, turn::bigint idx, role speaker, text source_text, (turn * 4000)::bigint start_ms, (turn * 4000 + 3500)::bigint end_ms,
  (case when k % 5 = 0 then '[' || upper(role) || '] ' when k % 5 = 1 then upper(role[1]) || lower(role[2:]) || ': ' when k % 5 = 2 then '<i>' when k % 11 = 3 then 'Note: ' else '' end) || coalesce(text, '') labelled,
  case when k % 6 = 0 then ' (' || text || ')' else text end captioned,
  (case when k % 7 = 0 then 0 else length(coalesce(text, '')) * 11 + k % 900 end)::bigint clip_ms,
  case when k % 4 = 0 then 'rerolled' when k % 4 = 1 then 'pending' when k % 9 = 2 then 'failed' else 'qc_pass' end status,
  case when k % 3 = 0 then null when k % 10 = 1 then '' else 'cue_' || lpad(turn::varchar, 5, '0') || '.wav' end audio_path,
  case when k % 8 <> 3 then text || '~' end answer, 'v' || (k % 3)::varchar voice, case when k % 13 = 0 then 'tts' else 'subtitles' end kind from k)
"""


def tone(clip_ms: int) -> np.ndarray:
    """A clip of so many milliseconds, at 8 kHz."""
    return np.sin(0.2 * np.arange(1, 8 * clip_ms + 1)).astype(np.float32)


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("cue_id"), F.col("l_linenumber").alias("attempt"), F.bround(1 - F.col("l_discount"), 2).alias("coverage"), F.bround(1 - F.col("l_tax"), 2).alias("similarity"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_quantity") * 100 - 300).cast("long").alias("clip_ms"), F.col("l_extendedprice").alias("price"))


TAKES = """
with takes as (select l_orderkey cue_id, l_linenumber attempt, round_even(1 - l_discount, 2) coverage, round_even(1 - l_tax, 2) similarity, l_partkey part, l_suppkey supp, (l_quantity * 100 - 300)::bigint clip_ms, l_extendedprice price from lineitem)
"""


def _timed_words(every: bool):
    """Words of lines, parted by spaces, with their made times and scores, of which some are left out unless `every` has its times."""

    def make(lines: pa.Array, file: pa.Array, seg: pa.Array) -> pa.Array:
        parts = pc.split_pattern(lines, " ")
        word = parts.flatten()
        row = np.repeat(np.arange(len(lines)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        keep = pc.not_equal(word, "")
        word, row = word.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lines)))])
        i = np.arange(len(row)) - ends[row]
        nameless = pc.is_null(file).to_numpy(zero_copy_only=False)[row]
        seg = seg.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        k = pc.fill_null(file, 0).to_numpy(zero_copy_only=False)[row] + seg
        at = (seg * 100000 + i * 300 + i // 9 * 700).astype(float) / 1000
        known = ~nameless & (np.fmod(k + i, 17) != 5) | every
        scored = ~nameless & (np.fmod(k + i, 5) != 1)
        score = (np.fmod(k * 31 + i * 7, 97) + 3).astype(float) / 100
        made = pa.StructArray.from_arrays([word, pa.array(at, mask=~known), pa.array(at + 0.25, mask=~known), pa.array(score, mask=~scored)], ["word", "start", "end", "score"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)

    return F.arrow_udf(make, "array<struct<word:string,start:double,end:double,score:double>>")


def words(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Segments of a document's lines that have words: each word with
    integer-millisecond timings, some left out unless `every` word has them."""
    # the made words take many times the room of the text, so texts of few files are dealt over all cores first
    texts = read(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition(spark.sparkContext.defaultParallelism)
    d = texts.select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seg", "line"))
    seg = d.where(F.trim("line") != "").select("doc_id", "lang", "seg", "line", _timed_words(every)("line", F.col("doc_id").cast("long"), "seg").alias("words"))
    return seg.select(F.col("doc_id").alias("file"), F.col("lang").alias("language"), "seg", (F.col("seg") * 100).cast("double").alias("start"), (F.col("seg") * 100 + F.size("words") * 0.4).cast("double").alias("end"), F.col("line").alias("text"), "words")

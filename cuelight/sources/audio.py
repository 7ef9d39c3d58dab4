"""WAV clips and archives, through the standard library in Arrow batches."""

from __future__ import annotations

import io
import warnings
import wave
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1, channels mixed by their mean, and the rate."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, {2: np.int16, 4: np.int32}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def encode(samples, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float32), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encoded(samples, rate: int, kind: str = "wav", mp3: Callable | None = None) -> tuple[bytes, str, str]:
    """Bytes, extension and media type. mp3: samples, rate -> bytes, an encoder
    from outside; without one, or where it fails, a WAV is made."""
    if kind == "mp3" and mp3 is not None:
        try:
            return mp3(samples, rate), "mp3", "audio/mpeg"
        except Exception as e:
            warnings.warn(f"no mp3, wav instead: {e}", stacklevel=2)
    return encode(samples, rate), "wav", "audio/wav"


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples, error of every file; a broken file has an error instead of samples."""

    def load(batches):
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    x, rate = decode(raw)
                    out.append((path, rate, x.tolist(), None))
                except Exception as e:  # a row a file, broken or not
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "rate", "samples", "error"]).astype({"rate": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, rate int, samples array<float>, error string")


def clip_index(files: DataFrame) -> DataFrame:
    """idx, path: the clip of each cue number; '7.wav' comes before '0007.wav'."""
    name = F.regexp_extract("path", r"([0-9]+)\.wav$", 1)
    rows = files.where(name != "").select(name.cast("int").alias("idx"), "path", F.when(name == name.cast("int").cast("string"), 0).when(F.length(name) == 4, 1).alias("_r"))
    return rows.where("_r is not null").groupBy("idx").agg(F.min_by("path", "_r").alias("path"))


def encode_wav(clips: DataFrame, rate: int) -> DataFrame:
    """Adds wav (bytes) to rows with samples."""
    to_wav = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else encode(x, rate)), "binary")
    return clips.withColumn("wav", to_wav("samples"))


def zip_lines(clips: DataFrame) -> DataFrame:
    """job_id, zip: a job's clips (job_id, idx from 0, wav) as numbered entries."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for idx, raw in pdf.sort_values("idx")[["idx", "wav"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(f"{idx + 1:04d}.wav"), raw)
        return pd.DataFrame({"job_id": [pdf["job_id"].iat[0]], "zip": [out.getvalue()]})

    kind = clips.schema["job_id"].dataType.simpleString()
    return clips.groupBy("job_id").applyInPandas(pack, f"job_id {kind}, zip binary")

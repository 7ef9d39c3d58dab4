"""Spectra of samples: overlapping frames, mel bands, and what a voice sounds like.

Frames are cut and transformed in numpy, a batch of rows at a time. Long clips
may come in chunks: a frame that begins in a chunk ends in the next one, whose
beginning is brought along, and sums over frames are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Samples a second, of a frame and between frames, mel bands and coefficients, shortest clip in seconds.
RATE, FRAME, HOP, BANDS, COEFFICIENTS, SHORTEST_S = 24_000, 2048, 512, 128, 20, 0.25
#: Power below which a band is silent, and dB below the loudest that are kept.
SILENT, RANGE_DB = 1e-10, 80.0


def frames(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Whole frames of x, a row each."""
    n = 1 + (len(x) - frame) // hop if len(x) >= frame else 0
    return np.lib.stride_tricks.sliding_window_view(x, frame)[:: hop][:n] if n else np.zeros((0, frame))


def magnitudes(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    return np.abs(np.fft.rfft(frames(x, frame, hop) * window, axis=1))


def mel_bands(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles of equal area, evenly spaced on a scale that is even in Hz up to 1000 and in its logarithm beyond."""
    step, knee, log_step = 200 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, knee) / knee) / log_step)
    mels = np.linspace(0, to_mel(np.array(rate / 2)), bands + 2)
    edges = np.where(mels < knee / step, mels * step, knee * np.exp((mels - knee / step) * log_step))
    hz = np.fft.rfftfreq(frame, 1 / rate)
    up = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def timbre_of(x: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP, bands: int = BANDS, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """Mean cepstral coefficients of the mel bands; zeros for clips too short to tell."""
    if len(x) < rate * SHORTEST_S:
        return np.zeros(coefficients)
    power = magnitudes(np.pad(x, frame // 2), frame, hop) ** 2 @ mel_bands(rate, frame, bands).T
    level = 10 * np.log10(np.maximum(power, SILENT))
    level = np.maximum(level, level.max() - RANGE_DB).mean(0)
    k, m = np.arange(coefficients)[:, None], np.arange(bands)
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * bands)) * np.sqrt(np.where(k == 0, 1, 2) / bands)
    return basis @ level


def timbre(samples: Column, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> Column:
    """array<double> for functions.text.cosine(); null samples give null."""
    return F.pandas_udf(lambda xs: pd.Series([None if x is None else timbre_of(np.nan_to_num(np.asarray(x, float)), rate, frame, hop) for x in xs]), "array<double>")(samples)


def spectrum(clips: DataFrame, key: str, samples: str = "samples", chunk: str | None = None, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """voice, hz, power: mean magnitude of each frequency over a clip's whole
    frames, as qc.bandwidth() takes it. With `chunk`, a clip's rows in its order,
    of a multiple of `hop` samples each but for the last, and of a frame at least
    but for the last two; frames run across them. Clips shorter than a frame have
    no row."""
    rows = clips.select(F.col(key).alias("voice"), F.col(samples).alias("_x"), *([F.col(chunk).alias("_at")] if chunk else []))
    if chunk:
        w = W.partitionBy("voice").orderBy("_at")
        rest = lambda k: F.coalesce(F.slice(F.lead("_x", k).over(w), 1, frame), F.array().cast(rows.schema["_x"].dataType))
        rows = rows.withColumn("_more", F.slice(F.concat(rest(1), rest(2)), 1, frame - hop)).select("voice", "_x", F.concat("_x", "_more").alias("_all"))
    else:
        rows = rows.select("voice", "_x", F.col("_x").alias("_all"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray | None] = []
            counts = []
            for own, x in zip(batch.column(1), batch.column(2)):
                x = np.nan_to_num(np.asarray(x.as_py() or [], float))
                m = magnitudes(x, frame, hop)[: -(-len(own) // hop) if own.is_valid else 0]  # frames that begin in the row
                out.append(m.sum(0) if len(m) else None)
                counts.append(len(m))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["voice", "n", "sums"])

    kind = rows.schema["voice"].dataType.simpleString()
    parts = rows.mapInArrow(sums, f"voice {kind}, n long, sums array<double>").where("n > 0")
    bins = parts.select("voice", "n", F.posexplode("sums").alias("bin", "x")).groupBy("voice", "bin").agg((F.sum("x") / F.sum("n")).alias("power"))
    return bins.select("voice", (F.col("bin") * rate / frame).alias("hz"), "power")

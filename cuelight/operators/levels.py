"""Loudness over hops of samples, ducking, and what a bed of sound is worth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T

# Levels in dBFS, times in seconds.
SPEECH_DBFS, TARGET_DBFS, MOST_BOOST_DB = -45.0, -20.0, 12.0
ATTACK_S, RELEASE_S = 0.05, 0.40
SILENT_DBFS, DEFICIT_DB, RESIDUAL_DB = -50.0, 20.0, -20.0


def hops(samples: Column, hop: int) -> Column:
    """rms of each hop; the last is padded with silence, so it too is divided by hop."""
    n = F.ceil(F.size(samples) / hop).cast("int")
    power = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.sqrt(power(F.slice(samples, k * hop + 1, F.lit(hop))) / hop))).otherwise(F.array(F.lit(0.0)))


def speech_gain(rms: Column) -> Column:
    """What brings the speaking hops to the target level; at most the boost; 1 where nobody speaks."""
    said = F.filter(rms, lambda r: r > 10 ** (SPEECH_DBFS / 20))
    mean = F.aggregate(said, F.lit(0.0), lambda a, r: a + r) / F.size(said)
    return F.when(F.size(said) > 0, F.least(F.lit(10 ** (MOST_BOOST_DB / 20)), F.lit(10 ** (TARGET_DBFS / 20)) / F.greatest(mean, F.lit(1e-9)))).otherwise(1.0)


def duck_hops(rms: Column, duck_gain: float) -> Column:
    """Gain of the bed at each hop: it falls while someone speaks and recovers
    after, each step a part of the way that hangs on the direction."""
    attack, release = 1 - float(np.exp(-1 / (ATTACK_S * 100))), 1 - float(np.exp(-1 / (RELEASE_S * 100)))

    def follow(hops_: pa.Array) -> pa.Array:
        out = []
        for r in hops_:
            g, gains = 1.0, []
            for target in (duck_gain if x > 10 ** (SPEECH_DBFS / 20) else 1.0 for x in r.as_py() or ()):
                g += (target - g) * (attack if target < g else release)
                gains.append(g)
            out.append(gains if r.is_valid else None)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(follow, "array<double>")(rms)


def duck_curve(clips: DataFrame, samples: str, hop: int, duck_gain: float) -> DataFrame:
    """Adds gain, one value a sample: the hops' gains, in a line between their middles."""

    def spread(gains: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.interp(np.arange(k), np.arange(len(g)) * hop + hop / 2, np.asarray(g, float)).astype("float32").tolist() for g, k in zip(gains, n)])

    return clips.withColumn("gain", F.pandas_udf(spread, "array<float>")(duck_hops(hops(F.col(samples), hop), duck_gain), F.size(samples)))


def duck_db(asked: Column, separated: Column) -> Column:
    return F.coalesce(asked, F.when(separated, 10.0).otherwise(18.0))


def thin_bed(bed_dbfs: Column, mix_dbfs: Column) -> Column:
    """Too quiet, or too far below the mix it came from, to carry the background."""
    return (bed_dbfs <= SILENT_DBFS) | (mix_dbfs - bed_dbfs >= DEFICIT_DB)


def blended(bed: Column, residual: Column, thin: Column, residual_db: float | None = RESIDUAL_DB) -> Column:
    """A thin bed with what separation left over added at a low level; other beds as they are."""
    if residual_db is None:
        return bed
    level = 10 ** (residual_db / 20)
    both = F.zip_with(bed, residual, lambda x, r: F.when(r.isNull(), x).otherwise(x + r * level))
    added = F.slice(both, F.lit(1), F.size(bed))  # what is left over may be longer
    return F.when(thin & residual.isNotNull(), added).otherwise(bed)


def mixed(bed: Column, gain: Column, voice: Column, bed_gain_db: float = 0.0) -> Column:
    """Voice over the ducked bed, scaled down to a peak of 0.98 if it is over.
    Time is linear in the samples: mix and peak are computed once a row."""
    level = 10 ** (bed_gain_db / 20)
    duck = F.zip_with(bed, gain, lambda b, g: F.coalesce(b, F.lit(0.0)).cast("double") * F.coalesce(g, F.lit(0.0)) * level)
    mix = F.zip_with(duck, voice, lambda b, v: F.coalesce(b, F.lit(0.0)) + F.coalesce(v.cast("double"), F.lit(0.0)))
    both = T.let(mix, lambda m: F.struct(m.alias("m"), F.coalesce(F.aggregate(m, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))), F.lit(0.0)).alias("peak")))
    return T.let(both, lambda s: F.when(s["peak"] > 0.98, F.transform(s["m"], lambda x: x * 0.98 / s["peak"])).otherwise(s["m"]))


def joined(clips: Column, gap: int) -> Column:
    """One array of a list of clips, with `gap` silent samples strictly between them."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), gap)
    return F.flatten(F.transform(clips, lambda c, i: F.when(i == 0, c).otherwise(F.concat(silence, c))))


def level_delta(before: Column, after: Column) -> Column:
    """dB taken out, as of noise."""
    return T.dbfs(before, -120.0) - T.dbfs(after, -120.0)

"""Measures of sampled signals (SIG) over a table of samples (audio_id, channel, i, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bounds of the analysis bands in Hz.
BANDS = ((60, 120), (120, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 8000), (8000, 16000))


def mono(samples: DataFrame) -> DataFrame:
    """(audio_id, i, x): channels averaged, the mean removed."""
    mixed = samples.groupBy("audio_id", "i").agg(F.avg("value").alias("x"))
    level = mixed.groupBy("audio_id").agg(F.avg("x").alias("dc"))
    return mixed.join(level, "audio_id").select("audio_id", "i", (F.col("x") - F.col("dc")).alias("x"))


def levels(samples: DataFrame) -> DataFrame:
    """(audio_id, peak, rms, crest_db): the peak over raw channels, RMS and crest of the mono mix."""
    peak = samples.groupBy("audio_id").agg(F.max(F.abs("value")).alias("peak"))
    out = mono(samples).groupBy("audio_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).join(peak, "audio_id")
    return out.withColumn("crest_db", F.when((F.col("rms") > 0) & (F.col("peak") > 0), 20 * F.log10(F.col("peak") / F.col("rms"))))


def activity(samples: DataFrame, frame: int = 16, gate_db: float = -60.0) -> DataFrame:
    """(audio_id, frames, active, activity_ratio): frames (not overlapping) whose RMS is above the gate."""
    rms = mono(samples).groupBy("audio_id", F.floor(F.col("i") / frame).alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("r"))
    loud = F.when(F.col("r") > 0, 20 * F.log10("r") > gate_db).otherwise(False)
    return rms.groupBy("audio_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(loud).alias("active")).withColumn("activity_ratio", F.col("active") / F.col("frames"))


def zero_crossings(samples: DataFrame) -> DataFrame:
    """(audio_id, samples, crossings): sign changes of neighbours in the mono mix."""
    before = F.lag("x").over(Window.partitionBy("audio_id").orderBy("i"))
    rows = mono(samples).withColumn("crossed", (before < 0) != (F.col("x") < 0))
    return rows.groupBy("audio_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("crossed").alias("crossings"))


def stereo_width(samples: DataFrame) -> DataFrame:
    """(audio_id, width): RMS of the side over that of the middle; null if the middle is silent."""
    pair = samples.groupBy("audio_id", "i").pivot("channel", [0, 1]).agg(F.first("value"))
    rms = lambda x: F.sqrt(F.avg(x * x))
    out = pair.groupBy("audio_id").agg(rms((F.col("0") - F.col("1")) / 2).alias("side"), rms((F.col("0") + F.col("1")) / 2).alias("mid"))
    return out.select("audio_id", F.when(F.col("mid") > 0, F.col("side") / F.col("mid")).alias("width"))


def reconcile(stems: DataFrame, mixes: DataFrame) -> DataFrame:
    """Stems (mix_id, audio_id, i, value) summed and held against their mix (mix_id, i, value): gain, correlation, residual in dB, tier."""
    summed = stems.groupBy("mix_id", "i").agg(F.sum("value").alias("s"))
    both = summed.join(mixes.select("mix_id", "i", F.col("value").alias("m")), ["mix_id", "i"])
    fit = both.groupBy("mix_id").agg(F.sum(F.col("s") * F.col("m")).alias("sm"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.corr("s", "m").alias("correlation"), F.count(F.lit(1)).alias("n"))
    left = F.greatest(F.lit(0.0), F.col("mm") - F.col("sm") * F.col("sm") / F.col("ss"))
    out = fit.withColumn("gain", F.when(F.col("ss") > 0, F.col("sm") / F.col("ss"))).withColumn("residual_db", F.when((F.col("mm") > 0) & (left > 0), 10 * F.log10(left / F.col("mm"))))
    tier = F.when(F.col("residual_db") <= -40, "exact").when(F.col("residual_db") <= -20, "close").otherwise("different")
    return out.select("mix_id", "n", "gain", "correlation", "residual_db", tier.alias("tier"))


def band_energies(samples: DataFrame, rate: int) -> DataFrame:
    """(audio_id, band_hz, energy): energy of a file's spectrum from each band's lower bound on; one file is one group."""

    def spectrum(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("i")["x"].to_numpy()
        power, hz = np.abs(np.fft.rfft(x)) ** 2 / max(1, len(x)), np.fft.rfftfreq(len(x), 1 / rate)
        energy = [float(power[(hz >= low) & (hz < high)].sum()) for low, high in BANDS]
        return pd.DataFrame({"audio_id": rows["audio_id"].iloc[0], "band_hz": [low for low, _ in BANDS], "energy": energy})

    return mono(samples).groupBy("audio_id").applyInPandas(spectrum, "audio_id long, band_hz int, energy double")

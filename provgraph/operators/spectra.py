"""Measures of overlapping frames of sampled signals, and comparisons of band energies (SIG).

Frames are centred: frame f has the samples from f * hop - size / 2 on, zeros beyond a file's ends and in gaps, and a
file of n samples has n div hop + 1 of them. A file is never gathered: levels come from sums of hops, of which a
frame is a few; spectra from blocks of frames keyed (audio_id, block) with the samples that their edges share, so
that a long file spans tasks, each of at most BLOCK * hop + size samples.

Rows without audio_id, i or value take no part. A silent frame has a centroid, bandwidth and rolloff of 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import mono

# Frames, silence gate, rolloff, and the least share of a band.
SIZE, HOP = 2048, 512
GATE_DB, ROLLOFF, FLOOR = -60.0, 0.85, 1e-4
#: Frames of a block.
BLOCK = 64


def _ready(samples: DataFrame, size: int, hop: int) -> tuple[DataFrame, DataFrame]:
    """The samples that take part, and (audio_id, last): each file's last frame."""
    if size <= 0 or hop <= 0 or size % (2 * hop):
        raise ValueError(f"a frame of {size} samples must be an even number of hops of {hop}")
    rows = samples.where("audio_id is not null and i is not null and value is not null")
    return rows, rows.groupBy("audio_id").agg(F.floor((F.max("i") + 1) / hop).alias("last"), F.max(F.abs("value")).alias("peak"), (F.max("i") + 1).alias("n"))


def _db(above: Column, below: Column) -> Column:
    return F.when((above > 0) & (below > 0), 20 * F.log10(above / below))


def framed_levels(samples: DataFrame, rate: int, size: int = SIZE, hop: int = HOP, gate_db: float = GATE_DB) -> DataFrame:
    """(audio_id, frames, rms_mean, rms_std, activity_ratio, active_rms_mean, active_seconds, peak, range_db, active_range_db): of frames' RMS, and of those above the gate."""
    rows, files = _ready(samples, size, hop)
    half = size // (2 * hop)
    hops = mono(rows).groupBy("audio_id", F.floor(F.col("i") / hop).alias("c")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    hops = hops.join(files.select("audio_id", "last"), "audio_id")
    of_frames = hops.select("audio_id", "e", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - half + 1), F.least("last", F.col("c") + half))).alias("frame"))
    rms = of_frames.groupBy("audio_id", "frame").agg(F.sqrt(F.sum("e") / size).alias("r"))
    loud = F.col("r") > 10 ** (gate_db / 20)
    sums = rms.groupBy("audio_id").agg(F.count(F.lit(1)).alias("held"), F.avg("r").alias("mean"), F.var_pop("r").alias("var"), F.count_if(loud).alias("active"), F.avg(F.when(loud, F.col("r"))).alias("active_rms_mean"))
    # frames that no sample reaches are silent
    out = files.join(sums, "audio_id").withColumn("frames", F.col("last") + 1)
    out = out.withColumn("rms_mean", F.col("mean") * F.col("held") / F.col("frames")).withColumn("activity_ratio", F.col("active") / F.col("frames"))
    off = F.col("mean") - F.col("rms_mean")
    var = (F.col("held") * (F.col("var") + off * off) + (F.col("frames") - F.col("held")) * F.col("rms_mean") * F.col("rms_mean")) / F.col("frames")
    seconds = F.when(F.col("active") > 0, F.col("activity_ratio") * F.col("n") / rate)
    ranges = [_db(F.col("peak"), F.col("rms_mean")).alias("range_db"), _db(F.col("peak"), F.col("active_rms_mean")).alias("active_range_db")]
    return out.select("audio_id", "frames", "rms_mean", F.sqrt(var).alias("rms_std"), "activity_ratio", "active_rms_mean", seconds.alias("active_seconds"), "peak", *ranges)


def frame_spectra(x: np.ndarray, size: int, hop: int, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, bandwidth and rolloff of every frame that x, begun at the first frame's first sample, holds whole."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * window, axis=1))
    hz = np.arange(power.shape[1]) * rate / size
    total = power.sum(axis=1, keepdims=True)
    share = power / np.where(total > np.finfo(float).tiny, total, 1.0)
    centroid = share @ hz
    bandwidth = np.sqrt((share * (hz - centroid[:, None]) ** 2).sum(axis=1))
    return centroid, bandwidth, hz[(np.cumsum(power, axis=1) >= ROLLOFF * total).argmax(axis=1)]


def spectral_means(samples: DataFrame, rate: int, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """(audio_id, frames, centroid, bandwidth, rolloff): means over all frames, in Hz."""
    rows, files = _ready(samples, size, hop)
    i, half = F.col("i"), size // 2
    first, last = F.greatest(F.lit(0), F.floor((i - half) / hop) + 1), F.least("last", F.floor((i + half) / hop))
    blocks = F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))
    dealt = mono(rows).join(files.select("audio_id", "last"), "audio_id").where(first <= last).select("audio_id", F.explode(blocks).alias("block"), "last", "i", "x")

    def measure(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * BLOCK
        n = min(BLOCK, int(part["last"].iloc[0]) - start + 1)
        x = np.zeros((n - 1) * hop + size)
        at = part["i"].to_numpy() - (start * hop - half)
        inside = at < len(x)
        x[at[inside]] = part["x"].to_numpy()[inside]
        sums = [float(v.sum()) for v in frame_spectra(x, size, hop, rate)]
        return pd.DataFrame([(key[0], *sums)], columns=["audio_id", "c", "b", "r"])

    kind = samples.schema["audio_id"].dataType.simpleString()
    sums = dealt.groupBy("audio_id", "block").applyInPandas(measure, f"audio_id {kind}, c double, b double, r double")
    sums = sums.groupBy("audio_id").agg(F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("r").alias("r"))
    frames = F.col("last") + 1
    return files.join(sums, "audio_id").select("audio_id", frames.alias("frames"), *((F.col(s) / frames).alias(name) for s, name in zip("cbr", ("centroid", "bandwidth", "rolloff"), strict=True)))


def band_residuals(mixes: DataFrame, residuals: DataFrame) -> DataFrame:
    """(audio_id, band_hz, residual_db): energies (audio_id, band_hz, energy) of what a mix's stems leave, against the mix's, a band of which counts as FLOOR of all its bands at least."""
    total = mixes.groupBy("audio_id").agg(F.sum("energy").alias("total"))
    rows = mixes.join(total, "audio_id").join(residuals.where("energy > 0").select("audio_id", "band_hz", F.col("energy").alias("left")), ["audio_id", "band_hz"])
    least = FLOOR * F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    return rows.select("audio_id", "band_hz", F.round(10 * F.log10(F.col("left") / F.greatest("energy", least)), 2).alias("residual_db"))


def compare_bands(pairs: DataFrame, bands: DataFrame) -> DataFrame:
    """(pair_id, band_hz, delta_db, largest) of pairs (pair_id, mix_id, ref_id): how much more of its energy (audio_id, band_hz, energy) a mix has in a band than its reference.

    Shares count as FLOOR at least; pairs of which one side has no energy give no rows; of equally large differences the lowest band's is the largest.
    """
    total = bands.groupBy("audio_id").agg(F.sum("energy").alias("total")).where("total > 0")
    shares = bands.join(total, "audio_id").select("audio_id", "band_hz", F.greatest(F.col("energy") / F.col("total"), F.lit(FLOOR)).alias("share"))
    side = lambda c: shares.select(F.col("audio_id").alias(c), "band_hz", F.col("share").alias(f"{c}_share"))
    rows = pairs.join(side("mix_id"), "mix_id").join(side("ref_id"), ["ref_id", "band_hz"])
    rows = rows.select("pair_id", "band_hz", (F.round(10 * F.log10(F.col("mix_id_share") / F.col("ref_id_share")), 2) + 0.0).alias("delta_db"))
    top = rows.groupBy("pair_id").agg(F.max(F.struct(F.abs("delta_db").alias("d"), (-F.col("band_hz")).alias("b"))).alias("top"))
    return rows.join(top, "pair_id").select("pair_id", "band_hz", "delta_db", (F.col("band_hz") == -F.col("top.b")).alias("largest"))


def compare_measures(pairs: DataFrame, measures: DataFrame) -> DataFrame:
    """(pair_id, lufs_delta, crest_delta_db, width_delta) from measures (audio_id, lufs, active_range_db, range_db, width); the crest of active frames comes before that of all; unknown on one side is unknown."""
    names = ("lufs", "active_range_db", "range_db", "width")
    side = lambda c: measures.select(F.col("audio_id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in names))
    rows = pairs.join(side("mix_id"), "mix_id", "left").join(side("ref_id"), "ref_id", "left")
    delta = {x: F.round(F.col(f"mix_id_{x}") - F.col(f"ref_id_{x}"), 2) for x in names}
    return rows.select("pair_id", delta["lufs"].alias("lufs_delta"), F.coalesce(delta["active_range_db"], delta["range_db"]).alias("crest_delta_db"), delta["width"].alias("width_delta"))

"""Registered queries of framed signals and band comparisons, with their SQL.

The events in the order of their ids are one signal of 48 kHz, cut into recordings of 64 samples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal, spectra
from ..sources.corpus import tables
from .queries import query

RATE, SIZE, HOP = 48_000, 16, 4

RECORDINGS = """WITH m AS (SELECT event_id // 64 AS audio_id, event_id % 64 AS i, avg(value) AS v FROM events GROUP BY ALL),
x AS (SELECT audio_id, i, v - avg(v) OVER (PARTITION BY audio_id) AS x, max(i) OVER (PARTITION BY audio_id) + 1 AS n FROM m),
fs AS (SELECT audio_id, n, unnest(range(n // 4 + 1)) AS f FROM (SELECT DISTINCT audio_id, n FROM x))"""


def _recordings(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select(F.expr("event_id div 64").alias("audio_id"), F.lit(0).alias("channel"), (F.col("event_id") % 64).alias("i"), "value")


@query(RECORDINGS + """,
p AS (SELECT event_id // 64 AS audio_id, max(abs(value)) AS peak FROM events GROUP BY 1),
r AS (SELECT fs.audio_id, fs.n, f, sqrt(coalesce(sum(x.x * x.x), 0) / 16) AS r FROM fs LEFT JOIN x ON x.audio_id = fs.audio_id AND x.i >= f * 4 - 8 AND x.i < f * 4 + 8 GROUP BY ALL),
a AS (SELECT audio_id, n, count(*) AS frames, avg(r) AS rms_mean, stddev_pop(r) AS rms_std, avg(r) FILTER (r > 100) AS active_rms_mean, count(*) FILTER (r > 100) AS active FROM r GROUP BY ALL)
SELECT audio_id, frames, round(rms_mean, 6) AS rms_mean, round(rms_std, 6) AS rms_std, round(active / frames, 6) AS activity_ratio, round(active_rms_mean, 6) AS active_rms_mean,
  CASE WHEN active > 0 THEN round(active / frames * n / 48000, 8) END AS active_seconds, round(peak, 6) AS peak,
  CASE WHEN peak > 0 AND rms_mean > 0 THEN round(20 * log10(peak / rms_mean), 6) END AS range_db,
  CASE WHEN peak > 0 AND active_rms_mean > 0 THEN round(20 * log10(peak / active_rms_mean), 6) END AS active_range_db FROM a JOIN p USING (audio_id)""")
def signal_framed_levels(spark, sf_dir):
    out = spectra.framed_levels(_recordings(spark, sf_dir), RATE, SIZE, HOP, 40.0)
    return out.select("audio_id", "frames", *(F.round(c, 8 if c == "active_seconds" else 6).alias(c) for c in out.columns[2:]))


@query(RECORDINGS + """,
h AS (SELECT fs.audio_id, fs.n, f, x.i - f * 4 + 8 AS k, x.x * (0.5 - 0.5 * cos(2 * pi() * (x.i - f * 4 + 8) / 16)) AS x FROM fs JOIN x ON x.audio_id = fs.audio_id AND x.i >= f * 4 - 8 AND x.i < f * 4 + 8),
d AS (SELECT audio_id, n, f, b, sqrt(pow(sum(x * cos(2 * pi() * b * k / 16)), 2) + pow(sum(x * sin(2 * pi() * b * k / 16)), 2)) AS s FROM h, (SELECT unnest(range(9)) AS b) GROUP BY ALL),
c AS (SELECT *, b * 3000.0 AS hz, sum(s) OVER (PARTITION BY audio_id, f) AS t, sum(s) OVER (PARTITION BY audio_id, f ORDER BY b) AS u FROM d),
g AS (SELECT *, CASE WHEN t > 1e-300 THEN sum(s * hz) OVER (PARTITION BY audio_id, f) / t ELSE 0 END AS centroid FROM c),
o AS (SELECT audio_id, n, f, max(centroid) AS centroid, CASE WHEN max(t) > 1e-300 THEN sqrt(sum(s / t * pow(hz - centroid, 2))) ELSE 0 END AS bandwidth, min(hz) FILTER (u >= 0.85 * t) AS rolloff FROM g GROUP BY ALL)
SELECT audio_id, n // 4 + 1 AS frames, round(sum(centroid) / (n // 4 + 1), 4) AS centroid, round(sum(bandwidth) / (n // 4 + 1), 4) AS bandwidth, round(sum(rolloff) / (n // 4 + 1), 4) AS rolloff FROM o GROUP BY audio_id, n""")
def signal_spectral_means(spark, sf_dir):
    out = spectra.spectral_means(_recordings(spark, sf_dir), RATE, SIZE, HOP)
    return out.select("audio_id", "frames", *(F.round(c, 4).alias(c) for c in ("centroid", "bandwidth", "rolloff")))


@query(RECORDINGS + """,
q AS (SELECT *, row_number() OVER (PARTITION BY audio_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY audio_id) AS len FROM x),
bins AS (SELECT audio_id, len, unnest(range(len // 2 + 1)) AS b FROM (SELECT DISTINCT audio_id, len FROM q)),
d AS (SELECT bins.audio_id, bins.b * 48000.0 / bins.len AS hz, pow(sum(x * cos(2 * pi() * b * k / bins.len)), 2) + pow(sum(x * sin(2 * pi() * b * k / bins.len)), 2) AS p FROM bins JOIN q USING (audio_id) GROUP BY bins.audio_id, bins.b, bins.len),
edges AS (SELECT unnest([60, 120, 250, 500, 1000, 2000, 4000, 8000]) AS lo, unnest([120, 250, 500, 1000, 2000, 4000, 8000, 16000]) AS hi),
e AS (SELECT audio_id, lo, coalesce(sum(p) FILTER (hz >= lo AND hz < hi), 0) AS energy FROM d, edges GROUP BY ALL),
s AS (SELECT *, greatest(energy / sum(energy) OVER (PARTITION BY audio_id), 1e-4) AS share, sum(energy) OVER (PARTITION BY audio_id) AS total FROM e),
o AS (SELECT a.audio_id // 2 AS pair_id, a.lo AS band_hz, round(10 * log10(a.share / b.share), 2) + 0.0 AS delta_db FROM s a JOIN s b ON a.audio_id % 2 = 1 AND b.audio_id = a.audio_id - 1 AND a.lo = b.lo WHERE a.total > 0 AND b.total > 0)
SELECT pair_id, band_hz, delta_db, row_number() OVER (PARTITION BY pair_id ORDER BY abs(delta_db) DESC, band_hz) = 1 AS largest FROM o""")
def signal_reference_bands(spark, sf_dir):
    recordings = _recordings(spark, sf_dir)
    odd = recordings.where("audio_id % 2 = 1").select("audio_id").distinct()
    pairs = odd.select(F.expr("audio_id div 2").alias("pair_id"), F.col("audio_id").alias("mix_id"), (F.col("audio_id") - 1).alias("ref_id"))
    return spectra.compare_bands(pairs, signal.band_energies(recordings, RATE))

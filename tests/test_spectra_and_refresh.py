"""Framed signals against one-shot computation, changed bundles, written datasets."""

import json

import numpy as np
import pytest

from provgraph.operators import spectra
from provgraph.sources import bundles
from provgraph.streaming import ingest

SAMPLES = "audio_id long, channel int, i long, value double"


def whole(x, size, hop):
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2 + hop)])
    return np.stack([padded[f * hop : f * hop + size] for f in range(len(x) // hop + 1)])


def test_frames_equal_one_shot(spark):
    rng, size, hop, rate = np.random.default_rng(5), 32, 8, 8000
    files = {1: rng.normal(size=3 * spectra.BLOCK * hop + 13), 2: rng.normal(size=5), 3: np.zeros(64), 4: np.append(rng.normal(size=40), np.zeros(160)), 5: rng.normal(size=size)}
    rows = [(a, 0, i, float(v)) for a, x in files.items() for i, v in enumerate(x)] + [(None, 0, 1, 1.0), (1, 0, None, 9.0), (1, 1, 2, None)]
    samples = spark.createDataFrame(rows, SAMPLES)
    levels = {r.audio_id: r for r in spectra.framed_levels(samples, rate, size, hop, -20.0).collect()}
    means = {r.audio_id: r for r in spectra.spectral_means(samples, rate, size, hop).collect()}
    assert set(levels) == set(means) == set(files)
    window, hz = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size), np.arange(size // 2 + 1) * rate / size
    for a, x in files.items():
        frames = whole(x - x.mean(), size, hop)
        rms = np.sqrt((frames**2).mean(axis=1))
        active = rms > 0.1
        got = levels[a]
        assert got.frames == means[a].frames == len(frames)
        assert np.allclose([got.rms_mean, got.rms_std, got.activity_ratio], [rms.mean(), rms.std(), active.mean()], atol=1e-9)
        if active.any():
            assert np.allclose([got.active_rms_mean, got.active_seconds, got.active_range_db], [rms[active].mean(), active.mean() * len(x) / rate, 20 * np.log10(np.abs(x).max() / rms[active].mean())])
        else:
            assert got.active_rms_mean is got.active_seconds is got.active_range_db is None
        want = np.zeros((len(frames), 3))
        for f, part in enumerate(frames):
            s = np.abs(np.fft.rfft(part * window))
            if s.sum() > 1e-300:
                c = (s * hz).sum() / s.sum()
                want[f] = c, np.sqrt((s * (hz - c) ** 2).sum() / s.sum()), hz[np.flatnonzero(np.cumsum(s) >= 0.85 * s.sum())[0]]
        assert np.allclose([means[a].centroid, means[a].bandwidth, means[a].rolloff], want.mean(axis=0))


def test_gaps_are_silence_and_odd_frames_are_refused(spark):
    far = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, -1.0), (1, 0, 9_999, 0.0)], SAMPLES)
    x = np.zeros(10_000)
    x[:2] = 1, -1
    rms = np.sqrt((whole(x, 32, 8) ** 2).mean(axis=1))
    got = spectra.framed_levels(far, 100, 32, 8).first()
    assert got.frames == len(rms) and np.allclose([got.rms_mean, got.rms_std], [rms.mean(), rms.std()])
    assert spectra.spectral_means(far, 100, 32, 8).first().frames == len(rms)
    assert spectra.framed_levels(far.where("false"), 100).count() == spectra.spectral_means(far.where("false"), 100).count() == 0
    with pytest.raises(ValueError):
        spectra.framed_levels(far, 100, 24, 8)


def test_band_comparisons(spark):
    bands = spark.createDataFrame([(1, 60, 50.0), (1, 120, 50.0), (2, 60, 100.0), (2, 120, 0.0), (3, 60, 0.0), (3, 120, 0.0)], "audio_id long, band_hz int, energy double")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3), (9, 1, 1)], "pair_id long, mix_id long, ref_id long")
    got = sorted(map(tuple, spectra.compare_bands(pairs, bands).collect()))
    assert got == [(7, 60, -3.01, False), (7, 120, 36.99, True), (9, 60, 0.0, True), (9, 120, 0.0, False)]
    left = spark.createDataFrame([(2, 60, 1.0), (2, 120, 1.0), (1, 60, 0.0)], "audio_id long, band_hz int, energy double")
    assert sorted(map(tuple, spectra.band_residuals(bands, left).collect())) == [(2, 60, -20.0), (2, 120, 20.0)]
    measures = spark.createDataFrame([(1, -14.0, None, 9.0, 0.5), (2, -16.5, 3.0, 9.0, None)], "audio_id long, lufs double, active_range_db double, range_db double, width double")
    assert tuple(spectra.compare_measures(pairs.where("pair_id = 7"), measures).first()) == (7, 2.5, 0.0, None)


def test_refresh_reads_what_changed(spark, tmp_path):
    root, state, seen = tmp_path / "in", str(tmp_path / "state"), []

    def put(name, text):
        (root / name).mkdir(parents=True, exist_ok=True)
        (root / name / bundles.SNAPSHOT).write_text(text)

    def call():
        seen.clear()
        number = ingest.refresh(spark, str(root), state, lambda df, n: seen.extend((r.change, r.snapshot.snapshot_id if r.snapshot else None, n) for r in df.collect()))
        return number, sorted(seen, key=str)

    put("a", json.dumps({"snapshot_id": "a1"}))
    put("b", json.dumps({"snapshot_id": "b1"}))
    assert call() == (0, [("new", "a1", 0), ("new", "b1", 0)])
    assert call() == (0, [])
    put("a", json.dumps({"snapshot_id": "a2", "project": "p"}))
    put("c", json.dumps({"snapshot_id": "c1"}))
    assert call() == (1, [("changed", "a2", 1), ("new", "c1", 1)])
    put("b", json.dumps({"snapshot_id": "b1"}))  # a new time, the old content
    (root / "c" / bundles.SNAPSHOT).unlink()
    assert call()[1] == [("removed", None, 2)]

    def lost(df, n):
        raise RuntimeError("lost")

    put("d", "not json")
    with pytest.raises(RuntimeError):
        ingest.refresh(spark, str(root), state, lost)
    number, changes = call()
    assert number == 3 and [c[0] for c in changes] == ["new"] and call() == (3, [])


def test_dataset_has_the_same_bytes_and_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(50).selectExpr("id % 3 AS bundle_id", "CAST(id AS string) AS text", "map('k', id) AS m")
    out = tmp_path / "out"
    read = lambda: sorted(f.read_bytes() for part in ("x", "y") for f in (out / part).glob("part-*"))
    manifest = bundles.write_dataset({"x": rows.mapInPandas(count, rows.schema), "y": rows.limit(0)}, str(out), 3)
    first = read()
    assert sorted(map(tuple, manifest.collect())) == [("x", 50), ("y", 0)] and seen.value == 50
    bundles.write_dataset({"x": rows.orderBy("text"), "y": rows.limit(0)}, str(out), 3)
    assert read() == first and (out / "manifest" / "_SUCCESS").exists()

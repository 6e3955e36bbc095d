"""Signals against direct numpy computations, and streams against batch."""

from __future__ import annotations

import numpy as np
import pytest

from assaywright.operators import signals


def test_flicker_finds_shaking():
    t = np.arange(120) / 30
    still = np.column_stack([10 + 0.1 * t, 20 + 0 * t, 110 + 0.1 * t, 120 + 0 * t])
    assert signals.flicker(still, 30)[0] < 0.1
    shaking = still.copy()
    shaking[:, 0] += np.sin(2 * np.pi * 11 * t)
    score, hz, ratio = signals.flicker(shaking, 30)
    assert score == 1.0 and hz == pytest.approx(11, abs=0.3) and ratio > 0.9
    assert signals.flicker(still[:59], 30) == (0.0, None, 0.0)


def test_band_pass_response():
    b, a = signals.butter_band(4, 0.7 / 15, 4.0 / 15)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 30)) / np.polyval(a, np.exp(2j * np.pi * f / 30)))
    assert gain(0.7) == pytest.approx(2**-0.5, abs=1e-6) and gain(4.0) == pytest.approx(2**-0.5, abs=1e-6)
    assert gain(1.7) == pytest.approx(1, abs=1e-3) and gain(0.01) < 1e-4 and gain(14.9) < 1e-4


def test_zero_phase_keeps_position():
    t = np.arange(300) / 30
    x = np.sin(2 * np.pi * 1.5 * t)
    y = signals.zero_phase(*signals.butter_band(4, 0.7 / 15, 4.0 / 15), x)
    assert np.abs(y - x)[60:-60].max() < 0.02


def test_pulse():
    t = np.arange(300) / 30
    absence, quality, bpm = signals.pulse(128 + np.sin(2 * np.pi * 1.2 * t), 30)
    assert absence == 0.0 and quality == 1.0 and bpm == pytest.approx(72, abs=2)
    assert signals.pulse(np.full(300, 5.0), 30) == (1.0, 0.0, None)
    assert signals.pulse(np.zeros(149), 30) == (0.5, 0.0, None)


def test_blinks(spark):
    def rate(series):
        df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(series)], "track_id bigint, frame bigint, openness double")
        return signals.blink_metrics(df).first()

    r = rate([1.0] * 300)
    assert (r["blinks"], r["blink_rate"], r["rate_anomaly"], r["duration_anomaly"]) == (0, 0.0, 1.0, 0.5)
    r = rate(([1.0] * 50 + [0.1] * 6 + [1.0] * 44) * 6)
    assert r["blinks"] == 6 and r["blink_rate"] == pytest.approx(18) and r["mean_duration_ms"] == pytest.approx(200) and r["duration_anomaly"] == 0.6
    r = rate([0.1] * 10 + [1.0] * 90 + [0.1] * 10)  # an offset first and an onset without an end: no pair is left
    assert (r["blinks"], r["rate_anomaly"], r["duration_anomaly"]) == (0, 1.0, 1.0)


def test_track_queries_take_every_customer(spark):
    from assaywright.plans import detection

    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/customer.parquet").count()
    faces = {r["face_id"]: r for r in detection.track_spectra(spark, data).collect()}
    assert len(faces) == n > 40
    assert sum(r["faces_analyzed"] for r in detection.l2_rollup(spark, data).collect()) == n
    for k in (41, 42, n - 1):  # by the arithmetic of the fixture
        i = np.arange(241 - k % 3 * 40, dtype=float)
        shake = np.sin(i * (0.1 + k % 40 * 0.07)) * (1 + k % 3)
        boxes = np.column_stack([shake + 10, 0 * i + 20, 110 + i * 0.01, 0 * i + 120 + k])
        assert faces[k]["flicker_score"] == pytest.approx(signals.flicker(boxes, 30)[0], abs=1e-6)


def test_frames_are_made_where_their_tracks_lie(spark, monkeypatch):
    from assaywright.plans import views

    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/customer.parquet").count()
    monkeypatch.setattr(views, "TRACKS_A_TASK", 16)
    frames = views.tracks(spark, data)
    assert frames.rdd.getNumPartitions() == -(-n // 16)  # grows with the tracks
    for got in (signals.saccade_metrics(frames), signals.blink_metrics(frames), signals.detrended(frames, "px")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)  # of tracks, none of frames


def test_spectra_of_unequal_tracks(spark):
    r = np.random.default_rng(3)
    rows, expected = [], {}
    for i, n in enumerate([200, 200, 160, 59, 0, 200]):
        boxes, green, fps = r.normal(50, 5, (n, 4)), r.normal(128, 2, n), 25.0 if i == 5 else 30.0
        rows.append((7, i, [tuple(map(float, b)) for b in boxes], [float(g) for g in green], fps))
        expected[i] = (*signals.flicker(boxes, fps), *signals.pulse(green, fps))
    rows.append((7, 6, None, None, 30.0))  # no frames at all
    expected[6] = expected[4]
    df = spark.createDataFrame(rows, "scan_id bigint, face_id bigint, boxes array<struct<x0: double, y0: double, x1: double, y1: double>>, green array<double>, fps double")
    got = {x["face_id"]: tuple(x)[2:] for x in signals.track_spectra(df).collect()}
    assert got.keys() == expected.keys()
    for i, want in expected.items():
        assert [x is None for x in got[i]] == [x is None for x in want] and [x for x in got[i] if x is not None] == pytest.approx([x for x in want if x is not None], abs=1e-9)

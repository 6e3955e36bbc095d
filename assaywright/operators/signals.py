"""Second layer: flicker, pulse and eye signals of face tracks, and their roll-up by video.

Blinks and gaze jumps are window and aggregate expressions over frames. Spectra need a transform of the whole series, so flicker and
pulse are grouped functions over one track (bounded by its frames) in numpy; the zero-phase band-pass is written here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, listed

#: Least frames, frequencies in Hz, filter order, and where scores are full; eye openness and gaze jumps; the bound to go on.
FLICKER_FRAMES, FLICKER_HZ, FLICKER_FULL = 60, 8.0, 0.30
PULSE_FRAMES, PULSE_LOW, PULSE_HIGH, PULSE_ORDER, PULSE_FULL = 150, 0.7, 4.0, 4, 6.0
EYE_FRAMES, CLOSED, JUMP = 90, 0.3, 0.02
ESCALATE = 0.35


# ---- numpy parts
def flickers(boxes: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, dominant frequencies, ratios) of tracks of one length, boxes (tracks, frames, 4): the share of boundary motion at 8 Hz and more,
    the largest of six edges. All edges of all tracks are one matrix: a projection takes the lines out, one transform along the frames
    gives the spectra. The frequency is NaN where nothing moves."""
    m, n = boxes.shape[:2]
    none = np.zeros(m), np.full(m, np.nan), np.zeros(m)
    freqs = np.fft.rfftfreq(n, 1.0 / fps) if n else np.zeros(0)
    fast = freqs >= FLICKER_HZ
    if n < FLICKER_FRAMES or not fast.any():
        return none
    edges = np.concatenate([boxes, boxes[..., 2:] - boxes[..., :2]], axis=2).transpose(0, 2, 1)
    line, _ = np.linalg.qr(np.column_stack([np.ones(n), np.arange(n)]))  # what a straight line can explain
    moved = edges - (edges @ line) @ line.T
    power = np.abs(np.fft.rfft(moved * np.hanning(n), axis=2)) ** 2
    total = power.sum(axis=2)
    ratio = np.divide(power[..., fast].sum(axis=2), total, out=np.zeros_like(total), where=total >= 1e-12)
    best = ratio.argmax(axis=1)
    row = np.arange(m)
    top = ratio[row, best]
    peak = np.where(top > 0, freqs[fast][power[row, best][:, fast].argmax(axis=1)], np.nan)
    return np.minimum(1.0, top / FLICKER_FULL), peak, top


def flicker(boxes: np.ndarray, fps: float) -> tuple[float, float | None, float]:
    """flickers() of one track, (frames, 4)."""
    score, peak, ratio = (float(x[0]) for x in flickers(np.asarray(boxes, float).reshape(1, -1, 4), fps))
    return score, None if np.isnan(peak) else peak, ratio


def butter_band(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth band-pass; edges as shares of the Nyquist frequency."""
    w = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre2 = w[1] - w[0], w[0] * w[1]
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre2 + 0j)
    poles = np.concatenate([poles + root, poles - root])
    z_poles = (4 + poles) / (4 - poles)
    gain = np.real(width**order * 4.0**order / np.prod(4 - poles))
    return gain * np.poly(np.concatenate([np.ones(order), -np.ones(order)])), np.real(np.poly(z_poles))


def _run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The filter over the last axis of x (tracks, frames), all tracks at once; state: (tracks, order)."""
    out, z = np.empty_like(x), np.concatenate([state, np.zeros((len(x), 1))], axis=1)
    for i in range(x.shape[1]):
        v = x[:, i, None]
        y = b[0] * v + z[:, :1]
        z[:, :-1] = z[:, 1:] + b[1:] * v - a[1:] * y
        out[:, i] = y[:, 0]
    return out


def resting_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state after a constant one has come in for ever."""
    n = len(a) - 1
    companion = np.eye(n) - np.column_stack([-a[1:], np.vstack([np.eye(n - 1), np.zeros((1, n - 1))])])
    return np.linalg.solve(companion, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards over the series (one, or several of equal length), which are extended oddly at both ends; the state begins at
    rest for the first value."""
    if x.ndim == 1:
        return zero_phase(b, a, x[None, :])[0]
    n = len(a) - 1
    pad = 3 * (n + 1)
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    rest = resting_state(b, a)
    y = _run_filter(b, a, ext, rest * ext[:, :1])
    y = _run_filter(b, a, y[:, ::-1], rest * y[:, -1:])[:, ::-1]
    return y[:, pad:-pad]


def pulses(green: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(absences, qualities, beats a minute) of tracks of one length, from the mean green of the skin in each frame (tracks, frames): how far the
    highest line of the pulse's band stands above the rest of the band, its neighbours left out. The rate is NaN where there is no line."""
    m, n = green.shape
    absence, quality, bpm = np.full(m, 0.5), np.zeros(m), np.full(m, np.nan)
    if n < PULSE_FRAMES:
        return absence, quality, bpm
    spread = green.std(axis=1)
    live = np.flatnonzero(spread >= 1e-8)
    absence[:] = 1.0
    freqs = np.fft.rfftfreq(n, 1.0 / fps)
    inside = np.flatnonzero((freqs >= PULSE_LOW) & (freqs <= PULSE_HIGH))
    if not len(live) or not len(inside):
        return absence, quality, bpm
    x = (green[live] - green[live].mean(axis=1, keepdims=True)) / spread[live, None]
    x = zero_phase(*butter_band(PULSE_ORDER, PULSE_LOW / (fps / 2), min(PULSE_HIGH / (fps / 2), 0.99)), x)
    lines = np.abs(np.fft.rfft(x * np.hanning(n), axis=1))[:, inside]
    at = lines.argmax(axis=1)
    high = lines[np.arange(len(live)), at]
    rest = np.abs(np.arange(len(inside))[None, :] - at[:, None]) > 1
    count = rest.sum(axis=1)
    floor = np.divide((lines * rest).sum(axis=1), count, out=np.zeros(len(live)), where=count > 0)
    snr = np.where((count > 0) & (high > 0), np.divide(high, floor, out=high.copy(), where=floor > 0), 0.0)
    found = (count > 0) & (high > 0)
    absence[live] = np.where(snr <= 0, 1.0, np.where(snr >= PULSE_FULL, 0.0, 1.0 - snr / PULSE_FULL))
    quality[live] = np.minimum(snr / (PULSE_FULL / 2), 1.0)
    bpm[live] = np.where(found, freqs[inside][at] * 60, np.nan)
    return absence, quality, bpm


def pulse(green: np.ndarray, fps: float) -> tuple[float, float, float | None]:
    """pulses() of one track."""
    absence, quality, bpm = (float(x[0]) for x in pulses(np.asarray(green, float).reshape(1, -1), fps))
    return absence, quality, None if np.isnan(bpm) else bpm


def track_spectra(tracks: DataFrame) -> DataFrame:
    """(scan_id, face_id, flicker_score, flicker_hz, flicker_ratio, rppg_absence, rppg_quality, bpm) of tracks with arrays boxes (of x0, y0, x1, y1)
    and green, and fps. Arrow batches of whole tracks: no shuffle."""

    def run(it):
        for batch in it:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            fps = np.asarray(col["fps"], float)
            out = np.full((batch.num_rows, 6), np.nan)
            boxes = col["boxes"].flatten()
            corners = dict(zip([f.name for f in boxes.type], boxes.flatten(), strict=True))
            corners = np.column_stack([np.asarray(corners[c].cast(pa.float64()).fill_null(np.nan)) for c in ("x0", "y0", "x1", "y1")])
            green = np.asarray(col["green"].flatten().cast(pa.float64()).fill_null(np.nan))
            for values, lists, where, measure in ((corners, col["boxes"], slice(0, 3), flickers), (green, col["green"], slice(3, 6), pulses)):
                sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
                starts = np.cumsum(sizes) - sizes
                kinds, of = np.unique(np.column_stack([sizes, fps]), axis=0, return_inverse=True)  # tracks of one length and rate go together
                for i, (n, f) in enumerate(kinds):
                    some = np.flatnonzero(of.ravel() == i)
                    out[some, where] = np.column_stack(measure(values[starts[some, None] + np.arange(int(n))], float(f)))
            got = [pa.array(x, pa.float64(), from_pandas=True) for x in out.T]  # NaN is null
            yield pa.RecordBatch.from_arrays([col["scan_id"], col["face_id"], *got], names)

    names = ["scan_id", "face_id", "flicker_score", "flicker_hz", "flicker_ratio", "rppg_absence", "rppg_quality", "bpm"]
    return tracks.select("scan_id", "face_id", "boxes", "green", "fps").mapInArrow(run, ", ".join(f"{c} {'bigint' if c.endswith('_id') else 'double'}" for c in names))


# ---- expressions over frames
def blink_metrics(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """frames: (track_id, frame, openness). Rate, mean duration and their anomalies, one row for each track.

    Onsets and offsets are changes of state; an offset before the first onset is dropped and the k-th onset goes with the k-th offset.
    """
    w = Window.partitionBy("track_id").orderBy("frame")
    step = frames.withColumn("closed", (F.col("openness") < CLOSED).cast("int")).withColumn("d", F.col("closed") - F.lag("closed").over(w))
    events = step.withColumn("at", F.col("frame") - 1)
    lists = events.groupBy("track_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("d") == 1, F.col("at")))).alias("on"), F.array_sort(F.collect_list(F.when(F.col("d") == -1, F.col("at")))).alias("off"))
    none = (F.size("on") == 0) | (F.size("off") == 0)
    lists = lists.withColumns({"none": none, "off": F.when(~none & (F.get("off", F.lit(0)) < F.get("on", F.lit(0))), F.slice("off", 2, F.greatest(F.size("off") - 1, F.lit(0)))).otherwise(F.col("off"))})
    lists = lists.withColumn("k", F.when(F.col("none"), 0).otherwise(F.least(F.size("on"), F.size("off"))))
    lists = lists.withColumns({"on": F.slice("on", F.lit(1), F.col("k")), "off": F.slice("off", F.lit(1), F.col("k"))})
    secs = F.col("n") / fps
    frames_closed = F.aggregate(F.zip_with("off", "on", lambda a, b: a - b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    lists = lists.withColumns({"blink_rate": F.col("k") / secs * 60.0, "mean_ms": F.when(F.col("k") > 0, frames_closed * 1000.0 / fps / F.col("k")).otherwise(0.0)})
    r, m = F.col("blink_rate"), F.col("mean_ms")
    rate = F.when(F.col("none"), F.when(secs > 5.0, 1.0).otherwise(0.5)).when(r < 12, F.least(F.lit(1.0), (12 - r) / 12.0)).when(r > 25, F.least(F.lit(1.0), (r - 25) / 25.0)).otherwise(0.0)
    dur = F.when(F.col("none"), 0.5).when(m < 100, F.least(F.lit(1.0), (100 - m) / 100.0)).when(m > 400, F.least(F.lit(1.0), (m - 400) / 400.0)).otherwise(0.0)
    gaps = F.when(F.col("k") >= 3, F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.get("on", i) - F.get("on", i - 1)))
    mean = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(gaps)
    var = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(gaps)
    regular = F.when(F.col("k") >= 3, F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0) < 0.1).otherwise(False)
    return lists.select("track_id", F.col("n").alias("frames"), F.col("k").alias("blinks"), "blink_rate", rate.alias("rate_anomaly"), m.alias("mean_duration_ms"), F.when(regular, F.greatest(dur, F.lit(0.6))).otherwise(dur).alias("duration_anomaly"))


def saccade_metrics(frames: DataFrame) -> DataFrame:
    """frames: (track_id, frame, px, py, pupil_distance). Share of gaze jumps and the anomaly of the pattern."""
    w = Window.partitionBy("track_id").orderBy("frame")
    dx, dy = F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)
    v = F.try_divide(F.sqrt(dx * dx + dy * dy), F.col("pupil_distance"))
    steps = frames.withColumn("v", v)
    nano = F.floor(F.col("v") * 1e9 + 0.5).cast("bigint")
    g = steps.groupBy("track_id").agg(F.count("v").alias("steps"), F.count_if(F.col("v") > JUMP).alias("jumps"), (F.sum(nano) / 1e9).alias("s"), (F.sum(F.floor(F.col("v") * F.col("v") * 1e9 + 0.5).cast("bigint")) / 1e9).alias("q"), F.min("pupil_distance").alias("ipd"))
    blank = (F.col("ipd") < 1e-6) | (F.col("steps") == 0)
    ratio = F.try_divide(F.col("jumps").cast("double"), F.col("steps").cast("double"))
    base = F.when(ratio < 0.05, F.least(F.lit(1.0), (0.05 - ratio) / 0.05)).when(ratio > 0.30, F.least(F.lit(1.0), (ratio - 0.30) / 0.7)).otherwise(0.0)
    mean = F.col("s") / F.col("steps")
    cv = F.sqrt(F.greatest(F.col("q") / F.col("steps") - mean * mean, F.lit(0.0))) / mean
    smooth = F.when((F.col("steps") >= 30) & (mean > 0), cv < 0.5).otherwise(False)
    return g.select("track_id", "steps", F.when(blank, 0.0).otherwise(ratio).alias("saccade_ratio"), F.when(blank, 0.5).otherwise(F.when(smooth, F.greatest(base, F.lit(0.4))).otherwise(base)).alias("saccade_anomaly"))


def eye_score(df: DataFrame) -> DataFrame:
    """df: blink and saccade metrics and `frames`. Tracks that are too short score zero."""
    s = F.col("rate_anomaly") * 0.30 + F.col("duration_anomaly") * 0.25 + F.col("saccade_anomaly") * 0.45
    return df.withColumn("eye_score", F.when(F.col("frames") < EYE_FRAMES, 0.0).otherwise(clamp01(s)))


def detrended(frames: DataFrame, value: str, key: str = "track_id", order: str = "frame") -> DataFrame:
    """Adds detrended: value less its least-squares line over order."""
    x, y = F.col(order).cast("double"), F.col(value).cast("double")
    both = y.isNotNull()
    total = lambda c: F.sum(F.when(both, c))
    # plain sums: exact for whole and half numbers, so they don't hang on the order of rows
    fit = frames.groupBy(key).agg(F.count(y).alias("_n"), total(x).alias("_x"), total(y).alias("_y"), total(x * x).alias("_xx"), total(x * y).alias("_xy"))
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("_n", "_x", "_y", "_xx", "_xy"))
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))  # one frame has no slope
    fit = fit.select(key, slope.alias("_b"), F.try_divide(sy - slope * sx, n.cast("double")).alias("_a"))
    # a row a track is small beside the frames: those are not sorted, nor shuffled again where they lie by track
    return frames.join(fit.hint("shuffle_hash"), key).withColumn("detrended", y - F.col("_a") - F.col("_b") * x).drop("_a", "_b")


def face_composite(rppg: Column, flick: Column, eye: Column) -> Column:
    return clamp01(rppg * 0.35 + flick * 0.30 + eye * 0.35)


def roll_up(faces: DataFrame) -> DataFrame:
    """faces: (scan_id, rppg_absence, rppg_quality, flicker_score, eye_score). Worst case over faces, and whether the video goes on."""
    f = faces.withColumn("c", face_composite(F.col("rppg_absence"), F.col("flicker_score"), F.col("eye_score")))
    g = f.groupBy("scan_id").agg(F.count("*").alias("faces_analyzed"), F.max("rppg_absence").alias("rppg_absence_score"), F.min("rppg_quality").alias("rppg_signal_quality"), F.max("flicker_score").alias("micro_flicker_score"), F.max("eye_score").alias("eye_movement_anomaly_score"), F.max("c").alias("l2_escalation_score"))
    codes = listed(F.when(F.col("rppg_absence_score") > 0.6, F.lit("BIO_RPPG_ABSENT")), F.when(F.col("micro_flicker_score") > 0.5, F.lit("BIO_BOUNDARY_FLICKER")), F.when(F.col("eye_movement_anomaly_score") > 0.5, F.lit("BIO_EYE_ANOMALY")))
    return g.withColumns({"escalate_to_l3": F.col("l2_escalation_score") >= ESCALATE, "bio_codes": codes})


def skin_means(pixels: DataFrame) -> DataFrame:
    """pixels: (track_id, frame, blue, green, red, skin). Mean colours of skin pixels; frames without any give 0."""
    m = lambda c: F.coalesce(F.avg(F.when(F.col("skin"), F.col(c))), F.lit(0.0)).alias(c)
    return pixels.groupBy("track_id", "frame").agg(m("red"), m("green"), m("blue"))


def cheek_sync(frames: DataFrame, least: float = 0.0) -> DataFrame:
    """frames: (track_id, frame, left, right), mean green of each cheek. Their correlation by track, from plain sums, and whether the blood
    flow of the two sides runs against each other. A side without any change has no correlation."""
    x, y = F.col("left").cast("double"), F.col("right").cast("double")
    g = frames.filter(x.isNotNull() & y.isNotNull()).groupBy("track_id").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    n, sx, sy, xx, yy, xy = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    r = F.try_divide(n * xy - sx * sy, F.sqrt(n * xx - sx * sx) * F.sqrt(n * yy - sy * sy))
    return g.select("track_id", r.alias("cheek_correlation")).withColumn("sync_fail", F.coalesce(F.col("cheek_correlation") < least, F.lit(False)))


def facial_symmetry(marks: DataFrame) -> DataFrame:
    """marks: (track_id, frame, pair, left_x, left_y, right_x, right_y, axis_x), pairs of landmarks on both sides of the face's axis. Mean
    distance between a landmark and its mirrored partner, as a share of the mean width between them; by track."""
    off = F.sqrt(F.pow(2 * F.col("axis_x") - F.col("right_x") - F.col("left_x"), 2) + F.pow(F.col("right_y") - F.col("left_y"), 2))
    width = F.abs(F.col("right_x") - F.col("left_x"))
    micro = lambda c: F.sum(F.floor(c * 1e6 + 0.5).cast("bigint"))
    return marks.groupBy("track_id").agg(clamp01(F.coalesce(F.try_divide(micro(off).cast("double"), micro(width).cast("double")), F.lit(0.0))).alias("asymmetry"))

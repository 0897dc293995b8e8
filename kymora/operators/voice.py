"""Voice analysis of whole waveforms: frames, energy gate, pitch, formant centroids and the signs of slurred speech, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions import signal as D

FRAME_S, HOP_S, LOW_HZ, HIGH_HZ = 0.032, 0.016, 80.0, 320.0
FORMANT = (850.0, 2500.0)
FRAMES = "places array<int>, periods array<double>, peaks array<double>, correlations array<double>, centroids array<double>, rms double, frames int, active int"


def framed(x: np.ndarray, rate: int) -> np.ndarray:
    n, hop = int(FRAME_S * rate), int(HOP_S * rate)
    return np.lib.stride_tricks.sliding_window_view(x, n)[::hop] if len(x) >= n else np.empty((0, n))


def autocorrelations(frames: np.ndarray) -> np.ndarray:
    """Each windowed frame's autocorrelation over that at lag 0, by a transform of twice the length."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames, 2 * n, axis=1)) ** 2
    full = np.fft.irfft(power, 2 * n, axis=1)[:, :n]
    first = full[:, :1]
    return np.divide(full, first, out=np.zeros_like(full), where=first > 1e-9)


def voiced_frames(x: np.ndarray, rate: int, voiced_from: float = 0.30) -> dict[str, object]:
    """What the voiced frames of a waveform hold: places, periods in seconds, peaks, correlations, formant centroids."""
    x = np.asarray(x, float)
    x = x - x.mean() if len(x) else x
    rms = float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
    frames = framed(x, rate)
    out: dict[str, object] = {"places": [], "periods": [], "peaks": [], "correlations": [], "centroids": [], "rms": rms, "frames": len(frames), "active": 0}
    if not len(frames):
        return out
    energy = np.sqrt((frames**2).mean(axis=1))
    active = np.flatnonzero(energy >= max(0.008, 0.20 * energy.max()))
    out["active"] = len(active)
    windowed = frames[active] * np.hanning(frames.shape[1])
    corr = autocorrelations(windowed)
    low, high = int(rate / HIGH_HZ), min(frames.shape[1] - 2, int(rate / LOW_HZ))
    if not len(active) or high <= low:
        return out
    lag = low + corr[:, low:high].argmax(axis=1)
    row = np.arange(len(lag))
    best = corr[row, lag]
    keep = best >= voiced_from
    before, after = corr[row, lag - 1], corr[row, lag + 1]
    bend = before - 2 * best + after
    shift = np.divide(0.5 * (before - after), bend, out=np.zeros(len(lag)), where=np.abs(bend) > 1e-9)
    freq = np.fft.rfftfreq(frames.shape[1], 1 / rate)
    band = (freq >= FORMANT[0]) & (freq <= FORMANT[1])
    power = np.abs(np.fft.rfft(windowed, axis=1))[:, band] ** 2
    weight = power.sum(axis=1)
    centre = np.divide(power @ freq[band], weight, out=np.zeros(len(lag)), where=weight > 1e-9)
    out |= {
        "places": active[keep].tolist(), "periods": ((lag + shift.clip(-0.5, 0.5)) / rate)[keep].tolist(), "peaks": np.abs(frames[active]).max(axis=1)[keep].tolist(),
        "correlations": np.minimum(best, 0.995)[keep].tolist(), "centroids": centre[keep & (weight > 1e-9)].tolist(),
    }
    return out


def _analyse(batches: Iterator[pd.DataFrame], keys: list[str], samples: str, rate: int, voiced_from: float) -> Iterator[pd.DataFrame]:
    for df in batches:
        found = [voiced_frames(x if x is not None else [], rate, voiced_from) for x in df[samples]]
        yield pd.concat([df[keys].reset_index(drop=True), pd.DataFrame(found)], axis=1)


def voice_features(df: DataFrame, keys: list[str], samples: str, lips: str, rate: int = 16_000, live: bool = False) -> DataFrame:
    """Per waveform: keys, jitter, shimmer, hnr, slope, score, slurred, voiced, pause_ratio, valid.

    Frames are found in Arrow batches, a waveform at a time; what follows are Column expressions. Without enough voice, or
    lips that move (column ``lips``), a waveform isn't valid and its signs are null. A null waveform is an empty one.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, lips])
    least = 0.25 if live else 0.30
    got = df.select(*keys, lips, samples).mapInPandas(lambda b: _analyse(b, [*keys, lips], samples, rate, least), f"{kinds}, {FRAMES}")
    n, active = F.size("places"), F.greatest(F.col("active"), F.lit(1))
    spoken = (n >= (4 if live else 5)) & (n / active >= (0.18 if live else 0.25)) & F.coalesce(F.col(lips), F.lit(False))
    signs = {"jitter": D.jitter(F.col("periods"), F.col("places")), "shimmer": D.shimmer(F.col("peaks"), F.col("places")), "hnr": D.voiced_hnr(F.col("correlations"), live), "slope": D.formant_slope(F.col("centroids"), HOP_S * 1000)}
    got = got.withColumns({"valid": spoken, "voiced": n, "pause_ratio": 1 - F.col("active") / F.greatest(F.col("frames"), F.lit(1))})
    got = got.withColumns({k: F.when(F.col("valid"), v) for k, v in signs.items()})
    got = got.withColumn("score", F.when(F.col("valid"), D.voice_score(*[F.col(k) for k in signs])))
    said = D.slurred(*[F.col(k) for k in signs], F.col("score"), F.col("valid"), F.col("rms"), F.col("voiced"), live)
    return got.select(*keys, *signs, "score", F.coalesce(said, F.lit(False)).alias("slurred"), "voiced", "pause_ratio", "valid")

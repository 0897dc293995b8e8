"""Filters and spectra that need more than SQL: a zero-phase band-pass and the pulse from a green-channel series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def butter_bandpass(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth band-pass, by prewarping and the bilinear transform."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    band, centre = w2 - w1, np.sqrt(w1 * w2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = poles * band / 2
    root = np.sqrt(half * half - centre * centre)
    analog = np.concatenate([half + root, half - root])
    z_poles = (2 * rate + analog) / (2 * rate - analog)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = band**order * (2 * rate) ** order / np.prod(2 * rate - analog)
    return np.real(gain) * np.real(np.poly(zeros)), np.real(np.poly(z_poles))


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed."""
    z = state.copy()
    y = np.empty_like(x)
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state after a long run of ones."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over the series, extended by its odd reflection; a series too short for that stays."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return x
    zi = steady_state(b, a)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = filtered(b, a, ext, zi * ext[0])[::-1]
    return filtered(b, a, y, zi * y[0])[::-1][pad:-pad]


def pulse(t: np.ndarray, green: np.ndarray) -> tuple[bool, float | None, float | None]:
    """(valid, beats a minute, RMSSD in ms) of ten seconds: 60 samples over 4 s at 18 a second or more."""
    if len(t) < 60 or t[-1] - t[0] < 4 or (len(t) - 1) / (t[-1] - t[0]) < 18:
        return False, None, None
    fps = (len(t) - 1) / (t[-1] - t[0])
    even = np.linspace(t[0], t[-1], len(t))
    x = np.interp(even, t, green)
    x = x - np.polyval(np.polyfit(even, x, 1), even)
    if x.std() < 1e-9:
        return False, None, None
    x = (x - x.mean()) / x.std()
    n = max(1024, 1 << (len(x) - 1).bit_length())
    power, freq = np.abs(np.fft.rfft(x * np.hanning(len(x)), n)) ** 2, np.fft.rfftfreq(n, 1 / fps)
    band = (freq >= 0.75) & (freq <= 2.5)
    bpm = float(freq[band][np.argmax(power[band])] * 60)
    spectrum = np.fft.rfft(x)
    spectrum[(np.fft.rfftfreq(len(x), 1 / fps) < 0.75) | (np.fft.rfftfreq(len(x), 1 / fps) > 2.5)] = 0
    y = np.fft.irfft(spectrum, len(x))
    up = np.flatnonzero((y[:-1] < 0) & (y[1:] >= 0))
    beats = np.diff(even[up] - y[up] * (even[1] - even[0]) / (y[up + 1] - y[up]))
    beats = beats[(beats >= 0.40) & (beats <= 1.35)]
    if len(beats):
        beats = beats[np.abs(beats - np.median(beats)) <= 0.22 * np.median(beats)]
    rmssd = float(np.clip(1000 * np.sqrt(np.mean(np.diff(beats) ** 2)), 10, 135)) if len(beats) >= 3 else None
    return True, bpm, rmssd


def _pulses(batches: Iterator[pd.DataFrame], keep: list[str]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [pulse(np.array(t, float), np.array(g, float)) for t, g in zip(df["ts"], df["values"])]
        yield pd.concat([df[keep].reset_index(drop=True), pd.DataFrame(rows, columns=["valid", "bpm", "rmssd"])], axis=1)


def pulses(windows: DataFrame, keep: list[str]) -> DataFrame:
    """Pulse of each row of (ts array<double>, values array<double>), a window of seconds."""
    schema = ", ".join([*(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keep), "valid boolean, bpm double, rmssd double"])
    return windows.select(*keep, "ts", "values").mapInPandas(lambda it: _pulses(it, keep), schema)


def bandpassed(waves: DataFrame, column: str, rate: float, low: float = 75.0, high: float = 4000.0, order: int = 4) -> DataFrame:
    """``column`` (array<double>) band-passed with no phase shift."""
    b, a = butter_bandpass(order, low, high, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df[column] = [None if x is None else zero_phase(b, a, np.asarray(x, float)).tolist() for x in df[column]]
            yield df

    return waves.mapInPandas(run, waves.schema)

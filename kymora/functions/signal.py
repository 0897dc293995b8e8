"""Waveforms held as arrays: framing, energy, autocorrelation, spectra, perturbation and a composite voice score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def bound(a: Column, body) -> Column:
    """``body`` of a computed array: bound once, not computed again for each element of a lambda."""
    return F.element_at(F.transform(F.array(a), body), 1)


def without_mean(a: Column) -> Column:
    return bound(F.struct(a.alias("a"), mean(a).alias("m")), lambda b: F.transform(b["a"], lambda v: v - b["m"]))


def rms(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)) / F.size(a))


def frames(a: Column, length: int, hop: int) -> Column:
    """Overlapping frames; none if the signal is shorter than one."""
    n = 1 + F.floor((F.size(a) - length) / hop).cast("int")
    return F.when(F.size(a) >= length, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * hop + 1, F.lit(length)))).otherwise(F.array().cast("array<array<double>>"))


def autocorrelation(a: Column, lag: Column) -> Column:
    """Sum of products at a lag over that at lag 0."""
    shifted = F.zip_with(a, F.slice(a, lag + 1, F.size(a)), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    power = total(F.transform(a, lambda v: v * v))
    return F.when(power > 0, total(shifted) / power).otherwise(0.0)


def pitch(a: Column, low: int, high: int, voiced: float) -> dict[str, Column]:
    """First lag in [low, high) of the largest autocorrelation, that value, and whether it reaches ``voiced``."""
    lags = F.sequence(F.lit(low), F.lit(high - 1))
    got = bound(a, lambda b: F.transform(lags, lambda k: F.round(autocorrelation(b, k), 9)))
    best = bound(got, lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1 + low).cast("int").alias("lag"), F.array_max(r).alias("r")))
    return {"lag": best["lag"], "r": best["r"], "voiced": best["r"] >= voiced}


def hnr_db(r: Column) -> Column:
    """Harmonics to noise from an autocorrelation value, 0 to 35 dB."""
    c = F.least(r, F.lit(0.995))
    return F.when(c <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(35.0), 10 * F.log10(c / (1 - c)))))


def dft_magnitude(a: Column, n: int, k: int) -> Column:
    """Magnitude of one bin of an ``n``-point transform, its cosines and sines being literals."""
    angle = [2 * math.pi * k * i / n for i in range(n)]
    part = lambda f: total(F.zip_with(a, F.array(*[F.lit(f(x)) for x in angle]), lambda v, c: v * c))
    re, im = part(math.cos), part(math.sin)
    return F.sqrt(re * re + im * im)


def hann(n: int) -> Column:
    return F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i in range(n)])


def detrended(a: Column, n: int) -> Column:
    """The array less its least-squares line, for arrays of ``n`` values."""
    middle = (n - 1) / 2
    ss = sum((i - middle) ** 2 for i in range(n))
    slope = total(F.transform(a, lambda v, i: v * (i - middle))) / ss
    return bound(F.struct(a.alias("a"), mean(a).alias("m"), slope.alias("k")), lambda b: F.transform(b["a"], lambda v, i: v - b["m"] - b["k"] * (i - middle)))


def band_power(a: Column, n: int, rate: float, low: float, high: float) -> Column:
    """Sum of windowed, detrended magnitudes of the bins from ``low`` to ``high`` Hz; 0 for a flat signal."""
    windowed = F.zip_with(bound(a, lambda b: detrended(b, n)), hann(n), lambda v, w: v * w)
    bins = [k for k in range(n // 2 + 1) if low <= k * rate / n <= high]
    power = bound(windowed, lambda w: sum((dft_magnitude(w, n, k) for k in bins[1:]), dft_magnitude(w, n, bins[0])))
    return F.when(rms(without_mean(a)) < 0.002, 0.0).otherwise(power)


def quantile_of(a: Column, q: float) -> Column:
    """Linear quantile of an array's values; null for an empty one."""

    def body(s: Column) -> Column:
        at = (F.size(s) - 1) * q
        low = F.floor(at).cast("int")
        high = F.least(low + 1, F.size(s) - 1)
        return F.when(F.size(s) > 0, F.get(s, low) + (at - low) * (F.get(s, high) - F.get(s, low)))

    return bound(F.sort_array(a), body)


def perturbation(a: Column, places: Column, low: float, high: float, default: float, step: float | None = None) -> Column:
    """How values of voiced frames waver, in percent of their mean: the median deviation from the mean of three neighbours.

    Frames are neighbours up to two hops apart; at a run's end the step before counts by 0.65. ``step`` leaves out octave
    jumps. With fewer than two such values all steps count, and ``default`` stands for a single frame.
    """

    def body(b: Column) -> Column:
        x, at, m = b["x"], b["at"], b["m"]
        near = lambda i: F.get(at, i) - F.get(at, i - 1) <= 2
        moved = lambda i: F.abs(F.get(x, i) - F.get(x, i - 1))
        local = lambda i: F.abs(F.get(x, i) - (F.get(x, i - 1) + F.get(x, i) + F.get(x, i + 1)) / 3)
        counts = lambda i: near(i) if step is None else near(i) & (moved(i) / F.greatest(m, F.lit(1e-6)) < step)
        each = lambda i: F.when(counts(i), F.when((i + 1 < F.size(x)) & F.coalesce(near(i + 1), F.lit(False)), local(i)).otherwise(0.65 * moved(i)))
        steps = F.sequence(F.lit(1), F.size(x) - 1)
        kept = F.filter(F.transform(steps, each), lambda v: v.isNotNull())
        value = bound(kept, lambda k: F.when(F.size(k) >= 2, quantile_of(k, 0.5)).otherwise(quantile_of(F.transform(steps, moved), 0.5)))
        return F.when((F.size(x) >= 2) & (m > 1e-6), 100 * value / m).otherwise(default)

    raw = bound(F.struct(a.alias("x"), places.alias("at"), mean(a).alias("m")), body)
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def jitter(periods: Column, places: Column) -> Column:
    return perturbation(periods, places, 0.05, 10.0, 0.35, step=0.18)


def shimmer(peaks: Column, places: Column) -> Column:
    return perturbation(peaks, places, 0.1, 25.0, 1.5)


def voiced_hnr(correlations: Column, live: bool = False) -> Column:
    """Harmonics to noise in dB from the 70 % quantile of the voiced frames' autocorrelations."""
    r = quantile_of(F.transform(correlations, lambda v: F.least(v, F.lit(0.995))), 0.7)
    db = bound(r, lambda x: 10 * F.log10(x / F.greatest(F.lit(1e-4), 1 - x))) + (3.0 if live else 0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(35.0), db))


def formant_slope(centroids: Column, hop_ms: float = 16.0) -> Column:
    """How fast the second formant moves, in Hz a millisecond; 22 for fewer than five frames."""

    def body(smooth: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(smooth) - 1), lambda i: F.abs(F.get(smooth, i) - F.get(smooth, i - 1)))
        return bound(steps, lambda d: F.coalesce(quantile_of(F.filter(d, lambda v: v > 5), 0.65), mean(d)))

    raw = bound(bound(centroids, median3), body) / hop_ms * 2
    return F.when(F.size(centroids) < 5, 22.0).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(45.0), raw)))


def slurred(jitter_: Column, shimmer_: Column, hnr: Column, slope: Column, score: Column, lips: Column, rms_: Column, voiced: Column, live: bool = False) -> Column:
    """Two of four signs, a score of 45, moving lips, a loud signal and enough voiced frames."""
    signs = sum(c.cast("int") for c in (jitter_ > 1.35, shimmer_ > 4.20, hnr < 11.5, slope < 12.0))
    enough = (voiced >= 8) & (jitter_ >= 1.25) if live else voiced >= 5
    return lips & (rms_ >= 0.010) & enough & (signs >= 2) & (score >= 45)


def median3(a: Column) -> Column:
    """Median of three neighbours, zeros beyond the ends."""
    get = lambda i: F.coalesce(F.when(i >= 0, F.get(a, i)), F.lit(0.0))
    return F.transform(a, lambda v, i: v + get(i - 1) + get(i + 1) - F.greatest(v, get(i - 1), get(i + 1)) - F.least(v, get(i - 1), get(i + 1)))


def centroid(power: Column, freqs: list[float], low: float, high: float) -> Column:
    """Power-weighted mean frequency of a band."""
    band = [i for i, f in enumerate(freqs) if low <= f <= high]
    top = sum((F.get(power, i) * freqs[i] for i in band[1:]), F.get(power, band[0]) * freqs[band[0]])
    all_ = sum((F.get(power, i) for i in band[1:]), F.get(power, band[0]))
    return F.when(all_ > 0, top / all_).otherwise(0.0)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 to 100 as x goes from ``low`` to ``high`` (which may be the smaller one)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) / (high - low) * 100))


def voice_score(jitter: Column, shimmer: Column, hnr: Column, slope: Column) -> Column:
    """Weighted ramps of four signs of slurred speech; a steady pitch caps the score at 22."""
    # Weights and ramps of the score.
    s = 0.35 * ramp(slope, 15.0, 7.0) + 0.25 * ramp(jitter, 1.15, 2.65) + 0.20 * ramp(shimmer, 3.8, 8.3) + 0.20 * ramp(hnr, 13.5, 7.5)
    return F.when(jitter < 1.15, F.least(s, F.lit(22.0))).otherwise(s)


def telemetry_score(jitter: Column, shimmer: Column, hnr: Column, slope: Column) -> tuple[Column, Column]:
    """Score of values that a device reports, on ramps of its own, and whether they say slurred: 45 or more, two signs over 35."""
    # Weights and ramps of the score.
    ramps = [(ramp(jitter, 1.0, 2.5), 0.30), (ramp(shimmer, 3.8, 8.0), 0.25), (ramp(hnr, 14.0, 6.0), 0.20), (ramp(slope, 16.0, 6.0), 0.25)]
    score = sum((r * w for r, w in ramps[1:]), ramps[0][0] * ramps[0][1])
    return score, (score >= 45) & (sum(((r > 35).cast("int") for r, _ in ramps[1:]), (ramps[0][0] > 35).cast("int")) >= 2)


def pushed(chunk: Column, ring: Column, most: int, largest: float = 1.0) -> Column:
    """A ring of samples with a chunk appended, as fractions of its type's largest: the last ``most`` of them."""
    both = F.concat(ring, to_mono(chunk, largest))
    return F.slice(both, F.greatest(F.lit(1), F.size(both) - most + 1), F.lit(most))


def to_mono(a: Column, largest: float) -> Column:
    """Integer samples as fractions of their type's largest."""
    return F.transform(a, lambda v: v.cast("double") / largest)


def to_unit(a: Column) -> Column:
    """Float samples as they are, or divided by the largest where that is over 1."""
    return bound(F.struct(a.alias("a"), F.array_max(F.transform(a, F.abs)).alias("m")), lambda b: F.when(b["m"] > 1, F.transform(b["a"], lambda v: v / b["m"])).otherwise(b["a"]))

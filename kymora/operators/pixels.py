"""Pixel operators over rows of (height, width, channels, data): numpy within Arrow batches, one frame at a time in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def luminance(img: np.ndarray) -> np.ndarray:
    """Luma of BGR or the only channel."""
    if img.shape[2] == 1:
        return img[:, :, 0].astype(float)
    return 0.114 * img[:, :, 0] + 0.587 * img[:, :, 1] + 0.299 * img[:, :, 2]


def mean_luminance(img: np.ndarray) -> float:
    """Over every fourth pixel of frames of 32 x 32 and more."""
    y = luminance(img)
    return float((y[::4, ::4] if min(y.shape) >= 32 else y).mean()) if y.size else 0.0


def is_monochrome(img: np.ndarray, step: int = 16, limit: float = 4.0) -> bool:
    """One channel, no pixels, or channels that hardly differ on a coarse grid."""
    if not img.size or img.shape[2] == 1:
        return True
    some = img[::step, ::step].astype(int)
    return bool((some.max(axis=2) - some.min(axis=2)).max() < limit)


def gamma_lut(gamma: float) -> np.ndarray:
    return np.clip((np.arange(256) / 255.0) ** gamma * 255.0, 0, 255).astype(np.uint8)


def equalised(y: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a luma plane: clipped histograms per tile, bilinear between tiles."""
    h, w = y.shape
    ph, pw = -h % tiles, -w % tiles
    padded = np.pad(y, ((0, ph), (0, pw)), mode="reflect" if h > ph and w > pw else "edge").astype(np.uint8)
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    tables = np.empty((tiles, tiles, 256))
    limit = max(1.0, clip * th * tw / 256)
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            over = np.maximum(hist - limit, 0).sum()
            tables[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / (th * tw)
    gy, gx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(gy).astype(int), 0, tiles - 1), np.clip(np.floor(gx).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(gy - y0, 0, 1)[:, None], np.clip(gx - x0, 0, 1)[None, :]
    v = padded[:h, :w]
    at = lambda a, b: tables[a[:, None], b[None, :], v]
    return np.clip((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1)), 0, 255)


def lit(img: np.ndarray) -> np.ndarray:
    """Dark frames lifted by gamma, bright ones blended with their equalised luma."""
    mean = mean_luminance(img)
    gamma = 0.5 if mean < 40 else 0.7 if mean < 60 else None
    out = gamma_lut(gamma)[img] if gamma else img
    y = luminance(out)
    eq = equalised(np.round(y))
    share = 0.35 if mean >= 95 else 1.0
    return np.clip(out.astype(float) + (share * (eq - y))[:, :, None], 0, 255).astype(np.uint8)


def split_sunlight(img: np.ndarray, limit: float = 45.0, gamma: float = 0.6) -> np.ndarray:
    """A dark half lifted along a ramp when the halves' brightness differs by more than ``limit``."""
    y = luminance(img)
    w = y.shape[1]
    left, right = y[:, : w // 2].mean(), y[:, w // 2 :].mean()
    if abs(left - right) <= limit:
        return img
    ramp = np.clip((np.arange(w) - w / 2) / max(16, w / 4) + 0.5, 0, 1)
    ramp = ramp if right < left else 1 - ramp
    return (img + (gamma_lut(gamma)[img].astype(float) - img) * ramp[None, :, None]).astype(np.uint8)


def redness(img: np.ndarray, box: tuple[int, int, int, int], bright: float = 70.0) -> float:
    """Red over the mean of green and blue in the bright pixels of a box; 1 without any."""
    x0, y0, x1, y1 = box
    part = img[y0:y1, x0:x1]
    if part.size == 0 or part.shape[2] < 3:
        return 1.0
    chosen = part[luminance(part) > bright].astype(float)
    return float(np.mean(chosen[:, 2] / ((chosen[:, 1] + chosen[:, 0]) / 2 + 1e-5))) if len(chosen) else 1.0


def has_glare(img: np.ndarray, box: tuple[int, int, int, int]) -> bool:
    """More than a quarter of the box is white, in a crop that is neither bright all over nor uniform."""
    x0, y0, x1, y1 = box
    y = luminance(img[y0:y1, x0:x1])
    return bool(y.size and y.std() >= 1 and (y > 242).mean() > 0.25 and y.mean() < 210)


def shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which the second luma plane moved against the first, by phase correlation with a window."""
    win = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    A, B = np.fft.rfft2((a - a.mean()) * win), np.fft.rfft2((b - b.mean()) * win)
    cross = B * np.conj(A)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape)
    dy, dx = np.unravel_index(int(np.argmax(peak)), peak.shape)
    wrap = lambda v, n: float(v - n if v > n // 2 else v)
    return wrap(dx, a.shape[1]), wrap(dy, a.shape[0])


def measured(frames: DataFrame, keep: list[str], measure: Callable[[np.ndarray], tuple], outputs: str) -> DataFrame:
    """``keep`` columns and what ``measure`` says of each frame; frames whose bytes don't fit their size give nulls."""
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for h, w, c, data in zip(df["height"], df["width"], df["channels"], df["data"]):
                ok = data is not None and len(data) == h * w * c
                rows.append(measure(image(h, w, c, bytes(data))) if ok else (None,) * len(names))
            yield pd.concat([df[keep].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join([*(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keep), outputs])
    return frames.select(*dict.fromkeys([*keep, "height", "width", "channels", "data"])).mapInPandas(run, schema)


def frame_measures(frames: DataFrame, keep: list[str]) -> DataFrame:
    return measured(frames, keep, lambda img: (mean_luminance(img), is_monochrome(img), mean_luminance(lit(img))), "luminance double, monochrome boolean, lit double")

"""Readers and writers: clips, waveforms, window archives, CSV and JSON reports."""

from __future__ import annotations

import io
import json
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name endings of clips.
CLIPS = ("mp4", "avi", "mov", "mkv", "webm", "m4v")


def discover_clips(spark: SparkSession, folder: str, label: str, endings: tuple[str, ...] = CLIPS) -> DataFrame:
    """(path, label, length) of the files below a folder with one of the endings, whatever their case, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings)).withColumn("label", F.lit(label)).orderBy("path")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in [-1, 1]) of PCM data of 1, 2 or 4 bytes."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    kinds = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    dtype, zero, full = kinds[width]
    x = (np.frombuffer(raw, dtype).astype(float) - zero) / full
    return rate, x.reshape(-1, channels).mean(axis=1)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A signal at another rate, by a polyphase low-pass filter: a Kaiser-windowed sinc over ten zero crossings on each side."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(x):
        return x
    widest = max(up, down)
    half = 10 * widest
    taps = np.sinc(np.arange(-half, half + 1) / widest) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    at = np.arange(-(-len(x) * up // down)) * down
    out = np.empty(len(at))
    # A stretch of outputs at a time: each has the inputs that fall within the filter.
    near = 2 * half // up + 2
    for i in range(0, len(at), 1 << 14):
        now = at[i : i + (1 << 14), None]
        k = -((half - now) // up) + np.arange(near)[None, :] - 1
        j = now - k * up + half
        use = (k >= 0) & (k < len(x)) & (j >= 0) & (j < len(taps))
        out[i : i + (1 << 14)] = np.where(use, x[np.clip(k, 0, len(x) - 1)] * taps[np.clip(j, 0, len(taps) - 1)], 0.0).sum(axis=1)
    return out


def _waves(frames: Iterator[pd.DataFrame], rate: int) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for path, content in zip(df["path"], df["content"]):
            try:
                got, x = decode_wav(content)
            except (wave.Error, EOFError, KeyError):
                rows.append((path, rate, None))
                continue
            rows.append((path, rate, resampled(x, got, rate).astype(np.float32).tolist()))
        yield pd.DataFrame(rows, columns=["path", "rate", "samples"])


def read_waves(spark: SparkSession, folder: str, rate: int = 16_000) -> DataFrame:
    """(path, rate, samples) of the WAV files below a folder; samples are null where a file is no PCM data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", "content").mapInPandas(lambda it: _waves(it, rate), "path string, rate int, samples array<float>")


def write_archive(windows: DataFrame, path: str, label: str = "label", subject: str = "subject_id", audio: tuple[str, ...] = (), voice: bool = False) -> bool:
    """Windows as Parquet, a folder per label and subject; rows of one are gathered before they are written.

    The ``audio`` columns are left out where no window has valid audio, unless ``voice`` asks for them; without windows
    nothing is written, and False returned.
    """
    if windows.isEmpty():
        return False
    if audio and not voice and windows.where(F.col("audio_valid") > 0).isEmpty():
        windows = windows.drop(*audio)
    windows.repartition(label, subject).write.mode("overwrite").partitionBy(label, subject).parquet(path)
    return True


#: What stands for a channel that an older archive lacks.
ABSENT = {"audio_valid": 0.0, "n_gated": 0, "duration_s": 0.0}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Windows of archives written with different channels: columns are merged by name, absent ones have a default.

    Where windows hold their rows' times (``timestamps``) but no bounds, the bounds are the first and the last of them.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in ABSENT.items()})
    if "timestamps" in df.columns:
        ends = {"start_ts": F.get("timestamps", 0), "end_ts": F.get("timestamps", F.size("timestamps") - 1)}
        df = df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in ends.items()})
    return df


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Archives that a pattern names; FileNotFoundError where there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return read_archive(spark, pattern)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the candidate paths that exists, in any of Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def batch_times(df: DataFrame, subject: list[str], order: list[str], rate: float, most: int | None = None) -> DataFrame:
    """Numbered frames of clips with the time that the rate gives them (30 a second where it says 5 or less), ``most`` at most."""
    fps = rate if rate > 5 else 30.0
    numbered = df.withColumn("nth", F.row_number().over(Window.partitionBy(*subject).orderBy(*order)))
    numbered = numbered if most is None else numbered.where(F.col("nth") <= most)
    return numbered.withColumn("ts", (F.col("nth") - 1) / fps)


def read_camera(text: str | None, width: int, height: int, focal: float | None = None) -> dict[str, list[float]]:
    """(matrix, distortion) of a camera from a JSON document; one of the frame's width as focal length where it has none."""
    found = json.loads(text) if text else {}
    matrix = found.get("camera_matrix")
    if matrix is not None:
        matrix = np.asarray(matrix, float).reshape(3, 3)
    else:
        f = focal or float(width)
        matrix = np.array([[f, 0, width / 2], [0, f, height / 2], [0, 0, 1]])
    bend = found.get("dist_coeffs")
    return {"matrix": matrix.ravel().tolist(), "distortion": np.zeros(4).tolist() if bend is None else np.asarray(bend, float).ravel().tolist(), "custom": bool(found.get("camera_matrix"))}


def save_model(model, features: list[str], results: dict, path: str) -> None:
    """A fitted Spark ML model, and beside it its features' order and its evaluation as JSON."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"feature_names": features, "results": results}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, reader, *paths: str) -> tuple[object, list[str], dict]:
    """(model, features, results) from the first candidate that exists; ``reader`` is the model's class."""
    path = first_existing(spark, *paths)
    if path is None:
        raise FileNotFoundError(f"no model in {paths}")
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return reader.load(f"{path}/model"), about["feature_names"], about["results"]


def progress(done: int, total: int, status: str) -> str | None:
    """The progress document of a batch after ``done`` clips: of the first five, every tenth and the last; else None."""
    if done <= 5 or done % 10 == 0 or done == total:
        return json.dumps({"completed": done, "total": total, "pct": round(100 * done / max(1, total), 1), "status": status})
    return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)

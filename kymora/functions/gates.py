"""Per-row guards and corrections of measured signals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_eye(left: Column, right: Column, glare_left: Column, glare_right: Column) -> tuple[Column, Column]:
    """With glare on exactly one side both sides take the other's value."""
    return F.when(glare_left & ~glare_right, right).otherwise(left), F.when(glare_right & ~glare_left, left).otherwise(right)


def shutter_corrected(ear: Column, ratio: Column, baseline: Column, vibration: Column, pitch_step: Column) -> Column:
    """Undoes a rolling-shutter stretch: by ratio / baseline within 15 %, while shaking hard with a steady pitch."""
    stretch = F.greatest(F.lit(0.85), F.least(F.lit(1.15), ratio / baseline))
    on = (vibration > 0.25) & (baseline > 0.05) & (F.abs(pitch_step) < 2.5) & (F.abs(stretch - 1) > 0.015)
    return F.when(on, ear / stretch).otherwise(ear)


def foreshortened(left: Column, right: Column, yaw: Column, threshold: float) -> Column:
    """One lid only looks closed: turned, one eye wide, the other far narrower."""
    return (F.abs(yaw) > 10) & (F.greatest(left, right) >= F.greatest(F.lit(0.26), F.lit(1.3 * threshold))) & (F.abs(left - right) > 0.09)


def brow_ratio(eye_y: Column, brow_y: Column, width: Column, pitch: Column) -> Column:
    """Brow height over the eye in eye widths, raised with the pitch; null where it can't be measured."""
    ok = (width >= 1e-4) & (brow_y > 1) & ~F.isnan(eye_y) & ~F.isnan(brow_y)
    return F.when(ok, (eye_y - brow_y) / width * (1 + 0.006 * F.greatest(F.lit(-20.0), F.least(F.lit(20.0), pitch))))


def quadrant(width: float, height: float) -> tuple[int, int, int, int]:
    """The driver's part of the frame."""
    return round(0.2 * width), round(0.1 * height), round(0.8 * width), round(0.85 * height)


def face_is_plausible(width: Column, height: Column, eye_order: Column, nose: Column, eyes: Column, mouth: Column, scale: Column, last_scale: Column) -> Column:
    """Aspect, order of eyes, nose between eyes and mouth, and no jump in size against the last valid face."""
    aspect, change = width / height, scale / last_scale
    return (aspect >= 0.38) & (aspect <= 2.5) & eye_order & (nose > eyes) & (nose < mouth) & F.coalesce((change >= 0.55) & (change <= 1.8), F.lit(True))


def face_geometry(box: tuple[Column, Column, Column, Column], frame: tuple[Column, Column], eyes: tuple[Column, Column, Column, Column], nose: tuple[Column, Column], mouth: tuple[Column, Column], last_scale: Column) -> Column:
    """Whether landmarks can be a face: ``box`` (x0, y0, x1, y1), ``frame`` size, outer eye corners, nose tip, mouth centre.

    Large enough, near the frame, of a plausible aspect, eyes apart and in order, the mouth below them, the nose between
    them along the face's own axis, and no jump in size against the last valid face (null: any).
    """
    width, height = box[2] - box[0], box[3] - box[1]
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    near = lambda c, full: (c >= -0.2 * full) & (c <= 1.2 * full)
    across, apart = eyes[2] - eyes[0], F.hypot(eyes[2] - eyes[0], eyes[3] - eyes[1])
    mid = ((eyes[0] + eyes[2]) / 2, (eyes[1] + eyes[3]) / 2)
    down = (mouth[0] - mid[0], mouth[1] - mid[1])
    length = F.hypot(*down)
    along = ((nose[0] - mid[0]) * down[0] + (nose[1] - mid[1]) * down[1]) / length
    aspect, change = width / height, F.greatest(width, height) / F.greatest(last_scale, F.lit(1.0))
    good = (width >= 10) & (height >= 10) & near(cx, frame[0]) & near(cy, frame[1]) & (aspect >= 0.38) & (aspect <= 2.5)
    good = good & (across > 5) & (apart >= 0.18 * width) & (down[1] > 0) & (length >= 0.22 * height) & (along > 0.08 * length) & (along < 0.95 * length)
    steady = F.when(last_scale.isNull(), True).otherwise((change >= 0.55) & (change <= 1.8))
    return F.coalesce(good & steady, F.lit(False))


def alert_gaze(ear: Column, closed: Column, dispersion: Column, nystagmus: Column, apart: Column, microsleep: Column) -> Column:
    return (ear >= 0.26) & (closed < 0.10) & (dispersion >= 0.024) & ~nystagmus & ~apart & ~microsleep


def capped_risk(risk: Column, heuristic: Column, guarded: Column) -> Column:
    """An alert driver's risk stays at 22 while the rules say less than 25."""
    return F.when(guarded & (heuristic < 25), F.least(risk, F.lit(22.0))).otherwise(risk)


def reflex_suppressed(head_speed: Column, vertical_speed: Column) -> Column:
    """Head or vertical gaze moves too fast to read beats."""
    return (head_speed > 10) | (vertical_speed > 25)


def vergence_blocked(blink: Column, low: Column, yaw: Column, pitch: Column, gaze: Column) -> Column:
    return blink | low | (F.abs(yaw) > 20) | (pitch < -12) | (pitch > 8) | (F.abs(gaze) > 0.30)


def voice_activity(rms: Column, peak: Column, active_rms: Column, active: Column, voiced: Column, live: bool = False) -> Column:
    """Loud enough, three active frames, and enough of them voiced."""
    least, share = (4, 0.18) if live else (5, 0.25)
    return (rms >= 0.0012) & (peak >= 0.008) & (active_rms >= 0.008) & (active >= 3) & (voiced >= least) & (voiced / F.greatest(active, F.lit(1)) >= share)


def levelled(samples: Column, p95: Column) -> Column:
    """Quiet speech raised to a peak of 0.12, by 15 at most, cut at 1."""
    gain = F.when((p95 > 1e-5) & (p95 < 0.08), F.least(F.lit(15.0), 0.12 / p95)).otherwise(1.0)
    return F.transform(samples, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * gain)))


def throttled(run: Column) -> Column:
    """The heavy fallback runs after the first loss and then after every fifth."""
    return (run <= 1) | (F.pmod(run, F.lit(5)) == 0)


def tiered(*stages: Column) -> Column:
    """The first stage that found something."""
    return F.coalesce(*stages)


def kept_columns(names: list[str], keep: tuple[str, ...], drop_prefixes: tuple[str, ...]) -> list[str]:
    """Column pruning by rule: names that are listed, or that no dropped prefix begins."""
    return [n for n in names if n in keep or not n.startswith(drop_prefixes)]


def in_model_order(available: list[str], order: list[str]) -> list[Column]:
    """A model's columns in its order, absent ones 0."""
    return [(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in available else F.lit(0.0)).alias(n) for n in order]


def source_kind(name: Column, channels: Column) -> Column:
    """camera for a number, gray for one channel, else video."""
    return F.when(name.rlike(r"^\s*\d+\s*$"), "camera").when(channels <= 1, "gray").otherwise("video")


def frame_counts(fps: float) -> dict[str, int]:
    """Rows of a microsleep and of a yawn, halves to even."""
    return {"microsleep": max(5, round(0.5 * fps)), "yawn": max(10, round(fps))}

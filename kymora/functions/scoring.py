"""Rule scores, evidence and commands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(x: Column, steps: list[tuple[float, float]], above: bool = True, default: float = 0.0) -> Column:
    """The score of the first threshold that x passes; steps go from the strictest on."""
    out = None
    for at, score in steps:
        hit = x > at if above else x < at
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(default)


def mean_positive(markers: Column) -> Column:
    """Mean of the positive entries, 0 without any."""
    some = F.filter(markers, lambda v: v > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some)).otherwise(0.0)


def masking_divergence(rate: Column, upstroke: Column, age: Column, signs: list[tuple[Column, float]], voluntary: Column, involuntary: Column) -> Column:
    """Mismatch between a normal or raised blink rate and sluggish lids, fading after 8 s, plus bonuses; 0 without both kinds of sign."""
    sluggish = 2.5 / F.greatest(upstroke, F.lit(0.1))
    base = F.when((sluggish > 1.25) & (rate >= 0.8), F.least(F.lit(100.0), 50 * F.least(F.lit(2.0), rate) * (sluggish - 1.25))).otherwise(0.0)
    base = F.when(age > 8, base * F.exp(-(age - 8) / 5)).otherwise(base)
    score = base + sum((F.when(c, b).otherwise(0.0) for c, b in signs), F.lit(0.0))
    return F.when(voluntary & (involuntary >= 1), F.least(F.lit(100.0), score)).otherwise(0.0)


def fuse(rule: Column, model: Column, alert: Column) -> Column:
    """Rule and model risk: an alert driver's low rule risk keeps most weight, else the model has 25 or 40 %."""
    w = F.when(rule >= 25, 0.40).otherwise(0.25)
    return F.when(model.isNull(), rule).when(alert & (rule < 20), 0.85 * rule + F.least(F.lit(12.0), 0.15 * model)).otherwise((1 - w) * rule + w * model)


def voice_boost(risk: Column, voice: Column) -> Column:
    return risk + F.when(risk >= 40, F.least(F.lit(15.0), 0.20 * voice)).when(risk >= 22, F.least(F.lit(10.0), 0.12 * voice)).otherwise(0.0)


def risk_class(risk: Column, voluntary: Column, closed: Column, masking: Column, alert_gaze: Column) -> Column:
    return (
        F.when((risk >= 50) | (masking & (risk >= 40) & ~alert_gaze), "HIGH_RISK_INTOXICATED")
        .when((risk >= 25) | ((voluntary >= 50) & (risk >= 22) & (closed > 0.08)), "MILD_IMPAIRMENT")
        .otherwise("SOBER")
    )


def command(lockout: Column, microsleep: Column, kind: Column, slurred: Column, risk: Column) -> Column:
    """0 none, 1 warn, 2 critical."""
    warn = kind.isin("MILD_IMPAIRMENT", "HIGH_RISK_INTOXICATED") | (slurred & (risk.isNull() | (risk >= 25)))
    return F.when(lockout | microsleep, 2).when(warn, 1).otherwise(0)


def pose_gate(yaw: Column, pitch: Column, yaw_limit: float, down: float, up: float) -> tuple[Column, Column]:
    """(valid, reason): angles beyond the limits, each named with one digit."""
    ok = yaw.isNotNull() & pitch.isNotNull() & (F.abs(yaw) <= yaw_limit) & (pitch >= down) & (pitch <= up)
    reason = (
        F.when(yaw.isNull() | pitch.isNull(), "no pose")
        .when(F.abs(yaw) > yaw_limit, F.format_string("yaw %.1f", yaw))
        .when((pitch < down) | (pitch > up), F.format_string("pitch %.1f", pitch))
        .otherwise("")
    )
    return F.coalesce(ok, F.lit(False)), reason


def label_of(text: Column, impaired: list[str]) -> Column:
    """1 for a name of the impaired class, trimmed and lower-cased; 0 for any other, unknown ones included."""
    return F.coalesce(F.lower(F.trim(text)).isin(impaired).cast("int"), F.lit(0))

"""The temporal risk of a frame: one statement of the rules, as SQL expressions in stages, that Spark runs as projections.

Each stage names columns that only use the columns before it, so Catalyst sees a chain of projections without a shuffle.
``as_sql`` writes the same stages as nested selects for another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.keys import Stream
from kymora.operators.windows import last_known

#: What a frame may hold, and what stands for an absent column.
INPUTS = {
    "face_valid": "true", "imu_gated": "false", "blink_phase": "'open'", "ear_avg": "0.0", "mar": "0.0", "perclos": "0.0",
    "gaze_yaw_dispersion": "0.0", "stare_fixation_duration_s": "0.0", "head_postural_sway": "0.0", "blink_opening_velocity": "0.0",
    "pursuit_fragmentation_ratio": "0.0", "vor_gain": "1.0", "eyelid_tremor_hz": "0.0", "eyeball_tremor_hz": "0.0",
    "flushing_valid": "false", "flushing_delta": "0.0", "rppg_valid": "false", "rppg_hrv_rmssd_ms": "0.0",
    "masking_divergence_score": "0.0", "voice_impairment_score": "0.0", "ml_probability": "CAST(NULL AS DOUBLE)",
    "gen_detected": "false", "lack_of_convergence": "false", "microsleep_detected": "false", "deliberate_blink_suppression": "false",
    "compensatory_stare_active": "false", "rigid_head_stabilization": "false", "frontalis_compensation_active": "false",
    "masking_detected": "false", "voluntary_eye_widening": "false", "highway_fixation_exempt": "false", "speech_active": "false",
    "yawn_detected": "false", "audio_valid": "false", "voice_slurred_detected": "false", "last_open_ear": "0.30",
}

#: A marker's scores by the first condition that holds, strictest first; 0 where none does.
LADDERS = {
    "gen": [("gen_detected", 90.0)],
    "pursuit_fragmentation": [("pursuit_fragmentation_ratio > 0.30", 85.0), ("pursuit_fragmentation_ratio > 0.15", 45.0)],
    "lack_of_convergence": [("lack_of_convergence", 80.0)],
    "vor_depression": [("vor_gain < 0.65", 75.0), ("vor_gain < 0.78", 35.0)],
    "perclos": [("perclos > 0.30", 90.0), ("perclos > 0.15", 50.0)],
    "blink_velocity": [("blink_opening_velocity <= 0.0", 0.0), ("blink_opening_velocity < 1.2", 80.0), ("blink_opening_velocity < 1.8", 40.0)],
    "gaze_tunneling": [("NOT tunnel_backed OR gaze_yaw_dispersion <= 0.0", 0.0), ("gaze_yaw_dispersion < 0.03", 75.0), ("gaze_yaw_dispersion < 0.06", 35.0)],
    "microsleep": [("microsleep_detected", 100.0)],
    "postural_sway": [("head_postural_sway > 1.8", 70.0), ("head_postural_sway > 1.2", 35.0)],
    "facial_flushing": [("NOT flushing_valid", 0.0), ("flushing_delta >= 0.20", 70.0), ("flushing_delta >= 0.10", 35.0)],
    "eyelid_tremor": [("eyelid_tremor_hz >= 5.0", 65.0), ("eyelid_tremor_hz >= 3.5", 30.0)],
    "eyeball_tremor": [("eyeball_tremor_hz >= 5.0", 65.0), ("eyeball_tremor_hz >= 3.5", 30.0)],
    "voluntary_eye_widening": [("voluntary_eye_widening", 75.0)],
    "deliberate_blink_suppression": [("deliberate_blink_suppression", 70.0)],
    "compensatory_stare": [("compensatory_stare_active", 75.0), ("stare_fixation_duration_s >= 6.0", 35.0)],
    "rigid_head_stabilization": [("rigid_head_stabilization AND NOT rigid_excused", 60.0)],
    "frontalis_compensation": [("frontalis_compensation_active", 65.0)],
}
#: Weights of the involuntary risk, bonuses that count from 20 on, and the voluntary markers.
WEIGHTS = {"gen": 0.24, "pursuit_fragmentation": 0.22, "blink_velocity": 0.22, "vor_depression": 0.00, "lack_of_convergence": 0.12, "perclos": 0.10, "gaze_tunneling": 0.05, "microsleep": 0.05}
BONUSES = [("m_postural_sway >= 35.0", 5.0), ("m_facial_flushing >= 35.0", 5.0), ("m_eyelid_tremor >= 30.0", 4.0), ("m_eyeball_tremor >= 30.0", 4.0), ("rppg_valid AND rppg_hrv_rmssd_ms > 0.0 AND rppg_hrv_rmssd_ms < 18.0", 3.0)]
VOLUNTARY = ("voluntary_eye_widening", "deliberate_blink_suppression", "compensatory_stare", "rigid_head_stabilization", "frontalis_compensation")
ACTIVE = {
    "gen": "gen_detected", "lack_of_convergence": "lack_of_convergence", "microsleep": "microsleep_detected", "deliberate_blink_suppression": "deliberate_blink_suppression",
    "compensatory_stare": "compensatory_stare_active", "rigid_head_stabilization": "rigid_head_stabilization", "frontalis_compensation": "frontalis_compensation_active",
    "masking_detected": "masking_detected", "sluggish_blink": "sluggish", "catatonic_stare_stupor": "stupor_stare", "slurred_voice_dysarthria": "audio_valid AND voice_slurred_detected",
}


def _case(steps: list[tuple[str, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {float(s)}" for c, s in steps) + " ELSE 0.0 END"


def _between(x: str, low: float, high: float) -> str:
    return f"({x} > {float(low)} AND {x} < {float(high)})"


def _clip(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def stages(open_ear: float = 0.28, ingress: bool = False, fps: float = 30.0) -> list[dict[str, str]]:
    """The rules, for a driver's open-eye baseline, whether the start-up check failed, and the frame rate."""
    v, gaze, stare = "blink_opening_velocity", "gaze_yaw_dispersion", "stare_fixation_duration_s"
    reflex = "gen_detected OR lack_of_convergence"
    upstroke = 1.00 if fps < 22 else 1.20
    ml = "ml_probability * 100.0"
    voluntary = [f"m_{n}" for n in VOLUNTARY]
    started = f"CASE WHEN ear_avg = 0.0 THEN greatest(r2, 55.0) WHEN r2 >= 20.0 THEN least(100.0, r2 + 10.0) ELSE r2 END" if ingress else "r2"  # noqa: F541
    return [
        {
            "observed": "face_valid AND NOT imu_gated",
            "effective_ear": "CASE WHEN blink_phase IN ('closing', 'closed', 'opening') THEN last_open_ear ELSE ear_avg END",
            "sluggish": _between(v, 0, 1.45),
            "slack_jaw": "mar >= 0.22 AND NOT speech_active AND NOT yawn_detected",
            "flutter": "(eyeball_tremor_hz >= 3.5 AND eyelid_tremor_hz >= 2.5) OR (eyeball_tremor_hz >= 4.0 AND head_postural_sway >= 0.55)",
            "pinned_stare": f"(compensatory_stare_active OR {stare} >= 5.0) AND {_between(gaze, 0, 0.035)} AND {_between(v, 0, 1.65)}",
        },
        {
            "alert_gaze": f"effective_ear >= 0.26 AND perclos < 0.10 AND {gaze} >= 0.024 AND NOT ({reflex} OR microsleep_detected)",
            "tunnel_backed": f"{v} = 0.0 OR perclos > 0.10 OR effective_ear < {open_ear} * 0.88 OR {reflex} OR pursuit_fragmentation_ratio > 0.15",
            "rigid_excused": f"effective_ear >= {open_ear} * 0.90 AND ({v} = 0.0 OR {v} >= 1.50) AND NOT ({reflex}) AND perclos <= 0.10",
        },
        {
            "stupor_stare": f"NOT alert_gaze AND (compensatory_stare_active OR deliberate_blink_suppression) AND (({_between(v, 0, 1.5)} AND ({stare} >= 3.5 OR {_between(gaze, 0, 0.028)})) OR ({v} = 0.0 AND {stare} >= 5.5 AND {_between(gaze, 0, 0.022)} AND head_postural_sway < 0.35))",
            "stupor": f"CASE WHEN NOT alert_gaze AND deliberate_blink_suppression AND flutter AND {v} < 1.45 AND {gaze} < 0.025 AND NOT highway_fixation_exempt AND (slack_jaw OR {stare} >= 5.5 OR compensatory_stare_active) "
            f"THEN 42.0 + CASE WHEN slack_jaw AND head_postural_sway >= 0.60 THEN 12.0 ELSE 0.0 END + CASE WHEN {_between(v, 0, 1.35)} THEN 14.0 ELSE 0.0 END ELSE 0.0 END",
            "slow_lid": f"{_between(v, 0, 1.35)} AND NOT alert_gaze",
            "masked": f"NOT alert_gaze AND (masking_detected OR masking_divergence_score >= 50.0) AND (({_between(v, 0, 1.25)} AND effective_ear < 0.27) OR perclos >= 0.18 OR {reflex})",
        },
        {f"m_{n}": _case(steps) for n, steps in LADDERS.items()},
        {
            "r0": " + ".join(f"m_{n} * {w}" for n, w in WEIGHTS.items()),
            "floor": f"CASE WHEN NOT stupor_stare THEN 0.0 WHEN sluggish OR {_between(gaze, 0, 0.020)} THEN 62.0 ELSE 48.0 END",
            "impaired_stare": "pinned_stare OR stupor_stare",
        },
        {"r1": f"r0 + CASE WHEN r0 >= 20.0 THEN {' + '.join(f'CASE WHEN {c} THEN {b} ELSE 0.0 END' for c, b in BONUSES)} ELSE 0.0 END"},
        {"r2": "greatest(r1, floor, CASE WHEN pinned_stare THEN 48.0 ELSE 0.0 END)"},
        {
            "rules": _clip(started),
            "attentive": "effective_ear >= 0.26 AND perclos < 0.10 AND NOT (impaired_stare OR sluggish OR masking_detected)",
            "open_eyes": f"effective_ear > 0.0 AND effective_ear >= {open_ear} * 0.84 AND perclos < 0.12 AND NOT (microsleep_detected OR {reflex} OR impaired_stare OR sluggish OR masking_detected) AND pursuit_fragmentation_ratio <= 0.20",
            "model_and_mask": f"deliberate_blink_suppression AND slow_lid AND coalesce({ml} >= 45.0, false)",
            "alert": f"effective_ear >= 0.25 AND perclos < 0.12 AND NOT (microsleep_detected OR {reflex} OR impaired_stare OR stupor > 0.0 OR masked) AND pursuit_fragmentation_ratio <= 0.25 AND ({v} <= 0.01 OR {v} >= {upstroke})",
        },
        {"uncapped": f"impaired_stare OR slow_lid OR (masking_detected AND NOT alert_gaze) OR stupor >= 35.0 OR masked OR model_and_mask OR {reflex} OR NOT (attentive OR alert_gaze)"},
        {
            "r3": f"CASE WHEN ml_probability IS NULL THEN rules WHEN (alert OR (open_eyes AND NOT uncapped)) AND rules < 20.0 THEN {_clip(f'0.85 * rules + least(12.0, 0.15 * ({ml}))')} "
            f"ELSE greatest({_clip(f'CASE WHEN rules < 15.0 AND perclos < 0.10 THEN 0.75 * rules + 0.25 * ({ml}) ELSE 0.60 * rules + 0.40 * ({ml}) END')}, CASE WHEN stupor_stare THEN greatest(0.85 * rules, floor) ELSE 0.0 END) END",
        },
        {"r4": f"CASE WHEN masked THEN {_clip(f'greatest(r3, 0.65 * masking_divergence_score + 0.35 * greatest(coalesce({ml}, masking_divergence_score), masking_divergence_score))')} ELSE r3 END"},
        {"r5": f"CASE WHEN stupor > 0.0 THEN {_clip(f'greatest(r4, 0.65 * stupor + 0.35 * greatest(coalesce({ml}, stupor), stupor))')} ELSE r4 END"},
        {"r6": f"CASE WHEN (NOT uncapped OR alert) AND (attentive OR alert) AND effective_ear >= {open_ear} * 0.84 AND perclos < 0.15 AND mar < 0.22 AND NOT (model_and_mask OR masked OR impaired_stare OR stupor > 0.0) AND rules < 25.0 THEN least(r5, 22.0) ELSE r5 END"},
        {
            "involuntary": f"CASE WHEN NOT observed THEN 0.0 WHEN NOT (audio_valid AND voice_slurred_detected) OR r6 < 22.0 THEN r6 WHEN r6 >= 40.0 THEN {_clip('r6 + least(15.0, 0.20 * voice_impairment_score)')} ELSE {_clip('r6 + least(10.0, 0.12 * voice_impairment_score)')} END",
            "voluntary": f"CASE WHEN NOT observed THEN 0.0 ELSE ({' + '.join(voluntary)}) / greatest(1.0, {' + '.join(f'CASE WHEN {m} > 0.0 THEN 1.0 ELSE 0.0 END' for m in voluntary)}) END",
        },
        {
            "classification": "CASE WHEN NOT observed THEN 'INSUFFICIENT_DATA' WHEN involuntary >= 50.0 OR (masking_detected AND involuntary >= 40.0 AND NOT alert_gaze) THEN 'HIGH_RISK_INTOXICATED' WHEN involuntary >= 25.0 OR (voluntary >= 50.0 AND involuntary >= 22.0 AND perclos > 0.08) THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END",
            "active_markers": "CASE WHEN observed THEN concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in ACTIVE.items()) + ") ELSE '' END",
        },
        {
            "total_risk": _clip("CASE WHEN classification = 'HIGH_RISK_INTOXICATED' AND involuntary < 50.0 THEN greatest(involuntary, masking_divergence_score) WHEN classification = 'MILD_IMPAIRMENT' THEN greatest(involuntary, 25.0) ELSE involuntary END"),
            "lockout": "classification = 'HIGH_RISK_INTOXICATED'",
            "throttle": "CASE WHEN classification IN ('MILD_IMPAIRMENT', 'HIGH_RISK_INTOXICATED') THEN 1 ELSE 0 END",
            "confidence": "CASE WHEN observed THEN 0.88 ELSE 0.0 END",
        },
    ]


#: Inputs of the score of a single picture: a null redness is that of a picture without colour.
STILL = {"ear_left": "0.0", "ear_right": "0.0", "mar": "0.0", "head_pitch": "0.0", "head_roll": "0.0", "speech_active": "false", "redness": "CAST(NULL AS DOUBLE)"}


def still_stages(asymmetry: float = 0.0, pitch: float = 0.0, roll: float = 0.0, ingress: bool = False) -> list[dict[str, str]]:
    """The rules for one picture, against a person's own asymmetry and head pose."""
    ear = "(ear_left + ear_right) / 2.0"
    rest = "(0.50 * m_ptosis + 0.25 * m_slump + 0.10 * m_asymmetry + 0.10 * m_jaw)"
    risk = f"CASE WHEN redness IS NULL THEN {rest} / 0.95 ELSE {rest} + 0.05 * m_redness END + CASE WHEN m_ptosis >= 60.0 AND m_slump >= 25.0 THEN 15.0 ELSE 0.0 END"
    return [
        {"ear": ear, "apart": f"greatest(0.0, abs(ear_left - ear_right) - {asymmetry})", "nod": f"head_pitch - ({pitch})", "list": f"abs(head_roll - ({roll}))"},
        {
            "m_ptosis": "CASE WHEN ear < 0.12 THEN 90.0 WHEN ear < 0.22 THEN greatest(50.0, least(90.0, 50.0 + (0.26 - ear) / 0.14 * 40.0)) WHEN ear < 0.26 THEN greatest(20.0, least(50.0, 20.0 + (0.26 - ear) / 0.04 * 30.0)) ELSE 0.0 END",
            "m_asymmetry": _case([("apart > 0.06", 75.0), ("apart > 0.035", 40.0)]),
            "m_slump": "least(85.0, CASE WHEN nod < -14.0 THEN least(60.0, (-14.0 - nod) * 5.0) ELSE 0.0 END + CASE WHEN list > 14.0 THEN least(40.0, (list - 14.0) * 4.0) ELSE 0.0 END)",
            "m_jaw": _case([("speech_active", 0.0), ("mar > 0.35", 70.0), ("mar > 0.22", 35.0)]),
            "m_redness": _case([("redness IS NULL", 0.0), ("redness > 1.35", 75.0), ("redness > 1.15", 35.0)]),
        },
        {"risk": _clip(f"greatest({risk}, {55.0 if ingress else 0.0})")},
        {
            "class": "CASE WHEN risk >= 50.0 THEN 'HIGH_RISK_INTOXICATED' WHEN risk >= 25.0 THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END",
            "confidence": "CASE WHEN risk >= 50.0 THEN greatest(0.70, least(0.95, 0.70 + (risk - 50.0) / 50.0 * 0.25)) WHEN risk >= 25.0 THEN 0.70 ELSE greatest(0.80, least(0.95, 0.80 + (25.0 - risk) / 25.0 * 0.15)) END",
            "lockout": "risk >= 50.0",
        },
    ]


def still_score(df: DataFrame, keep: list[str], **settings) -> DataFrame:
    """Scores single pictures with the columns of STILL: ``keep``, risk, class, confidence, lockout and the five markers."""
    have = set(df.columns)
    df = df.withColumns({n: F.coalesce(F.col(n), F.expr(doubles(d))) if n in have else F.expr(doubles(d)) for n, d in STILL.items()})
    for stage in still_stages(**settings):
        df = df.withColumns({n: F.expr(doubles(sql)) for n, sql in stage.items()})
    return df.select(*keep, "risk", "class", "confidence", "lockout", *[f"m_{n}" for n in ("ptosis", "asymmetry", "slump", "jaw", "redness")])


OUTPUTS = ("classification", "total_risk", "involuntary", "voluntary", "lockout", "throttle", "confidence", "active_markers")


def doubles(sql: str) -> str:
    """Numbers with a point as doubles, which both engines read an exponent as."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


def with_open_ear(df: DataFrame, s: Stream) -> DataFrame:
    """``last_open_ear``: the last aperture of an open eye of 0.22 or more, 0.30 before any."""
    seen = F.when((F.col("blink_phase") == "open") & (F.col("ear_avg") >= 0.22) & F.col("face_valid") & ~F.col("imu_gated"), F.col("ear_avg"))
    return df.withColumn("last_open_ear", F.coalesce(last_known(seen, s.rows()), F.lit(0.30)))


def temporal_score(df: DataFrame, keep: list[str], **settings) -> DataFrame:
    """Scores frames with the columns of INPUTS, absent ones as stated there: ``keep``, OUTPUTS and the markers as a map.

    A row without a valid face, or gated, is INSUFFICIENT_DATA with zeros and no markers; a null input counts as absent.
    """
    have = set(df.columns)
    df = df.withColumns({n: F.coalesce(F.col(n), F.expr(doubles(d))) if n in have else F.expr(doubles(d)) for n, d in INPUTS.items()})
    for stage in stages(**settings):
        df = df.withColumns({n: F.expr(doubles(sql)) for n, sql in stage.items()})
    scores = F.create_map(*[x for n in LADDERS for x in (F.lit(n), F.col(f"m_{n}"))], F.lit("masking_divergence"), F.col("masking_divergence_score"), F.lit("catatonic_stupor"), F.col("stupor"))
    return df.select(*keep, *OUTPUTS, F.when(F.col("observed"), scores).otherwise(F.map_filter(scores, lambda k, v: F.lit(False))).alias("markers"))


def as_sql(source: str, rules: list[dict[str, str]]) -> str:
    """Stages as nested selects over a query that has all columns they use."""
    for stage in rules:
        source = f"SELECT *, {', '.join(f'{doubles(sql)} AS {n}' for n, sql in stage.items())} FROM ({source})"
    return source

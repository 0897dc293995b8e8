"""Whole frames: their composition, records, personal baselines, roll-ups and reports, over one row schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.functions import geometry as G
from kymora.operators.aggregates import conditional_medians, verdict

#: A batch record's columns in order, with the digits that numbers are rounded to (None: kept as they are).
RECORD: tuple[tuple[str, int | None], ...] = (
    ("frame_id", None), ("timestamp", 3), ("face_valid", None), ("ear_avg", 4), ("ear_left", 4), ("ear_right", 4), ("mar", 4), ("perclos", 4),
    ("blink_phase", None), ("blink_detected", None), ("microsleep_detected", None), ("yawn_detected", None), ("saccade_velocity", 2),
    ("saccade_detected", None), ("saccade_latency_ms", 1), ("head_yaw", 2), ("head_pitch", 2), ("head_roll", 2), ("gen_detected", None),
    ("gen_beat_count", None), ("gen_slow_phase_vel", 2), ("pursuit_fragmentation_ratio", 4), ("vor_gain", 3), ("vergence_angle_deg", 2),
    ("lack_of_convergence", None), ("blink_closing_velocity", 3), ("blink_opening_velocity", 3), ("head_postural_sway", 3),
    ("facial_flushing_ratio", 3), ("flushing_valid", None), ("flushing_delta", 3), ("gaze_yaw_dispersion", 4), ("deliberate_blink_suppression", None),
    ("voluntary_eye_widening", None), ("stare_fixation_duration_s", 2), ("compensatory_stare_active", None), ("rigid_head_stabilization", None),
    ("brow_eye_distance_ratio", 4), ("brow_elevation_delta", 4), ("frontalis_compensation_active", None), ("eyelid_tremor_hz", 2),
    ("eyeball_tremor_hz", 2), ("rppg_pulse_bpm", 1), ("rppg_hrv_rmssd_ms", 2), ("rppg_valid", None), ("imu_gated", None), ("gating_reason", None),
    ("masking_divergence_score", 1), ("masking_detected", None), ("risk_score", 1), ("involuntary_risk_score", 1), ("voluntary_masking_score", 1),
    ("classification", None), ("lockout_recommended", None), ("bayesian_posterior", 4), ("bayesian_sustained_s", 2),
    ("bayesian_lockout_confirmed", None), ("audio_valid", None), ("vocal_jitter_pct", 3), ("vocal_shimmer_pct", 3), ("vocal_hnr_db", 2),
    ("formant_f2_slope_hz_ms", 2), ("voice_impairment_score", 2), ("voice_slurred_detected", None),
)
#: What the streaming log adds to the features, with digits.
LOGGED = (("risk_score", 2), ("involuntary_risk_score", 2), ("voluntary_masking_score", 2), ("classification", None), ("lockout_recommended", None), ("ml_probability", 4), ("bayesian_posterior", 4), ("bayesian_sustained_s", 2), ("bayesian_lockout_confirmed", None))
#: An audit row's columns with what stands for an absent one.
AUDIT = (("clip_path", ""), ("subject_id", ""), ("label", ""), ("status", ""), ("total_frames", 0), ("fps", 0.0), ("duration_s", 0.0), ("face_detected_frames", 0), ("face_detection_rate_pct", 0.0), ("valid_ungated_frames", 0), ("valid_ungated_rate_pct", 0.0), ("scene_cut_count", 0), ("windows_extracted", 0), ("archive_file", ""))
#: The audio channels of a window, in order.
AUDIO = ("audio_valid", "vocal_jitter_pct", "vocal_shimmer_pct", "vocal_hnr_db", "formant_f2_slope_hz_ms", "voice_impairment_score", "voice_slurred_detected")
#: What features are clamped to, the same in training and inference.
CLAMPS = {"saccade_latency_ms": 10_000.0, "stare_fixation_duration_s": 30.0}


# ---------------------------------------------------------------- composition and projections


def compose(face: DataFrame, keys: list[str], **parts: tuple[DataFrame, dict[str, object]]) -> DataFrame:
    """One row per frame: each part's columns beside the face's, by the same keys; ``{column: value where the part lacks the frame}``.

    Parts hold a frame once at most. All joins share one partitioning, so each table is shuffled once.
    """
    out = face
    for df, fill in parts.values():
        out = out.join(df.select(*keys, *fill), keys, "left").withColumns({c: F.col(c) if v is None else F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return out


def socket_centre(points: Column, corners: tuple[int, int, int, int]) -> Column:
    """Mean of the four eye corners (outer and inner of each eye), in mean eye widths of one at least; null where a corner is missing."""
    mean = lambda axis: sum((G.at(points, p, axis) for p in corners), F.lit(0.0)) / 4
    width = lambda p, q: F.hypot(G.at(points, p, 0) - G.at(points, q, 0), G.at(points, p, 1) - G.at(points, q, 1))
    unit = F.greatest((width(corners[0], corners[1]) + width(corners[2], corners[3])) / 2, F.lit(1.0))
    x, y = mean(0) / unit, mean(1) / unit
    return F.when(~F.isnan(x) & ~F.isnan(y), F.struct(x.alias("x"), y.alias("y")))


def both_eyes(left: Column, right: Column) -> tuple[Column, Column]:
    """(mean, asymmetry) of the two sides."""
    return (left + right) / 2, F.abs(left - right)


def clamped(name: str, default: float = 0.0) -> Column:
    """A feature under the bound that training and inference share."""
    value = F.coalesce(F.col(name).cast("double"), F.lit(default))
    return F.least(value, F.lit(CLAMPS[name])) if name in CLAMPS else value


def feature_vector(numbers: list[str], flags: list[str]) -> Column:
    """Clamped numbers, then flags as 0 and 1, as floats."""
    return F.array(*[clamped(n).cast("float") for n in numbers], *[F.coalesce(F.col(n), F.lit(False)).cast("float") for n in flags])


def audio_vector() -> Column:
    """The seven audio channels of a frame."""
    return F.array(*[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) for n in AUDIO])


def final_slurred(flag: Column, lips: Column, rms: Column, speech: Column) -> tuple[Column, Column]:
    """(slurred, speech) of a frame: the extractor's flag counts with lips moving and a loud signal, and is speech itself."""
    slurred = flag & lips & (rms >= 0.010)
    return slurred, speech | slurred


def overridden(df: DataFrame) -> DataFrame:
    """Dark glasses hide lids and gaze, so suppression and stare don't count; a drowsy head isn't rigid on purpose."""
    drowsy = F.col("microsleep_detected") | (F.col("perclos") > 0.15)
    return df.withColumns({
        "deliberate_blink_suppression": F.col("deliberate_blink_suppression") & ~F.col("sunglasses"),
        "compensatory_stare_active": F.col("compensatory_stare_active") & ~F.col("sunglasses"),
        "rigid_head_stabilization": F.col("rigid_head_stabilization") & ~drowsy,
    })


def rescaled_camera(matrix: Column, width: Column, height: Column, new_width: Column, new_height: Column, custom: Column) -> Column:
    """(fx, fy, cx, cy) for another frame size: a measured camera is scaled, an assumed one starts from the new width."""
    at = lambda i: F.get(matrix, i)
    sx, sy = new_width / width, new_height / height
    scaled = F.array(at(0) * sx, at(1) * sy, at(2) * sx, at(3) * sy)
    assumed = F.array(new_width * 1.0, new_width * 1.0, new_width / 2, new_height / 2)
    return F.when((new_width == width) & (new_height == height), matrix).when(custom, scaled).otherwise(assumed)


# ---------------------------------------------------------------- records


def _rounded(df: DataFrame, columns: tuple[tuple[str, int | None], ...]) -> list[Column]:
    return [F.bround(F.col(c).cast("double"), digits).alias(c) if digits is not None else F.col(c) for c, digits in columns if c in df.columns]


def batch_record(df: DataFrame) -> DataFrame:
    """The record's columns that a table has, in order, rounded half to even."""
    return df.select(*_rounded(df, RECORD))


def log_record(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as they are, then the assessment; an absent model's probability stays null, which the log writes as a blank."""
    return df.select(*features, *_rounded(df.select(*[c for c, _ in LOGGED if c in df.columns]), LOGGED))


def audit_rows(df: DataFrame) -> DataFrame:
    """The fourteen columns of the audit, absent and null ones by their default."""
    value = lambda c, d: F.coalesce(F.col(c).cast({str: "string", int: "bigint", float: "double"}[type(d)]), F.lit(d)) if c in df.columns else F.lit(d)
    return df.select(*[value(c, d).alias(c) for c, d in AUDIT])


def audit_summary(df: DataFrame, impaired: str = "drunk") -> DataFrame:
    """Totals of an audit and, nested, its clips by path: one row. Clips number thousands, a row each."""
    rows = audit_rows(df).withColumn("taken", F.col("status").startswith("ACCEPTED"))
    windows = lambda is_impaired: F.coalesce(F.sum(F.when((F.col("label") == impaired) == is_impaired, F.col("windows_extracted"))), F.lit(0))
    agg = rows.agg(
        F.count("*").alias("total_clips"), F.count_if("taken").alias("accepted_clips"), F.count_if(F.col("status") == "WARNING_JUMP_CUTS").alias("warning_jump_cut_clips"),
        F.count_if(F.col("status").startswith("REJECTED")).alias("rejected_clips"), F.coalesce(F.sum("windows_extracted"), F.lit(0)).alias("total_windows"),
        windows(False).alias("sober_windows"), windows(True).alias("drunk_windows"), F.sort_array(F.collect_list(F.struct(*[c for c, _ in AUDIT]))).alias("clips"),
    )
    ratio = F.bround(F.col("sober_windows") / F.greatest(F.col("drunk_windows"), F.lit(1)), 2)
    return agg.withColumn("imbalance_ratio", ratio).select(*[c for c in agg.columns if c != "clips"], "imbalance_ratio", "clips")


# ---------------------------------------------------------------- baselines


def baseline_metrics() -> dict[str, tuple[Column, Column]]:
    """The values that personal baselines are medians of, each with its own condition beside a valid, ungated frame."""
    c = F.col
    good = c("face_valid") & ~c("imu_gated")
    still = ~c("blink_detected")
    raw = {
        "ear": (c("ear_avg"), (c("ear_avg") > 0.18) & still),
        "asymmetry": (F.abs(c("ear_left") - c("ear_right")), (c("ear_avg") > 0.18) & still),
        "mar": (c("mar"), (c("mar") > 0.02) & (c("mar") < 0.40) & ~c("yawn_detected")),
        "upstroke_seen": (c("blink_opening_velocity"), c("blink_opening_velocity") > 0.20),
        "upstroke": (c("blink_opening_velocity"), (c("blink_opening_velocity") > 0.20) & c("blink_detected")),
        "flushing": (c("facial_flushing_ratio"), c("flushing_valid") & (c("facial_flushing_ratio") > 0.5)),
        "brow": (c("brow_eye_distance_ratio"), (c("brow_eye_distance_ratio") > 0.05) & ~c("frontalis_compensation_active") & still),
        "pitch": (c("head_pitch"), F.lit(True)),
        "roll": (c("head_roll"), F.lit(True)),
        "yaw": (c("head_yaw"), F.lit(True)),
    }
    return {n: (value, good & cond) for n, (value, cond) in raw.items()}


def baselines(df: DataFrame, subject: str, order: list[str], most: int = 600) -> DataFrame:
    """Personal baselines of each subject from its last ``most`` values of each metric, guarded against an impaired start.

    Upstrokes of completed blinks count before those merely seen; a metric without values has its norm.
    """
    got = conditional_medians(df, subject, baseline_metrics(), order, most)
    or_norm = lambda c, norm: F.coalesce(F.col(c), F.lit(norm))
    got = got.withColumns({"level": or_norm("ear", 0.28), "speed": F.coalesce("upstroke", "upstroke_seen", F.lit(2.5)), "apart": or_norm("asymmetry", 0.0)})
    weak = (F.col("level") < 0.25) & (F.col("speed") < 1.80) & ((F.col("n_upstroke") >= 3) | (F.col("n_upstroke_seen") >= 3))
    reason = F.when(weak, "low lids and slow reopening").when(F.col("level") < 0.21, "severe ptosis").when(F.col("apart") > 0.08, "asymmetry")
    clip = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
    return got.withColumn("ingress_reason", reason).select(
        subject, F.col("ingress_reason").isNotNull().alias("ingress"), F.coalesce("ingress_reason", F.lit("")).alias("ingress_reason"),
        F.when(F.col("ingress_reason").isNotNull(), 0.28).otherwise(clip("level", 0.25, 0.38)).alias("ear_baseline"),
        F.when(F.col("ingress_reason").isNotNull(), 2.5).otherwise(clip("speed", 1.80, 3.20)).alias("upstroke_baseline"),
        F.least(F.col("apart"), F.lit(0.05)).alias("asymmetry_baseline"), or_norm("mar", 0.15).alias("mar_baseline"),
        or_norm("flushing", 1.35).alias("flushing_baseline"), or_norm("brow", 0.0).alias("brow_baseline"), or_norm("pitch", 0.0).alias("pitch_baseline"),
        or_norm("roll", 0.0).alias("roll_baseline"), or_norm("yaw", 0.0).alias("yaw_baseline"), F.col("n_ear").alias("samples"),
    )


# ---------------------------------------------------------------- roll-up and report

#: Means over valid frames: (name, column, digits, value without any); flags counted there.
MEANS = (
    ("mean_involuntary_risk_pct", "involuntary_risk_score", 1, 0.0), ("mean_masking_divergence_pct", "masking_divergence_score", 1, 0.0), ("mean_vor_gain", "vor_gain", 3, 1.0),
    ("mean_pursuit_fragmentation_ratio", "pursuit_fragmentation_ratio", 4, 0.0), ("mean_head_postural_sway_deg", "head_postural_sway", 3, 0.0), ("mean_facial_flushing_ratio", "facial_flushing_ratio", 3, 1.0),
    ("mean_ear", "ear_avg", 4, 0.0), ("mean_eyelid_tremor_hz", "eyelid_tremor_hz", 2, 0.0), ("mean_eyeball_tremor_hz", "eyeball_tremor_hz", 2, 0.0),
)
COUNTS = {
    "gaze_evoked_nystagmus_frames": "gen_detected", "lack_of_convergence_frames": "lack_of_convergence", "deliberate_blink_suppression_frames": "deliberate_blink_suppression",
    "voluntary_eye_widening_spikes": "voluntary_eye_widening", "rigid_head_stabilization_frames": "rigid_head_stabilization", "frontalis_compensation_frames": "frontalis_compensation_active",
    "audio_valid_frames": "audio_valid", "slurred_speech_frames": "voice_slurred_detected",
}


def clip_summary(df: DataFrame, subject: list[str]) -> DataFrame:
    """A clip's roll-up: class counts over all frames, everything else over the valid ones, and the verdict."""
    valid = F.col("face_valid")
    of = lambda c, cond=None: F.when(valid if cond is None else valid & cond, F.col(c))
    mean = lambda c, digits, none, cond=None: F.bround(F.coalesce(F.avg(of(c, cond)), F.lit(none)), digits)
    top = lambda c, digits: F.bround(F.coalesce(F.max(of(c)), F.lit(0.0)), digits)
    kind = lambda k: F.count_if(F.col("classification") == k)
    got = df.groupBy(*subject).agg(
        F.count("*").alias("frames"), F.count_if(valid).alias("face_detected_frames"), kind("SOBER").alias("sober_frames"), kind("MILD_IMPAIRMENT").alias("mild_impairment_frames"),
        kind("HIGH_RISK_INTOXICATED").alias("high_risk_intoxicated_frames"), F.count_if("lockout_recommended").alias("lockout_trigger_frames"), F.count_if(valid & F.col("masking_detected")).alias("masking_detected_frames"),
        F.avg(of("involuntary_risk_score")).alias("__mean"), *[mean(c, d, none).alias(n) for n, c, d, none in MEANS], *[F.count_if(valid & F.col(c)).alias(n) for n, c in COUNTS.items()],
        top("involuntary_risk_score", 1).alias("max_involuntary_risk_pct"), top("masking_divergence_score", 1).alias("max_masking_divergence_pct"), top("stare_fixation_duration_s", 2).alias("max_compensatory_stare_duration_s"),
        mean("rppg_pulse_bpm", 1, 0.0, F.col("rppg_valid")).alias("mean_rppg_pulse_bpm"), mean("rppg_hrv_rmssd_ms", 2, 0.0, F.col("rppg_valid")).alias("mean_rppg_hrv_rmssd_ms"),
        mean("voice_impairment_score", 1, 0.0, F.col("audio_valid")).alias("mean_voice_impairment_score"),
    )
    said = verdict(F.col("high_risk_intoxicated_frames"), F.col("mild_impairment_frames"), F.col("lockout_trigger_frames"), F.col("face_detected_frames"), F.coalesce("__mean", F.lit(0.0)))
    share = F.bround(100 * F.col("lockout_trigger_frames") / F.greatest(F.col("face_detected_frames"), F.lit(1)), 1)
    rate = F.bround(100 * F.col("face_detected_frames") / F.col("frames"), 1)
    return got.withColumns({"final_classification": said, "lockout_triggered": said == "HIGH_RISK_INTOXICATED", "lockout_trigger_pct": share, "face_detection_rate_pct": rate}).drop("__mean")


#: The report's sections and lines: (label, column, format).
REPORT = (
    ("FORENSIC IMPAIRMENT REPORT", (("Frames analysed", "frames", "%d"), ("Face detection rate", "face_detection_rate_pct", "%.1f%%"))),
    ("OVERALL VERDICT", (("Final classification", "final_classification", "%s"), ("Lockout triggered", "lockout_triggered", "%s"), ("Lockout frames", "lockout_trigger_frames", "%d"), ("Lockout share", "lockout_trigger_pct", "%.1f%%"),
        ("Mean involuntary risk", "mean_involuntary_risk_pct", "%.1f%%"), ("Peak involuntary risk", "max_involuntary_risk_pct", "%.1f%%"), ("Mean masking divergence", "mean_masking_divergence_pct", "%.1f%%"), ("Peak masking divergence", "max_masking_divergence_pct", "%.1f%%"), ("Masking frames", "masking_detected_frames", "%d"))),
    ("SECTION A: INVOLUNTARY", (("VOR gain", "mean_vor_gain", "%.3f"), ("Pursuit fragmentation", "mean_pursuit_fragmentation_ratio", "%.4f"), ("Nystagmus frames", "gaze_evoked_nystagmus_frames", "%d"), ("Convergence loss frames", "lack_of_convergence_frames", "%d"), ("Postural sway", "mean_head_postural_sway_deg", "%.3f deg"),
        ("Flushing ratio", "mean_facial_flushing_ratio", "%.3f"), ("Mean EAR", "mean_ear", "%.4f"), ("Eyelid tremor", "mean_eyelid_tremor_hz", "%.2f Hz"), ("Eyeball tremor", "mean_eyeball_tremor_hz", "%.2f Hz"), ("Pulse", "mean_rppg_pulse_bpm", "%.1f bpm"), ("HRV RMSSD", "mean_rppg_hrv_rmssd_ms", "%.2f ms"))),
    ("SECTION B: VOLUNTARY", (("Blink suppression frames", "deliberate_blink_suppression_frames", "%d"), ("Eye widening spikes", "voluntary_eye_widening_spikes", "%d"), ("Longest stare", "max_compensatory_stare_duration_s", "%.2f s"), ("Rigid head frames", "rigid_head_stabilization_frames", "%d"), ("Frontalis frames", "frontalis_compensation_frames", "%d"))),
    ("VOICE", (("Valid audio frames", "audio_valid_frames", "%d"), ("Slurred frames", "slurred_speech_frames", "%d"), ("Voice impairment", "mean_voice_impairment_score", "%.1f"))),
    ("FRAMES BY CLASS", (("Sober", "sober_frames", "%d"), ("Mild impairment", "mild_impairment_frames", "%d"), ("High risk", "high_risk_intoxicated_frames", "%d"))),
)


def text_report(summary: DataFrame, subject: list[str]) -> DataFrame:
    """The roll-up as lines of text, by section: (subject, report)."""
    rule = "=" * 64
    lines: list[Column] = []
    for title, rows in REPORT:
        lines += [F.lit(rule), F.lit(title), F.lit(rule)]
        lines += [F.concat(F.rpad(F.lit(f"  {label}:"), 34, " "), F.format_string(form, F.col(c).cast("string") if form == "%s" else F.col(c))) for label, c, form in rows]
    return summary.select(*subject, F.concat_ws("\n", *lines).alias("report"))


def diagnostic_card(risk: Column, markers: Column) -> Column:
    """A bar of thirty places and, below it, the markers that scored, highest first."""
    full = F.greatest(F.lit(0), F.least(F.lit(30), F.floor(risk / 100 * 30).cast("int")))
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), 30 - full), F.lit("]"))
    scored = F.filter(F.map_entries(markers), lambda m: m["value"] > 0)
    ranked = F.array_sort(F.transform(scored, lambda m: F.struct((-m["value"]).alias("s"), m["key"].alias("n"))))
    return F.concat_ws("\n", F.array(bar), F.transform(ranked, lambda m: F.format_string("%-32s %5.1f", m["n"], -m["s"])))

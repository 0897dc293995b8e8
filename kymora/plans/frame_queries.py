"""Whole frames made of ``embeddings`` (subject: label), and clips made of ``documents``: composition, records, baselines, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kymora.functions import gates as T
from kymora.operators import frames as R
from kymora.operators import temporal
from kymora.operators.temporal import doubles
from kymora.operators.windows import first_rows
from kymora.plans.guard_queries import frame_columns
from kymora.plans.stream_queries import r
from kymora.session import table

#: Numbers beyond those of the temporal score: (place of the number, factor, offset); and further columns.
_MORE = {
    "saccade_velocity": (16, 300.0, 0.0), "saccade_latency_ms": (17, 90000.0, 0.0), "head_yaw": (18, 200.0, 0.0), "head_pitch": (19, 100.0, 0.0), "head_roll": (20, 40.0, 0.0), "gen_slow_phase_vel": (21, 40.0, 0.0),
    "vergence_angle_deg": (22, 30.0, 0.0), "blink_closing_velocity": (23, 20.0, 0.0), "facial_flushing_ratio": (24, 4.0, 0.3), "brow_eye_distance_ratio": (25, 1.0, 0.0), "brow_elevation_delta": (26, 1.0, 0.0), "rppg_pulse_bpm": (27, 300.0, 40.0),
    "risk_score": (28, 300.0, 0.0), "involuntary_risk_score": (28, 260.0, 0.0), "voluntary_masking_score": (29, 200.0, 0.0), "bayesian_posterior": (30, 2.0, 0.0), "bayesian_sustained_s": (31, 60.0, 0.0), "vocal_jitter_pct": (32, 10.0, 0.0),
    "vocal_shimmer_pct": (33, 20.0, 0.0), "vocal_hnr_db": (34, 50.0, 0.0), "formant_f2_slope_hz_ms": (35, 50.0, 0.0),
}
_OTHERS = {
    "frame_id": "vec_id", "timestamp": "vec_id / 30.0", "blink_detected": "vec_id % 6 = 2", "saccade_detected": "vec_id % 8 = 5", "gen_beat_count": "vec_id % 4", "gating_reason": "CASE WHEN vec_id % 23 = 1 THEN 'shock' ELSE '' END",
    "lockout_recommended": "vec_id % 21 = 1", "bayesian_lockout_confirmed": "vec_id % 50 = 1", "classification": "CASE WHEN vec_id % 21 = 1 THEN 'HIGH_RISK_INTOXICATED' WHEN vec_id % 5 = 2 THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END", "sunglasses": "vec_id % 9 = 4",
}


def _made(at) -> dict[str, str]:
    out = frame_columns(at) | {n: f"{x} + abs({at(i)}) * {k}" for n, (i, k, x) in _MORE.items()} | _OTHERS
    out |= {"ear_left": f"0.1 + abs({at(0)}) * 2.0 + abs({at(36)}) * 0.2", "ear_right": f"0.1 + abs({at(0)}) * 2.0 - abs({at(37)}) * 0.2"}
    return {n: doubles(x) for n, x in out.items()}


def made(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("subject"), F.col("embedding").cast("array<double>").alias("a"))
    return df.select("vec_id", "subject", "a", *[F.expr(x).alias(n) for n, x in _made(lambda i: f"a[{i}]").items()])


_columns = ", ".join(f"{x} AS {n}" for n, x in _made(lambda i: f"a[{i + 1}]").items())
MADE = f"d AS (SELECT vec_id, label AS subject, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), f AS (SELECT vec_id, subject, a, {_columns} FROM d)"


def frame_composition(spark, sf):
    df = made(spark, sf)
    pose = df.where("vec_id % 7 <> 0").select("vec_id", "head_yaw", "head_pitch")
    gate = df.where("vec_id % 11 <> 0").select("vec_id", "imu_gated", "gating_reason")
    audio = df.where("vec_id % 3 = 0").select("vec_id", "audio_valid", "voice_impairment_score")
    got = R.compose(df.select("vec_id", "ear_avg", "face_valid"), ["vec_id"], pose=(pose, {"head_yaw": None, "head_pitch": None}), gate=(gate, {"imu_gated": False, "gating_reason": ""}), audio=(audio, {"audio_valid": False, "voice_impairment_score": 0.0}))
    usable = F.col("face_valid") & F.col("head_yaw").isNotNull() & ~F.col("imu_gated")
    return got.select("vec_id", r("ear_avg").alias("ear_avg"), r("head_yaw").alias("head_yaw"), r("head_pitch").alias("head_pitch"), "gating_reason", "audio_valid", r("voice_impairment_score").alias("voice"), usable.alias("usable"))


COMPOSITION = f"""WITH {MADE}, p AS (SELECT vec_id, head_yaw, head_pitch FROM f WHERE vec_id % 7 <> 0), g AS (SELECT vec_id, imu_gated, gating_reason FROM f WHERE vec_id % 11 <> 0), u AS (SELECT vec_id, audio_valid, voice_impairment_score FROM f WHERE vec_id % 3 = 0)
SELECT f.vec_id, round(f.ear_avg, 6) AS ear_avg, round(p.head_yaw, 6) AS head_yaw, round(p.head_pitch, 6) AS head_pitch, coalesce(g.gating_reason, '') AS gating_reason, coalesce(u.audio_valid, false) AS audio_valid, round(coalesce(u.voice_impairment_score, 0), 6) AS voice,
f.face_valid AND p.head_yaw IS NOT NULL AND NOT coalesce(g.imu_gated, false) AS usable FROM f LEFT JOIN p USING (vec_id) LEFT JOIN g USING (vec_id) LEFT JOIN u USING (vec_id)"""


def batch_record(spark, sf):
    return R.batch_record(made(spark, sf))


def _rounded(columns) -> str:
    return ", ".join(c if digits is None else f"round_even({c}, {digits}) AS {c}" for c, digits in columns)


RECORD = f"WITH {MADE} SELECT {_rounded(R.RECORD)} FROM f"


def log_record(spark, sf):
    return R.log_record(made(spark, sf), ["frame_id", "ear_avg", "perclos", "blink_phase"])


LOG = f"WITH {MADE} SELECT frame_id, ear_avg, perclos, blink_phase, {_rounded(R.LOGGED)} FROM f"


def frame_baselines(spark, sf):
    got = R.baselines(made(spark, sf), "subject", ["vec_id"], most=12)
    return got.select("subject", "ingress", "ingress_reason", "samples", *[r(c, 9).alias(c) for c in got.columns if c.endswith("_baseline")])


_good = "face_valid AND NOT imu_gated"
_metrics = {
    "ear": ("ear_avg", "ear_avg > 0.18 AND NOT blink_detected"), "asymmetry": ("abs(ear_left - ear_right)", "ear_avg > 0.18 AND NOT blink_detected"), "mar": ("mar", "mar > 0.02 AND mar < 0.40 AND NOT yawn_detected"),
    "upstroke_seen": ("blink_opening_velocity", "blink_opening_velocity > 0.20"), "upstroke": ("blink_opening_velocity", "blink_opening_velocity > 0.20 AND blink_detected"), "flushing": ("facial_flushing_ratio", "flushing_valid AND facial_flushing_ratio > 0.5"),
    "brow": ("brow_eye_distance_ratio", "brow_eye_distance_ratio > 0.05 AND NOT frontalis_compensation_active AND NOT blink_detected"), "pitch": ("head_pitch", "true"), "roll": ("head_roll", "true"), "yaw": ("head_yaw", "true"),
}
BASELINES = f"""WITH {MADE}, m AS (SELECT subject, vec_id, {', '.join(f'CASE WHEN {_good} AND {c} THEN {x} END AS q_{n}' for n, (x, c) in _metrics.items())} FROM f),
c AS (SELECT *, {', '.join(f'count(q_{n}) OVER w AS c_{n}' for n in _metrics)} FROM m WINDOW w AS (PARTITION BY subject ORDER BY vec_id DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT subject, {', '.join(f'quantile_cont(q_{n}, 0.5) FILTER (c_{n} <= 12) AS {n}, count(q_{n}) FILTER (c_{n} <= 12) AS n_{n}' for n in _metrics)} FROM c GROUP BY 1),
b AS (SELECT *, coalesce(ear, 0.28) AS level, coalesce(upstroke, upstroke_seen, 2.5) AS speed, coalesce(asymmetry, 0) AS apart FROM a),
g AS (SELECT *, CASE WHEN level < 0.25 AND speed < 1.8 AND (n_upstroke >= 3 OR n_upstroke_seen >= 3) THEN 'low lids and slow reopening' WHEN level < 0.21 THEN 'severe ptosis' WHEN apart > 0.08 THEN 'asymmetry' END AS reason FROM b)
SELECT subject, reason IS NOT NULL AS ingress, coalesce(reason, '') AS ingress_reason, n_ear AS samples, round(CASE WHEN reason IS NOT NULL THEN 0.28 ELSE greatest(0.25, least(0.38, level)) END, 9) AS ear_baseline,
round(CASE WHEN reason IS NOT NULL THEN 2.5 ELSE greatest(1.8, least(3.2, speed)) END, 9) AS upstroke_baseline, round(least(apart, 0.05), 9) AS asymmetry_baseline, round(coalesce(mar, 0.15), 9) AS mar_baseline, round(coalesce(flushing, 1.35), 9) AS flushing_baseline,
round(coalesce(brow, 0), 9) AS brow_baseline, round(coalesce(pitch, 0), 9) AS pitch_baseline, round(coalesce(roll, 0), 9) AS roll_baseline, round(coalesce(yaw, 0), 9) AS yaw_baseline FROM g"""


def clip_summary(spark, sf):
    return R.clip_summary(made(spark, sf), ["subject"])


_means = ", ".join(f"round_even(coalesce(avg({c}) FILTER (face_valid), {none}), {d}) AS {n}" for n, c, d, none in R.MEANS)
_counts = ", ".join(f"count(*) FILTER (face_valid AND {c}) AS {n}" for n, c in R.COUNTS.items())
_summary = f"""{MADE}, a AS (SELECT subject, count(*) AS frames, count(*) FILTER (face_valid) AS face_detected_frames, count(*) FILTER (classification = 'SOBER') AS sober_frames, count(*) FILTER (classification = 'MILD_IMPAIRMENT') AS mild_impairment_frames,
    count(*) FILTER (classification = 'HIGH_RISK_INTOXICATED') AS high_risk_intoxicated_frames, count(*) FILTER (lockout_recommended) AS lockout_trigger_frames, count(*) FILTER (face_valid AND masking_detected) AS masking_detected_frames, avg(involuntary_risk_score) FILTER (face_valid) AS m, {_means}, {_counts},
    round_even(coalesce(max(involuntary_risk_score) FILTER (face_valid), 0), 1) AS max_involuntary_risk_pct, round_even(coalesce(max(masking_divergence_score) FILTER (face_valid), 0), 1) AS max_masking_divergence_pct, round_even(coalesce(max(stare_fixation_duration_s) FILTER (face_valid), 0), 2) AS max_compensatory_stare_duration_s,
    round_even(coalesce(avg(rppg_pulse_bpm) FILTER (face_valid AND rppg_valid), 0), 1) AS mean_rppg_pulse_bpm, round_even(coalesce(avg(rppg_hrv_rmssd_ms) FILTER (face_valid AND rppg_valid), 0), 2) AS mean_rppg_hrv_rmssd_ms, round_even(coalesce(avg(voice_impairment_score) FILTER (face_valid AND audio_valid), 0), 1) AS mean_voice_impairment_score FROM f GROUP BY 1),
s AS (SELECT * EXCLUDE (m), CASE WHEN lockout_trigger_frames >= 5 OR high_risk_intoxicated_frames / greatest(face_detected_frames, 1)::DOUBLE >= 0.10 THEN 'HIGH_RISK_INTOXICATED' WHEN mild_impairment_frames / greatest(face_detected_frames, 1)::DOUBLE >= 0.25 OR coalesce(m, 0) >= 25 THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END AS final_classification FROM a),
t AS (SELECT *, final_classification = 'HIGH_RISK_INTOXICATED' AS lockout_triggered, round_even(100 * lockout_trigger_frames / greatest(face_detected_frames, 1)::DOUBLE, 1) AS lockout_trigger_pct, round_even(100 * face_detected_frames / frames::DOUBLE, 1) AS face_detection_rate_pct FROM s)"""
SUMMARY = f"WITH {_summary} SELECT * FROM t"


def clip_report(spark, sf):
    return R.text_report(R.clip_summary(made(spark, sf), ["subject"]), ["subject"])


def _report() -> str:
    lines = []
    for title, rows in R.REPORT:
        lines += [f"'{'=' * 64}'", f"'{title}'", f"'{'=' * 64}'"]
        lines += [f"rpad('  {label}:', 34, ' ') || printf('{form}', {f'CAST({c} AS VARCHAR)' if form == '%s' else c})" for label, c, form in rows]
    return f"concat_ws(chr(10), {', '.join(lines)})"


REPORT = f"WITH {_summary} SELECT subject, {_report()} AS report FROM t"


def _clips(spark, sf):
    docs = table(spark, sf, "documents")
    status = F.when(F.col("n_chars") < 300, "REJECTED_LOW_FACE").when(F.col("n_chars") % 7 == 0, "WARNING_JUMP_CUTS").otherwise("ACCEPTED")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("clip_path"), F.col("source").alias("subject_id"), F.when(F.col("lang") == "en", "drunk").otherwise("sober").alias("label"), status.alias("status"), F.col("n_chars").alias("total_frames"), (F.col("n_chars") % 50).alias("windows_extracted"))


def audit_rows(spark, sf):
    return R.audit_rows(_clips(spark, sf))


def audit_summary(spark, sf):
    got = R.audit_summary(_clips(spark, sf))
    return got.withColumns({"n_clips": F.size("clips").cast("bigint"), "first_path": F.get("clips", 0)["clip_path"]}).drop("clips")


CLIPS = "c AS (SELECT source || '/' || doc_id AS clip_path, source AS subject_id, CASE WHEN lang = 'en' THEN 'drunk' ELSE 'sober' END AS label, CASE WHEN n_chars < 300 THEN 'REJECTED_LOW_FACE' WHEN n_chars % 7 = 0 THEN 'WARNING_JUMP_CUTS' ELSE 'ACCEPTED' END AS status, n_chars AS total_frames, n_chars % 50 AS windows_extracted FROM documents)"
AUDIT_ROWS = f"WITH {CLIPS} SELECT clip_path, subject_id, label, status, total_frames, 0.0::DOUBLE AS fps, 0.0::DOUBLE AS duration_s, 0::BIGINT AS face_detected_frames, 0.0::DOUBLE AS face_detection_rate_pct, 0::BIGINT AS valid_ungated_frames, 0.0::DOUBLE AS valid_ungated_rate_pct, 0::BIGINT AS scene_cut_count, windows_extracted, '' AS archive_file FROM c"
AUDIT_SUMMARY = f"""WITH {CLIPS}, a AS (SELECT count(*) AS total_clips, count(*) FILTER (status = 'ACCEPTED') AS accepted_clips, count(*) FILTER (status = 'WARNING_JUMP_CUTS') AS warning_jump_cut_clips, count(*) FILTER (status LIKE 'REJECTED%') AS rejected_clips,
sum(windows_extracted)::BIGINT AS total_windows, sum(windows_extracted) FILTER (label <> 'drunk')::BIGINT AS sober_windows, sum(windows_extracted) FILTER (label = 'drunk')::BIGINT AS drunk_windows, count(*) AS n_clips, min(clip_path) AS first_path FROM c)
SELECT *, round_even(sober_windows / greatest(drunk_windows, 1)::DOUBLE, 2) AS imbalance_ratio FROM a"""


def frame_projections(spark, sf):
    df = R.overridden(made(spark, sf))
    mean, apart = R.both_eyes(F.col("ear_left"), F.col("ear_right"))
    centre = R.socket_centre(F.col("a"), (0, 1, 2, 3))
    slurred, speech = R.final_slurred(F.col("voice_slurred_detected"), F.col("speech_active"), F.abs(F.get("a", 38)) / 10, F.col("yawn_detected"))
    camera = R.rescaled_camera(F.array(F.lit(900.0), F.lit(910.0), F.lit(640.0), F.lit(360.0)), F.lit(1280), F.lit(720), (640 + F.col("vec_id") % 3 * 320).cast("int"), F.lit(720), F.col("vec_id") % 2 == 0)
    audio, vector = R.audio_vector(), R.feature_vector(["saccade_latency_ms", "stare_fixation_duration_s", "mar"], ["gen_detected", "blink_detected"])
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 2)
    return df.select(
        "vec_id", r(mean).alias("ear_mean"), r(apart).alias("ear_apart"), r(centre["x"]).alias("socket_x"), r(centre["y"]).alias("socket_y"), slurred.alias("slurred"), speech.alias("speech"), r(F.get(camera, 0)).alias("fx"), r(F.get(camera, 2)).alias("cx"),
        total(audio).alias("audio"), total(vector).alias("vector"), "deliberate_blink_suppression", "compensatory_stare_active", "rigid_head_stabilization",
    )


_x, _y = "(a[1] + a[3] + a[5] + a[7]) / 4", "(a[2] + a[4] + a[6] + a[8]) / 4"
_unit = "greatest(1, (sqrt(pow(a[1] - a[3], 2) + pow(a[2] - a[4], 2)) + sqrt(pow(a[5] - a[7], 2) + pow(a[6] - a[8], 2))) / 2)"
_single = lambda *xs: " + ".join(f"CAST(CAST({x} AS FLOAT) AS DOUBLE)" for x in xs)
PROJECTIONS = f"""WITH {MADE}, n AS (SELECT *, 640 + vec_id % 3 * 320 AS w, voice_slurred_detected AND speech_active AND abs(a[39]) / 10 >= 0.010 AS slurred FROM f)
SELECT vec_id, round((ear_left + ear_right) / 2, 6) AS ear_mean, round(abs(ear_left - ear_right), 6) AS ear_apart, round({_x} / {_unit}, 6) AS socket_x, round({_y} / {_unit}, 6) AS socket_y, slurred, yawn_detected OR slurred AS speech,
round(CASE WHEN w = 1280 THEN 900 WHEN vec_id % 2 = 0 THEN 900 * (w / 1280.0::DOUBLE) ELSE w END, 6)::DOUBLE AS fx, round(CASE WHEN w = 1280 THEN 640 WHEN vec_id % 2 = 0 THEN 640 * (w / 1280.0::DOUBLE) ELSE w / 2 END, 6)::DOUBLE AS cx,
round({_single('audio_valid', 'vocal_jitter_pct', 'vocal_shimmer_pct', 'vocal_hnr_db', 'formant_f2_slope_hz_ms', 'voice_impairment_score', 'voice_slurred_detected')}, 2) AS audio,
round({_single('least(saccade_latency_ms, 10000)', 'least(stare_fixation_duration_s, 30)', 'mar', 'gen_detected', 'blink_detected')}, 2) AS vector,
deliberate_blink_suppression AND NOT sunglasses AS deliberate_blink_suppression, compensatory_stare_active AND NOT sunglasses AS compensatory_stare_active, rigid_head_stabilization AND NOT (microsleep_detected OR perclos > 0.15) AS rigid_head_stabilization FROM n"""


def face_geometry(spark, sf):
    """Faces made of vectors: a template that the numbers bend, against the last one that was a face by its box alone."""
    a = lambda i: F.get("a", i)
    df = made(spark, sf).select("vec_id", "subject", *[c.alias(n) for n, c in {
        "x0": 100 + 300 * a(40), "y0": 80 + 300 * a(41), "x1": 300 + 500 * a(42), "y1": 330 + 500 * a(43), "ex": 150 + 100 * a(44), "ey": 150 + 50 * a(45), "fx": 250 + 400 * a(46), "fy": 150 + 50 * a(47),
        "nx": 200 + 50 * a(48), "ny": 200 + 300 * a(49), "mx": 200 + 50 * a(50), "my": 260 + 300 * a(51)}.items()])
    scale = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    last = F.last(F.when(scale >= 150, scale), ignorenulls=True).over(Window.partitionBy("subject").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1))
    c = F.col
    ok = T.face_geometry((c("x0"), c("y0"), c("x1"), c("y1")), (F.lit(640.0), F.lit(480.0)), (c("ex"), c("ey"), c("fx"), c("fy")), (c("nx"), c("ny")), (c("mx"), c("my")), c("last"))
    return df.withColumn("last", last).select("vec_id", ok.alias("valid"))


GEOMETRY = f"""WITH {MADE}, p AS (SELECT vec_id, subject, 100 + 300 * a[41] AS x0, 80 + 300 * a[42] AS y0, 300 + 500 * a[43] AS x1, 330 + 500 * a[44] AS y1, 150 + 100 * a[45] AS ex, 150 + 50 * a[46] AS ey, 250 + 400 * a[47] AS fx, 150 + 50 * a[48] AS fy, 200 + 50 * a[49] AS nx, 200 + 300 * a[50] AS ny, 200 + 50 * a[51] AS mx, 260 + 300 * a[52] AS my FROM f),
s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (ex + fx) / 2 AS ix, (ey + fy) / 2 AS iy FROM p), l AS (SELECT *, sqrt(pow(mx - ix, 2) + pow(my - iy, 2)) AS len, last_value(CASE WHEN greatest(w, h) >= 150 THEN greatest(w, h) END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s),
g AS (SELECT *, ((nx - ix) * (mx - ix) + (ny - iy) * (my - iy)) / len AS along FROM l)
SELECT vec_id, w >= 10 AND h >= 10 AND (x0 + x1) / 2 BETWEEN -128 AND 768 AND (y0 + y1) / 2 BETWEEN -96 AND 576 AND w / h BETWEEN 0.38 AND 2.5 AND fx - ex > 5 AND sqrt(pow(fx - ex, 2) + pow(fy - ey, 2)) >= 0.18 * w AND my > iy AND len >= 0.22 * h AND along > 0.08 * len AND along < 0.95 * len
AND (last IS NULL OR greatest(w, h) / greatest(last, 1) BETWEEN 0.55 AND 1.8) AS valid FROM g"""


def diagnostic_card(spark, sf):
    got = temporal.temporal_score(made(spark, sf), ["vec_id"])
    return got.select("vec_id", R.diagnostic_card(F.col("total_risk"), F.col("markers")).alias("card"))


_scored = ", ".join(f"{{'s': -m_{n}, 'n': '{n}'}}" for n in temporal.LADDERS) + ", {'s': -masking_divergence_score, 'n': 'masking_divergence'}, {'s': -stupor, 'n': 'catatonic_stupor'}"
CARD = f"""WITH {MADE}, t AS (SELECT *, least(30, greatest(0, floor(total_risk / 100 * 30)))::INT AS k FROM ({temporal.as_sql('SELECT * EXCLUDE (classification), 0.30::DOUBLE AS last_open_ear FROM f', temporal.stages())}))
SELECT vec_id, concat_ws(chr(10), '[' || repeat('#', k) || repeat('-', 30 - k) || ']', CASE WHEN observed THEN nullif(array_to_string(list_transform(list_sort(list_filter([{_scored}], lambda m: m.s < 0)), lambda m: printf('%-32s %5.1f', m.n, -m.s)), chr(10)), '') END) AS card FROM t"""


def row_limits(spark, sf):
    """The first twenty rows of each subject, numbered, with the time a fixed rate gives them."""
    got = first_rows(made(spark, sf), ["subject"], ["vec_id"], 20).withColumn("at", (F.col("nth") - 1) / 30.0)
    return got.select("subject", "vec_id", "nth", r("at").alias("at"))


LIMITS = f"WITH {MADE} SELECT subject, vec_id, nth, round((nth - 1) / 30.0::DOUBLE, 6) AS at FROM (SELECT subject, vec_id, row_number() OVER (PARTITION BY subject ORDER BY vec_id)::INT AS nth FROM f) WHERE nth <= 20"


def labelled_union(spark, sf):
    """Windows of two inputs under one label each, as one table."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = docs.where("doc_id % 2 = 0").withColumn("label", F.lit("sober")).unionByName(docs.where("doc_id % 2 = 1").withColumn("label", F.lit("drunk")))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


UNION = "SELECT label, count(*) AS n, sum(n_chars)::BIGINT AS total FROM (SELECT n_chars, 'sober' AS label FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT n_chars, 'drunk' FROM documents WHERE doc_id % 2 = 1) GROUP BY 1"

QUERIES = {
    "frame_composition": (frame_composition, COMPOSITION),
    "batch_record": (batch_record, RECORD),
    "log_record": (log_record, LOG),
    "frame_baselines": (frame_baselines, BASELINES),
    "clip_summary": (clip_summary, SUMMARY),
    "clip_report": (clip_report, REPORT),
    "audit_rows": (audit_rows, AUDIT_ROWS),
    "audit_summary": (audit_summary, AUDIT_SUMMARY),
    "frame_projections": (frame_projections, PROJECTIONS),
    "diagnostic_card": (diagnostic_card, CARD),
    "face_geometry": (face_geometry, GEOMETRY),
    "row_limits": (row_limits, LIMITS),
    "labelled_union": (labelled_union, UNION),
}

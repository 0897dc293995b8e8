"""Guards and corrections per row, on ``events`` and ``embeddings``; pixel, pulse, voice and pose operators on signals made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.functions import gates as T
from kymora.functions import geometry as G
from kymora.keys import Stream
from kymora.operators import folds as X
from kymora.operators import pixels, pose, pulse, temporal, voice
from kymora.operators import windows as W
from kymora.operators.learning import augment_minority
from kymora.plans.array_queries import V, vectors
from kymora.plans.stream_queries import BASE, OVER, S, e, r, rows
from kymora.session import table


def glare_fallback(spark, sf):
    a = F.col("a")
    left, right = T.one_eye(F.abs(G.at(a, 0, 0)), F.abs(G.at(a, 0, 1)), G.at(a, 1, 0) > 0.1, G.at(a, 1, 1) > 0.1)
    return vectors(spark, sf).select("vec_id", r(left).alias("left_ear"), r(right).alias("right_ear"))


GLARE = f"""WITH {V}, g AS (SELECT *, a[3] > 0.1 AS gl, a[4] > 0.1 AS gr FROM v)
SELECT vec_id, round(CASE WHEN gl AND NOT gr THEN abs(a[2]) ELSE abs(a[1]) END, 6) AS left_ear, round(CASE WHEN gr AND NOT gl THEN abs(a[1]) ELSE abs(a[2]) END, 6) AS right_ear FROM g"""


def shutter_correction(spark, sf):
    a = F.col("a")
    got = T.shutter_corrected(F.abs(G.at(a, 0, 0)), 1 + G.at(a, 0, 1), F.lit(1.0), F.abs(G.at(a, 1, 0)) * 3, G.at(a, 1, 1) * 10)
    return vectors(spark, sf).select("vec_id", r(got).alias("ear"), T.foreshortened(F.abs(G.at(a, 2, 0)) * 2, F.abs(G.at(a, 2, 1)) * 2, G.at(a, 3, 0) * 100, 0.21).alias("foreshortened"))


SHUTTER = f"""WITH {V}, s AS (SELECT *, greatest(0.85, least(1.15, 1 + a[2])) AS st FROM v)
SELECT vec_id, round(CASE WHEN abs(a[3]) * 3 > 0.25 AND abs(a[4] * 10) < 2.5 AND abs(st - 1) > 0.015 THEN abs(a[1]) / st ELSE abs(a[1]) END, 6) AS ear,
abs(a[7] * 100) > 10 AND greatest(abs(a[5]), abs(a[6])) * 2 >= greatest(0.26, 0.273) AND abs(abs(a[5]) * 2 - abs(a[6]) * 2) > 0.09 AS foreshortened FROM s"""


def brow_and_face(spark, sf):
    a = F.col("a")
    brow = T.brow_ratio(10 + G.at(a, 0, 0), 2 + G.at(a, 0, 1) * 5, F.abs(G.at(a, 1, 0)), G.at(a, 1, 1) * 200)
    ok = T.face_is_plausible(1 + G.at(a, 2, 0), 1 + G.at(a, 2, 1), G.at(a, 3, 0) < 0.2, G.at(a, 3, 1), G.at(a, 3, 1) - 0.1, G.at(a, 4, 0), F.abs(G.at(a, 4, 1)) + 0.1, F.lit(0.2))
    return vectors(spark, sf).select("vec_id", r(brow, 5).alias("brow"), ok.alias("plausible"))


BROW = f"""WITH {V} SELECT vec_id, round(CASE WHEN abs(a[3]) >= 1e-4 AND 2 + a[2] * 5 > 1 THEN (10 + a[1] - (2 + a[2] * 5)) / abs(a[3]) * (1 + 0.006 * greatest(-20, least(20, a[4] * 200))) END, 5) AS brow,
(1 + a[5]) / (1 + a[6]) BETWEEN 0.38 AND 2.5 AND a[7] < 0.2 AND a[8] > a[8] - 0.1 AND a[8] < a[9] AND (abs(a[10]) + 0.1) / 0.2 BETWEEN 0.55 AND 1.8 AS plausible FROM v"""


def gate_resume(spark, sf):
    """Derivatives start anew after a gated run: the first valid row is 0."""
    df = e(spark, sf).withColumn("gated", F.col("kind") == "error")
    was = F.lag("gated", 1, True).over(S.plain())
    step = F.when(F.col("gated") | was, 0.0).otherwise(F.col("x") - F.lag("x").over(S.plain()))
    return df.select("event_id", r(step).alias("step"))


RESUME = f"WITH {BASE}, g AS (SELECT *, kind = 'error' AS g FROM e) SELECT event_id, round(CASE WHEN g OR lag(g, 1, true) OVER {OVER} THEN 0 ELSE x - lag(x) OVER {OVER} END, 6) AS step FROM g"


def lip_gate(spark, sf):
    df = e(spark, sf).withColumn("spread", F.stddev_pop("x").over(S.rows(-14)))
    df = df.withColumn("moving", (F.col("kind") == "purchase") | (F.col("x") > 150) | (F.col("spread") > 70))
    df = W.suppressed_for(df, S, F.col("moving"), "since")
    seen = W.last_known(F.when(F.col("moving"), True), S.rows())
    return df.withColumn("ever", seen).select("event_id", (F.col("ever").isNotNull() & (F.col("since") <= 36 * 3600)).alias("open"))


LIP = f"""WITH {BASE}, m AS (SELECT *, kind = 'purchase' OR x > 150 OR stddev_pop(x) OVER {rows(14)} > 70 AS moving FROM e), t AS (SELECT *, last_value(CASE WHEN moving THEN us END IGNORE NULLS) OVER {rows(-1)} AS since_us FROM m)
SELECT event_id, coalesce((us - since_us) / 1e6 <= 129600, false) AS open FROM t"""


def voice_gate(spark, sf):
    a = F.col("a")
    n = F.floor(F.abs(G.at(a, 0, 0)) * 40).cast("int")
    ok = T.voice_activity(F.abs(G.at(a, 0, 1)) / 20, F.abs(G.at(a, 1, 0)) / 5, F.abs(G.at(a, 1, 1)) / 5, n, F.floor(n * 0.6))
    return vectors(spark, sf).select("vec_id", ok.alias("voice"))


VOICE_GATE = f"""WITH {V}, n AS (SELECT *, floor(abs(a[1]) * 40)::INT AS n FROM v)
SELECT vec_id, abs(a[2]) / 20 >= 0.0012 AND abs(a[3]) / 5 >= 0.008 AND abs(a[4]) / 5 >= 0.008 AND n >= 3 AND floor(n * 0.6::DOUBLE) >= 5 AND floor(n * 0.6::DOUBLE) / greatest(n, 1) >= 0.25 AS voice FROM n"""


def alert_guards(spark, sf):
    a = F.col("a")
    guarded = T.alert_gaze(F.abs(G.at(a, 0, 0)) * 4, F.abs(G.at(a, 0, 1)), F.abs(G.at(a, 1, 0)), G.at(a, 1, 1) > 0.3, G.at(a, 2, 0) > 0.3, F.col("vec_id") % 50 == 0)
    risk = F.abs(G.at(a, 2, 1)) * 300
    return vectors(spark, sf).select("vec_id", guarded.alias("alert"), r(T.capped_risk(risk, F.abs(G.at(a, 3, 0)) * 200, guarded)).alias("risk"), T.reflex_suppressed(F.abs(G.at(a, 3, 1)) * 60, F.abs(G.at(a, 4, 0)) * 100).alias("suppressed"))


ALERT = f"""WITH {V}, g AS (SELECT *, abs(a[1]) * 4 >= 0.26 AND abs(a[2]) < 0.10 AND abs(a[3]) >= 0.024 AND NOT a[4] > 0.3 AND NOT a[5] > 0.3 AND NOT vec_id % 50 = 0 AS al FROM v)
SELECT vec_id, al AS alert, round(CASE WHEN al AND abs(a[7]) * 200 < 25 THEN least(abs(a[6]) * 300, 22) ELSE abs(a[6]) * 300 END, 6) AS risk, abs(a[8]) * 60 > 10 OR abs(a[9]) * 100 > 25 AS suppressed FROM g"""


#: Frames made of vectors: the n-th number's size, or which ids have a flag.
_SIZES = {"ear_avg": (0, 2.0, 0.1), "mar": (1, 2.0, 0.0), "perclos": (2, 1.2, 0.0), "gaze_yaw_dispersion": (3, 0.4, 0.0), "stare_fixation_duration_s": (4, 50.0, 0.0), "head_postural_sway": (5, 12.0, 0.0), "pursuit_fragmentation_ratio": (7, 1.6, 0.0), "eyelid_tremor_hz": (8, 30.0, 0.0), "eyeball_tremor_hz": (9, 30.0, 0.0), "flushing_delta": (10, 1.5, 0.0), "rppg_hrv_rmssd_ms": (11, 200.0, 0.0), "masking_divergence_score": (12, 400.0, 0.0), "voice_impairment_score": (13, 500.0, 0.0), "vor_gain": (15, -2.0, 1.0)}
_FLAGS = {"imu_gated": 23, "flushing_valid": 3, "rppg_valid": 2, "gen_detected": 7, "lack_of_convergence": 11, "microsleep_detected": 13, "deliberate_blink_suppression": 4, "compensatory_stare_active": 5, "rigid_head_stabilization": 6, "frontalis_compensation_active": 8, "masking_detected": 9, "voluntary_eye_widening": 10, "highway_fixation_exempt": 12, "speech_active": 14, "yawn_detected": 15, "audio_valid": 2, "voice_slurred_detected": 4}


def frame_columns(at) -> dict[str, str]:
    """Frame columns as SQL over (vec_id, a); ``at`` writes the n-th number, from 0."""
    out = {n: f"{x} + abs({at(i)}) * {k}" for n, (i, k, x) in _SIZES.items()} | {n: f"vec_id % {m} = 1" for n, m in _FLAGS.items()}
    out["blink_opening_velocity"] = f"CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE abs({at(6)}) * 16.0 END"
    out["ml_probability"] = f"CASE WHEN vec_id % 3 > 0 THEN least(1.0, abs({at(14)}) * 5.0) END"
    return out | {"blink_phase": "CASE WHEN vec_id % 4 = 2 THEN 'closing' ELSE 'open' END", "face_valid": "vec_id % 19 <> 0"}


def temporal_risk(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("subject"), F.col("embedding").cast("array<double>").alias("a"))
    df = df.withColumns({n: F.expr(temporal.doubles(x)) for n, x in frame_columns(lambda i: f"a[{i}]").items()})
    got = temporal.temporal_score(temporal.with_open_ear(df, Stream(("subject",), "vec_id", None)), ["vec_id"], ingress=True)
    return got.select("vec_id", "classification", r("total_risk").alias("total_risk"), r("involuntary").alias("involuntary"), r("voluntary").alias("voluntary"), "lockout", "throttle", "active_markers")


_made = ", ".join(f"{temporal.doubles(x)} AS {n}" for n, x in frame_columns(lambda i: f"a[{i + 1}]").items())
_held = "coalesce(last_value(CASE WHEN blink_phase = 'open' AND ear_avg >= 0.22 AND face_valid AND NOT imu_gated THEN ear_avg END IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 0.30) AS last_open_ear"
TEMPORAL = f"""WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), f AS (SELECT vec_id, label, {_made} FROM d)
SELECT vec_id, classification, round(total_risk, 6) AS total_risk, round(involuntary, 6) AS involuntary, round(voluntary, 6) AS voluntary, lockout, throttle, active_markers
FROM ({temporal.as_sql(f"SELECT *, {_held} FROM f", temporal.stages(ingress=True))})"""


def model_alignment(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return df.select("l_orderkey", "l_linenumber", *T.in_model_order(df.columns, ["l_tax", "l_absent", "l_quantity"])).groupBy("l_linenumber").agg(r(F.sum("l_tax"), 4).alias("l_tax"), r(F.sum("l_absent")).alias("l_absent"), r(F.sum("l_quantity"), 4).alias("l_quantity"))


ALIGNMENT = "SELECT l_linenumber, round(sum(l_tax), 4) AS l_tax, 0.0::DOUBLE AS l_absent, round(sum(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1"


def source_kind(spark, sf):
    df = e(spark, sf).withColumn("name", F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(F.concat(F.col("kind"), F.lit(".mp4"))))
    return df.select("event_id", T.source_kind(F.col("name"), F.col("k") % 4).alias("source_kind"))


KIND = f"""WITH {BASE}, n AS (SELECT *, CASE WHEN k % 3 = 0 THEN ' ' || k ELSE kind || '.mp4' END AS name FROM e)
SELECT event_id, CASE WHEN regexp_matches(name, '^\\s*\\d+\\s*$') THEN 'camera' WHEN k % 4 <= 1 THEN 'gray' ELSE 'video' END AS source_kind FROM n"""


def muted_failover(spark, sf):
    """A device is left once it has been silent for two days: the number of the device in a ring of three."""
    df = W.suppressed_for(e(spark, sf), S, F.col("x") >= 15, "silent").withColumn("muted", F.col("silent") >= 2 * 86400)
    df = df.withColumn("switch", F.col("muted") & ~F.lag("muted", 1, False).over(S.plain()))
    return df.withColumn("n", F.sum(F.col("switch").cast("int")).over(S.rows())).select("event_id", "muted", (F.col("n") % 3).cast("int").alias("device"))


MUTED = f"""WITH {BASE}, s AS (SELECT *, (us - coalesce(last_value(CASE WHEN x >= 15 THEN us END IGNORE NULLS) OVER {rows(-1)}, min(us) OVER (PARTITION BY user_id))) / 1e6 >= 172800 AS muted FROM e),
w AS (SELECT *, muted AND NOT lag(muted, 1, false) OVER {OVER} AS sw FROM s) SELECT event_id, muted, (sum(sw::INT) OVER {rows(-1)} % 3)::INT AS device FROM w"""


def telemetry_injection(spark, sf):
    """A device's value, where one came since the row before, stands for the computed one."""
    df = e(spark, sf).withColumn("pushed", F.when(F.col("kind") == "signup", F.col("k").cast("double")))
    before = F.lag("pushed").over(S.plain())
    return df.select("event_id", F.coalesce(before, F.col("x")).alias("jitter"), before.isNotNull().alias("injected"))


INJECTION = f"WITH {BASE}, p AS (SELECT *, CASE WHEN kind = 'signup' THEN k::DOUBLE END AS p FROM e) SELECT event_id, coalesce(lag(p) OVER {OVER}, x) AS jitter, lag(p) OVER {OVER} IS NOT NULL AS injected FROM p"


def last_open_hold(spark, sf):
    open_ = (F.col("kind") != "error") & (F.col("x") >= 22)
    held = W.last_known(F.when(open_, F.col("x")), S.rows())
    return e(spark, sf).select("event_id", F.when(F.col("kind") == "error", F.coalesce(held, F.col("x"))).otherwise(F.col("x")).alias("x"))


OPEN_HOLD = f"WITH {BASE} SELECT event_id, CASE WHEN kind = 'error' THEN coalesce(last_value(CASE WHEN kind <> 'error' AND x >= 22 THEN x END IGNORE NULLS) OVER {rows(-1)}, x) ELSE x END AS x FROM e"


def calibration_progress(spark, sf):
    n = F.count(F.when(F.col("kind") != "error", 1)).over(S.rows())
    lasted = (F.col("us") - F.min("us").over(S.whole())) / float(10 * 86_400_000_000)
    return e(spark, sf).select("event_id", r(F.least(F.lit(1.0), lasted, n / 30.0)).alias("progress"))


PROGRESS = f"WITH {BASE} SELECT event_id, round(least(1.0::DOUBLE, (us - min(us) OVER (PARTITION BY user_id)) / 864000000000.0::DOUBLE, count(CASE WHEN kind <> 'error' THEN 1 END) OVER {rows(-1)} / 30.0::DOUBLE), 6) AS progress FROM e"


def pursuit_band(spark, sf):
    """Share of catch-up moves in a speed band among the moves of the last five days."""
    from kymora.keys import DAY

    df = e(spark, sf).withColumn("v", F.abs(F.col("x") - F.lag("x").over(S.plain())))
    flag = F.coalesce((F.col("v") > 4) & (F.col("v") < 45), F.lit(False))
    return W.fragmentation(df, S, flag, 5 * DAY, 5, "ratio").select("event_id", r("ratio").alias("ratio"))


PURSUIT = f"""WITH {BASE}, v AS (SELECT *, abs(x - lag(x) OVER {OVER}) AS v FROM e), f AS (SELECT *, coalesce(v > 4 AND v < 45, false)::INT AS f FROM v)
SELECT event_id, round(CASE WHEN count(*) OVER w >= 5 THEN avg(f) OVER w ELSE 0 END, 6) AS ratio FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW)"""


def peak_position(spark, sf):
    """Place of the first largest value of each waveform."""
    return vectors(spark, sf).select("vec_id", (F.array_position("a", F.array_max("a")) - 1).cast("int").alias("peak"), r(F.array_max("a")).alias("height"))


PEAK = f"WITH {V} SELECT vec_id, (list_position(a, list_max(a)) - 1)::INT AS peak, round(list_max(a), 6) AS height FROM v"


def channel_difference(spark, sf):
    """Set operations on channel names: those a row lacks, those it shares, all of both."""
    have = F.array_distinct(F.transform(F.slice("a", 1, 12), lambda v: F.concat(F.lit("c"), F.floor(F.abs(v) * 30).cast("string"))))
    want = F.array(*[F.lit(f"c{i}") for i in range(6)])
    return vectors(spark, sf).select("vec_id", F.array_join(F.array_sort(F.array_except(want, have)), ",").alias("absent"), F.array_join(F.array_sort(F.array_intersect(want, have)), ",").alias("shared"), F.size(F.array_union(want, have)).alias("n"))


CHANNELS = f"""WITH {V}, h AS (SELECT vec_id, list_distinct(list_transform(a[1:12], lambda v: 'c' || floor(abs(v) * 30)::INT)) AS h, ['c0', 'c1', 'c2', 'c3', 'c4', 'c5'] AS w FROM v)
SELECT vec_id, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(h, x))), ',') AS absent, array_to_string(list_sort(list_filter(w, lambda x: list_contains(h, x))), ',') AS shared, len(list_distinct(list_concat(w, h)))::INT AS n FROM h"""


def lighting_measures(spark, sf):
    """Pages as gray pictures 64 pixels wide: a picture is whatever bytes there are."""
    raw = F.rpad(F.coalesce("html", F.lit("")), 64, " ").cast("binary")
    df = table(spark, sf, "pages").select(F.col("page_id").alias("frame_id"), raw.alias("raw")).withColumn("height", F.floor(F.octet_length("raw") / 64).cast("int"))
    return pixels.frame_measures(df.select("frame_id", "height", F.lit(64).alias("width"), F.lit(1).alias("channels"), F.expr("substring(raw, 1, height * 64)").alias("data")), ["frame_id"])


def rppg_fft(spark, sf):
    """Pulses made of vectors: each has a rate of its own and a slow drift."""
    df = vectors(spark, sf).select("vec_id", (0.9 + F.abs(F.get("a", 0)) * 3).alias("hz")).withColumn("ts", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: i / 30.0))
    df = df.withColumn("values", F.transform("ts", lambda s: 0.4 + 0.01 * F.sin(2 * 3.141592653589793 * F.col("hz") * s) + 0.002 * s))
    return pulse.pulses(df, ["vec_id", "hz"])


def voice_features(spark, sf):
    """Voices made of vectors: three harmonics of a pitch, 0.4 seconds at 16 kHz."""
    df = vectors(spark, sf).withColumns({"hz": 100 + 400 * F.abs(F.get("a", 0)), "lips": F.col("vec_id") % 4 > 0})
    wave = F.transform(F.sequence(F.lit(0), F.lit(6399)), lambda i: sum(0.2 / k * F.sin(2 * 3.141592653589793 * k * F.col("hz") * (i / 16000.0)) for k in (1, 2, 3)))
    got = voice.voice_features(df.withColumn("samples", wave), ["vec_id", "hz"], "samples", "lips")
    return got.select("vec_id", *[r(c, 4).alias(c) for c in ("jitter", "shimmer", "hnr", "slope", "score")], "slurred", "voiced", "valid")


def bandpass_filter(spark, sf):
    return pulse.bandpassed(vectors(spark, sf), "a", 16_000.0).select("vec_id", r(F.aggregate("a", F.lit(0.0), lambda s, v: s + v * v), 8).alias("energy"))


def _posed(batches):
    import numpy as np
    import pandas as pd

    for df in batches:
        truth = [np.array([0.3 * a[0], a[1], 0.2 * a[2], 50 * a[3], 50 * a[4], 600 + 200 * abs(a[5])]) for a in df["a"]]
        points = [pose.project(t, 900.0, (640.0, 360.0)).ravel().tolist() for t in truth]
        yield pd.DataFrame({"subject": df["subject"], "us": df["vec_id"], "points": points})


def pose_solve(spark, sf):
    """Heads posed as vectors say, seen by a camera, and solved for again."""
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("subject"), F.col("embedding").cast("array<double>").alias("a"))
    seen = df.mapInPandas(_posed, "subject int, us long, points array<double>")
    return X.fold(seen, Stream(("subject",), tie=None), pose.tracker(900.0, (640.0, 360.0)), ["points"], ["subject", "us"])


def noise_augmentation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), (F.col("doc_id") % 2).cast("double").alias("even"))
    df = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return augment_minority(df, "toxic", ["size", "even"], "doc_id").groupBy("toxic", "synthetic").count()


def synthetic_sessions(spark, sf):
    """A made-up labelled set: a subject per nation, 24 windows each; odd ones sway, blink slowly, beat and fragment."""
    at = F.explode(F.sequence(F.lit(0), F.lit(24 * 90 - 1)))
    df = table(spark, sf, "nation").select(F.col("n_nationkey").alias("subject"), at.alias("i")).withColumns({"window": (F.col("i") / 90).cast("int"), "pos": F.col("i") % 90, "bad": F.col("subject") % 2})
    # Noise follows from the row, so it is the same however the rows lie.
    noise = lambda seed: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("subject", "i", F.lit(seed)), F.lit(1 << 20)) + 1) / (1 << 20))) * F.cos(6.283185307179586 * F.pmod(F.xxhash64("subject", "i", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20))
    ear = F.when((F.col("pos") % (45 + 15 * F.col("bad"))) < 4 + 6 * F.col("bad"), 0.12).otherwise(0.30) + 0.01 * noise(42)
    df = df.withColumns({"ear": ear, "sway": (0.2 + 1.4 * F.col("bad")) * noise(52), "upstroke": 3.0 - 1.8 * F.col("bad") + 0.2 * noise(62), "gen": (F.col("bad") == 1) & (F.abs(noise(72)) > 1.5), "pursuit": 0.08 + 0.25 * F.col("bad") + 0.03 * noise(82)})
    means = [F.avg("ear").alias("ear_mean"), F.stddev_pop("sway").alias("sway_std"), F.avg("upstroke").alias("upstroke_mean"), F.avg(F.col("gen").cast("int")).alias("gen_rate"), F.avg("pursuit").alias("pursuit_mean")]
    return df.groupBy("subject", "window", F.col("bad").alias("label")).agg(*means)


QUERIES = {
    "glare_fallback": (glare_fallback, GLARE),
    "shutter_correction": (shutter_correction, SHUTTER),
    "brow_and_face": (brow_and_face, BROW),
    "gate_resume": (gate_resume, RESUME),
    "lip_gate": (lip_gate, LIP),
    "voice_gate": (voice_gate, VOICE_GATE),
    "alert_guards": (alert_guards, ALERT),
    "temporal_risk": (temporal_risk, TEMPORAL),
    "model_alignment": (model_alignment, ALIGNMENT),
    "source_kind": (source_kind, KIND),
    "muted_failover": (muted_failover, MUTED),
    "telemetry_injection": (telemetry_injection, INJECTION),
    "last_open_hold": (last_open_hold, OPEN_HOLD),
    "calibration_progress": (calibration_progress, PROGRESS),
    "pursuit_band": (pursuit_band, PURSUIT),
    "peak_position": (peak_position, PEAK),
    "channel_difference": (channel_difference, CHANNELS),
    "lighting_measures": (lighting_measures, None),
    "rppg_fft": (rppg_fft, None),
    "voice_features": (voice_features, None),
    "bandpass_filter": (bandpass_filter, None),
    "pose_solve": (pose_solve, None),
    "noise_augmentation": (noise_augmentation, None),
    "synthetic_sessions": (synthetic_sessions, None),
}

"""State machines over ``events``, streams, and learning on documents with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.keys import HOUR, Stream, frames
from kymora.operators import filters
from kymora.operators import folds as X
from kymora.operators.learning import out_of_fold
from kymora.plans.stream_queries import BASE, OVER, S, e, r
from kymora.session import table

#: Gaps of the stand-in are hours: machines see their time divided by this, so that an hour is a tenth of a second.
SLOW = 36_000


def ema_fold(spark, sf):
    return X.fold(e(spark, sf), S, X.ema(0.35), ["x"], ["event_id"])


_NUMBERED = f"{BASE}, n AS (SELECT *, row_number() OVER {OVER} AS rn FROM e)"
EMA = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, x AS y FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, 0.35::DOUBLE * n.x + 0.65::DOUBLE * f.y FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, y AS ema FROM f"""


def sprt_latch(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "risk": F.least(F.lit(100.0), F.col("x") / 2), "seen": F.col("kind") != "error", "hard": F.col("kind") == "click", "parked": F.lit(False)})
    got = X.fold(df, S, X.evidence(), ["us", "risk", "seen", "hard", "parked"], ["event_id"])
    return got.select("event_id", r("log_odds").alias("log_odds"), r("sustained").alias("sustained"), "latched")


_SIG = "1 / (1 + exp(-greatest(-20, least(20, {}))))"
SPRT = f"""WITH RECURSIVE {_NUMBERED}, m AS (SELECT *, CAST(us / {SLOW}::DOUBLE AS DOUBLE) AS tt, least(100.0::DOUBLE, x / 2) AS risk, kind <> 'error' AS seen, kind = 'click' AS hard, ln(0.01::DOUBLE / 0.99::DOUBLE) AS prior FROM n),
q AS (SELECT *, trunc(tt) AS u FROM m),
f AS (
    SELECT user_id, rn, event_id, u, l AS odds, CASE WHEN NOT seen THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS timer, false AS latched
    FROM (SELECT *, CASE WHEN NOT seen THEN prior ELSE greatest(prior - 1, least(12, prior + 0.033::DOUBLE * CASE WHEN risk >= 50 THEN 1 + 1.5 * (risk - 50) / 50 WHEN risk >= 30 THEN 0.2 + 0.6 * (risk - 30) / 20 WHEN risk < 12 THEN -1.25 ELSE -0.40 END)) END AS l FROM q WHERE rn = 1)
    UNION ALL
    SELECT user_id, rn, event_id, u, o2, CASE WHEN l2 THEN greatest(15.0::DOUBLE, t2) ELSE t2 END, l2 FROM (
        SELECT *, latched OR (seen AND t2 >= 15) AS l2 FROM (
            SELECT *, CASE WHEN NOT seen THEN CASE WHEN latched THEN timer ELSE greatest(0, timer - 0.5 * least(greatest(dt, 0), 1)) END WHEN {_SIG.format('o2')} >= 0.999 THEN timer + d2 ELSE greatest(0, timer - 2 * d2) END AS t2 FROM (
                SELECT *, CASE WHEN NOT seen THEN odds ELSE greatest(prior - 1, least(12, odds + d2 * CASE WHEN llr > 0 AND NOT hard AND risk < 48 AND {_SIG.format('odds')} > 0.20 THEN 0 ELSE llr END)) END AS o2 FROM (
                    SELECT q.*, f.odds, f.timer, f.latched, (q.u - f.u) / 1e6 AS dt, CASE WHEN q.u - f.u <= 0 THEN 1e-4 ELSE least((q.u - f.u) / 1e6, 0.25) END AS d2,
                        CASE WHEN risk >= 50 THEN 1 + 1.5 * (risk - 50) / 50 WHEN risk >= 30 THEN 0.2 + 0.6 * (risk - 30) / 20 WHEN risk < 12 THEN -1.25 ELSE -0.40 END AS llr
                    FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))))
SELECT event_id, round(odds, 6) AS log_odds, round(timer, 6) AS sustained, latched FROM f"""


def debounced_command(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "raw": F.when(F.col("x") > 250, 2).when(F.col("x") > 60, 1).otherwise(0), "high": F.col("x") > 120, "unknown": F.col("kind") == "error"})
    return X.fold(df, S, X.debounce(), ["us", "raw", "high", "unknown"], ["event_id"])


def _debounce(s: str, a: str, g: str) -> str:
    """Columns (since, active, gate, command) of the next state from those of the last."""
    gate = f"coalesce({g}, us)"
    held, since = f"us - {gate} <= 1000000", f"coalesce({s}, us)"
    active = f"({a} OR us - {since} >= CASE WHEN high THEN 500000 ELSE 1500000 END)"
    return f"""CASE WHEN raw = 2 THEN NULL WHEN unknown THEN CASE WHEN {held} THEN {s} END WHEN raw = 1 THEN {since} END AS since,
        CASE WHEN raw = 2 THEN false WHEN unknown THEN {held} AND {a} WHEN raw = 1 THEN {active} ELSE false END AS active,
        CASE WHEN raw <> 2 AND unknown THEN {gate} END AS gate,
        CASE WHEN raw = 2 THEN 2 WHEN unknown THEN CASE WHEN {held} AND {a} THEN 1 ELSE 0 END WHEN raw = 1 THEN CASE WHEN {active} THEN 1 ELSE 0 END ELSE 0 END AS command"""


DEBOUNCE = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, trunc(us / {SLOW}::DOUBLE)::BIGINT AS us, CASE WHEN x > 250 THEN 2 WHEN x > 60 THEN 1 ELSE 0 END AS raw, x > 120 AS high, kind = 'error' AS unknown FROM n),
f AS (SELECT user_id, rn, event_id, {_debounce('NULL::BIGINT', 'false', 'NULL::BIGINT')} FROM q WHERE rn = 1
UNION ALL SELECT q.user_id, q.rn, q.event_id, {_debounce('f.since', 'f.active', 'f.gate')} FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)
SELECT event_id, command::INT AS command FROM f"""


def change_only_sink(spark, sf):
    from kymora.streaming.processors import change_only

    df = e(spark, sf).withColumn("command", F.when(F.col("x") > 120, 2).when(F.col("x") > 60, 1).otherwise(0))
    return change_only(df, S, "command", 48 * HOUR).select("event_id", "command")


CHANGE = f"""WITH {BASE}, c AS (SELECT *, CASE WHEN x > 120 THEN 2 WHEN x > 60 THEN 1 ELSE 0 END AS command FROM e), d AS (SELECT *, coalesce(command <> lag(command) OVER {OVER}, true) AS ch FROM c),
a AS (SELECT *, last_value(CASE WHEN ch THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS start FROM d), g AS (SELECT *, (us - start) // {48 * HOUR} AS cell FROM a)
SELECT event_id, command FROM (SELECT *, lag(cell) OVER {OVER} AS pc FROM g) WHERE ch OR coalesce(cell <> pc, true)"""


def shock_gate(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW / 20).cast("bigint"), "x": F.when(F.col("kind") != "error", F.col("x") / 20), "y": F.col("k") / 50.0, "z": F.lit(600.0), "pitch": F.lit(0.0), "yaw": F.col("k") / 60.0, "roll": F.lit(0.0)})
    return X.fold(df, S, X.shock_gate(), ["us", "x", "y", "z", "pitch", "yaw", "roll"], ["event_id"])


def one_euro(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "scale": F.lit(60.0), "shake": F.col("k") / 120.0})
    return X.fold(df, S, X.one_euro(structural=True), ["us", "x", "scale", "shake"], ["event_id"]).select("event_id", r("filtered", 5).alias("filtered"))


#: The 32 points of a vector as a face.
FACE = filters.Layout(skull=(0, 1, 2, 3), right_corners=(4, 5), left_corners=(6, 7), right_eye=(8, 9, 10, 11, 12), left_eye=(13, 14, 15, 16, 17), eyelid=(8, 9, 13, 14), iris=(10, 11, 15, 16))


def one_euro_bank(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("subject"), (F.col("vec_id") * 33_000).alias("us"), F.transform("embedding", lambda v: v.cast("double") * 200).alias("points"), (F.col("vec_id") % 10 / 10.0).alias("shake"))
    return X.fold(df, Stream(("subject",), "us", None), filters.filter_bank(FACE, 32), ["us", "points", "shake"], ["vec_id"])


def brow_baseline(spark, sf):
    df = e(spark, sf).withColumns({"ratio": 0.2 + F.col("x") / 1000, "ear": F.col("k") / 200.0})
    got = X.fold(df, S, X.brow(), ["ratio", "ear"], ["event_id"])
    return got.select("event_id", r("smooth").alias("smooth"), r("rise").alias("rise"), "raised")


BROW = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, 0.2::DOUBLE + x / 1000 AS x, k / 200.0::DOUBLE AS ear FROM n),
f AS (SELECT user_id, rn, event_id, x AS smooth, NULL::DOUBLE AS base, [x] AS seen FROM q WHERE rn = 1 UNION ALL
SELECT q.user_id, q.rn, q.event_id, 0.80::DOUBLE * f.smooth + 0.20::DOUBLE * q.x, CASE WHEN f.base IS NULL THEN CASE WHEN len(f.seen) = 14 THEN list_median(list_append(f.seen, q.x)) END
    WHEN q.ear >= 0.21 AND (q.x - f.base) / greatest(0.1, abs(f.base)) < 0.10 THEN (1 - CASE WHEN q.rn <= 25 THEN 0.15::DOUBLE ELSE 0.005::DOUBLE END) * f.base + CASE WHEN q.rn <= 25 THEN 0.15::DOUBLE ELSE 0.005::DOUBLE END * q.x ELSE f.base END,
    CASE WHEN len(f.seen) < 15 THEN list_append(f.seen, q.x) ELSE f.seen END
FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)
SELECT event_id, round(smooth, 6) AS smooth, round(CASE WHEN base IS NULL THEN 0 ELSE (smooth - base) / greatest(0.1, abs(base)) END, 6) AS rise, coalesce((smooth - base) / greatest(0.1, abs(base)) >= 0.12, false) AS raised FROM f"""


def fixation_stare(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW * 10).cast("bigint"), "gx": F.col("x") / 200, "gy": F.col("k") / 100, "broken": F.col("kind") == "error", "up": F.col("x") / 50})
    got = X.fold(df, S, X.stare(), ["us", "gx", "gy", "broken", "up"], ["event_id"])
    return got.select("event_id", r("duration").alias("duration"), "rigid", "excused")


_far = "sqrt(pow(q.gx - f.ax, 2) + pow(q.gy - f.ay, 2)) > 2.5"
STARE = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, trunc(us / {SLOW}::DOUBLE * 10) AS u, x / 200 AS gx, k / 100.0::DOUBLE AS gy, kind = 'error' AS broken, x / 50 AS up FROM n),
f AS (SELECT user_id, rn, event_id, u AS start, gx AS ax, gy AS ay, [gx] AS xs, [gy] AS ys, 0.0::DOUBLE AS duration, up FROM q WHERE rn = 1 UNION ALL
SELECT user_id, rn, event_id, CASE WHEN cut THEN u ELSE start END, CASE WHEN cut THEN gx ELSE ax END, CASE WHEN cut THEN gy ELSE ay END, CASE WHEN cut THEN [gx] ELSE list_append(xs, gx)[-300:] END, CASE WHEN cut THEN [gy] ELSE list_append(ys, gy)[-300:] END, CASE WHEN cut THEN 0 ELSE (u - start) / 1e6 END, up
FROM (SELECT q.*, f.start, f.ax, f.ay, f.xs, f.ys, q.broken OR {_far} AS cut FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)),
g AS (SELECT *, CASE WHEN duration >= 6 AND len(xs) >= 15 THEN sqrt(list_aggregate(xs, 'var_pop') + list_aggregate(ys, 'var_pop')) END AS spread FROM f)
SELECT event_id, round(duration, 6) AS duration, coalesce(spread < 0.8 AND NOT (spread >= 0.15 AND up >= 1.8), false) AS rigid, coalesce(spread >= 0.15 AND spread < 0.8 AND up >= 1.8, false) AS excused FROM g"""


def saccade_dynamics(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "gx": F.col("x") / 300, "gy": F.col("k") / 400.0})
    df = df.withColumns({"left": F.col("gx") + F.col("k") / 900.0, "right": F.col("gx") - F.col("k") / 900.0, "closed": F.col("kind") == "error", "head": F.col("k") / 4.0, "socket": F.col("x") / 200, "shake": F.col("k") / 150.0, "yaw": F.col("k") / 4.0})
    got = X.fold(df, S, X.saccade(), ["us", "gx", "gy", "left", "right", "closed", "head", "socket", "shake", "yaw"], ["event_id"])
    return got.select("event_id", r("speed").alias("speed"), "jumping", r("latency_ms", 3).alias("latency_ms"))


_wide = "(CASE WHEN shake > 0.2 THEN 1 + 1.2::DOUBLE * shake ELSE 1 END)"
SACCADE = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, trunc(us / {SLOW}::DOUBLE) AS u, x / 300 AS gx, k / 400.0::DOUBLE AS gy, x / 300 + k / 900.0::DOUBLE AS l, x / 300 - k / 900.0::DOUBLE AS r, kind = 'error' AS closed, k / 4.0::DOUBLE AS head, x / 200 AS socket, k / 150.0::DOUBLE AS shake, k / 4.0::DOUBLE AS yaw FROM n),
f AS (SELECT user_id, rn, event_id, u, gx, gy, l, r, false AS jumping, NULL::DOUBLE AS ended, false AS blinked, 0.0::DOUBLE AS speed, 0.0::DOUBLE AS latency FROM q WHERE rn = 1 UNION ALL
SELECT user_id, rn, event_id, CASE WHEN dt <= 1e-6 THEN pu ELSE u END, CASE WHEN dt <= 1e-6 THEN px ELSE gx END, CASE WHEN dt <= 1e-6 THEN py ELSE gy END, CASE WHEN dt <= 1e-6 THEN pl ELSE l END, CASE WHEN dt <= 1e-6 THEN pr ELSE r END,
    j2, e2, CASE WHEN dt <= 1e-6 THEN blinked WHEN dt > 0.5 THEN blinked WHEN closed THEN true ELSE false END, v,
    CASE WHEN dt <= 1e-6 OR dt > 0.5 OR j2 OR e2 IS NULL THEN 0 ELSE (u / 1e6 - e2) * 1000 END
FROM (SELECT *, CASE WHEN dt <= 1e-6 THEN jumping WHEN dt > 0.5 OR closed OR blinked THEN false WHEN jumping THEN NOT v < 20 ELSE v > 35 END AS j2,
        CASE WHEN dt > 1e-6 AND jumping AND (dt > 0.5 OR closed OR (NOT blinked AND v < 20)) THEN u / 1e6 ELSE ended END AS e2
    FROM (SELECT *, CASE WHEN dt <= 1e-6 OR dt > 0.5 OR closed OR blinked THEN 0
            WHEN socket > 0.75 OR (head > 15 AND socket > 0.30) THEN CASE WHEN jump < greatest(0.085, 0.026::DOUBLE * {_wide}) THEN 0 ELSE greatest(0, jump * 22 / dt - 0.85::DOUBLE * head) END
            WHEN jump < 0.026::DOUBLE * {_wide} OR sqrt(pow(gx - px, 2) + pow((gy - py) / 2, 2)) < 0.030::DOUBLE * {_wide} THEN 0 ELSE jump * 22 / dt END AS v
        FROM (SELECT *, CASE WHEN (l - pl) * (r - pr) < -1e-4 THEN 0 WHEN abs(yaw) > 12 AND greatest(abs(l - pl), abs(r - pr)) > 2.2::DOUBLE * least(abs(l - pl), abs(r - pr)) THEN least(abs(l - pl), abs(r - pr)) ELSE abs(gx - px) END AS jump
            FROM (SELECT q.*, f.u AS pu, f.gx AS px, f.gy AS py, f.l AS pl, f.r AS pr, f.jumping, f.ended, f.blinked, q.u / 1e6 - f.u / 1e6 AS dt FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))))
SELECT event_id, round(speed, 6) AS speed, jumping, round(latency, 3) AS latency_ms FROM f"""


def pose_jump_rejection(spark, sf):
    df = e(spark, sf).withColumns({"yaw": F.col("x") / 5, "pitch": F.col("k") / 4.0, "roll": F.lit(0.0)})
    return X.fold(df, S, X.jump_rejection(), ["yaw", "pitch", "roll"], ["event_id"])


_jump = "greatest(abs((x / 5 - f.yaw + 180) - 360 * floor((x / 5 - f.yaw + 180) / 360) - 180), abs((k / 4.0::DOUBLE - f.pitch + 180) - 360 * floor((k / 4.0::DOUBLE - f.pitch + 180) / 360) - 180)) > 25 AND NOT f.rejected"
JUMP = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, x / 5 AS yaw, k / 4.0::DOUBLE AS pitch, false AS rejected FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, CASE WHEN {_jump} THEN f.yaw ELSE x / 5 END, CASE WHEN {_jump} THEN f.pitch ELSE k / 4.0::DOUBLE END, {_jump} FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, yaw AS yaw_out, pitch AS pitch_out, 0.0::DOUBLE AS roll_out, rejected FROM f"""


def roi_tracker(spark, sf):
    df = e(spark, sf).withColumns({"cx": F.col("x"), "cy": F.col("k") * 2.0, "scale": F.col("x") / 3 + 40})
    return X.fold(df, S, X.roi_tracker(), ["cx", "cy", "scale"], ["event_id"])


_quick = "least(0.85, 0.15 + 0.70::DOUBLE * greatest(0, (sqrt((x - f.cx) * (x - f.cx) + (k * 2.0::DOUBLE - f.cy) * (k * 2.0::DOUBLE - f.cy)) - 8) / 30))"
ROI = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, x AS cx, k * 2.0::DOUBLE AS cy, x / 3 + 40 AS sc FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, f.cx + {_quick} * (x - f.cx), f.cy + {_quick} * (k * 2.0::DOUBLE - f.cy), f.sc + 0.15::DOUBLE * (x / 3 + 40 - f.sc) FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, cx AS cx_out, cy AS cy_out, sc AS scale_out FROM f"""

_alpha = lambda f: f"(2 * pi() * {f} * dt / (2 * pi() * {f} * dt + 1))"
EURO = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, x, k / 120.0::DOUBLE AS vib, trunc(us / {SLOW}::DOUBLE) AS u FROM n), f AS (
    SELECT user_id, rn, event_id, u, x AS y, 0.0::DOUBLE AS speed, 0.0::DOUBLE AS raw, 0.0::DOUBLE AS osc FROM q WHERE rn = 1 UNION ALL
    SELECT user_id, rn, event_id, u2, CASE WHEN dt <= 1e-9 THEN y ELSE {_alpha('cut')} * x + (1 - {_alpha('cut')}) * y END, CASE WHEN dt <= 1e-9 THEN speed ELSE s2 END, CASE WHEN dt <= 1e-9 THEN raw ELSE dx END, CASE WHEN dt <= 1e-9 THEN osc ELSE o2 END FROM (
        SELECT *, CASE WHEN sh > 0.4 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + 0.007::DOUBLE * greatest(0.05, 1 - 1.5 * sh) * abs(s2) * 100 / 60 AS cut FROM (SELECT *, greatest(o2, vib) AS sh FROM (
            SELECT *, 0.35::DOUBLE * (CASE WHEN dx * raw < 0 THEN 1 ELSE 0 END) + 0.65::DOUBLE * osc AS o2, {_alpha('1.0::DOUBLE')} * dx + (1 - {_alpha('1.0::DOUBLE')}) * speed AS s2 FROM (
                SELECT q.user_id, q.rn, q.event_id, q.u AS u2, q.x, q.vib, f.y, f.speed, f.raw, f.osc, (q.u - f.u) / 1e6 AS dt, CASE WHEN q.u > f.u THEN (q.x - f.y) / ((q.u - f.u) / 1e6) END AS dx
                FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))))
SELECT event_id, round(y, 5) AS filtered FROM f"""


def vor_gain(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "eye": -F.col("x") / 40, "yaw": F.col("k") / 12.0, "pitch": F.col("x") / 20, "open": F.col("kind") != "error"})
    return X.fold(df, S, X.vor_gain(digits=12), ["us", "eye", "yaw", "pitch", "open"], ["event_id"]).select("event_id", r("gain", 9).alias("gain"))


VOR = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT user_id, rn, event_id, trunc(us / {SLOW}::DOUBLE) AS u, -x / 40 AS eye, k / 12.0::DOUBLE AS yaw, x / 20 AS pitch, kind <> 'error' AS is_open FROM n),
f AS (SELECT user_id, rn, event_id, u, eye, yaw, 1.0::DOUBLE AS gain, []::DOUBLE[] AS ratios FROM q WHERE rn = 1 UNION ALL
SELECT user_id, rn, event_id, u, eye, yaw,
    CASE WHEN ratio IS NOT NULL THEN list_median(list_append(ratios, ratio)[-30:]) WHEN NOT ok OR (abs(turned) > 0.45 AND abs(turned) < 8) THEN gain WHEN abs(turned) / dt >= 2 AND abs(turned) / dt <= 25 THEN CASE WHEN -moved / turned > 0.05 THEN 0.85::DOUBLE * gain + 0.15::DOUBLE * least(2, -moved / turned) ELSE gain END ELSE gain END,
    CASE WHEN ratio IS NULL THEN ratios ELSE list_append(ratios, ratio)[-30:] END
FROM (SELECT *, CASE WHEN ok AND abs(turned) > 0.45 AND abs(turned) < 8 THEN CASE WHEN abs(moved) > 0.20 THEN greatest(0, least(2, -moved / turned)) WHEN abs(moved) <= 0.15 AND abs(turned) > 1.5 THEN 0 END END AS ratio
    FROM (SELECT q.*, f.gain, f.ratios, (q.u - f.u) / 1e6 AS dt, q.eye - f.eye AS moved, (q.yaw - f.yaw + 180) - 360 * floor((q.yaw - f.yaw + 180) / 360) - 180 AS turned, q.pitch <= 12 AND (q.u - f.u) / 1e6 > 1e-6 AND q.is_open AS ok FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))
SELECT event_id, round(gain, 9) AS gain FROM f"""


def blink_phase(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / SLOW / 3).cast("bigint"), "ear": F.least(F.lit(0.4), F.col("x") / 300)})
    return X.fold(df, S, X.blink_phase(), ["us", "ear"], ["event_id"])


def baseline_lock(spark, sf):
    df = e(spark, sf).withColumn("open", F.col("kind") != "error")
    got = X.fold(df, S, X.locked_baseline(15, 165.0, 0.004, 0.18), ["x", "open"], ["event_id"])
    return got.select("event_id", r("baseline").alias("baseline"), r("delta").alias("delta"))


BASELINE = f"""WITH RECURSIVE {_NUMBERED}, q AS (SELECT *, kind <> 'error' AS is_open FROM n),
f AS (SELECT user_id, rn, event_id, x, NULL::DOUBLE AS base, CASE WHEN x < 165 THEN [x] ELSE []::DOUBLE[] END AS seen FROM q WHERE rn = 1 UNION ALL
SELECT q.user_id, q.rn, q.event_id, q.x, CASE WHEN f.base IS NOT NULL THEN CASE WHEN q.is_open AND abs(q.x - f.base) <= 0.18::DOUBLE * f.base THEN 0.004::DOUBLE * q.x + 0.996::DOUBLE * f.base ELSE f.base END WHEN q.x < 165 AND len(f.seen) = 14 THEN list_median(list_append(f.seen, q.x)) END,
    CASE WHEN f.base IS NOT NULL OR len(f.seen) = 15 THEN f.seen WHEN q.x < 165 THEN list_append(f.seen, q.x) ELSE f.seen END
FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)
SELECT event_id, round(base, 6) AS baseline, round(x / base - 1, 6) AS delta FROM f"""


def noise_floor(spark, sf):
    return X.fold(e(spark, sf), S, X.gated_ema(0.1, 80.0), ["x"], ["event_id"])


NOISE = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, CASE WHEN x < 80 THEN x END AS y FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, CASE WHEN n.x < 80 THEN CASE WHEN f.y IS NULL THEN n.x ELSE 0.1::DOUBLE * n.x + 0.9::DOUBLE * f.y END ELSE f.y END FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, y AS floor FROM f"""


def angle_oscillation(spark, sf):
    return X.fold(e(spark, sf), S, X.oscillation(0.4, 60.0), ["x"], ["event_id"])


OSCILLATION = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, x, 0.0::DOUBLE AS d, 0.0::DOUBLE AS o FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, n.x, n.x - f.x, CASE WHEN abs(n.x - f.x) < 60 THEN 0.4::DOUBLE * (CASE WHEN (n.x - f.x) * f.d < 0 THEN 1 ELSE 0 END) + 0.6::DOUBLE * f.o ELSE f.o END FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, o AS oscillation FROM f"""


def crop_hysteresis(spark, sf):
    edge = F.round(F.col("x") / 50)
    df = e(spark, sf).withColumns({"x0": edge, "y0": F.lit(0.0), "x1": edge + 10, "y1": F.lit(10.0)})
    return X.fold(df, S, X.crop_hysteresis(), ["x0", "y0", "x1", "y1"], ["event_id"]).select("event_id", "x0_out", "x1_out")


HYSTERESIS_CROP = f"""WITH RECURSIVE {_NUMBERED}, f AS (SELECT user_id, rn, event_id, round(x / 50) AS c FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.event_id, CASE WHEN abs(round(n.x / 50) - f.c) > 2 THEN round(n.x / 50) ELSE f.c END FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, c AS x0_out, c + 10 AS x1_out FROM f"""


def rolling_model(spark, sf):
    df = e(spark, sf).withColumn("valid", F.col("kind") != "error")
    mean = lambda w: sum(r[0] for r in w) / len(w)
    return X.fold(df, S, X.rolling_model(10, 5, mean), ["valid", "x"], ["event_id"])


def streaming_evidence(spark, sf):
    """The evidence machine on a stream of the events file, drained into a table; its rows are those of the batch fold."""
    import uuid

    from kymora.session import stream_checkpoint
    from kymora.streaming.processors import drain, stateful

    src = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf}/events.parquet*")
    df = frames(src).withColumns({"us": (F.col("us") / SLOW).cast("bigint"), "risk": F.least(F.lit(100.0), F.col("x") / 2), "seen": F.col("kind") != "error", "hard": F.col("kind") == "click", "parked": F.lit(False)})
    got = stateful(df, Stream(), X.evidence(), ["us", "risk", "seen", "hard", "parked"], ["event_id"])
    name = f"evidence_{uuid.uuid4().hex[:8]}"
    return drain(got, name, stream_checkpoint(spark, name)).select("event_id", r("log_odds").alias("log_odds"), r("sustained").alias("sustained"), "latched")


def gbt_oof(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "source", F.log1p(F.col("n_chars").cast("double")).alias("size"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / (F.col("n_chars") + 1)).alias("upper"), (F.length(F.regexp_replace("text", "[^!|%$#*&]", "")) / (F.col("n_chars") + 1)).alias("marks"))
    got = out_of_fold(docs.join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id"), ["size", "upper", "marks"], "y", "source", k=3, rounds=10)
    return got.select("doc_id", "fold", r("score", 4).alias("score"), "y")


QUERIES = {
    "ema_fold": (ema_fold, EMA),
    "sprt_latch": (sprt_latch, SPRT),
    "debounced_command": (debounced_command, DEBOUNCE),
    "change_only_sink": (change_only_sink, CHANGE),
    "shock_gate": (shock_gate, None),
    "one_euro": (one_euro, EURO),
    "one_euro_bank": (one_euro_bank, None),
    "brow_baseline": (brow_baseline, BROW),
    "fixation_stare": (fixation_stare, STARE),
    "saccade_dynamics": (saccade_dynamics, SACCADE),
    "pose_jump_rejection": (pose_jump_rejection, JUMP),
    "roi_tracker": (roi_tracker, ROI),
    "vor_gain": (vor_gain, VOR),
    "blink_phase": (blink_phase, None),
    "baseline_lock": (baseline_lock, BASELINE),
    "noise_floor": (noise_floor, NOISE),
    "angle_oscillation": (angle_oscillation, OSCILLATION),
    "crop_hysteresis": (crop_hysteresis, HYSTERESIS_CROP),
    "rolling_model": (rolling_model, None),
    "streaming_evidence": (streaming_evidence, SPRT),
    "gbt_oof": (gbt_oof, None),
}

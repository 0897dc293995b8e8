"""Ordered stream operators over ``events``: subject user_id, signal value, side channel props.k. Durations are hours and days, as the table's gaps are."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.keys import DAY, HOUR, Stream, frames
from kymora.operators import windows as W
from kymora.session import table

S = Stream()
BASE = """e AS (
    SELECT user_id, event_id, epoch_us(ts) AS us, value AS x, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
)"""
OVER = "(PARTITION BY user_id ORDER BY us, event_id)"


def rows(n: int, last: str = "CURRENT ROW") -> str:
    first = "UNBOUNDED PRECEDING" if n < 0 else f"{n} PRECEDING"
    return f"(PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN {first} AND {last})"


def span(us: int) -> str:
    return f"(PARTITION BY user_id ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"


def e(spark, sf):
    return frames(table(spark, sf, "events"))


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def derivative_guarded(spark, sf):
    got = W.derivative(e(spark, sf), S, "x", "slope", longest=100_000.0)
    return got.select("event_id", r("slope", 8).alias("slope"))


DERIVATIVE = f"""WITH {BASE}, d AS (SELECT *, (us - lag(us) OVER {OVER}) / 1e6 AS dt, x - lag(x) OVER {OVER} AS dx FROM e),
v AS (SELECT *, CASE WHEN dt IS NULL OR dt > 100000 THEN 0.0 WHEN dt > 1e-6 THEN dx / dt END AS raw FROM d)
SELECT event_id, round(last_value(raw IGNORE NULLS) OVER {rows(-1)}, 8) AS slope FROM v"""


def angular_speed_wrapped(spark, sf):
    df = e(spark, sf).withColumn("yaw", F.pmod("x", F.lit(360.0))).withColumn("pitch", F.col("k") - 50.0)
    return W.angular_speed(df, S, "yaw", "pitch", "speed").select("event_id", r("speed", 8).alias("speed"))


ANGULAR = f"""WITH {BASE}, a AS (SELECT *, fmod(x, 360.0) AS yaw, k - 50.0::DOUBLE AS pitch FROM e),
d AS (SELECT *, (us - lag(us) OVER {OVER}) / 1e6 AS dt, yaw - lag(yaw) OVER {OVER} AS dy, pitch - lag(pitch) OVER {OVER} AS dp FROM a),
w AS (SELECT *, (dy + 180) - 360 * floor((dy + 180) / 360) - 180 AS wy FROM d)
SELECT event_id, round(CASE WHEN dt > 0 THEN sqrt(wy * wy + dp * dp) / dt ELSE 0 END, 8) AS speed FROM w"""


def hysteresis_state(spark, sf):
    return W.hysteresis(e(spark, sf), S, "x", 120.0, 30.0, "active").select("event_id", "active")


ON = f"h AS (SELECT *, coalesce(last_value(CASE WHEN x > 120 THEN true WHEN x < 30 THEN false END IGNORE NULLS) OVER {rows(-1)}, false) AS active FROM e)"
HYSTERESIS = f"WITH {BASE}, {ON} SELECT event_id, active FROM h"


def latency_since_event(spark, sf):
    got = W.latency_ms(W.hysteresis(e(spark, sf), S, "x", 120.0, 30.0, "active"), S, "active", "latency_ms")
    return got.select("event_id", r("latency_ms", 3).alias("latency_ms"))


LATENCY = f"""WITH {BASE}, {ON}, n AS (SELECT *, CASE WHEN NOT active AND lag(active, 1, false) OVER {OVER} THEN us END AS ended FROM h)
SELECT event_id, round(CASE WHEN active THEN 0 ELSE coalesce((us - last_value(ended IGNORE NULLS) OVER {rows(-1)}) / 1000.0, 0) END::DOUBLE, 3) AS latency_ms FROM n"""


def run_length_microsleep(spark, sf):
    got = W.closures(W.run_length(e(spark, sf), S, F.col("x") < 40, "run"), S, "run", 4)
    return got.select("event_id", F.col("run").cast("bigint").alias("run"), "blink", "microsleep")


RUN = f"""WITH {BASE}, g AS (SELECT *, sum(CASE WHEN NOT x < 40 THEN 1 ELSE 0 END) OVER {rows(-1)} AS grp FROM e),
n AS (SELECT *, sum(CASE WHEN x < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, run::BIGINT AS run, run = 0 AND lag(run, 1, 0) OVER {OVER} > 0 AS blink, run >= 4 AS microsleep FROM n"""


def neutral_run_yawn(spark, sf):
    got = W.run_length(e(spark, sf), S, F.col("x") > 60, "run", neutral=(F.col("kind") == "view") & (F.col("x") < 70))
    return got.select("event_id", F.col("run").cast("bigint").alias("run"), (F.col("run") >= 3).alias("yawn"))


YAWN = f"""WITH {BASE}, c AS (SELECT *, kind = 'view' AND x < 70 AS neutral FROM e), h AS (SELECT *, x > 60 AND NOT neutral AS hit FROM c),
g AS (SELECT *, sum(CASE WHEN NOT hit AND NOT neutral THEN 1 ELSE 0 END) OVER {rows(-1)} AS grp FROM h),
n AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, run::BIGINT AS run, run >= 3 AS yawn FROM n"""


def perclos_ring(spark, sf):
    return W.closed_ratio(e(spark, sf), S, F.col("x") < 40, 30, 5, "perclos").select("event_id", r("perclos").alias("perclos"))


PERCLOS = f"WITH {BASE} SELECT event_id, round(sum((x < 40)::INT) OVER {rows(29)}::DOUBLE / greatest(count(*) OVER {rows(29)}, 5), 6) AS perclos FROM e"


def rolling_dispersion_holdover(spark, sf):
    got = W.dispersion_held(e(spark, sf), S, "x", F.col("kind") != "error", 20, 5, "dispersion")
    return got.select("event_id", r("dispersion").alias("dispersion"))


DISPERSION = f"""WITH {BASE}, o AS (SELECT *, kind <> 'error' AS o FROM e),
d AS (SELECT *, CASE WHEN o THEN CASE WHEN count(*) OVER w >= 5 THEN stddev_pop(x) OVER w ELSE 0 END END AS v FROM o
      WINDOW w AS (PARTITION BY user_id, o ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER {rows(-1)}, 0), 6) AS dispersion FROM d"""


def median_autozero(spark, sf):
    return W.median_autozero(e(spark, sf), S, "x", F.col("x") < 90, 30, 5, "zeroed").select("event_id", r("zeroed").alias("zeroed"))


AUTOZERO = f"""WITH {BASE}, c AS (SELECT *, CASE WHEN x < 90 THEN x END AS v FROM e)
SELECT event_id, round(x - CASE WHEN count(v) OVER {rows(29)} >= 5 THEN quantile_cont(v, 0.5) OVER {rows(29)} ELSE 0 END, 6) AS zeroed FROM c"""


def drift_beat_fsm(spark, sf):
    df = e(spark, sf).withColumn("speed", F.col("x") - F.lag("x").over(S.plain()))
    got = W.beats(df, S, "speed", F.col("kind") == "error", (5.0, 80.0), 60.0, 3 * DAY, 2)
    return got.select("event_id", "beat", F.col("beat_count").cast("bigint").alias("beat_count"), "detected", r("drift").alias("drift"))


BEATS = f"""WITH {BASE}, v AS (SELECT *, x - lag(x) OVER {OVER} AS v FROM e),
a AS (SELECT *, CASE WHEN kind = 'error' THEN 0 WHEN v BETWEEN 5 AND 80 THEN 1 WHEN v <= -60 THEN 2 END AS ev FROM v),
b AS (SELECT *, coalesce(ev = 2 AND last_value(ev IGNORE NULLS) OVER {rows(-1, '1 PRECEDING')} = 1, false) AS beat FROM a),
c AS (SELECT *, sum(beat::INT) OVER {span(3 * DAY)} AS n, last_value(CASE WHEN ev = 1 THEN v END IGNORE NULLS) OVER {rows(-1)} AS dr FROM b)
SELECT event_id, beat, n::BIGINT AS beat_count, n >= 2 AS detected, round(CASE WHEN n >= 2 THEN dr ELSE 0 END, 6) AS drift FROM c"""


def fragmentation_ratio(spark, sf):
    return W.fragmentation(e(spark, sf), S, F.col("x") > 100, 5 * DAY, 5, "ratio").select("event_id", r("ratio").alias("ratio"))


FRAGMENTATION = f"WITH {BASE} SELECT event_id, round(CASE WHEN count(*) OVER {span(5 * DAY)} >= 5 THEN avg((x > 100)::INT) OVER {span(5 * DAY)} ELSE 0 END, 6) AS ratio FROM e"


def detrended_sway(spark, sf):
    df = W.detrended_spread(e(spark, sf), S, "x", 5 * DAY, 5, "a")
    df = W.detrended_spread(df, S, "k", 5 * DAY, 5, "b")
    return df.select("event_id", r(F.hypot("a", "b"), 4).alias("sway"))


def _detrended(y: str, out: str) -> str:
    # The line is fitted to the window's rows in one pass over lists: streaming regressions over moving frames lose digits.
    return f"""list_sum(list_transform(range(1, len(ts) + 1), lambda i: pow({y}s[i] - my_{y} - CASE WHEN vt > 0 THEN c_{y} / vt ELSE 0 END * (ts[i] - mt), 2))) / len(ts) AS {out}"""


SWAY = f"""WITH {BASE}, b AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS t FROM e),
l AS (SELECT event_id, list(t) OVER w AS ts, list(x) OVER w AS xs, list(k::DOUBLE) OVER w AS ks FROM b WINDOW w AS {span(5 * DAY)}),
m AS (SELECT *, list_avg(ts) AS mt, list_avg(xs) AS my_x, list_avg(ks) AS my_k FROM l),
v AS (SELECT *, list_sum(list_transform(ts, lambda u: (u - mt) * (u - mt))) AS vt,
      list_sum(list_transform(range(1, len(ts) + 1), lambda i: (ts[i] - mt) * (xs[i] - my_x))) AS c_x,
      list_sum(list_transform(range(1, len(ts) + 1), lambda i: (ts[i] - mt) * (ks[i] - my_k))) AS c_k FROM m),
z AS (SELECT event_id, len(ts) AS n, {_detrended('x', 'a')}, {_detrended('k', 'b')} FROM v)
SELECT event_id, round(CASE WHEN n >= 5 THEN sqrt(a + b) ELSE 0 END, 4) AS sway FROM z"""


def first_n_median_baseline(spark, sf):
    return W.first_n_median(e(spark, sf), S, "x", 15, "baseline").select("event_id", r("baseline").alias("baseline"))


FIRST_N = f"""WITH {BASE}, i AS (SELECT *, row_number() OVER {OVER} AS i FROM e),
m AS (SELECT user_id, quantile_cont(x, 0.5) AS base FROM i WHERE i <= 15 GROUP BY 1)
SELECT event_id, round(CASE WHEN i >= 15 THEN base END, 6) AS baseline FROM i JOIN m USING (user_id)"""


def reversal_frequency(spark, sf):
    got = W.reversal_frequency(e(spark, sf), S, "x", 2.0, 150.0, 5 * DAY, 6, "hz")
    return got.select("event_id", r(F.col("hz") * 86400, 6).alias("per_day"))


REVERSAL = f"""WITH {BASE}, d AS (SELECT *, x - lag(x) OVER {OVER} AS d FROM e), v AS (SELECT *, coalesce(abs(d) > 2 AND abs(d) < 150, false) AS v FROM d),
f AS (SELECT *, (v AND lag(v, 1, false) OVER {OVER} AND coalesce(sign(d) * sign(lag(d) OVER {OVER}) < 0, false))::INT AS f FROM v),
s AS (SELECT *, (us - min(us) OVER w) / 1e6 AS secs, sum(v::INT) OVER w AS nv, sum(f) OVER w AS nf FROM f WINDOW w AS {span(5 * DAY)})
SELECT event_id, round(CASE WHEN nv >= 6 AND secs > 0 THEN nf / (2 * secs) ELSE 0 END * 86400, 6) AS per_day FROM s"""


def lid_tremor(spark, sf):
    df = e(spark, sf).withColumns({"us": (F.col("us") / 360_000).cast("bigint"), "shake": F.col("k") / 150.0})
    got = W.tremor(df, S, "x", F.col("kind") != "error", 2.0, 150.0, 2_000_000, "shake", "hz")
    return got.select("event_id", r("hz", 2).alias("hz"))


TREMOR = f"""WITH {BASE}, q AS (SELECT event_id, user_id, trunc(us / 360000::DOUBLE)::BIGINT AS us, x, k / 150.0::DOUBLE AS shake, kind <> 'error' AS u FROM e),
d AS (SELECT *, x - lag(x) OVER o AS d FROM q WINDOW o AS (PARTITION BY user_id, u ORDER BY us, event_id)), v AS (SELECT *, coalesce(abs(d) > 2 AND abs(d) < 150, false) AS v FROM d),
f AS (SELECT *, coalesce(v AND lag(v, 1, false) OVER o AND sign(d) * sign(lag(d) OVER o) < 0, false)::INT AS f FROM v WINDOW o AS (PARTITION BY user_id, u ORDER BY us, event_id)),
w AS (SELECT *, count(*) OVER t AS n, (us - min(us) OVER t) / 1e6 AS secs, sum(v::INT) OVER t AS nv, sum(f) OVER t AS nf FROM f WINDOW t AS (PARTITION BY user_id, u ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN u AND n >= 12 AND secs >= 0.4 AND nv >= 6 THEN round_even(nf / (2 * secs) * CASE WHEN shake > 0.35 THEN greatest(0, 1 - shake) ELSE 1 END, 2) ELSE 0 END::DOUBLE AS hz FROM w"""


def window_tremor(spark, sf):
    df = e(spark, sf).withColumn("nth", F.row_number().over(S.plain()) - 1).withColumns({"window": F.floor(F.col("nth") / 25), "eye": F.col("x") / 4000})
    return W.window_tremor(df, ["user_id", "window"], "nth", "eye", 25)


WINDOW_TREMOR = f"""WITH {BASE}, n AS (SELECT *, row_number() OVER {OVER} - 1 AS nth, x / 4000 AS eye FROM e), d AS (SELECT user_id, nth, nth // 25 AS win, eye - lag(eye) OVER (PARTITION BY user_id, nth // 25 ORDER BY nth) AS d FROM n),
v AS (SELECT *, coalesce(abs(d) > 0.001 AND abs(d) < 0.045, false) AS v FROM d), f AS (SELECT *, coalesce(v AND lag(v, 1, false) OVER o AND sign(d) * sign(lag(d) OVER o) < 0, false)::INT AS f FROM v WINDOW o AS (PARTITION BY user_id, win ORDER BY nth))
SELECT user_id, win AS "window", CASE WHEN count(*) >= 12 AND sum(v::INT) >= 6 THEN round_even(sum(f) / (2 * (25 / 30.0::DOUBLE)), 2) ELSE 0 END::DOUBLE AS tremor FROM f GROUP BY 1, 2"""


def cadence_detector(spark, sf):
    return W.cadence(e(spark, sf), S, "x", 5 * DAY, 8, (40.0, 120.0), 20.0, 60.0, 90.0, 0.8 / 86400, "speech").select("event_id", "speech")


CADENCE = f"""WITH {BASE}, l AS (SELECT *, list(x ORDER BY us, event_id) OVER w AS a, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd, max(x) OVER w AS hi, max(x) OVER w - min(x) OVER w AS rg, (us - min(us) OVER w) / 1e6 AS secs FROM e WINDOW w AS {span(5 * DAY)}),
g AS (SELECT *, list_filter(list_transform(a, lambda v: sign(v - list_sum(a) / len(a))), lambda v: v <> 0) AS s FROM l)
SELECT event_id, len(a) >= 8 AND m BETWEEN 40 AND 120 AND sd >= 20 AND rg >= 60 AND hi >= 90 AND len(list_filter(range(1, len(s)), lambda i: s[i] * s[i + 1] < 0)) >= 0.8::DOUBLE / 86400 * secs AS speech FROM g"""


def range_min_spike(spark, sf):
    return W.widening(e(spark, sf), S, "x", 80.0, 2 * DAY, 10.0, 60.0, "spike").select("event_id", "spike")


SPIKE = f"WITH {BASE} SELECT event_id, x > 80 AND (min(x) OVER w < 10 OR x - min(x) OVER w > 60) AS spike FROM e WINDOW w AS {span(2 * DAY)}"


def suppression_clock(spark, sf):
    got = W.suppressed_for(e(spark, sf), S, F.col("kind") == "click", "since")
    return got.select("event_id", r("since", 3).alias("since"), (F.col("since") >= 2.0 * 86400).alias("suppressed"))


SUPPRESSION = f"""WITH {BASE}, s AS (SELECT *, (us - coalesce(last_value(CASE WHEN kind = 'click' THEN us END IGNORE NULLS) OVER {rows(-1)}, min(us) OVER (PARTITION BY user_id))) / 1e6 AS since FROM e)
SELECT event_id, round(since, 3) AS since, since >= 172800 AS suppressed FROM s"""


def event_rate_60(spark, sf):
    return W.event_rate(e(spark, sf), S, F.col("kind") == "click", 6 * DAY, 2, "rate").select("event_id", r("rate").alias("rate"))


RATE = f"""WITH {BASE}, n AS (SELECT *, sum((kind = 'click')::INT) OVER {span(6 * DAY)} AS n, least({6 * DAY}::DOUBLE, (us - min(us) OVER (PARTITION BY user_id))::DOUBLE) / {6 * DAY} AS p FROM e)
SELECT event_id, round(CASE WHEN n >= 2 AND p > 0 THEN n / p ELSE 0 END, 6) AS rate FROM n"""


def quadratic_accel(spark, sf):
    df = e(spark, sf).withColumn("us", (F.col("us") / 3600).cast("bigint"))
    return W.quadratic_acceleration(df, S, "x", 5, "acceleration").select("event_id", r("acceleration", 3).alias("acceleration"))


# Exact here too: moments of the five rows about their first, by the same normal equations.
QUADRATIC = f"""WITH {BASE}, q AS (SELECT event_id, user_id, us // 3600 AS us, x FROM e),
l AS (SELECT event_id, list(us) OVER w AS ts, list(x) OVER w AS ys FROM q WINDOW w AS {rows(4)}),
u AS (SELECT *, list_transform(ts, lambda t: (t - ts[1]) / 1e6) AS u, len(ts)::DOUBLE AS n FROM l),
m AS (SELECT *, list_sum(u) AS s1, list_sum(list_transform(u, lambda v: v * v)) AS s2, list_sum(list_transform(u, lambda v: v * v * v)) AS s3, list_sum(list_transform(u, lambda v: v * v * v * v)) AS s4,
      list_sum(ys) AS y0, list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * ys[i])) AS y1, list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * u[i] * ys[i])) AS y2 FROM u),
d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det, n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s3 * y0) + s2 * (s1 * y1 - s2 * y0) AS top FROM m)
SELECT event_id, abs(round(CASE WHEN n >= 3 AND det <> 0 THEN 2 * top / det ELSE 0 END, 3)) * sign(round(CASE WHEN n >= 3 AND det <> 0 THEN 2 * top / det ELSE 0 END, 3)) AS acceleration FROM d"""


def high_freq_jitter(spark, sf):
    return W.jitter(e(spark, sf), S, "x", 5, "jitter").select("event_id", r("jitter").alias("jitter"))


JITTER = f"WITH {BASE} SELECT event_id, round(x - avg(x) OVER {rows(4)}, 6) AS jitter FROM e"


def vibration_score(spark, sf):
    df = e(spark, sf).withColumn("d", F.coalesce(F.col("x") - F.lag("x").over(S.plain()), F.lit(0.0)))
    return W.vibration_score(df, S, "d", 15, 5.0, 200.0, "score").select("event_id", r("score").alias("score"))


VIBRATION = f"""WITH {BASE}, d AS (SELECT *, coalesce(x - lag(x) OVER {OVER}, 0) AS d FROM e), l AS (SELECT *, list(d) OVER {rows(14)} AS a FROM d),
m AS (SELECT *, list_filter(a, lambda v: abs(v) > 5) AS m FROM l)
SELECT event_id, round(CASE WHEN len(a) >= 6 AND len(m) >= 4 THEN least(1, greatest(0, len(list_filter(range(1, len(m)), lambda i: m[i] * m[i + 1] < 0))::DOUBLE / greatest(len(m) - 1, 1)
    * sqrt(list_sum(list_transform(a, lambda v: v * v)) / len(a)) / 200)) ELSE 0 END, 6) AS score FROM m"""


def raw_variance(spark, sf):
    return e(spark, sf).select("event_id", r(F.stddev_pop("x").over(S.rows(-89))).alias("spread"))


VARIANCE = f"WITH {BASE} SELECT event_id, round(stddev_pop(x) OVER {rows(89)}, 6) AS spread FROM e"


def gated_drop(spark, sf):
    return W.drop_gated(e(spark, sf), F.col("kind") == "error").select("event_id", "x")


DROP = f"WITH {BASE} SELECT event_id, x FROM e WHERE kind <> 'error'"


def gated_hold_last(spark, sf):
    return W.hold_last(e(spark, sf), S, ["x", "k"], F.col("kind") == "error").select("event_id", "x", "k")


HOLD = f"""WITH {BASE} SELECT event_id, coalesce(last_value(CASE WHEN kind <> 'error' THEN x END IGNORE NULLS) OVER w, x) AS x,
coalesce(last_value(CASE WHEN kind <> 'error' THEN k END IGNORE NULLS) OVER w, k) AS k FROM e WINDOW w AS {rows(-1)}"""


def gated_interpolate(spark, sf):
    return W.interpolate_gated(e(spark, sf), S, "x", F.col("kind").isin("error", "view")).select("event_id", r("x").alias("x"))


INTERPOLATE = f"""WITH {BASE}, i AS (SELECT *, kind IN ('error', 'view') AS g, row_number() OVER {OVER} AS i FROM e),
n AS (SELECT *, last_value(CASE WHEN NOT g THEN x END IGNORE NULLS) OVER b AS p, last_value(CASE WHEN NOT g THEN i END IGNORE NULLS) OVER b AS pi,
      first_value(CASE WHEN NOT g THEN x END IGNORE NULLS) OVER a AS n, first_value(CASE WHEN NOT g THEN i END IGNORE NULLS) OVER a AS ni FROM i
      WINDOW b AS {rows(-1)}, a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, least(ni - coalesce(pi, 0) - 1, 2) AS gap FROM n WHERE ni IS NOT NULL AND (NOT g OR ni - i <= 2))
SELECT event_id, round(CASE WHEN NOT g THEN x ELSE coalesce(p + (n - p) * (gap - (ni - i) + 1) / (gap + 1), n) END, 6) AS x FROM h"""


def sliding_windows(spark, sf):
    got = W.sliding_windows(e(spark, sf), S, 3 * DAY, DAY + 12 * HOUR).where("pos < 90")
    return got.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), r(F.avg("x")).alias("mean_x"))


SPANS = f"""b AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS t0, max(us) OVER (PARTITION BY user_id) AS t1 FROM e),
s AS (SELECT DISTINCT user_id, t0, t1 FROM b), k AS (SELECT user_id, t0, unnest(range(0, ((t1 + 1000 - t0 - {3 * DAY}) // {DAY + 12 * HOUR}) + 1)) AS window_id FROM s WHERE t1 + 1000 - t0 >= {3 * DAY}),
m AS (SELECT k.user_id, window_id, event_id, x, kind, row_number() OVER (PARTITION BY k.user_id, window_id ORDER BY us, event_id) - 1 AS pos FROM k JOIN e
      ON e.user_id = k.user_id AND us >= t0 + window_id * {DAY + 12 * HOUR} - 100 AND us <= t0 + window_id * {DAY + 12 * HOUR} + {3 * DAY} + 100)"""
SLIDING = f"WITH {BASE}, {SPANS} SELECT user_id, window_id, count(*) AS n, min(event_id) AS first_id, round(avg(x), 6) AS mean_x FROM m WHERE pos < 90 GROUP BY 1, 2"


def min_fill_windows(spark, sf):
    got = W.sliding_windows(e(spark, sf), S, 3 * DAY, DAY + 12 * HOUR).where("pos < 10")
    need = int(10 * 0.7)
    agg = got.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "error").alias("n_valid"))
    return agg.where((F.col("n") >= need) & (F.col("n_valid") >= need))


MIN_FILL = f"WITH {BASE}, {SPANS} SELECT user_id, window_id, count(*) AS n, count(*) FILTER (kind <> 'error') AS n_valid FROM m WHERE pos < 10 GROUP BY 1, 2 HAVING n >= 7 AND n_valid >= 7"


def resample_linear(spark, sf):
    df = e(spark, sf).withColumn("pos", F.row_number().over(S.plain()))
    return W.resample(df, ["user_id"], "pos", "x", 32).select("user_id", "place", r("x").alias("x"))


RESAMPLE = f"""WITH {BASE}, l AS (SELECT user_id, list(x ORDER BY us, event_id) AS a FROM e GROUP BY 1),
p AS (SELECT *, unnest(range(0, 32))::INT AS place FROM l), q AS (SELECT *, place * (len(a) - 1) / 31.0::DOUBLE AS spot FROM p),
v AS (SELECT *, a[floor(spot)::INT + 1] AS lo, a[least(floor(spot)::INT + 1, len(a) - 1) + 1] AS hi FROM q)
SELECT user_id, place, round(lo + (hi - lo) * (spot - floor(spot)), 6) AS x FROM v"""

QUERIES = {
    "derivative_guarded": (derivative_guarded, DERIVATIVE),
    "angular_speed_wrapped": (angular_speed_wrapped, ANGULAR),
    "hysteresis_state": (hysteresis_state, HYSTERESIS),
    "latency_since_event": (latency_since_event, LATENCY),
    "run_length_microsleep": (run_length_microsleep, RUN),
    "neutral_run_yawn": (neutral_run_yawn, YAWN),
    "perclos_ring": (perclos_ring, PERCLOS),
    "rolling_dispersion_holdover": (rolling_dispersion_holdover, DISPERSION),
    "median_autozero": (median_autozero, AUTOZERO),
    "drift_beat_fsm": (drift_beat_fsm, BEATS),
    "fragmentation_ratio": (fragmentation_ratio, FRAGMENTATION),
    "detrended_sway": (detrended_sway, SWAY),
    "first_n_median_baseline": (first_n_median_baseline, FIRST_N),
    "reversal_frequency": (reversal_frequency, REVERSAL),
    "lid_tremor": (lid_tremor, TREMOR),
    "window_tremor": (window_tremor, WINDOW_TREMOR),
    "cadence_detector": (cadence_detector, CADENCE),
    "range_min_spike": (range_min_spike, SPIKE),
    "suppression_clock": (suppression_clock, SUPPRESSION),
    "event_rate_60": (event_rate_60, RATE),
    "quadratic_accel": (quadratic_accel, QUADRATIC),
    "high_freq_jitter": (high_freq_jitter, JITTER),
    "vibration_score": (vibration_score, VIBRATION),
    "raw_variance": (raw_variance, VARIANCE),
    "gated_drop": (gated_drop, DROP),
    "gated_hold_last": (gated_hold_last, HOLD),
    "gated_interpolate": (gated_interpolate, INTERPOLATE),
    "sliding_windows": (sliding_windows, SLIDING),
    "min_fill_windows": (min_fill_windows, MIN_FILL),
    "resample_linear": (resample_linear, RESAMPLE),
}

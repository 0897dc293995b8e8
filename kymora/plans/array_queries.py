"""Array operators over ``embeddings`` (32 points of two coordinates, or a waveform of 64 samples) and rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.config import LADDERS, Config
from kymora.functions import geometry as G
from kymora.functions import scoring as C
from kymora.functions import signal as D
from kymora.operators import temporal
from kymora.plans.stream_queries import BASE, e, r
from kymora.session import table

V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def _d(p: int, q: int) -> str:
    return f"sqrt(pow(a[{2 * p + 1}] - a[{2 * q + 1}], 2) + pow(a[{2 * p + 2}] - a[{2 * q + 2}], 2))"


def array_ear(spark, sf):
    return vectors(spark, sf).select("vec_id", r(G.aspect_ratio(F.col("a"), (0, 3), [(1, 5), (2, 4)])).alias("ear"))


EAR = f"WITH {V} SELECT vec_id, round(CASE WHEN {_d(0, 3)} < 1e-6 THEN 0 ELSE ({_d(1, 5)} + {_d(2, 4)}) / (2 * {_d(0, 3)}) END, 6) AS ear FROM v"


def array_mar(spark, sf):
    return vectors(spark, sf).select("vec_id", r(G.aspect_ratio(F.col("a"), (6, 9), [(7, 12), (8, 11), (10, 13)])).alias("mar"))


MAR = f"WITH {V} SELECT vec_id, round(CASE WHEN {_d(6, 9)} < 1e-6 THEN 0 ELSE ({_d(7, 12)} + {_d(8, 11)} + {_d(10, 13)}) / (3 * {_d(6, 9)}) END, 6) AS mar FROM v"


def iris_projection(spark, sf):
    x, y = G.iris_position(F.col("a"), 20, 21, 22)
    return vectors(spark, sf).select("vec_id", r(x).alias("iris_x"), r(y).alias("iris_y"))


IRIS = f"""WITH {V}, s AS (SELECT *, a[43] > a[45] AS sw FROM v), o AS (SELECT *, CASE WHEN sw THEN a[45] ELSE a[43] END AS lx, CASE WHEN sw THEN a[46] ELSE a[44] END AS ly, CASE WHEN sw THEN a[43] ELSE a[45] END AS rx, CASE WHEN sw THEN a[44] ELSE a[46] END AS ry FROM s),
w AS (SELECT *, sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) AS w FROM o), u AS (SELECT *, (rx - lx) / w AS ux, (ry - ly) / w AS uy, a[41] - (lx + rx) / 2 AS dx, a[42] - (ly + ry) / 2 AS dy FROM w)
SELECT vec_id, round(CASE WHEN w < 1e-6 THEN 0 ELSE greatest(-1, least(1, (dx * ux + dy * uy) / (w / 2))) END, 6) AS iris_x, round(CASE WHEN w < 1e-6 THEN 0 ELSE greatest(-1, least(1, (dx * uy - dy * ux) / (w / 2))) END, 6) AS iris_y FROM u"""


def bbox_center_scale(spark, sf):
    box, mid = G.bounding_box(F.col("a")), G.center_scale(F.col("a"), floor=0.1)
    return vectors(spark, sf).select("vec_id", *[r(c).alias(n) for n, c in (box | mid).items()])


_X, _Y = "list_transform(range(1, 64, 2), lambda i: a[i])", "list_transform(range(2, 65, 2), lambda i: a[i])"
BBOX = f"""WITH {V}, b AS (SELECT vec_id, list_min({_X}) AS x0, list_min({_Y}) AS y0, list_max({_X}) AS x1, list_max({_Y}) AS y1 FROM v)
SELECT vec_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(greatest(x1 - x0, y1 - y0, 0.1), 6) AS scale FROM b"""


def crop_remap_roundtrip(spark, sf):
    there = G.remap(F.col("a"), F.lit(100.0), F.lit(50.0), F.lit(640.0), F.lit(0.5))
    df = vectors(spark, sf).withColumn("b", there)
    back = G.unmap(F.col("b"), F.lit(100.0), F.lit(50.0), F.lit(640.0), F.lit(0.5))
    worst = F.array_max(F.zip_with(back, F.col("a"), lambda x, y: F.abs(x - y)))
    return df.select("vec_id", r(G.at(F.col("b"), 3, 0)).alias("x3"), r(G.at(F.col("b"), 3, 1)).alias("y3"), (worst < 1e-9).alias("round_trip"))


REMAP = f"WITH {V} SELECT vec_id, round(100 + a[7] * 640, 6) AS x3, round(50 + a[8] * 1, 6) AS y3, true AS round_trip FROM v"


def roll_derotate(spark, sf):
    df = vectors(spark, sf).withColumn("b", G.derotate(F.col("a"), 2, 5, 1))
    return df.select("vec_id", r(G.at(F.col("b"), 9, 0)).alias("x9"), r(G.at(F.col("b"), 9, 1)).alias("y9"), (F.abs(G.at(F.col("b"), 2, 1) - G.at(F.col("b"), 5, 1)) < 1e-9).alias("level"))


ROLL = f"""WITH {V}, t AS (SELECT *, -atan2(a[12] - a[6], a[11] - a[5]) AS t FROM v)
SELECT vec_id, round(a[3] + (a[19] - a[3]) * cos(t) - (a[20] - a[4]) * sin(t), 6) AS x9, round(a[4] + (a[19] - a[3]) * sin(t) + (a[20] - a[4]) * cos(t), 6) AS y9, true AS level FROM t"""


def landmark_valid(spark, sf):
    df = vectors(spark, sf).withColumn("a", F.when(F.col("vec_id") % 7 == 0, F.slice("a", 1, 40)).when(F.col("vec_id") % 11 == 0, F.transform("a", lambda v: v * 0.0)).otherwise(F.col("a")))
    return df.select("vec_id", G.is_valid(F.col("a"), 32).alias("valid"))


VALID = "SELECT vec_id, NOT (vec_id % 7 = 0 OR vec_id % 11 = 0) AS valid FROM embeddings"


def crop_bounds(spark, sf):
    mid = {n: c * 600 + 300 for n, c in G.center_scale(F.col("a"), floor=0.1).items()}
    box = G.square_crop(mid["cx"], mid["cy"], mid["scale"], 1.3, 1280.0, 720.0)
    return vectors(spark, sf).select("vec_id", *[F.col("vec_id").isNotNull().alias("known")], *[c.cast("int").alias(n) for n, c in box.items()])


CROP = f"""WITH {V}, b AS (SELECT vec_id, list_min({_X}) AS x0, list_min({_Y}) AS y0, list_max({_X}) AS x1, list_max({_Y}) AS y1 FROM v),
c AS (SELECT vec_id, (x0 + x1) / 2 * 600 + 300 AS cx, (y0 + y1) / 2 * 600 + 300 AS cy, greatest(x1 - x0, y1 - y0, 0.1) * 600 + 300 AS s FROM b), d AS (SELECT *, least(greatest(round_even(s * 1.3, 0), 1), 720) AS side FROM c),
f AS (SELECT *, least(greatest(round_even(cx - side / 2, 0), 0), 1280 - side) AS fx, least(greatest(round_even(cy - side / 2, 0), 0), 720 - side) AS fy FROM d)
SELECT vec_id, true AS known, fx::INT AS x0, fy::INT AS y0, (fx + side)::INT AS x1, (fy + side)::INT AS y1 FROM f"""


def vergence_angle(spark, sf):
    v, apart = G.vergence(G.at(F.col("a"), 0, 0), G.at(F.col("a"), 1, 0))
    return vectors(spark, sf).select("vec_id", r(v).alias("angle"), apart.alias("apart"))


VERGENCE = f"WITH {V} SELECT vec_id, round((a[3] - a[1]) * 15, 6) AS angle, (a[3] - a[1]) * 15 < -3.5 AS apart FROM v"


def pose_compensation(spark, sf):
    left, right = F.abs(G.at(F.col("a"), 0, 0)) + 0.1, F.abs(G.at(F.col("a"), 0, 1)) + 0.1
    yaw, pitch = G.at(F.col("a"), 1, 0) * 200, G.at(F.col("a"), 1, 1) * 100
    return vectors(spark, sf).select("vec_id", r(G.pose_compensated(left, right, yaw, pitch)).alias("ear"), r(G.down_glance_scale(pitch, G.at(F.col("a"), 2, 1) * 4)).alias("scale"))


COMPENSATION = f"""WITH {V}, p AS (SELECT vec_id, abs(a[1]) + 0.1 AS l, abs(a[2]) + 0.1 AS r, a[3] * 200 AS yaw, a[4] * 100 AS pitch, a[6] * 4 AS gy FROM v),
w AS (SELECT *, least(0.35, (abs(yaw) - 12) / 40) AS w FROM p)
SELECT vec_id, round(CASE WHEN abs(yaw) > 12 AND greatest(l, r) > 0.18 THEN (l + r) / 2 * (1 - w) + greatest(l, r) * w ELSE (l + r) / 2 END + CASE WHEN pitch > 6 THEN least(0.045, (pitch - 6) * 0.0025) ELSE 0 END, 6) AS ear,
round(greatest(0.65, 1 - 0.012 * greatest(0, pitch - 6, -pitch - 8) - 0.15 * greatest(0, -gy - 0.2)), 6) AS scale FROM w"""


def gamma_lookup(spark, sf):
    df = spark.range(1).select(F.posexplode(G.gamma_table(0.7)).alias("i", "out"))
    return df.select("i", "out")


GAMMA = "SELECT i::INT AS i, floor(least(255, greatest(0, pow(i / 255.0::DOUBLE, 0.7::DOUBLE) * 255)))::INT AS out FROM range(0, 256) t(i)"


def framing_rms(spark, sf):
    df = vectors(spark, sf).select("vec_id", F.posexplode(D.frames(F.col("a"), 16, 8)).alias("frame", "w"))
    return df.select("vec_id", "frame", r(D.rms(F.col("w"))).alias("rms"))


FRAMING = f"WITH {V}, f AS (SELECT vec_id, a, unnest(range(0, 7))::INT AS frame FROM v) SELECT vec_id, frame, round(sqrt(list_sum(list_transform(range(frame * 8 + 1, frame * 8 + 17), lambda i: a[i] * a[i])) / 16), 6) AS rms FROM f"


def autocorr_pitch(spark, sf):
    p = D.pitch(D.without_mean(F.col("a")), 4, 20, 0.12)
    return vectors(spark, sf).select("vec_id", p["lag"].alias("lag"), r(p["r"]).alias("r"), p["voiced"].alias("voiced"), r(D.hnr_db(p["r"])).alias("hnr"))


PITCH = f"""WITH {V}, m AS (SELECT vec_id, list_transform(a, lambda x: x - list_sum(a) / len(a)) AS a FROM v), q AS (SELECT *, list_sum(list_transform(a, lambda x: x * x)) AS p FROM m),
c AS (SELECT vec_id, list_transform(range(4, 20), lambda k: round(list_sum(list_transform(range(1, 65 - k), lambda i: a[i] * a[i + k])) / p, 9)) AS c FROM q),
b AS (SELECT vec_id, list_max(c) AS r, (list_position(c, list_max(c)) + 3)::INT AS lag FROM c)
SELECT vec_id, lag, round(r, 6) AS r, r >= 0.12 AS voiced, round(CASE WHEN least(r, 0.995) <= 0 THEN 0 ELSE greatest(0, least(35, 10 * log10(least(r, 0.995) / (1 - least(r, 0.995))))) END, 6) AS hnr FROM b"""


def _voiced(a):
    """Voiced frames made of a vector: (periods, peaks, places, correlations, centroids); every fifth frame is missing."""
    places = F.filter(F.sequence(F.lit(0), F.lit(39)), lambda i: (i % 5 != 0) | (F.get(a, 0) > 0))
    some = lambda f: F.transform(places, lambda i: f(F.get(a, i)))
    return some(lambda v: 0.008 + v / 200), some(lambda v: F.abs(v) + 0.2), places, some(lambda v: 0.7 + F.abs(v)), some(lambda v: 1500 + 900 * v)


def jitter_shimmer(spark, sf):
    periods, peaks, places, corr, cents = _voiced(F.col("a"))
    got = vectors(spark, sf).select("vec_id", D.jitter(periods, places).alias("j"), D.shimmer(peaks, places).alias("s"), D.voiced_hnr(corr).alias("h"), D.formant_slope(cents).alias("f"), F.size(places).alias("n"))
    score = D.voice_score(F.col("j"), F.col("s"), F.col("h"), F.col("f"))
    said = D.slurred(F.col("j"), F.col("s"), F.col("h"), F.col("f"), score, F.col("vec_id") % 3 > 0, F.lit(0.02), F.col("n"))
    return got.select("vec_id", r("j").alias("jitter"), r("s").alias("shimmer"), r("h").alias("hnr"), r("f").alias("slope"), r(score, 5).alias("score"), said.alias("slurred"))


def _perturb(x: str, m: str, step: str) -> str:
    """The median deviation of list ``x`` at places ``p``, in percent of ``m``."""
    each = f"CASE WHEN p[i] - p[i - 1] <= 2 {step} THEN CASE WHEN i < len({x}) AND p[i + 1] - p[i] <= 2 THEN abs({x}[i] - ({x}[i - 1] + {x}[i] + {x}[i + 1]) / 3) ELSE 0.65::DOUBLE * abs({x}[i] - {x}[i - 1]) END END"
    kept = f"list_filter(list_transform(range(2, len({x}) + 1), lambda i: {each}), lambda v: v IS NOT NULL)"
    return f"100 * CASE WHEN len({kept}) >= 2 THEN list_median({kept}) ELSE list_median(list_transform(range(2, len({x}) + 1), lambda i: abs({x}[i] - {x}[i - 1]))) END / {m}"


JITTER_SHIMMER = f"""WITH {V}, p AS (SELECT *, list_filter(range(0, 40), lambda i: i % 5 <> 0 OR a[1] > 0) AS p FROM v),
x AS (SELECT vec_id, p, list_transform(p, lambda i: 0.008::DOUBLE + a[i + 1] / 200) AS t, list_transform(p, lambda i: abs(a[i + 1]) + 0.2) AS k, list_sort(list_transform(p, lambda i: least(0.995, 0.7 + abs(a[i + 1])))) AS c, list_transform(p, lambda i: 1500 + 900 * a[i + 1]) AS f FROM p),
y AS (SELECT *, list_sum(t) / len(t) AS mt, list_sum(k) / len(k) AS mk, c[1 + floor((len(c) - 1) * 0.7)::INT] + ((len(c) - 1) * 0.7 - floor((len(c) - 1) * 0.7)) * (c[2 + floor((len(c) - 1) * 0.7)::INT] - c[1 + floor((len(c) - 1) * 0.7)::INT]) AS q,
    list_transform(range(1, len(f) + 1), lambda i: list_sort([CASE WHEN i > 1 THEN f[i - 1] ELSE 0 END, f[i], CASE WHEN i < len(f) THEN f[i + 1] ELSE 0 END])[2]) AS w FROM x),
z AS (SELECT *, list_transform(range(2, len(w) + 1), lambda i: abs(w[i] - w[i - 1])) AS d FROM y),
s AS (SELECT vec_id, len(p) AS n, greatest(0.05, least(10, {_perturb('t', 'mt', 'AND abs(t[i] - t[i - 1]) / mt < 0.18')})) AS j, greatest(0.1, least(25, {_perturb('k', 'mk', '')})) AS s, greatest(0, least(35, 10 * log10(q / greatest(1e-4, 1 - q)))) AS h,
    greatest(2, least(45, coalesce(list_aggregate(list_filter(d, lambda v: v > 5), 'quantile_cont', 0.65), list_sum(d) / len(d)) / 16 * 2)) AS f FROM z),
u AS (SELECT *, 0.35 * greatest(0, least(100, (f - 15) / (7 - 15) * 100)) + 0.25 * greatest(0, least(100, (j - 1.15) / 1.5 * 100)) + 0.20 * greatest(0, least(100, (s - 3.8) / 4.5 * 100)) + 0.20 * greatest(0, least(100, (h - 13.5) / (7.5 - 13.5) * 100)) AS raw FROM s),
g AS (SELECT *, CASE WHEN j < 1.15 THEN least(raw, 22) ELSE raw END AS score FROM u)
SELECT vec_id, round(j, 6) AS jitter, round(s, 6) AS shimmer, round(h, 6) AS hnr, round(f, 6) AS slope, round(score, 5) AS score, vec_id % 3 > 0 AND n >= 5 AND (j > 1.35)::INT + (s > 4.2)::INT + (h < 11.5)::INT + (f < 12)::INT >= 2 AND score >= 45 AS slurred FROM g"""


def dft_band_power(spark, sf):
    return vectors(spark, sf).select("vec_id", r(D.band_power(F.col("a"), 64, 30.0, 2.0, 6.0), 5).alias("power"))


BAND = f"""WITH {V}, m AS (SELECT vec_id, a, list_sum(a) / 64 AS mu, list_sum(list_transform(range(0, 64), lambda i: a[i + 1] * (i - 31.5))) / 21840 AS k FROM v),
d AS (SELECT *, list_transform(range(0, 64), lambda i: (a[i + 1] - mu - k * (i - 31.5)) * (0.5 - 0.5 * cos(2 * pi() * i / 63))) AS w FROM m),
p AS (SELECT *, list_sum(list_transform(range(5, 13), lambda b: sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: w[i + 1] * cos(2 * pi() * b * i / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: w[i + 1] * sin(2 * pi() * b * i / 64))), 2)))) AS p FROM d)
SELECT vec_id, round(CASE WHEN sqrt(list_sum(list_transform(a, lambda x: (x - mu) * (x - mu))) / 64) < 0.002 THEN 0 ELSE p END, 5) AS power FROM p"""


def centroid_slope(spark, sf):
    power = F.transform("a", lambda v: v * v)
    return vectors(spark, sf).select("vec_id", r(D.centroid(power, [50.0 * i for i in range(64)], 850.0, 2500.0), 4).alias("centroid"))


CENTROID = f"WITH {V} SELECT vec_id, round(list_sum(list_transform(range(17, 51), lambda i: a[i + 1] * a[i + 1] * 50 * i)) / list_sum(list_transform(range(17, 51), lambda i: a[i + 1] * a[i + 1])), 4) AS centroid FROM v"


def _voice(a):
    return [F.abs(G.at(a, 0, 0)) * 10 + 0.5, F.abs(G.at(a, 0, 1)) * 40, 20 - F.abs(G.at(a, 1, 0)) * 60, 25 - F.abs(G.at(a, 1, 1)) * 80]


def voice_score(spark, sf):
    signs = _voice(F.col("a"))
    device, slurred = D.telemetry_score(*signs)
    return vectors(spark, sf).select("vec_id", r(D.voice_score(*signs), 5).alias("score"), r(device, 5).alias("device_score"), slurred.alias("slurred"))


_ramp = lambda x, lo, hi: f"greatest(0, least(100, ({x} - {lo}) / ({hi} - {lo}) * 100))"
VOICE = f"""WITH {V}, s AS (SELECT vec_id, abs(a[1]) * 10 + 0.5 AS j, abs(a[2]) * 40 AS s, 20 - abs(a[3]) * 60 AS h, 25 - abs(a[4]) * 80 AS f FROM v),
t AS (SELECT *, 0.35 * {_ramp('f', '15.0', '7.0')} + 0.25 * {_ramp('j', '1.15', '2.65')} + 0.20 * {_ramp('s', '3.8', '8.3')} + 0.20 * {_ramp('h', '13.5', '7.5')} AS score,
      {_ramp('j', '1.0', '2.5')} AS dj, {_ramp('s', '3.8', '8.0')} AS ds, {_ramp('h', '14.0', '6.0')} AS dh, {_ramp('f', '16.0', '6.0')} AS df FROM s),
u AS (SELECT *, 0.30 * dj + 0.25 * ds + 0.20 * dh + 0.25 * df AS d FROM t)
SELECT vec_id, round(CASE WHEN j < 1.15 THEN least(score, 22) ELSE score END, 5) AS score, round(d, 5) AS device_score, d >= 45 AND (dj > 35)::INT + (ds > 35)::INT + (dh > 35)::INT + (df > 35)::INT >= 2 AS slurred FROM u"""


def marker_ladder(spark, sf):
    a = {n: F.abs(G.at(F.col("a"), i, 0)) * 6 for i, n in enumerate(LADDERS)}
    return vectors(spark, sf).select("vec_id", *[C.ladder(a[n], list(steps), above).alias(n) for n, (above, steps) in LADDERS.items()])


def _ladder(x: str, above: bool, steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} {'>' if above else '<'} {t} THEN {s}::DOUBLE" for t, s in steps) + " ELSE 0.0::DOUBLE END"


LADDER = f"WITH {V} SELECT vec_id, {', '.join(f'{_ladder(f'abs(a[{2 * i + 1}]) * 6', ab, st)} AS {n}' for i, (n, (ab, st)) in enumerate(LADDERS.items()))} FROM v"


#: Pictures made of vectors.
_still = lambda at: {
    "ear_left": f"0.05 + abs({at(0)}) * 2.0", "ear_right": f"0.05 + abs({at(0)}) * 2.0 + {at(1)} * 0.3", "mar": f"abs({at(2)}) * 3.0", "head_pitch": f"{at(3)} * 200.0", "head_roll": f"{at(4)} * 200.0",
    "speech_active": "vec_id % 5 = 0", "redness": f"CASE WHEN vec_id % 3 > 0 THEN 0.9 + abs({at(5)}) * 4.0 END",
}


def static_score(spark, sf):
    df = vectors(spark, sf).withColumns({n: F.expr(temporal.doubles(x)) for n, x in _still(lambda i: f"a[{i}]").items()})
    got = temporal.still_score(df, ["vec_id"], asymmetry=0.01, pitch=-2.0, roll=1.0)
    return got.select("vec_id", r("risk", 5).alias("risk"), "class", r("confidence", 5).alias("confidence"), "lockout", *[r(c, 5).alias(c) for c in got.columns if c.startswith("m_")])


_stills = ", ".join(f"{temporal.doubles(x)} AS {n}" for n, x in _still(lambda i: f"a[{i + 1}]").items())
STATIC = f"""WITH {V} SELECT vec_id, round(risk, 5) AS risk, class, round(confidence, 5) AS confidence, lockout, {', '.join(f'round(m_{n}, 5) AS m_{n}' for n in ('ptosis', 'asymmetry', 'slump', 'jaw', 'redness'))}
FROM ({temporal.as_sql(f'SELECT vec_id, {_stills} FROM v', temporal.still_stages(asymmetry=0.01, pitch=-2.0, roll=1.0))})"""


def divergence_score(spark, sf):
    a = F.col("a")
    vol, inv = F.col("vec_id") % 2 == 0, (F.col("vec_id") % 3).cast("int")
    signs = [(F.col("vec_id") % 4 == 0, 25.0), (F.col("vec_id") % 6 == 0, 25.0), (F.col("vec_id") % 5 == 0, 20.0)]
    got = C.masking_divergence(F.abs(G.at(a, 0, 0)) * 12, F.abs(G.at(a, 0, 1)) * 10, F.abs(G.at(a, 1, 0)) * 60, signs, vol, inv)
    return vectors(spark, sf).select("vec_id", r(got, 4).alias("score"), (got >= 50).alias("detected"))


DIVERGENCE = f"""WITH {V}, p AS (SELECT vec_id, abs(a[1]) * 12 AS rate, 2.5 / greatest(abs(a[2]) * 10, 0.1) AS s, abs(a[3]) * 60 AS age FROM v),
b AS (SELECT *, CASE WHEN s > 1.25 AND rate >= 0.8 THEN least(100, 50 * least(2, rate) * (s - 1.25)) ELSE 0 END AS k FROM p),
m AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 AND vec_id % 3 >= 1 THEN least(100, CASE WHEN age > 8 THEN k * exp(-(age - 8) / 5) ELSE k END + CASE WHEN vec_id % 4 = 0 THEN 25 ELSE 0 END + CASE WHEN vec_id % 6 = 0 THEN 25 ELSE 0 END + CASE WHEN vec_id % 5 = 0 THEN 20 ELSE 0 END) ELSE 0 END AS m FROM b)
SELECT vec_id, round(m, 4)::DOUBLE AS score, m >= 50 AS detected FROM m"""


def risk_class(spark, sf):
    a = F.col("a")
    rule, model = F.abs(G.at(a, 0, 0)) * 250, F.when(F.col("vec_id") % 5 != 0, F.abs(G.at(a, 0, 1)) * 250)
    df = vectors(spark, sf).withColumn("risk", C.voice_boost(C.fuse(rule, model, F.col("vec_id") % 2 == 0), F.abs(G.at(a, 1, 0)) * 300))
    kind = C.risk_class(F.col("risk"), F.abs(G.at(a, 1, 1)) * 300, F.abs(G.at(a, 2, 0)), F.col("vec_id") % 7 == 0, F.col("vec_id") % 4 == 0)
    df = df.withColumn("class", kind)
    cmd = C.command(F.col("risk") >= 70, F.col("vec_id") % 50 == 0, F.col("class"), F.col("vec_id") % 9 == 0, F.col("risk"))
    return df.select("vec_id", r("risk", 5).alias("risk"), "class", cmd.alias("command"))


RISK_CLASS = f"""WITH {V}, f AS (SELECT *, abs(a[1]) * 250 AS rule, CASE WHEN vec_id % 5 <> 0 THEN abs(a[2]) * 250 END AS model, abs(a[3]) * 300 AS voice, abs(a[4]) * 300 AS vol, abs(a[5]) AS closed FROM v),
u AS (SELECT *, CASE WHEN model IS NULL THEN rule WHEN vec_id % 2 = 0 AND rule < 20 THEN 0.85 * rule + least(12, 0.15 * model) WHEN rule >= 25 THEN 0.6 * rule + 0.4 * model ELSE 0.75 * rule + 0.25 * model END AS fused FROM f),
b AS (SELECT *, fused + CASE WHEN fused >= 40 THEN least(15, 0.2 * voice) WHEN fused >= 22 THEN least(10, 0.12 * voice) ELSE 0 END AS risk FROM u),
c AS (SELECT *, CASE WHEN risk >= 50 OR (vec_id % 7 = 0 AND risk >= 40 AND NOT vec_id % 4 = 0) THEN 'HIGH_RISK_INTOXICATED' WHEN risk >= 25 OR (vol >= 50 AND risk >= 22 AND closed > 0.08) THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END AS class FROM b)
SELECT vec_id, round(risk, 5) AS risk, class, CASE WHEN risk >= 70 OR vec_id % 50 = 0 THEN 2 WHEN class <> 'SOBER' OR (vec_id % 9 = 0 AND risk >= 25) THEN 1 ELSE 0 END AS command FROM c"""


def marker_set_overlap(spark, sf):
    active = F.array_distinct(F.transform(F.filter("a", lambda v: v > 0.2), lambda v: F.concat(F.lit("m"), F.floor(v * 20).cast("string"))))
    hard = F.array(F.lit("m5"), F.lit("m7"), F.lit("m9"))
    return vectors(spark, sf).select("vec_id", F.arrays_overlap(active, hard).alias("hard"), F.size(F.array_intersect(active, hard)).alias("n"))


OVERLAP = f"WITH {V}, m AS (SELECT vec_id, list_distinct(list_transform(list_filter(a, lambda v: v > 0.2), lambda v: 'm' || floor(v * 20)::INT)) AS m FROM v) SELECT vec_id, list_has_any(m, ['m5', 'm7', 'm9']) AS hard, len(list_intersect(m, ['m5', 'm7', 'm9']))::INT AS n FROM m"


def mean_positive_markers(spark, sf):
    return vectors(spark, sf).select("vec_id", r(C.mean_positive(F.col("a"))).alias("voluntary"))


MEAN_POSITIVE = f"WITH {V} SELECT vec_id, round(list_avg(list_filter(a, lambda v: v > 0)), 6) AS voluntary FROM v"


def rolling_feature_vector(spark, sf):
    from kymora.plans.stream_queries import S

    df = e(spark, sf).withColumn("f", F.array(F.least("x", F.lit(300.0)), (F.col("kind") == "error").cast("double")))
    df = df.withColumn("w", F.collect_list("f").over(S.rows(-29)))
    return df.select("event_id", F.size("w").alias("n"), r(F.get(F.get("w", 0), 0)).alias("oldest"), r(D.total(F.transform("w", lambda v: F.get(v, 1)))).alias("flags"))


ROLLING = f"""WITH {BASE}, w AS (SELECT event_id, list([least(x, 300), (kind = 'error')::INT::DOUBLE]) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w FROM e)
SELECT event_id, len(w)::INT AS n, round(w[1][1], 6) AS oldest, round(list_sum(list_transform(w, lambda v: v[2])), 6) AS flags FROM w"""


def json_config_overlay(spark, sf):
    """Settings over the defaults from the events' own JSON: a key that is no setting is passed over."""
    cfg = Config.from_json('{"eye_closed": 0.19, "stride_s": 0.75, "unknown": 3}')
    props = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return props.select("event_id", F.coalesce(F.when(F.col("k") >= 50, F.col("k") / 100), F.lit(cfg.eye_closed)).alias("eye_closed"), F.lit(cfg.stride_s).alias("stride_s"), F.lit(cfg.yaw_limit).alias("yaw_limit"))


CONFIG = "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 ELSE 0.19::DOUBLE END AS eye_closed, 0.75::DOUBLE AS stride_s, 35.0::DOUBLE AS yaw_limit FROM events"

QUERIES = {
    "array_ear": (array_ear, EAR),
    "array_mar": (array_mar, MAR),
    "iris_projection": (iris_projection, IRIS),
    "bbox_center_scale": (bbox_center_scale, BBOX),
    "crop_remap_roundtrip": (crop_remap_roundtrip, REMAP),
    "roll_derotate": (roll_derotate, ROLL),
    "landmark_valid": (landmark_valid, VALID),
    "crop_bounds": (crop_bounds, CROP),
    "vergence_angle": (vergence_angle, VERGENCE),
    "pose_compensation": (pose_compensation, COMPENSATION),
    "gamma_lookup": (gamma_lookup, GAMMA),
    "framing_rms": (framing_rms, FRAMING),
    "autocorr_pitch": (autocorr_pitch, PITCH),
    "jitter_shimmer": (jitter_shimmer, JITTER_SHIMMER),
    "dft_band_power": (dft_band_power, BAND),
    "centroid_slope": (centroid_slope, CENTROID),
    "voice_score": (voice_score, VOICE),
    "marker_ladder": (marker_ladder, LADDER),
    "static_score": (static_score, STATIC),
    "divergence_score": (divergence_score, DIVERGENCE),
    "risk_class": (risk_class, RISK_CLASS),
    "marker_set_overlap": (marker_set_overlap, OVERLAP),
    "mean_positive_markers": (mean_positive_markers, MEAN_POSITIVE),
    "rolling_feature_vector": (rolling_feature_vector, ROLLING),
    "json_config_overlay": (json_config_overlay, CONFIG),
}

"""Joins, summaries, gates, metrics and reports over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kymora.config import IMPAIRED
from kymora.functions import scoring as C
from kymora.keys import DAY, HOUR
from kymora.operators import aggregates as A
from kymora.operators import joins as J
from kymora.operators import metrics as M
from kymora.operators import windows as W
from kymora.plans.stream_queries import BASE, OVER, S, e, r, rows
from kymora.session import table

# ---------------------------------------------------------------- joins


def range_join_audio(spark, sf):
    df = e(spark, sf)
    left = df.where("kind = 'purchase'").select("user_id", "event_id", "us")
    right = df.where("kind = 'view'").select("user_id", F.col("us").alias("right_us"), "x")
    return J.interval(left, right, "user_id", "us", 2 * DAY, "right_us").groupBy("event_id").agg(F.count("*").alias("n"), r(F.sum("x")).alias("total"))


RANGE_JOIN = f"""WITH {BASE} SELECT a.event_id, count(*) AS n, round(sum(b.x), 6) AS total FROM e a JOIN e b
ON a.user_id = b.user_id AND a.kind = 'purchase' AND b.kind = 'view' AND b.us > a.us - {2 * DAY} AND b.us <= a.us GROUP BY 1"""


def asof_hold_join(spark, sf):
    df = e(spark, sf)
    left = df.where("kind = 'purchase'").select("user_id", "event_id", "us")
    got = J.asof(left, df.where("kind = 'view'").select("user_id", "us", "x"), "user_id", "us", "x", 2 * DAY, "held")
    return got.select("event_id", "held")


ASOF = f"""WITH {BASE}, l AS (SELECT * FROM e WHERE kind = 'purchase'), v AS (SELECT * FROM e WHERE kind = 'view')
SELECT l.event_id, CASE WHEN l.us - v.us <= {2 * DAY} THEN v.x END AS held FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.us >= v.us"""


def interval_overlap_join(spark, sf):
    df = e(spark, sf)
    spans = df.where("kind = 'error'").select("user_id", F.col("us").alias("start"), (F.col("us") + 6 * HOUR).alias("end"))
    windows = df.where("kind = 'click'").select("user_id", "event_id", (F.col("us") - 2 * DAY).alias("lo"), F.col("us").alias("hi"))
    return J.overlap(spans, windows, "user_id", 2 * DAY).select("event_id", "covered")


OVERLAP = f"""WITH {BASE}, s AS (SELECT user_id, us AS a, us + {6 * HOUR} AS b FROM e WHERE kind = 'error'),
w AS (SELECT user_id, event_id, us - {2 * DAY} AS lo, us AS hi FROM e WHERE kind = 'click')
SELECT event_id, sum(CASE WHEN a IS NULL THEN 0 ELSE greatest(0, least(b, hi) - greatest(a, lo)) END)::BIGINT AS covered FROM w LEFT JOIN s ON w.user_id = s.user_id AND b > lo AND a < hi GROUP BY 1"""


def duty_cycle_cap(spark, sf):
    got = interval_overlap_join(spark, sf)
    return got.select("event_id", r(F.col("covered") / float(2 * DAY)).alias("duty"), (F.col("covered") / float(2 * DAY) >= 0.25).alias("capped"))


DUTY = f"SELECT event_id, round(covered::DOUBLE / {2 * DAY}, 6) AS duty, covered::DOUBLE / {2 * DAY} >= 0.25 AS capped FROM ({OVERLAP})"


def broadcast_baseline_join(spark, sf):
    df = e(spark, sf)
    numbered = df.withColumn("i", F.row_number().over(S.plain()))
    base = numbered.where("i <= 15").groupBy("user_id").agg(F.percentile("x", 0.5).alias("base"), F.max("us").alias("since"))
    got = J.with_baseline(df, base, "user_id", ["base"], "since", "us")
    return got.select("event_id", r(F.col("x") - F.coalesce("base", F.lit(0.0))).alias("relative"))


BASELINE_JOIN = f"""WITH {BASE}, i AS (SELECT *, row_number() OVER {OVER} AS i FROM e), b AS (SELECT user_id, quantile_cont(x, 0.5) AS base, max(us) AS since FROM i WHERE i <= 15 GROUP BY 1)
SELECT event_id, round(x - CASE WHEN us >= since THEN base ELSE 0 END, 6) AS relative FROM e JOIN b USING (user_id)"""


def resume_anti_join(spark, sf):
    done = table(spark, sf, "labels").select("doc_id")
    return J.not_done(table(spark, sf, "documents").select("doc_id", "source"), done, ["doc_id"])


RESUME = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def valid_semi_join(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))
    return J.with_any(turns, ["conv_id"], F.col("n") > 400)


SEMI = "SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE length(text) > 400)"


def channel_equi_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    extra = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return lines.join(extra, "l_orderkey", "left").groupBy("l_linenumber").agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 2).alias("price"))


EQUI = "SELECT l_linenumber, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"


def union_by_name_fill(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit(1.0).alias("vor"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return J.union_filled([a, b, c], {"segment": "none", "vor": 1.0})


UNION = """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 1.0::DOUBLE AS vor, 0.0::DOUBLE AS price FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'none', 1.0, 0.0 FROM supplier UNION ALL SELECT p_partkey, 0.0, 'none', 1.0, p_retailprice FROM part"""

# ---------------------------------------------------------------- gates


def pose_gate_reason(spark, sf):
    df = e(spark, sf).withColumn("yaw", F.col("k") - 50.0).withColumn("pitch", F.pmod(F.col("x") * 1.371713, F.lit(70.0)) - 35)
    ok, why = C.pose_gate(F.col("yaw"), F.col("pitch"), 35.0, -30.0, 25.0)
    df = df.withColumns({"valid": ok, "reason": why})
    return df.select("event_id", "valid", "reason", r(W.last_known(F.when(F.col("valid"), F.col("yaw")), S.rows())).alias("last_yaw"))


POSE_GATE = f"""WITH {BASE}, p AS (SELECT *, k - 50.0::DOUBLE AS yaw, fmod(x * 1.371713::DOUBLE, 70.0) - 35 AS pitch FROM e), v AS (SELECT *, abs(yaw) <= 35 AND pitch BETWEEN -30 AND 25 AS valid FROM p)
SELECT event_id, valid, CASE WHEN abs(yaw) > 35 THEN 'yaw ' || printf('%.1f', yaw) WHEN NOT pitch BETWEEN -30 AND 25 THEN 'pitch ' || printf('%.1f', pitch) ELSE '' END AS reason,
round(last_value(CASE WHEN valid THEN yaw END IGNORE NULLS) OVER {rows(-1)}, 6) AS last_yaw FROM v"""


def vibration_sessions(spark, sf):
    df = e(spark, sf).where("x > 60").withColumn("new", (F.col("us") - F.lag("us").over(S.plain()) > 2 * DAY).cast("int"))
    df = df.withColumn("session", F.coalesce(F.sum("new").over(S.rows()), F.lit(0)))
    got = df.groupBy("user_id", "session").agg(F.min("us").alias("start"), F.max("us").alias("stop"), F.count("*").alias("n"))
    return got.withColumn("continuous", F.col("stop") - F.col("start") >= 3 * DAY)


SESSIONS = f"""WITH {BASE}, h AS (SELECT * FROM e WHERE x > 60), n AS (SELECT *, (us - lag(us) OVER {OVER} > {2 * DAY})::INT AS new FROM h),
s AS (SELECT *, coalesce(sum(new) OVER {rows(-1)}, 0)::BIGINT AS session FROM n)
SELECT user_id, session, min(us) AS start, max(us) AS stop, count(*) AS n, max(us) - min(us) >= {3 * DAY} AS continuous FROM s GROUP BY 1, 2"""


def scene_cut_segments(spark, sf):
    prev, w = F.lag("x").over(S.plain()), S.rows()
    df = e(spark, sf).withColumn("cut", F.coalesce(F.abs(F.col("x") - prev) > 180, F.lit(False)) | F.coalesce(F.abs(F.col("k") - F.lag("k").over(S.plain())) > 90, F.lit(False)))
    return df.withColumn("segment_id", F.sum(F.col("cut").cast("int")).over(w)).select("event_id", "cut", F.col("segment_id").cast("bigint").alias("segment_id"))


CUTS = f"""WITH {BASE}, c AS (SELECT *, coalesce(abs(x - lag(x) OVER {OVER}) > 180, false) OR coalesce(abs(k - lag(k) OVER {OVER}) > 90, false) AS cut FROM e)
SELECT event_id, cut, (sum(cut::INT) OVER {rows(-1)})::BIGINT AS segment_id FROM c"""


def occlusion_segments(spark, sf):
    df = W.run_length(e(spark, sf), S, F.col("x") < 60, "misses")
    return df.withColumn("segment", F.sum((F.col("misses") == 4).cast("int")).over(S.rows())).select("event_id", F.col("segment").cast("bigint").alias("segment"))


OCCLUSION = f"""WITH {BASE}, g AS (SELECT *, sum(CASE WHEN NOT x < 60 THEN 1 ELSE 0 END) OVER {rows(-1)} AS grp FROM e),
n AS (SELECT *, sum(CASE WHEN x < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, (sum((run = 4)::INT) OVER {rows(-1)})::BIGINT AS segment FROM n"""


def quarantine_filter(spark, sf):
    name = F.lower("url")
    bad = name.startswith("https://") & (name.rlike("blog|shop|ref=|/fr/") | F.col("url").contains("#top"))
    return table(spark, sf, "pages").where(~bad).select("page_id", "url")


QUARANTINE = "SELECT page_id, url FROM pages WHERE NOT (starts_with(lower(url), 'https://') AND (regexp_matches(lower(url), 'blog|shop|ref=|/fr/') OR contains(url, '#top')))"


def clip_discovery(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.where(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).isin("html", "htm", "php")).select("page_id", "url", F.lit("sober").alias("label"))


DISCOVERY = "SELECT page_id, url, 'sober' AS label FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'php')"


def subject_id_regex(spark, sf):
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1), r"\.[A-Za-z]+$", "")
    parent = F.regexp_extract("url", r"://(?:[a-z]+\.)?([a-z0-9-]+)\.", 1)
    plain = F.regexp_replace(stem, r"(?i)(_clip|_part|_seg|-|_)\d+$", "")
    return table(spark, sf, "pages").select("page_id", F.when(plain.rlike(r"^\d*$"), parent).otherwise(plain).alias("subject"))


SUBJECT_ID = """WITH s AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '\\.[A-Za-z]+$', '') AS stem FROM pages),
p AS (SELECT page_id, regexp_replace(stem, '(?i)(_clip|_part|_seg|-|_)\\d+$', '') AS plain, regexp_extract(url, '://(?:[a-z]+\\.)?([a-z0-9-]+)\\.', 1) AS parent FROM s)
SELECT page_id, CASE WHEN regexp_matches(plain, '^\\d*$') THEN parent ELSE plain END AS subject FROM p"""


def label_alias(spark, sf):
    docs = table(spark, sf, "documents")
    names = F.array(F.lit(" Drunk"), F.lit("sober"), F.lit("IMPAIRED "), F.lit("other"))
    text = F.element_at(names, (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return docs.select("doc_id", C.label_of(text, IMPAIRED).alias("label"))


LABEL_ALIAS = f"""SELECT doc_id, (lower(trim([' Drunk', 'sober', 'IMPAIRED ', 'other'][doc_id % 4 + 1])) IN ({", ".join(repr(x) for x in IMPAIRED)}))::INT AS label FROM documents"""

# ---------------------------------------------------------------- summaries


def window_seven_stats(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("valid", F.col("l_returnflag") != "R")
    channels = {"quantity": F.when(F.col("valid"), F.col("l_quantity")), "discount": F.when(F.col("valid"), F.col("l_discount")), "tax": F.when(F.col("valid") & (F.col("l_linestatus") == "F"), F.col("l_tax"))}
    got = A.derived_ratios(A.seven_stats(df, ["l_suppkey"], channels), "quantity", "discount", "tax")
    return got.select("l_suppkey", *[r(c, 6).alias(c) for c in got.columns if c != "l_suppkey"])


def _seven(n: str, c: str) -> str:
    stat = lambda f: f"coalesce({f}, 0)"
    parts = {"mean": f"avg({c})", "std": f"stddev_pop({c})", "min": f"min({c})", "max": f"max({c})", "p10": f"quantile_cont({c}, 0.1)", "p50": f"quantile_cont({c}, 0.5)", "p90": f"quantile_cont({c}, 0.9)"}
    return ", ".join(f"{stat(f)} AS {n}_{s}" for s, f in parts.items())


_CHANNELS = {"quantity": "q", "discount": "d", "tax": "t"}
SEVEN = f"""WITH v AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS q, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS d,
CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_tax END AS t FROM lineitem),
s AS (SELECT l_suppkey, {", ".join(_seven(n, c) for n, c in _CHANNELS.items())} FROM v GROUP BY 1)
SELECT l_suppkey, {", ".join(f"round({n}_{x}, 6) AS {n}_{x}" for n in _CHANNELS for x in A.STATS)}, round(quantity_p90 - quantity_p10, 6) AS aperture_range,
round(quantity_mean / greatest(quantity_p90, 0.15), 6) AS normalized_mean, round(discount_mean / greatest(tax_mean, 0.10), 6) AS up_down_ratio FROM s"""


def silent_neutral(spark, sf):
    df = table(spark, sf, "orders").withColumn("voiced", (F.col("o_orderstatus") == "O").cast("double"))
    got = A.seven_stats(df, ["o_custkey"], {"price": F.col("o_totalprice"), "voiced": F.col("voiced")})
    got = A.neutral_where(got, F.col("voiced_mean") < 0.20, {"price": 20.0})
    return got.select("o_custkey", *[r(f"price_{x}", 4 if x == "std" else 7).alias(f"price_{x}") for x in A.STATS])


SILENT = f"""WITH s AS (SELECT o_custkey, {_seven("price", "o_totalprice")}, avg((o_orderstatus = 'O')::INT) AS v FROM orders GROUP BY 1)
SELECT o_custkey, {", ".join(f"round(CASE WHEN v < 0.2 THEN {0.0 if x == 'std' else 20.0} ELSE price_{x} END, {4 if x == 'std' else 7}) AS price_{x}" for x in A.STATS)} FROM s"""


def subject_delta(spark, sf):
    df = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("price"))
    got = A.subject_delta(df, "o_custkey", ["price"])
    return got.select("o_custkey", "o_orderpriority", r("price_delta_base", 6).alias("price_delta_base"))


DELTA = """WITH a AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, round(p - quantile_cont(p, 0.9) OVER (PARTITION BY o_custkey), 6) AS price_delta_base FROM a"""


def personal_baselines(spark, sf):
    df = e(spark, sf).withColumn("z", F.col("x") / 400)
    kinds = {"level": (F.col("z"), (F.col("kind") != "error") & (F.col("z") > 0.05)), "speed": (F.col("z") * 8, (F.col("kind") == "click") & (F.col("z") > 0.02)), "asym": (F.col("k") / 1000.0, F.col("kind") == "view")}
    got = A.ingress_guard(A.conditional_medians(df, "user_id", kinds, S.order, 20), "level", "speed", "asym", "n_speed")
    return got.select("user_id", "ingress", *[r(c, 9).alias(c) for c in ("level", "speed", "asym", "level_base", "speed_base", "asym_base")])


PERSONAL = f"""WITH {BASE}, z AS (SELECT *, x / 400 AS z FROM e),
m AS (SELECT *, CASE WHEN kind <> 'error' AND z > 0.05 THEN z END AS level, CASE WHEN kind = 'click' AND z > 0.02 THEN z * 8 END AS speed, CASE WHEN kind = 'view' THEN k / 1000.0::DOUBLE END AS asym FROM z),
c AS (SELECT *, count(level) OVER l AS cl, count(speed) OVER l AS cs, count(asym) OVER l AS ca FROM m WINDOW l AS (PARTITION BY user_id ORDER BY us DESC, event_id DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT user_id, quantile_cont(level, 0.5) FILTER (cl <= 20) AS level, quantile_cont(speed, 0.5) FILTER (cs <= 20) AS speed, quantile_cont(asym, 0.5) FILTER (ca <= 20) AS asym, count(speed) FILTER (cs <= 20) AS n FROM c GROUP BY 1),
b AS (SELECT *, (level < 0.25 AND speed < 1.8 AND n >= 3) OR level < 0.21 OR asym > 0.08 AS ingress FROM a)
SELECT user_id, ingress, round(level, 9) AS level, round(speed, 9) AS speed, round(asym, 9) AS asym, round(CASE WHEN ingress THEN 0.28 ELSE least(greatest(level, 0.25), 0.38) END, 9) AS level_base,
round(CASE WHEN ingress THEN 2.5 ELSE least(greatest(speed, 1.8), 3.2) END, 9) AS speed_base, round(least(asym, 0.05), 9) AS asym_base FROM b"""


def calibration_trigger(spark, sf):
    df = e(spark, sf).withColumn("n", F.sum((F.col("kind") != "error").cast("int")).over(S.rows()))
    df = df.withColumn("lasted", F.col("us") - F.min("us").over(S.whole()))
    return df.groupBy("user_id").agg(F.min(F.when((F.col("lasted") >= 10 * DAY) & (F.col("n") >= 30), F.col("us"))).alias("calibrated_us"))


TRIGGER = f"""WITH {BASE}, n AS (SELECT *, sum((kind <> 'error')::INT) OVER {rows(-1)} AS n, us - min(us) OVER (PARTITION BY user_id) AS lasted FROM e)
SELECT user_id, min(CASE WHEN lasted >= {10 * DAY} AND n >= 30 THEN us END) AS calibrated_us FROM n GROUP BY 1"""


def signal_rollup_verdict(spark, sf):
    """The smallest whole path: closed share, dispersion, class per row, roll-up and verdict per subject."""
    df = e(spark, sf)
    df = W.closed_ratio(df, S, F.col("x") < 40, 30, 5, "perclos")
    df = W.dispersion_held(df, S, "x", F.col("kind") != "error", 20, 5, "dispersion")
    risk = F.least(F.lit(100.0), 60 * F.col("perclos") + F.when(F.col("dispersion") < 60, 20.0).otherwise(0.0))
    df = df.withColumns({"valid": F.col("kind") != "error", "risk": risk})
    kind = F.when(F.col("risk") >= 50, "H").when(F.col("risk") >= 25, "M").otherwise("S")
    agg = df.withColumn("class", kind).groupBy("user_id").agg(
        F.count_if(F.col("class") == "H").alias("high"), F.count_if(F.col("class") == "M").alias("mild"), F.count_if("valid").alias("n_valid"),
        F.count_if((F.col("risk") >= 60)).alias("lockouts"), F.avg(F.when(F.col("valid"), F.col("risk"))).alias("mean_risk"), F.max("dispersion").alias("top_dispersion"),
    )
    said = A.verdict(F.col("high"), F.col("mild"), F.col("lockouts"), F.col("n_valid"), F.col("mean_risk"))
    return agg.select("user_id", "high", "mild", "n_valid", "lockouts", r("mean_risk", 5).alias("mean_risk"), r("top_dispersion", 5).alias("top_dispersion"), said.alias("verdict"))


ROLLUP = f"""WITH {BASE}, p AS (SELECT *, sum((x < 40)::INT) OVER {rows(29)}::DOUBLE / greatest(count(*) OVER {rows(29)}, 5) AS perclos, kind <> 'error' AS o FROM e),
d AS (SELECT *, CASE WHEN o THEN CASE WHEN count(*) OVER w >= 5 THEN stddev_pop(x) OVER w ELSE 0 END END AS v FROM p WINDOW w AS (PARTITION BY user_id, o ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER {rows(-1)}, 0) AS dispersion FROM d), k AS (SELECT *, least(100, 60 * perclos + CASE WHEN dispersion < 60 THEN 20 ELSE 0 END) AS risk FROM h),
a AS (SELECT user_id, count(*) FILTER (risk >= 50) AS high, count(*) FILTER (risk >= 25 AND risk < 50) AS mild, count(*) FILTER (o) AS n_valid, count(*) FILTER (risk >= 60) AS lockouts, avg(risk) FILTER (o) AS mean_risk, max(dispersion) AS top_dispersion FROM k GROUP BY 1)
SELECT user_id, high, mild, n_valid, lockouts, round(mean_risk, 5) AS mean_risk, round(top_dispersion, 5) AS top_dispersion, CASE WHEN lockouts >= 5 OR high / greatest(n_valid, 1)::DOUBLE >= 0.10 THEN 'HIGH_RISK_INTOXICATED'
WHEN mild / greatest(n_valid, 1)::DOUBLE >= 0.25 OR mean_risk >= 25 THEN 'MILD_IMPAIRMENT' ELSE 'SOBER' END AS verdict FROM a"""


def audit_status(spark, sf):
    df = e(spark, sf).withColumn("cut", F.coalesce(F.abs(F.col("x") - F.lag("x").over(S.plain())) > 250, F.lit(False)))
    agg = df.groupBy("user_id").agg((100 * F.count_if(F.col("kind") != "error") / F.count("*")).alias("face"), (100 * F.count_if(F.col("x") > 20) / F.count("*")).alias("ungated"), F.count_if("cut").alias("cuts"))
    return agg.select("user_id", r("face").alias("face"), r("ungated").alias("ungated"), "cuts", A.audit_status(F.col("face"), F.col("ungated"), F.col("cuts")).alias("status"))


AUDIT = f"""WITH {BASE}, c AS (SELECT *, coalesce(abs(x - lag(x) OVER {OVER}) > 250, false) AS cut FROM e),
a AS (SELECT user_id, 100 * count(*) FILTER (kind <> 'error') / count(*)::DOUBLE AS face, 100 * count(*) FILTER (x > 20) / count(*)::DOUBLE AS ungated, count(*) FILTER (cut) AS cuts FROM c GROUP BY 1)
SELECT user_id, round(face, 6) AS face, round(ungated, 6) AS ungated, cuts, CASE WHEN face < 65 OR ungated < 50 THEN 'REJECTED_LOW_FACE' WHEN cuts >= 2 THEN 'WARNING_JUMP_CUTS' ELSE 'ACCEPTED' END AS status FROM a"""


def dataset_totals(spark, sf):
    got = table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    return got


TOTALS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"


def auto_stride(spark, sf):
    counts = table(spark, sf, "labels").groupBy("toxic").agg(F.count("*").alias("n"))
    return A.balanced_stride(counts, "toxic", "n").select("toxic", "n", r("stride").alias("stride"))


STRIDE = "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, n, round(CASE WHEN n = max(n) OVER () THEN 1.5 ELSE greatest(0.5, least(1.5, 1.5 * n / max(n) OVER ())) END, 6)::DOUBLE AS stride FROM c"


def class_weights(spark, sf):
    got = table(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 0).alias("n_neg"), F.count_if(F.col("toxic") == 1).alias("n_pos"), F.countDistinct("doc_id").alias("subjects"))
    return got.withColumn("pos_weight", r(F.col("n_neg") / F.greatest("n_pos", F.lit(1))))


WEIGHTS = "SELECT count(*) FILTER (toxic = 0) AS n_neg, count(*) FILTER (toxic = 1) AS n_pos, count(DISTINCT doc_id) AS subjects, round(count(*) FILTER (toxic = 0) / greatest(count(*) FILTER (toxic = 1), 1)::DOUBLE, 6) AS pos_weight FROM labels"


def modal_length(spark, sf):
    counts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    return counts.orderBy((F.col("n") == 90).desc(), F.desc("times"), "n").limit(1)


MODE = "WITH a AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), c AS (SELECT n, count(*) AS times FROM a GROUP BY 1) SELECT n, times FROM c ORDER BY n = 90 DESC, times DESC, n LIMIT 1"

# ---------------------------------------------------------------- metrics


def _scored(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("score"))
    return docs.join(labels, "doc_id")


SCORED = "s AS (SELECT doc_id, source, n_chars, least(1.0::DOUBLE, n_chars / 6000.0::DOUBLE) AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"


def confusion_metrics(spark, sf):
    got = M.confusion(_scored(spark, sf), "toxic", "score", 0.5)
    return got.select("tp", "fp", "tn", "fn", *[r(c).alias(c) for c in ("sensitivity", "specificity", "f1", "accuracy", "balanced_accuracy")])


CONFUSION = f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND toxic = 1) AS tp, count(*) FILTER (score >= 0.5 AND toxic = 0) AS fp, count(*) FILTER (score < 0.5 AND toxic = 0) AS tn, count(*) FILTER (score < 0.5 AND toxic = 1) AS fn FROM s)
SELECT tp, fp, tn, fn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1,
round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS accuracy, round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 6) AS balanced_accuracy FROM c"""


def roc_auc(spark, sf):
    return M.roc_auc(_scored(spark, sf), "toxic", "score").select(r("roc_auc").alias("roc_auc"))


ROC = f"""WITH {SCORED}, k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s), n AS (SELECT sum(toxic) AS p, sum(1 - toxic) AS n, sum(rk) FILTER (toxic = 1) AS t FROM k)
SELECT round((t - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM n"""


def average_precision(spark, sf):
    return M.average_precision(_scored(spark, sf), "toxic", "score").select(r("average_precision").alias("average_precision"))


AVERAGE_PRECISION = f"""WITH {SCORED}, t AS (SELECT score, sum(toxic) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS n_all FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(p * tp / n_all::DOUBLE) / sum(p), 6) AS average_precision FROM c"""


def youden_threshold(spark, sf):
    got = M.youden(_scored(spark, sf), "toxic", "score")
    return got.select(r("threshold").alias("threshold"), r("sensitivity").alias("sensitivity"), r("specificity").alias("specificity"), r("youden").alias("youden"))


YOUDEN = f"""WITH {SCORED}, t AS (SELECT (unnest(range(10, 86)) / 100.0)::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND toxic = 1) / count(*) FILTER (toxic = 1)::DOUBLE AS sensitivity,
count(*) FILTER (score < threshold AND toxic = 0) / count(*) FILTER (toxic = 0)::DOUBLE AS specificity FROM t CROSS JOIN s GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(sensitivity + specificity - 1, 6) AS youden FROM c ORDER BY round(sensitivity + specificity - 1, 12) DESC, c.threshold LIMIT 1"""


def cohens_d_topk(spark, sf):
    df = _scored(spark, sf).withColumns({"log_n": F.log1p(F.col("n_chars").cast("double")), "late": (F.col("doc_id") % 7).cast("double")})
    return M.cohens_d(df, "toxic", ["n_chars", "score", "log_n", "late", "quality"]).select("feature", r("d").alias("d")).orderBy(F.desc("d"), "feature").limit(4)


COHEN = f"""WITH {SCORED}, f AS (SELECT toxic, n_chars::DOUBLE AS n_chars, score, ln(1 + n_chars::DOUBLE) AS log_n, (doc_id % 7)::DOUBLE AS late, quality::DOUBLE AS quality FROM s),
u AS (UNPIVOT f ON n_chars, score, log_n, late, quality INTO NAME feature VALUE v), g AS (SELECT feature, avg(v) FILTER (toxic = 1) AS m1, avg(v) FILTER (toxic = 0) AS m0, (var_pop(v) FILTER (toxic = 1) + var_pop(v) FILTER (toxic = 0)) / 2 AS p FROM u GROUP BY 1)
SELECT feature, round(CASE WHEN p > 1e-6 THEN abs(m1 - m0) / sqrt(p) ELSE 0 END, 6) AS d FROM g ORDER BY d DESC, feature LIMIT 4"""


def subject_quota_downsample(spark, sf):
    got = M.downsample_by_subject(_scored(spark, sf), "toxic", "source", "doc_id")
    return got.groupBy("source", "toxic").agg(F.count("*").alias("n"))


QUOTA = f"""WITH {SCORED}, g AS (SELECT source, count(*) FILTER (toxic = 0) AS n, count(*) FILTER (toxic = 1) AS p FROM s GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS neg, sum(p) OVER () AS pos FROM g),
q AS (SELECT source, n, p, CASE WHEN neg > 1.5 * pos THEN least(n, greatest(1, round_even(floor(1.25 * pos) * n / neg::DOUBLE, 0)::BIGINT)) ELSE n END AS q FROM t)
SELECT source, 0 AS toxic, q AS n FROM q WHERE q > 0 UNION ALL SELECT source, 1, p FROM q WHERE p > 0"""


def group_kfold(spark, sf):
    return M.group_folds(_scored(spark, sf), "quality", "source", 3)


def telemetry_tumbling(spark, sf):
    ev = table(spark, sf, "events").groupBy(F.window(F.col("ts"), "1 day").alias("w")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))
    return ev.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "mean")


TELEMETRY = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"


def session_counts(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("new", (F.col("role") != F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).cast("int"))
    return turns.groupBy("conv_id").agg((1 + F.sum("new")).alias("runs"), F.count("*").alias("n")).select("conv_id", F.coalesce("runs", F.lit(1)).cast("bigint").alias("runs"), "n")


SESSION_COUNTS = "WITH c AS (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS new FROM conversations) SELECT conv_id, (1 + coalesce(sum(new), 0))::BIGINT AS runs, count(*) AS n FROM c GROUP BY 1"


def top_devices(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf, "supplier").withColumn("place", F.row_number().over(w)).where("place <= 3").select("s_nationkey", "place", "s_suppkey")


DEVICES = "SELECT * FROM (SELECT s_nationkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))::INT AS place, s_suppkey FROM supplier) WHERE place <= 3"


def json_summary(spark, sf):
    agg = e(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    return agg.select("user_id", F.to_json(F.struct(F.col("n").alias("rows"), F.struct("errors").alias("section_a"))).alias("summary"))


SUMMARY = f"WITH {BASE} SELECT user_id, to_json({{rows: count(*), section_a: {{errors: count(*) FILTER (kind = 'error')}}}})::VARCHAR AS summary FROM e GROUP BY 1"


def text_report(spark, sf):
    agg = e(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("x") > 100).alias("hits"))
    bar = F.least(F.lit(30), F.floor(30 * F.col("hits") / F.col("n"))).cast("int")
    return agg.select("user_id", F.concat_ws("\n", F.format_string("Subject %d", "user_id"), F.format_string("Rows %d", "n"), F.concat(F.repeat(F.lit("#"), bar), F.repeat(F.lit("-"), 30 - bar))).alias("report"))


REPORT = f"""WITH {BASE}, a AS (SELECT user_id, count(*) AS n, count(*) FILTER (x > 100) AS h FROM e GROUP BY 1), b AS (SELECT *, least(30, floor(30 * h / n::DOUBLE))::INT AS b FROM a)
SELECT user_id, 'Subject ' || user_id || chr(10) || 'Rows ' || n || chr(10) || repeat('#', b) || repeat('-', 30 - b) AS report FROM b"""


def stale_frames(spark, sf):
    df = e(spark, sf).withColumn("seq", F.floor(F.col("us") / (6 * HOUR)))
    return df.groupBy("user_id", "seq").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"), F.max_by("x", F.struct("us", "event_id")).alias("latest"))


STALE = f"WITH {BASE} SELECT user_id, us // {6 * HOUR} AS seq, arg_min(event_id, (us, event_id)) AS event_id, arg_max(x, (us, event_id)) AS latest FROM e GROUP BY 1, 2"

QUERIES = {
    "signal_rollup_verdict": (signal_rollup_verdict, ROLLUP),
    "range_join_audio": (range_join_audio, RANGE_JOIN),
    "asof_hold_join": (asof_hold_join, ASOF),
    "interval_overlap_join": (interval_overlap_join, OVERLAP),
    "duty_cycle_cap": (duty_cycle_cap, DUTY),
    "broadcast_baseline_join": (broadcast_baseline_join, BASELINE_JOIN),
    "resume_anti_join": (resume_anti_join, RESUME),
    "valid_semi_join": (valid_semi_join, SEMI),
    "channel_equi_join": (channel_equi_join, EQUI),
    "union_by_name_fill": (union_by_name_fill, UNION),
    "pose_gate_reason": (pose_gate_reason, POSE_GATE),
    "vibration_sessions": (vibration_sessions, SESSIONS),
    "scene_cut_segments": (scene_cut_segments, CUTS),
    "occlusion_segments": (occlusion_segments, OCCLUSION),
    "quarantine_filter": (quarantine_filter, QUARANTINE),
    "clip_discovery": (clip_discovery, DISCOVERY),
    "subject_id_regex": (subject_id_regex, SUBJECT_ID),
    "label_alias": (label_alias, LABEL_ALIAS),
    "window_seven_stats": (window_seven_stats, SEVEN),
    "silent_neutral": (silent_neutral, SILENT),
    "subject_delta": (subject_delta, DELTA),
    "personal_baselines": (personal_baselines, PERSONAL),
    "calibration_trigger": (calibration_trigger, TRIGGER),
    "audit_status": (audit_status, AUDIT),
    "dataset_totals": (dataset_totals, TOTALS),
    "auto_stride": (auto_stride, STRIDE),
    "class_weights": (class_weights, WEIGHTS),
    "modal_length": (modal_length, MODE),
    "confusion_metrics": (confusion_metrics, CONFUSION),
    "roc_auc": (roc_auc, ROC),
    "average_precision": (average_precision, AVERAGE_PRECISION),
    "youden_threshold": (youden_threshold, YOUDEN),
    "cohens_d_topk": (cohens_d_topk, COHEN),
    "subject_quota_downsample": (subject_quota_downsample, QUOTA),
    "group_kfold": (group_kfold, None),
    "telemetry_tumbling": (telemetry_tumbling, TELEMETRY),
    "session_counts": (session_counts, SESSION_COUNTS),
    "top_devices": (top_devices, DEVICES),
    "json_summary": (json_summary, SUMMARY),
    "text_report": (text_report, REPORT),
    "stale_frames": (stale_frames, STALE),
}

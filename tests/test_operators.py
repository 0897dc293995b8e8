"""Analytic checks, state machines, streams and files."""

import io
import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymora.config import Config
from kymora.functions import geometry as G
from kymora.functions import signal as D
from kymora.keys import DAY, Stream, micros
from kymora.operators import folds as X
from kymora.operators import joins as J
from kymora.operators import metrics as M
from kymora.operators import windows as W
from kymora.operators.learning import augment_minority
from kymora.sources import files
from kymora.streaming.processors import drain, fresh, sessions, stateful, telemetry

S = Stream(subject=("u",), us="us", tie=None)


def stream(spark, rows, extra=""):
    return spark.createDataFrame(rows, "u int, us long, x double" + extra)


def test_time_does_not_depend_on_the_session_zone(spark):
    sql = "SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.123456' AS ts"
    want = 1711852200123456
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert spark.sql(sql).select(micros("ts")).first()[0] == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parabola_acceleration_is_exact(spark):
    ts = [0.0, 0.020, 0.055, 0.085, 0.120]
    df = stream(spark, [(1, int(t * 1e6), 0.5 * 3200 * t * t) for t in ts])
    got = W.quadratic_acceleration(df, S, "x", 5, "a").orderBy("us").collect()
    assert got[0]["a"] == 0 and math.isclose(got[-1]["a"], 3200, rel_tol=1e-6)


def test_angles_wrap(spark):
    assert [r[0] for r in spark.createDataFrame([(350.0,), (-350.0,), (190.0,), (0.0,)], "d double").select(W.wrap_degrees(F.col("d"))).collect()] == [-10.0, 10.0, -170.0, 0.0]


def test_eye_aspect_ratio(spark):
    pts = [0, 0, 10, -6, 30, -6, 40, 0, 30, 6, 10, 6]
    df = spark.createDataFrame([([float(v) for v in pts],), ([0.0] * 12,)], "a array<double>")
    assert [r[0] for r in df.select(G.aspect_ratio(F.col("a"), (0, 3), [(1, 5), (2, 4)])).collect()] == [0.3, 0.0]


def test_windows_hold_both_ends(spark):
    df = stream(spark, [(1, i * 1_000_000, float(i)) for i in range(10)])
    got = W.sliding_windows(df, S, 3_000_000, 2_000_000).groupBy("window_id").agg(F.collect_set("x").alias("x")).collect()
    assert {r["window_id"]: set(r["x"]) for r in got} == {k: {2.0 * k + i for i in range(4)} for k in range(4)}


def test_interpolation_keeps_two_and_drops_the_tail(spark):
    rows = [(1, i, x) for i, x in enumerate([9.0, 1.0, 9.0, 9.0, 9.0, 4.0, 9.0])]
    got = W.interpolate_gated(stream(spark, rows), S, "x", F.col("x") == 9.0).orderBy("us").collect()
    assert [(r["us"], r["x"]) for r in got] == [(0, 1.0), (1, 1.0), (3, 2.0), (4, 3.0), (5, 4.0)]


def test_gated_rows_do_not_change_later_windows(spark):
    rows = [(1, i, float(i % 7)) for i in range(60)]
    base = W.closed_ratio(stream(spark, rows), S, F.col("x") < 3, 10, 5, "p").collect()
    gated = stream(spark, rows + [(1, 1000 + i, 0.0) for i in range(5)]).where("us < 1000")
    assert W.closed_ratio(gated, S, F.col("x") < 3, 10, 5, "p").collect() == base


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([(1, 10), (1, 50), (2, 10)], "u int, us long")
    right = spark.createDataFrame([(1, 5, 1.5), (1, 10, 2.5), (1, 20, 3.5)], "u int, us long, v double")
    got = {(r["u"], r["us"]): r["held"] for r in J.asof(left, right, "u", "us", "v", 25, "held").collect()}
    assert got == {(1, 10): 2.5, (1, 50): None, (2, 10): None}
    near = J.interval(left, right.select("u", F.col("us").alias("at"), "v"), "u", "us", 8, "at").collect()
    assert sorted((r["us"], r["at"]) for r in near) == [(10, 5), (10, 10)]


def test_metrics_on_known_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()[0] == 0.875
    assert math.isclose(M.average_precision(df, "y", "s").first()[0], 0.5 + 0.5 * 2 / 3)
    best = M.youden(df, "y", "s").first()
    assert (best["threshold"], best["sensitivity"], best["specificity"]) == (0.11, 1.0, 0.5)
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 400)) / 400) for _ in range(3000)]
    many = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [[s for y, s in rows if y == c] for c in (1, 0)]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(M.roc_auc(many, "y", "s").first()[0], want, rel_tol=1e-12)


def test_folds_take_whole_groups_and_both_classes(spark):
    with pytest.raises(ValueError):
        M.fold_plan([(5, 5, 1), (5, 0, 1)], 2)
    rows = [(f"g{i}", c) for i in range(40) for c in [0] * (2 + i % 3) + [1] * (1 + i % 2)]
    got = M.group_folds(spark.createDataFrame(rows, "g string, y int"), "y", "g", 5).collect()
    assert len(got) == 40 and {r["fold"] for r in got} == set(range(5))
    fold = {r["g"]: r["fold"] for r in got}
    shares = [sum(y for g, y in rows if fold[g] == j) / sum(y for _, y in rows) for j in range(5)]
    assert max(shares) - min(shares) < 0.08


def test_voice_of_steady_and_shaky_pitch(spark):
    from kymora.operators.voice import voice_features

    rng, t = np.random.default_rng(42), np.arange(16_000) / 16_000
    steady = sum(0.2 / k * np.sin(2 * np.pi * 130 * k * t) for k in range(1, 9))
    phase = np.cumsum(130 * (1 + 0.15 * np.repeat(rng.uniform(-1, 1, 63), 256)[:16_000])) / 16_000
    shaky = sum(0.2 / k * np.sin(2 * np.pi * k * phase) for k in range(1, 9)) * np.repeat(rng.uniform(0.5, 1.5, 63), 256)[:16_000] + rng.normal(0, 0.05, 16_000)
    rows = [(1, steady.tolist(), True), (2, shaky.tolist(), True), (3, steady.tolist(), False), (4, [0.0] * 16_000, True), (5, [], True), (6, None, True)]
    got = {r["id"]: r for r in voice_features(spark.createDataFrame(rows, "id int, x array<double>, lips boolean"), ["id"], "x", "lips").collect()}
    assert got[1]["valid"] and got[1]["jitter"] < 1.15 and got[1]["score"] <= 22 and not got[1]["slurred"]
    assert got[2]["valid"] and got[2]["jitter"] > got[1]["jitter"] and got[2]["shimmer"] > got[1]["shimmer"] and got[2]["hnr"] < got[1]["hnr"]
    assert not any(got[i]["valid"] for i in (3, 4, 5, 6)) and got[6]["score"] is None


def test_evidence_latches_and_unlatches():
    m = X.evidence()
    state, out = m.first, None
    for i in range(400):
        state, out = m.step(state, (i * 100_000, 95.0, True, True, False))
    assert out[3] and out[0] <= 12 and out[1] > 0.999
    for i in range(400, 420):
        state, out = m.step(state, (i * 100_000, 0.0, True, False, False))
    assert out[3]
    assert m.step(state, (42_000_000, 0.0, True, False, True))[1][3] is False


def test_unobserved_rows_leave_the_evidence():
    m = X.evidence()
    state, a = m.step(m.first, (0, 80.0, True, True, False))
    _, b = m.step(state, (1_000_000, 0.0, False, False, False))
    assert a[0] == b[0]


def test_debounce_tiers():
    m = X.debounce()
    def run(rows):
        state, got = m.first, []
        for r in rows:
            state, out = m.step(state, r)
            got.append(out[0])
        return got

    warn = [(t * 250_000, 1, False, False) for t in range(8)]
    assert run(warn) == [0, 0, 0, 0, 0, 0, 1, 1]
    assert run([(t, r, True, u) for t, r, _, u in warn])[:3] == [0, 0, 1]
    assert run([*warn, (2_000_000, 0, False, True), (3_500_000, 0, False, True)])[-2:] == [1, 0]
    assert run([(0, 2, False, False)]) == [2]


def test_shock_freezes_for_a_while():
    m = X.shock_gate()
    state, frozen = m.first, []
    for i in range(20):
        state, out = m.step(state, (i * 33_000, 80.0 if i == 5 else 0.0, 0.0, 600.0, 0.0))
        frozen.append(out[1])
    assert any(frozen[5:9]) and not any(frozen[:5]) and not frozen[-1]


def test_one_euro_follows_and_smooths():
    m = X.one_euro()
    state, out = m.first, []
    for i in range(200):
        state, got = m.step(state, (i * 33_000, 10.0 + (0.5 if i % 2 else -0.5), 60.0))
        out.append(got[0])
    assert np.std(out[50:]) < 0.3 and abs(np.mean(out[50:]) - 10) < 0.1


def test_blink_runs_through_its_phases():
    m = X.blink_phase()
    ears = [0.3] * 20 + [0.26, 0.2, 0.12, 0.1, 0.1, 0.15, 0.2, 0.27, 0.3, 0.3]
    state, phases, out = m.first, [], None
    for i, e in enumerate(ears):
        state, out = m.step(state, (i * 33_000, e))
        phases.append(out[0])
    assert "closing" in phases and "closed" in phases and phases[-1] == "open" and out[1] > 0 and out[2] > 0


def test_fold_does_not_depend_on_partitions(spark):
    rows = [(u, i * 50_000, float((i * 37 + u) % 90)) for u in range(7) for i in range(300)]
    df = stream(spark, rows)
    one = X.fold(df.coalesce(1), S, X.ema(0.2), ["x"], ["u", "us"]).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    many = X.fold(df.repartition(9), S, X.ema(0.2), ["x"], ["u", "us"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(one) == sorted(many)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, i * 50_000, float((i * 37 + u) % 90)) for u in range(3) for i in range(100)]
    df = stream(spark, rows)
    for n in range(3):  # three files, in order of time: three micro-batches
        df.where(F.floor(F.col("us") / 1_700_000) == n).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = drain(stateful(src, S, X.ema(0.2), ["x"], ["u", "us"]), "ema_stream", f"{tmp_path}/cp")
    assert sorted(got.collect()) == sorted(X.fold(df, S, X.ema(0.2), ["x"], ["u", "us"]).collect())


def test_event_time_aggregates(spark, tmp_path):
    df = spark.createDataFrame([(1, f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 3, 9, 9)], "u int, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = drain(telemetry(src(), "ts", "x"), "tumbling", f"{tmp_path}/a", "complete").select("n", "mean").collect()
    assert sorted(map(tuple, got)) == [(1, 3.0), (2, 9.0), (3, 1.0)]
    assert sorted(r["n"] for r in drain(sessions(src(), "ts", "u", "4 seconds"), "sess", f"{tmp_path}/b", "complete").collect()) == [2, 4]
    assert drain(fresh(src(), "ts", ["u", "x"]), "fresh_rows", f"{tmp_path}/c").count() == 5


def test_drained_rows_lie_in_files_and_go_on_from_the_checkpoint(spark, tmp_path):
    rows = [(u, i * 50_000, float((i * 37 + u) % 90)) for u in range(3) for i in range(40)]
    df = stream(spark, rows)
    df.where("false").write.parquet(f"{tmp_path}/in/none")
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = lambda: drain(stateful(src, S, X.ema(0.2), ["x"], ["u", "us"]), "ema_files", f"{tmp_path}/cp")
    assert run().count() == 0
    for n in range(2):
        df.where(F.floor(F.col("us") / 1_000_000) == n).write.parquet(f"{tmp_path}/in/{n}")
        got = run()
        assert got.inputFiles() and got.count() == spark.table("ema_files").count() == 60 * (n + 1)
    assert sorted(run().collect()) == sorted(X.fold(df, S, X.ema(0.2), ["x"], ["u", "us"]).collect())


def test_signals(spark):
    n = 64
    wave_ = [math.sin(2 * math.pi * 4 * i / n) for i in range(n)]
    df = spark.createDataFrame([(wave_,)], "a array<double>")
    lag = D.pitch(F.col("a"), 8, 24, 0.3)
    r = df.select(lag["lag"], lag["voiced"], F.size(D.frames(F.col("a"), 16, 8)), D.dft_magnitude(F.col("a"), n, 4), D.band_power(F.col("a"), n, 64.0, 3.0, 5.0)).first()
    assert r[0] == 16 and r[1] and r[2] == 7 and math.isclose(r[3], 32, rel_tol=1e-9) and r[4] > 10


def test_clips_and_waves(spark, tmp_path):
    for name in ("a/x.MP4", "a/b/y.mov", "z.txt"):
        p = tmp_path / "clips" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1")
    got = files.discover_clips(spark, f"file://{tmp_path}/clips", "sober").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["y.mov", "x.MP4"]
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<8h", 16384, 0, 16384, 0, -16384, 0, 0, 0))
    rate, x = files.decode_wav(buf.getvalue())
    assert rate == 8000 and x.tolist() == [0.25, 0.25, -0.25, 0.0]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/ok.wav").write_bytes(buf.getvalue())
    (tmp_path / "w/bad.wav").write_bytes(b"no")
    read = {r["path"].rsplit("/", 1)[1]: r["samples"] for r in files.read_waves(spark, f"file://{tmp_path}/w").collect()}
    assert read["bad.wav"] is None and len(read["ok.wav"]) == 8


def test_archives_merge_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/arc"
    files.write_archive(spark.createDataFrame([(1, "s1", 0.5)], "label int, subject_id string, a double"), path + "/one")
    files.write_archive(spark.createDataFrame([(0, "s2", 0.5, 0.1)], "label int, subject_id string, a double, b double"), path + "/two")
    both = J.union_filled([files.read_archive(spark, path + "/one"), files.read_archive(spark, path + "/two")], {"b": 7.0})
    assert {(r["subject_id"], r["b"]) for r in both.collect()} == {("s1", 7.0), ("s2", 0.1)}
    files.write_report(both, path + "/json")
    assert json.loads(spark.read.text(path + "/json").first()[0])["a"] == 0.5
    files.write_csv(both, path + "/csv")
    assert spark.read.option("header", True).csv(path + "/csv").count() == 2


def test_augmentation_balances(spark):
    df = spark.createDataFrame([(i, int(i < 10), float(i), float(i % 2)) for i in range(100)], "id int, y int, f double, g double")
    got = augment_minority(df, "y", ["f", "g"], "id")
    n = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert 0.6 < n[1] / n[0] < 1.4 and got.where("synthetic and g not in (0, 1)").count() == 0


def test_config_overlay():
    assert Config.from_json('{"yaw_limit": 20, "nope": 1}').yaw_limit == 20


def test_late_rows_are_held(spark):
    df = stream(spark, [(1, 0, 1.0), (1, 0, 5.0), (1, 2 * DAY, 3.0)])
    got = W.derivative(df, S, "x", "d", longest=10.0).orderBy("us", "x").collect()
    assert [r["d"] for r in got] == [0.0, 0.0, 0.0]


def test_permutation_importance_finds_the_feature(spark):
    from kymora.operators.learning import permutation_importance

    df = spark.createDataFrame([(i, i % 2, (i % 2) + (i % 5) / 10.0, float((i * 7) % 13)) for i in range(400)], "id int, y int, f double, g double")
    got = permutation_importance(df, ["f", "g"], "y", lambda d: d.withColumn("score", F.col("f") + 0.001 * F.col("g")), repeats=1).collect()
    assert got[0]["feature"] == "f" and got[0]["importance"] > 0.3 and abs(got[1]["importance"]) < 0.05


def test_rolling_model_holds_and_clears():
    m = X.rolling_model(3, 2, lambda w: sum(r[0] for r in w), misses=2)
    state, out = m.first, []
    for row in [(True, 1), (True, 2), (True, 3), (True, 4), (False, 0), (False, 0), (False, 0), (True, 9)]:
        state, got = m.step(state, row)
        out.append(got[0])
    assert out == [None, None, None, 9, 9, 9, None, None]


def run_machine(machine, rows):
    state, out = machine.first, []
    for row in rows:
        state, got = machine.step(state, row)
        out.append(got)
    return out


def test_shock_gate_keeps_its_past_over_two_missing_poses():
    pose = lambda i, x: (i * 33_000, x, 0.0, 600.0, 0.0, 0.0, 0.0)
    gone = lambda i: (i * 33_000, *[None] * 6)
    short = run_machine(X.shock_gate(), [pose(0, 0.0), pose(1, 0.0), gone(2), pose(3, 80.0), pose(4, 80.0)])
    assert short[3][1]
    long = run_machine(X.shock_gate(), [pose(0, 0.0), pose(1, 0.0), gone(2), gone(3), gone(4), pose(5, 80.0), pose(6, 80.0)])
    assert not any(r[1] for r in long)
    turning = run_machine(X.shock_gate(), [(i * 33_000, 80.0 * (i > 3), 0.0, 600.0, 0.0, 5.0 * i, 0.0) for i in range(8)])
    assert not any(r[1] for r in turning)


def test_shock_gate_caps_frozen_time_and_notices_shaking():
    out = run_machine(X.shock_gate(), [(i * 33_000, 90.0 * (i // 6 % 2), 0.0, 600.0, 0.0, 0.0, 0.0) for i in range(120)])
    assert any(r[2] for r in out) and sum(r[1] for r in out[60:]) / 60 < 0.5
    shaky = run_machine(X.shock_gate(), [(i * 33_000, 6.0 * math.sin(i * 1.3), 0.0, 600.0, 0.0, 0.0, 0.0) for i in range(60)])
    assert shaky[-1][3] and not run_machine(X.shock_gate(), [(i * 33_000, 1.0, 0.0, 600.0, 0.0, 0.0, 0.0) for i in range(60)])[-1][3]


def test_evidence_takes_reflexes_and_voice():
    one = lambda *row: run_machine(X.evidence(), [row])[0][0] - math.log(0.01 / 0.99)
    assert math.isclose(one(0, 50.0, True, True, False), 0.033)
    assert math.isclose(one(0, 50.0, True, True, False, 50.0, False, True, True, None), 2.5 * 0.033)
    assert math.isclose(one(0, 25.0, True, False, False, 25.0, False, False, False, 80.0), (0.28 - 0.40) * 0.033)
    assert math.isclose(one(0, 8.0, True, False, False, 30.0, False), -0.40 * 0.033) and math.isclose(one(0, 8.0, True, False, False), -1.25 * 0.033)


def test_saccades_need_a_jump_of_both_eyes():
    still = (0.0, 0.0, 0.0, 0.0, False, 0.0, 0.0, 0.0, 0.0)
    at = lambda i, x, **k: (i * 33_000, x, 0.0, k.get("left", x), k.get("right", x), k.get("closed", False), 0.0, 0.0, 0.0, 0.0)
    out = run_machine(X.saccade(), [(0, *still), at(1, 0.1), at(2, 0.101), at(3, 0.101)])
    assert math.isclose(out[1][0], 0.1 * 22 / 0.033) and out[1][1] and not out[2][1] and math.isclose(out[3][2], 33.0)
    assert run_machine(X.saccade(), [(0, *still), at(1, 0.1, left=0.2, right=-0.2)])[1][0] == 0
    blinked = run_machine(X.saccade(), [(0, *still), at(1, 0.1), at(2, 0.3, closed=True), at(3, 0.6), at(4, 0.6)])
    assert not any(r[1] for r in blinked[2:]) and blinked[3][0] == 0


def test_vor_gain_is_the_median_of_step_ratios():
    steps = [(0.9, True), (1.0, True), (0.8, True)]
    rows, eye, yaw = [(0, 0.0, 0.0, 0.0, True)], 0.0, 0.0
    for i, (ratio, is_open) in enumerate(steps):
        eye, yaw = eye - 2 * ratio, yaw + 2
        rows.append(((i + 1) * 33_000, eye, yaw, 0.0, is_open))
    assert [r[0] for r in run_machine(X.vor_gain(), rows)] == [1.0, 0.9, 0.95, 0.9]
    assert run_machine(X.vor_gain(), [(0, 0.0, 0.0, 0.0, True), (33_000, 0.0, 2.0, 0.0, True)])[-1] == (0.0,)
    assert run_machine(X.vor_gain(), [(0, 0.0, 0.0, 0.0, True), (33_000, 0.0, 2.0, 20.0, True)])[-1] == (1.0,)


def test_blink_speeds():
    fast = [0.3] * 20 + [0.22, 0.12, 0.08, 0.14, 0.24, 0.3, 0.3, 0.3]
    slow = [0.3] * 20 + [0.22, 0.12, 0.08, 0.09, 0.10, 0.16, 0.18, 0.20, 0.22, 0.26, 0.27]
    last = lambda ears: run_machine(X.blink_phase(), [(i * 33_000, e) for i, e in enumerate(ears)])[-1]
    assert last(fast)[0] == "open" and last(fast)[2] > last(slow)[2] > 0 and last(fast)[1] > 1.5
    aborted = run_machine(X.blink_phase(), [(i * 33_000, e) for i, e in enumerate([0.3] * 20 + [0.27, 0.29, 0.3, 0.3])])
    assert "closing" in [r[0] for r in aborted] and aborted[-1] == ("open", 0.0, 0.0)
    gap = run_machine(X.blink_phase(), [(0, 0.3), (33_000, 0.3), (900_000, 0.1), (933_000, 0.1)])
    assert [r[0] for r in gap] == ["open"] * 4


def test_stare_excuses_a_waking_gaze():
    rows = lambda up, wobble: [(i * 100_000, wobble * (i % 2), 0.0, False, up) for i in range(80)]
    assert run_machine(X.stare(), rows(0.0, 0.6))[-1][1:] == (True, False) and run_machine(X.stare(), rows(2.0, 0.6))[-1][1:] == (False, True)
    assert run_machine(X.stare(), rows(0.0, 2.0))[-1][1:] == (False, False)


AWAKE = {"ear_avg": 0.30, "gaze_yaw_dispersion": 0.08, "blink_opening_velocity": 2.5, "mar": 0.05}
#: Frames and (class, total, involuntary, voluntary) worked out by hand from the weights.
SCORED = [
    ({}, ("SOBER", 0.0, 0.0, 0.0)),
    ({"imu_gated": True, "gen_detected": True}, ("INSUFFICIENT_DATA", 0.0, 0.0, 0.0)),
    ({"gen_detected": True}, ("SOBER", 21.6, 21.6, 0.0)),
    ({"gen_detected": True, "head_postural_sway": 1.5}, ("MILD_IMPAIRMENT", 26.6, 26.6, 0.0)),
    ({"gen_detected": True, "lack_of_convergence": True, "microsleep_detected": True, "perclos": 0.35, "pursuit_fragmentation_ratio": 0.35, "blink_opening_velocity": 1.0, "gaze_yaw_dispersion": 0.02, "ear_avg": 0.2}, ("HIGH_RISK_INTOXICATED", 85.25, 85.25, 0.0)),
    ({"ml_probability": 0.8}, ("SOBER", 12.0, 12.0, 0.0)),
    ({"ml_probability": 0.8, "gen_detected": True}, ("MILD_IMPAIRMENT", 44.96, 44.96, 0.0)),
    ({"deliberate_blink_suppression": True, "eyeball_tremor_hz": 5.0, "eyelid_tremor_hz": 3.0, "gaze_yaw_dispersion": 0.02, "blink_opening_velocity": 0.0, "mar": 0.3, "head_postural_sway": 0.7, "ear_avg": 0.2}, ("HIGH_RISK_INTOXICATED", 54.0, 54.0, 70.0)),
    ({"compensatory_stare_active": True, "deliberate_blink_suppression": True, "gaze_yaw_dispersion": 0.025, "blink_opening_velocity": 1.4, "stare_fixation_duration_s": 4.0, "ear_avg": 0.24}, ("HIGH_RISK_INTOXICATED", 62.0, 62.0, 72.5)),
    ({"gen_detected": True, "voluntary_eye_widening": True, "perclos": 0.09, "audio_valid": True, "voice_slurred_detected": True, "voice_impairment_score": 90.0, "head_postural_sway": 1.5}, ("MILD_IMPAIRMENT", 36.6, 36.6, 75.0)),
]


@pytest.mark.parametrize("frame, want", SCORED)
def test_temporal_score(spark, frame, want):
    from kymora.operators import temporal

    got = temporal.temporal_score(spark.range(1).select("id", *[F.lit(v).alias(n) for n, v in (AWAKE | frame).items()]), ["id"]).first()
    assert (got["classification"], *(round(got[c], 6) for c in ("total_risk", "involuntary", "voluntary"))) == want
    assert got["lockout"] == (want[0] == "HIGH_RISK_INTOXICATED") and bool(got["markers"]) == (want[0] != "INSUFFICIENT_DATA")


def test_globs_candidates_and_archive_defaults(spark, tmp_path):
    path = f"file://{tmp_path}/arc"
    spark.createDataFrame([("w1", [0.5, 1.0, 1.5])], "window string, timestamps array<double>").write.parquet(f"{path}/a.parquet")
    got = files.read_glob(spark, f"{path}/*.parquet").first()
    assert (got["audio_valid"], got["n_gated"], got["start_ts"], got["end_ts"]) == (0.0, 0, 0.5, 1.5)
    with pytest.raises(FileNotFoundError):
        files.read_glob(spark, f"{path}/*.none")
    assert files.first_existing(spark, f"{path}/none", f"{path}/a.parquet", path) == f"{path}/a.parquet" and files.first_existing(spark, f"{path}/none") is None


def test_batch_times_camera_and_progress(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "u int, n int")
    assert [r["ts"] for r in files.batch_times(df, ["u"], ["n"], 10.0, most=3).orderBy("n").collect()] == [0.0, 0.1, 0.2]
    assert math.isclose(files.batch_times(df, ["u"], ["n"], 2.0).agg(F.max("ts")).first()[0], 4 / 30)
    assert files.read_camera(None, 1280, 720)["matrix"] == [1280.0, 0, 640.0, 0, 1280.0, 360.0, 0, 0, 1]
    mine = files.read_camera('{"camera_matrix": [[9, 0, 4], [0, 8, 3], [0, 0, 1]], "dist_coeffs": [0.1, 0.2]}', 1280, 720)
    assert mine["custom"] and mine["matrix"][4] == 8.0 and mine["distortion"] == [0.1, 0.2]
    assert [bool(files.progress(i, 33, "ok")) for i in (1, 5, 6, 10, 32, 33)] == [True, True, False, True, False, True]


def test_models_are_saved_with_their_features(spark, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    from kymora.operators.learning import mean_importance, out_of_fold

    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 12}", float(y), float(y + rng.normal(0, 0.4)), float(rng.normal())) for i in range(480) for y in [rng.integers(0, 2)]]
    df = spark.createDataFrame(rows, "id int, s string, y double, f double, g double")
    models = []
    got = out_of_fold(df, ["f", "g"], "y", "s", k=2, rounds=4, models=models)
    assert got.count() == 480 and M.roc_auc(got.withColumn("y", F.col("y").cast("int")), "y", "score").first()[0] > 0.85
    ranked = mean_importance(models, ["f", "g"])
    assert len(models) == 2 and ranked[0][0] == "f"
    files.save_model(models[0], ["f", "g"], {"auc": 0.9}, f"file://{tmp_path}/m")
    model, names, results = files.load_model(spark, GBTClassificationModel, f"file://{tmp_path}/none", f"file://{tmp_path}/m")
    assert names == ["f", "g"] and results == {"auc": 0.9} and model.getNumTrees == 4


def test_filter_bank_lets_lids_pass_and_holds_the_skull():
    from kymora.operators import filters

    layout = filters.Layout(skull=(0, 1), right_corners=(2, 3), left_corners=(4, 5), right_eye=(6, 7), left_eye=(8,), eyelid=(6,), iris=(7, 8))
    base = np.array([[0, 0], [10, 0], [20, 0], [30, 0], [60, 0], [70, 0], [25, 5], [25, 1], [65, 1], [40, 40]], float)
    rng, rows = np.random.default_rng(3), []
    for i in range(120):
        x = base + rng.normal(0, 0.3, base.shape)
        x[6, 1] -= 8 * (i >= 100)
        rows.append((i * 33_000, x.ravel().tolist(), 0.0))
    rows.append((120 * 33_000, [math.nan] * 20, 0.0))
    out = [np.array(r[0]).reshape(10, 2) for r in run_machine(filters.filter_bank(layout, 10), rows)]
    noise = np.std([o[9, 1] for o in out[40:100]])
    assert noise < 0.2 and out[104][6, 1] - out[99][6, 1] < -5 and np.array_equal(out[-1], out[-2])
    still = [np.array(r[0]) for r in run_machine(filters.filter_bank(layout, 10), [(i * 33_000, base.ravel().tolist(), 0.5) for i in range(30)])]
    assert np.allclose(still[-1], base.ravel())


def test_segments_and_control_rows_start_anew(spark, tmp_path):
    assert [r[0] for r in run_machine(X.restarting(X.ema(0.5)), [(False, 4.0), (False, 0.0), (True, 8.0), (False, 0.0)])] == [4.0, 2.0, 8.0, 4.0]
    from kymora.streaming.processors import with_control

    rows = [(1, 10_000_000 + i * 50_000, float(i)) for i in range(6)]
    path, other = f"{tmp_path}/in", f"{tmp_path}/control"
    stream(spark, rows).write.parquet(path)
    spark.createDataFrame([(1, 10_120_000)], "u int, us long").write.parquet(other)
    read = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    both = with_control(read(path), read(other), "reset").withColumns({"x": F.coalesce("x", F.lit(0.0)), "ts": F.timestamp_micros("us")}).withWatermark("ts", "1 second")
    got = drain(stateful(both, S, X.restarting(X.ema(0.5)), ["reset", "x"], ["u", "us"], idle_ms=60_000), "controlled", f"{tmp_path}/c").orderBy("us").collect()
    assert [r["ema"] for r in got] == [0.0, 0.5, 1.25, 0.0, 1.5, 2.75, 3.875]


def test_resampling_keeps_tones_and_removes_what_does_not_fit():
    t = np.arange(44_100) / 44_100
    out = files.resampled(np.sin(2 * np.pi * 440 * t), 44_100, 16_000)
    assert len(out) == 16_000 and np.abs(out[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[200:-200]).max() < 0.01
    assert np.abs(files.resampled(np.sin(2 * np.pi * 15_000 * t), 44_100, 16_000)[200:-200]).max() < 0.05
    assert len(files.resampled(np.ones(100), 8_000, 16_000)) == 200 and files.resampled(np.empty(0), 8_000, 16_000).size == 0


def test_archives_hold_audio_only_where_there_is_any(spark, tmp_path):
    df = spark.createDataFrame([(0, "s", 0.0, 0.5)], "label int, subject_id string, audio_valid double, vocal_jitter double")
    assert not files.write_archive(df.where("false"), f"file://{tmp_path}/none") and files.first_existing(spark, f"file://{tmp_path}/none") is None
    assert files.write_archive(df, f"file://{tmp_path}/a", audio=("vocal_jitter",)) and "vocal_jitter" not in spark.read.parquet(f"file://{tmp_path}/a").columns
    assert files.write_archive(df, f"file://{tmp_path}/b", audio=("vocal_jitter",), voice=True) and "vocal_jitter" in spark.read.parquet(f"file://{tmp_path}/b").columns
    got = spark.createDataFrame([([0.5, -2.0],), ([0.5, -0.2],)], "a array<double>").select(D.to_unit(F.col("a"))).collect()
    assert [r[0] for r in got] == [[0.25, -1.0], [0.5, -0.2]]

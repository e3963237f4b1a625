import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from voices import RATE, bleed_into, tracks, voice

from confab.operators import bleed, rendering, separation, signals
from confab.sources import files

SIZE = RATE // 8


def test_chunks_and_windows_against_numpy(spark):
    x, y = voice(1)[: SIZE * 21 + 37], voice(2)[: SIZE * 30]
    c = tracks(spark, [("c", 1, x), ("c", 2, y), ("d", 1, x[:50]), ("e", 1, [])])
    assert [(r.call_id, r.idx) for r in signals.joined(c).orderBy("call_id", "idx").collect()] == [("c", 1), ("c", 2), ("d", 1)]
    got = {r.idx: r.rms for r in signals.levels(c.where("call_id = 'c'")).collect()}
    assert abs(got[1] - np.sqrt(np.mean(x * x))) < 1e-9
    on = sorted((r.window, r.active) for r in signals.activity(c.where("call_id = 'c' and idx = 1"), SIZE).collect())
    want = [(k, bool(np.sqrt(np.mean(x[k * SIZE : (k + 2) * SIZE] ** 2)) > 0.1 * np.sqrt(np.mean(x * x)))) for k in range(20)]
    assert on == want and signals.activity(c.where("call_id = 'd'"), SIZE).count() == 0
    s = signals.pair_stats(c.where("call_id = 'c'"), SIZE).collect()
    n, rows = len(x), []
    v = y[:n]
    for a in range(0, max(1, n - 16 * SIZE + 1), 8 * SIZE):
        p, q = x[a : a + 16 * SIZE], v[a : a + 16 * SIZE]
        rows.append((abs(np.corrcoef(p, q)[0, 1]), p @ q / (q @ q)))
    assert len(s) == 1 and np.allclose((s[0].corr, s[0].g_b_in_a), np.median(rows, axis=0), atol=1e-6)


def test_shared_voice_plan_and_roles(spark):
    a, b = voice(1), voice(2)
    c = tracks(spark, [("c", 1, a + 0.7 * b), ("c", 2, a), ("d", 0, a), ("d", 1, b), ("e", 0, a), ("e", 1, a * 0.9)])
    w = signals.shared_voices(signals.pair_stats(c, SIZE)).cache()
    assert sorted((r.call_id, r.mix_idx, r.component_idx, r.kind) for r in w.collect()) == [("c", 1, 2, "contains"), ("e", 1, 0, "duplicate")]
    sel = c.select("call_id", "idx").distinct()
    plan = separation.resolve(sel, w)
    got = {(r.call_id, r.idx): (r.action, r.subtract) for r in plan.collect()}
    assert got[("c", 1)] == ("subtract", [2]) and got[("c", 2)] == ("keep", []) and got[("d", 0)] == ("keep", []) and got[("e", 1)] == ("drop", [])
    roles = {(r.call_id, r.idx): (r.kind, r.refs, r.duplicate_of) for r in signals.classify(c.union(tracks(spark, [("c", 3, a + 0.7 * b)])), SIZE).collect()}
    assert roles[("c", 1)] == ("isolate", [2], None) and roles[("c", 3)] == ("duplicate", [], 1) and roles[("c", 2)][0] == "keep" and roles[("e", 1)] == ("duplicate", [], 0)
    t = spark.createDataFrame([("c", 1, None), ("c", 2, "Eva"), ("e", 0, " "), ("e", 1, None)], "call_id string, idx int, title string")
    who = {(r.call_id, r.idx): (r.name, r.lane, r.ghost, r.set_aside) for r in separation.roster(t, plan).collect()}
    assert who == {("c", 1): ("Speaker 1", "a", "Eva", False), ("c", 2): ("Eva", "b", None, False), ("e", 0): ("Speaker 1", "a", None, False), ("e", 1): ("Another recording", None, None, True)}


def test_plan_never_drops_all(spark):
    sel = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "call_id string, idx int")
    w = lambda rows: spark.createDataFrame([("c", *r, 0.0) for r in rows], "call_id string, mix_idx int, component_idx int, kind string, drop_db double")
    do = lambda rows: {r.idx: r.action for r in separation.resolve(sel, w(rows)).collect()}
    assert do([(1, 3, "contains"), (2, 1, "duplicate"), (3, 2, "duplicate")]) == {1: "subtract", 2: "drop", 3: "keep"}
    assert "keep" in do([(2, 1, "duplicate"), (3, 2, "duplicate"), (3, 1, "duplicate")]).values()


def test_saved_plans_go_before_chosen_and_detected_ones(spark):
    sel = spark.createDataFrame([(c, i) for c in "abc" for i in (1, 2)], "call_id string, idx int")
    plan = lambda rows: spark.createDataFrame(rows, "call_id string, idx int, action string, subtract array<int>")
    detected = plan([("a", 1, "drop", []), ("a", 2, "keep", []), ("b", 1, "drop", []), ("c", 1, "drop", []), ("c", 2, "drop", [])])
    chosen = spark.createDataFrame([("a", 1, [2]), ("b", 2, [1])], "call_id string, idx int, subtract array<int>")
    got = {(r.call_id, r.idx): (r.action, r.origin) for r in separation.applied(sel, plan([("a", 2, "keep", [])]), chosen, detected).collect()}
    assert got == {("a", 1): ("drop", "saved"), ("a", 2): ("keep", "saved"), ("b", 1): ("keep", "chosen"), ("b", 2): ("subtract", "chosen"), ("c", 1): ("keep", "detected"), ("c", 2): ("keep", "detected")}


def test_isolation_rendering_and_wav(spark):
    a, b, d = voice(1), voice(2), voice(3)
    c = tracks(spark, [("c", 0, a + 0.7 * b - 0.4 * d), ("c", 1, b), ("c", 2, d[:-300]), ("c", 3, a)])
    plan = spark.createDataFrame([("c", 0, [1, 2]), ("c", 3, [])], "call_id string, idx int, refs array<int>")
    x = {r.idx: np.array(r.samples) for r in signals.joined(signals.isolate(c, plan)).collect()}
    assert len(x[0]) == len(a) - 300 and np.corrcoef(x[0], a[:-300])[0, 1] > 0.99 and np.allclose(x[3], a)
    out = {r.idx: (np.array(r.samples), bytes(r.w)) for r in rendering.rendered(c, plan, RATE).withColumn("w", rendering.wav(RATE)("samples")).collect()}
    assert abs(np.abs(out[0][0]).max() - 0.9) < 1e-9 and abs(np.abs(out[3][0]).max() - 0.9) < 1e-9
    with wave.open(io.BytesIO(out[3][1])) as w:
        assert w.getnframes() == len(a) and w.getframerate() == RATE
    back = spark.createDataFrame([(out[3][1],)], "b binary").select(files.wav_samples("b").alias("x")).collect()[0].x
    assert np.abs(np.array(back) - out[3][0]).max() < 1e-3
    half = rendering.denoised(F.col("s"), lambda x: x[: len(x) // 2])
    assert spark.createDataFrame([([1.0, 2.0, 3.0],)], "s array<double>").select(half.alias("y")).collect()[0].y == [1.0, 0.0, 0.0]


def test_gates_against_plain_loops(spark):
    r = np.random.default_rng(4)
    mix = voice(5, seconds=6)
    rest = mix * np.repeat(r.random(len(mix) // 160) < 0.5, 160) + 0.001 * r.standard_normal(len(mix))
    d = spark.createDataFrame([(rest.tolist(), mix.tolist())], "r array<double>, m array<double>").select(rendering.gate(RATE)("r", "m").alias("g"), rendering.noise_gate(RATE)("r").alias("n")).collect()[0]
    size, mask = RATE * 150 // 1000, np.zeros(len(mix))
    level = lambda x, k: np.sqrt(np.mean(x[k * size : (k + 2) * size] ** 2))
    count = (len(mix) - 2 * size) // size + 1
    keep = [level(rest, k) > 0.5 * level(mix, k) and level(rest, k) > 0.1 * np.sqrt(np.mean(mix**2)) for k in range(count)]
    for k in range(count):
        mask[k * size : (k + 1) * size] = any(keep[max(0, k - 2) : k + 1])
    ramp = RATE * 30 // 1000
    assert np.allclose(d.g, rest * np.convolve(mask, np.ones(ramp) / ramp, mode="same"), atol=1e-9)
    mask, own = np.zeros(len(mix)), np.sqrt(np.mean(rest**2))
    for k in range((len(mix) - 2 * SIZE) // SIZE + 1):
        if np.sqrt(np.mean(rest[k * SIZE : (k + 2) * SIZE] ** 2)) > 0.1 * own:
            mask[k * SIZE : (k + 2) * SIZE] = 1
    ramp = RATE * 20 // 1000
    assert np.allclose(d.n, rest * np.convolve(mask, np.ones(ramp) / ramp, mode="same"), atol=1e-9)


def test_correlation_cases(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 1.0], [1.0, 2.0]), ([], []), ([1.0], [1.0, 2.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(separation.correlation(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(r.c, 9) for r in got] == [1.0, 0.0, 0.0, 0.0]


def test_first_speech_and_envelopes(spark):
    d = spark.createDataFrame([([0.0] * 6 + [1.0] * 12,), ([0.0] * 20,), ([1.0] * 8,), (None,)], "x array<double>")
    assert [round(r.s, 6) for r in d.select(signals.first_speech(F.col("x")).alias("s")).collect()] == [1.7, 0.0, 0.0, 0.0]
    e = spark.createDataFrame([("c", 1, 0, [0.1, 0.9, 0.4]), ("c", 1, 1, [0.1, 0.9, 0.4, 1.0]), ("c", 2, 0, [0.2, 1.8, 0.8]), ("c", 3, 0, [0.9, 0.1, 0.2])], "call_id string, idx int, channel int, levels array<double>")
    assert [(r.idx, r.duplicate_of) for r in separation.twins(e).collect()] == [(2, 1)]
    t = spark.createDataFrame([("c", 1, 2, None, False), ("c", 2, 1, None, None), ("c", 9, 1, None, None)], "call_id string, idx int, channels int, pinned int, same boolean")
    got = {r.idx: r.levels for r in separation.drawn_envelope(e, t).collect()}
    assert np.allclose(got[1], [0.1, 0.9, 0.4]) and got[2] == [0.2, 1.8, 0.8] and got[9] is None
    roles = spark.createDataFrame([([(1, "keep"), (2, "duplicate")],)], "r array<struct<idx:int,kind:string>>")
    r = roles.select(separation.role_of(F.col("r"), F.lit(2))["kind"].alias("k"), F.size(separation.speakers(F.col("r"))).alias("n"), separation.changes_nothing(F.col("r")).alias("same")).collect()[0]
    assert (r.k, r.n, r.same) == ("duplicate", 1, False)
    starts = spark.createDataFrame([(100.0,), (1000.0,), (50.0,), (None,)], "d double").select(signals.analysis_start(F.col("d")).alias("s")).collect()
    assert [r.s for r in starts] == [10.0, 350.0, 0.0, 0.0]


@pytest.mark.parametrize("share,delay_ms,verdict", [(0.4, 8, "bleed B->A"), (0.0, 0, "no-bleed")])
def test_bleed(spark, share, delay_ms, verdict):
    a, b = voice(11, on=0.8), voice(12, on=0.8)
    c = tracks(spark, [("c", 1, bleed_into(a, b, share, RATE * delay_ms // 1000)), ("c", 2, b)])
    lags = bleed.window_lags(c, RATE).cache()
    x = lags.where("window = 3").collect()[0]
    m = bleed.decide(bleed.analyse(lags, RATE)).cache()
    r = m.collect()[0]
    assert x.rho <= 1 and r.n_active > 10
    if share:
        assert (r.verdict, r.lag) == (verdict, RATE * delay_ms // 1000) and r.tier == "auto-clean"
        assert bleed.gating_mask(lags, m, RATE).where("gated").count() > 10
    else:
        assert r.rho < 0.22
    s = bleed.sweep(m, "call_id").collect()[0]
    assert s.n == 1 and abs(s.p95 - r.rho) < 1e-12 and s.tier == r.tier


def test_probes(spark):
    a, b = voice(21), voice(22)
    taps = np.array([0.6, 0.3, -0.2])
    m = a * 0.05 + np.convolve(b, taps)[: len(b)]
    x = spark.createDataFrame([(m.tolist(), b.tolist())], "m array<double>, c array<double>").select(bleed.filtered_out(512)("m", "c").alias("r")).collect()[0].r
    assert len(x) == len(m) and np.mean(np.array(x) ** 2) < 0.1 * np.mean(m**2)

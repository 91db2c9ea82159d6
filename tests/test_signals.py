"""Correlation at all lags, waveforms with drift, and moves scanned in chunks, against plain walks."""

import random
import time

import numpy as np
import pytest

from chronoweave.operators import correlate, moves, series
from chronoweave.plans import registry
from tests.conftest import SMALL


def direct(a, b, local):
    b = (b - b.mean()) / b.std()
    whole = (a - a.mean()) / (a.std() if a.std() > 1e-9 else 1.0)
    out = []
    for k in range(len(a) - len(b) + 1):
        w = a[k : k + len(b)]
        if local and w.std() < 1e-9:
            out.append(None)
        else:
            out.append(float((((w - w.mean()) / w.std()) if local else whole[k : k + len(b)]) @ b / len(b)))
    return out


def lags(spark, a, b, local, least=None):
    long = spark.createDataFrame([("d", "s", i, float(x)) for i, x in enumerate(a) if x], "day string, src string, i long, x double").repartition(7)
    long = long.unionByName(spark.createDataFrame([("d", "s", len(a) - 1, 0.0)], long.schema)) if not a[-1] else long
    clips = spark.createDataFrame([("d", "c", [float(x) for x in b]), ("e", "none", [1.0]), ("d", "flat", [2.0] * 9), ("d", "empty", []), ("d", "longer", [float(i % 5) for i in range(len(a) + 1)])], "day string, clip string, env array<double>")
    found = correlate.match_lags(long, clips, ["day"], "src", "i", "x", "clip", "env", local)
    return found


@pytest.mark.parametrize("local", [False, True])
def test_lags_equal_the_direct_sum(spark, local, monkeypatch):
    monkeypatch.setattr(correlate, "LEAST", 64)
    rng = np.random.default_rng(1)
    a, b = rng.normal(3, 1, 700), rng.normal(0, 1, 90)
    a[300:390] += 3 * b
    a[500:600] = 0
    found = lags(spark, a, b, local)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["lag"]: r["r"] for r in found.collect()}
    want = {k: r for k, r in enumerate(direct(a, b, local)) if r is not None}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9
    best = series.best_match(found, ["clip"], "r", "lag", 60).first()
    assert best["lag"] == 300 and best["margin"] == pytest.approx(want[300] - max(r for k, r in want.items() if not 240 <= k < 360))


def test_an_hour(spark):
    """An hour at 100 samples a second, against five minutes."""
    rng = np.random.default_rng(2)
    a = np.log1p(np.abs(rng.normal(0, 1, 360_000)))
    b = a[123_456 : 123_456 + 30_000] + rng.normal(0, 0.2, 30_000)
    path = spark.createDataFrame([(a.tolist(),)], "x array<double>").selectExpr("'d' AS day", "'s' AS src", "posexplode(x) AS (i, x)")
    clip = spark.createDataFrame([("d", "c", b.tolist())], "day string, clip string, env array<double>")
    begin = time.time()
    found = correlate.match_lags(path, clip, ["day"], "src", "i", "x", "clip", "env")
    best = series.best_match(found, ["clip"], "r", "lag", 6000).first()
    assert best["lag"] == 123_456 and best["r"] > 0.8 and best["margin"] > 0.5 and time.time() - begin < 60
    whole = (a - a.mean()) / a.std()
    assert best["r"] == pytest.approx(float(whole[123_456:153_456] @ ((b - b.mean()) / b.std()) / 30_000), abs=1e-9)
    assert found.count() == 330_001


def slow_windows(x, y, size, lag, least):
    drift, out = 0, []
    power = [np.sqrt((x[i : i + size] ** 2).mean()) for i in range(0, len(x) - size + 1, size)]
    for k, p in enumerate(power):
        if p <= 0 or p < max(power) / 10:
            continue
        w, best, at = x[k * size : (k + 1) * size], -1.0, drift
        for s in range(drift - lag, drift + lag + 1):
            i = k * size + s
            if i >= 0 and i + size <= len(y):
                z = y[i : i + size]
                r = float(w @ z / (np.linalg.norm(w) * np.linalg.norm(z) + 1e-12))
                if r > best:
                    best, at = r, s
        out.append((k * size, best, at))
        drift = at if best >= least else drift
    return out


def test_waveform_drift(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 16_000)
    x[4000:6000] *= 0.001
    y = np.concatenate([np.zeros(30), x[:7000], np.zeros(25), x[7000:10_000], rng.normal(0, 1, 2000), x[12_000:]])[:16_000]
    begin = time.time()
    want = slow_windows(x, y, 500, 160, 0.6)
    slow = time.time() - begin
    begin = time.time()
    got = correlate.windows_lost(x, y, 500, 160, 0.6, 20.0)
    quick = time.time() - begin
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and np.allclose([r for _, r, _ in got], [r for _, r, _ in want], atol=1e-9)
    assert quick * 5 < slow
    df = spark.createDataFrame([(1, x.tolist(), y.tolist()), (2, [], [1.0]), (3, None, None), (4, [1.0] * 600, [])], "id int, a array<double>, b array<double>")
    rows = {r["id"]: r for r in correlate.waveform_match(df, "a", "b", rate=2000).collect()}
    assert rows[1]["status"] == "ok" and rows[1]["lost"] == sum(r < 0.6 for _, r, _ in want) == len(rows[1]["lost_s"]) and rows[1]["drift"] == 55
    assert rows[2]["status"] == rows[3]["status"] == "unchecked" and rows[2]["windows"] == 0
    assert (rows[4]["windows"], rows[4]["lost"], rows[4]["least_r"]) == (1, 1, -1.0)


def walk(n, seed):
    """Velocities with starts, stops, turns and long still parts."""
    rng, v = random.Random(seed), []
    while len(v) < n:
        speed, angle = rng.choice([0.0, 0.1, 3.0, 5.0]), rng.uniform(0, 6.3)
        v += [(speed * np.cos(angle) + rng.gauss(0, 0.05), speed * np.sin(angle) + rng.gauss(0, 0.05)) for _ in range(rng.randint(3, 80))]
    return np.array(v[:n])


def test_chunks_equal_the_walk(spark):
    sources = {"a": walk(3000, 1), "b": walk(40, 2), "still": np.zeros((900, 2)), "turning": np.array([(4 * np.cos(i / 15), 4 * np.sin(i / 15)) for i in range(800)])}
    rows = [(k, i / 12, float(x), float(y)) for k, v in sources.items() for i, (x, y) in enumerate(v)]
    rows += [("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, vx double, vy double").repartition(6)
    samples = df.where("t is not null").selectExpr("k AS key", "t AS at", "vx", "vy")
    got = {}
    for r in moves.move_cuts(samples, 10.0, 1.0).collect():
        got.setdefault(r["key"], []).append(r["t0"])
    for k, v in sources.items():
        assert sorted(got[k]) == [c / 12 for c in moves.split_moves(v)], k
    whole = moves.move_segments(df, "k", "t", "vx", "vy", width=1e6).orderBy("k", "segment").collect()
    parts = moves.move_segments(df, "k", "t", "vx", "vy", width=10.0, beyond=1.0).orderBy("k", "segment").collect()
    assert whole == parts and len(whole) > 40
    assert moves.move_segments(df.limit(0), "k", "t", "vx", "vy").count() == 0


def test_split_moves_against_slices():
    """The running sums against means of slices."""
    rules = moves.MoveRules
    for seed in range(6):
        v = walk(400, seed)
        moving = np.hypot(v[:, 0], v[:, 1]) >= rules.hover
        limit, cuts, i = np.cos(np.radians(rules.turn_deg)), [0], 1
        while i + rules.hold <= len(v):
            inside = v[cuts[-1] : i][moving[cuts[-1] : i]]
            state, ahead, on = moving[cuts[-1] : i].mean() >= 0.5, v[i : i + rules.hold], moving[i : i + rules.hold]
            turned = False
            if state and len(inside) and on.all():
                mean = inside.mean(axis=0)
                turned = bool((ahead @ mean < limit * np.maximum(np.hypot(ahead[:, 0], ahead[:, 1]) * np.hypot(*mean), 1e-12)).all())
            if turned or (on != state).all():
                cuts.append(i)
                i += rules.hold
            i += 1
        assert moves.split_moves(v) == cuts


def test_hourly_moves(spark):
    """The registered query against one walk over each whole source."""
    from chronoweave.plans import signals

    got = registry.QUERIES["hourly_moves"](spark, SMALL).orderBy("event_type", "segment").collect()
    by = {}
    for r in signals.hourly_path(spark, SMALL).orderBy("event_type", "at").collect():
        by.setdefault(r["event_type"], []).append((r["vx"], r["vy"], r["at"]))
    for kind, v in by.items():
        own = [g for g in got if g["event_type"] == kind]
        cuts = [v[c][2] for c in moves.split_moves(np.array(v)[:, :2])]
        assert set(cuts) <= {g["t0"] for g in own} and [g["segment"] for g in own] == list(range(len(own)))


def test_vector_windows(spark):
    got = {r["vec_id"]: r for r in registry.QUERIES["vector_windows"](spark, SMALL).collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert set(got) == {i for i in vectors if i + 1 in vectors}
    for i, r in got.items():
        want = slow_windows(vectors[i], vectors[i + 1], 16, 5, 0.3)
        assert (r["windows"], r["lost"]) == (len(want), sum(b < 0.3 for _, b, _ in want))

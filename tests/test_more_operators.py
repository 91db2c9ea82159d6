"""Operators that no registered query runs, on small tables worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import choose, cuts, evidence, intervals, rules, schedule, series, talk, verdicts


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_levels_and_words(spark):
    n = F.lit(None).cast("double")
    assert one(spark, verdicts.peak_gain_reason(F.lit(0.5), F.lit(0.4)), verdicts.peak_gain_reason(F.lit(0.4), F.lit(0.5)), verdicts.peak_gain_reason(F.lit(0.0), F.lit(0.0)), verdicts.peak_gain_reason(n, F.lit(1.0))) == (
        "talk sample peak", "resampled peak (inter-sample overshoot) above the sample peak", None, None,
    )
    gain = one(spark, verdicts.peak_gain(F.lit(0.25), F.lit(0.5)), verdicts.peak_gain(n, F.lit(0.5)))
    assert gain[0] == pytest.approx(-1 - 20 * np.log10(0.5)) and gain[1] is None
    assert one(spark, *[verdicts.motion_gloss(F.lit(e), F.lit(c)) for e, c in ((0.001, 0.9), (0.004, 0.1), (0.01, 0.1), (0.5, 0.7))]) == (
        "static movement, camera moves with the scene", "gentle movement, camera mostly still", "moderate movement, camera mostly still", "energetic movement, camera moves with the scene",
    )
    region = {k: n for k in ("vx_c", "vx_e", "vx_t", "vx_b", "vy_t", "vy_b")}
    zero = F.lit(0.0)
    assert one(spark, verdicts.move_label(F.lit(3.0), zero, zero, zero, region), verdicts.move_label(zero, F.lit(-1.0), zero, zero, region), verdicts.move_label(zero, zero, zero, F.lit(0.1), region)) == ("steady pan left", "slow tilt down", "hover")
    assert one(spark, verdicts.move_label(F.lit(6.0), zero, F.lit(4.0), zero, region | {"vx_c": F.lit(1.0), "vx_e": F.lit(5.0)}))[0] == "fast orbit right + push-in"


def test_verdicts_without_a_query(spark):
    ranked = F.expr("array(named_struct('name', 'Pinus nigra', 'score', 0.4D), named_struct('name', 'Quercus robur', 'score', 0.2D))")
    weak = F.expr("array(named_struct('name', 'Pinus nigra', 'score', 0.1D))")
    none = F.expr("cast(null as array<struct<name:string,score:double>>)")
    assert one(spark, *[verdicts.species_verdict(F.lit(a), r) for a, r in (("pinus nigra", ranked), ("Quercus ilex", ranked), ("Acer", ranked), ("Acer", weak), ("Acer", none))]) == ("agrees", "agrees", "disagrees", "cannot tell", "cannot tell")
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("double")
    assert one(spark, verdicts.sync_verdict(t, n, n), verdicts.sync_verdict(f, F.lit(0.6), F.lit(0.4)), verdicts.sync_verdict(f, n, n), verdicts.sync_verdict(f, F.lit(0.2), F.lit(0.9)), verdicts.sync_verdict(f, F.lit(0.6), F.lit(0.1))) == ("verified", "strong", "no coverage", "no coverage", "ambiguous")
    blur, other = F.array(F.lit("Motion BLUR")), F.array(F.lit("dull"))
    two, single = F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))
    assert one(spark, verdicts.watchable(t, blur, two), verdicts.watchable(t, blur, single), verdicts.watchable(t, other, single), verdicts.watchable(f, other, two), verdicts.watchable(F.lit(None).cast("boolean"), other, two)) == (True, False, True, False, False)
    assert one(spark, verdicts.in_sync(F.lit("a"), F.lit(1.0), F.lit("a"), F.lit(1.4)), verdicts.in_sync(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(1.0)), verdicts.in_sync(F.lit("a"), F.lit(1.0), F.lit("a"), F.lit(1.6))) == (True, False, False)
    assert one(spark, verdicts.interview_setup(t, f), verdicts.interview_setup(t, t), verdicts.interview_setup(f, f)) == (True, False, False)
    assert one(spark, verdicts.shaky(F.lit(1.0), F.lit(2.5)), verdicts.shaky(F.lit(1.0), n), verdicts.shaky(F.lit(2.1), n)) == (True, False, True)
    with pytest.raises(Exception, match="shake was not measured"):
        one(spark, verdicts.shaky(n, F.lit(1.0)))


def test_steady_picks(spark):
    times = F.array(*[F.lit(float(i)) for i in range(10)])
    runs = F.expr("array(named_struct('t0', 2.0D, 't1', 5.0D), named_struct('t0', 7.0D, 't1', 9.0D))")
    none = F.expr("cast(null as array<struct<t0:double,t1:double>>)")
    assert one(spark, verdicts.steady_picks(times, runs), verdicts.steady_picks(times, none), verdicts.steady_picks(times, F.slice(runs, 1, 0))) == ([2, 3, 7, 8], [0, 3, 6, 9], [])


def test_steady_runs_measure_again(spark):
    def path(source, amount, n):
        return [(source, i / 12, amount * (-1) ** i, 0.0, 50) for i in range(n)]

    data = path("still", 0.1, 60) + path("rough", 60.0, 60) + path("short", 0.1, 6)
    df = spark.createDataFrame(data, "source string, t double, dx double, dy double, inliers int")
    runs = spark.createDataFrame([("still", 0.0, 5.0), ("rough", 0.0, 5.0), ("short", 0.0, 5.0)], "source string, t0 double, t1 double")
    assert rows(series.steady_runs(df, runs, ["source"], "t", "dx", "dy", "inliers"), "source", "t0", "t1") == [("still", 0.0, 5.0)]
    r = F.expr("array(named_struct('t0', 0.0D, 't1', 2.0D))")
    length = lambda x: F.expr("cast(null as double)") if x is None else F.lit(x)
    got = one(spark, series.usable_runs(F.lit(1.0), 2.0, r, length(10.0), 3.0), series.usable_runs(F.lit(3.0), 2.0, r, length(10.0), 3.0))
    assert got[0] is None and got[1] is not None


def test_cover_rules(spark):
    fields = "id string, clip string, spoken_s double, pick_clip string, offset double, pick_offset double, people string, shake_status string, shake_whole double, shake_worst double, drone boolean, pieces array<struct<t0:double,t1:double>>, t0 double, t1 double"
    base = dict(clip="B1_w01", spoken_s=0.0, pick_clip="A1", offset=0.0, pick_offset=9.0, people="two men", shake_status="ok", shake_whole=1.0, shake_worst=1.0, drone=False, pieces=None, t0=0.0, t1=10.0)
    cases = {
        "fine": {}, "talks": {"spoken_s": 2.0}, "unheard": {"spoken_s": None}, "empty room": {"spoken_s": 2.0, "people": "Nobody in view"}, "exempt": {"clip": "X9_w02", "spoken_s": 5.0},
        "own picture": {"clip": "A1_w01", "pick_offset": 0.2, "spoken_s": 9.0, "shake_whole": 3.0}, "rough": {"shake_worst": 2.5}, "unmeasured": {"shake_status": "unchecked", "shake_whole": None},
        "flight": {"drone": True, "pieces": [(0.2, 9.8)]}, "bad flight": {"drone": True, "pieces": [(0.2, 3.0)]}, "blind flight": {"drone": True},
    }
    df = spark.createDataFrame([(k, *[(base | v)[f] for f in ("clip", "spoken_s", "pick_clip", "offset", "pick_offset", "people", "shake_status", "shake_whole", "shake_worst", "drone", "pieces", "t0", "t1")]) for k, v in cases.items()], fields)
    exempt = spark.createDataFrame([("X9",)], "clip string")
    assert rows(verdicts.cover_rules(df, "id", exempt)) == [
        ("bad flight", "drone_unclean"), ("blind flight", "drone_unmeasured"), ("own picture", "sync_shaky"), ("rough", "shaky"),
        ("talks", "talking"), ("unheard", "talking_unknown"), ("unmeasured", "shake_unmeasured"),
    ]


def test_exempt_clips_and_readback(spark):
    fields = "id string, why string, kind string, clips array<string>"
    data = [("x", None, "talking_cover_exempt", ["A", "B"]), ("y", "later", "talking_cover_exempt", ["C"]), ("e", None, "clips_excluded", ["S1"]), ("m", None, "must_be_present", ["S1", "S9"]), ("n", None, "no_cover", None)]
    r = spark.createDataFrame(data, fields)
    assert rows(rules.exempt_clips(r)) == [("A",), ("B",)]
    items = spark.createDataFrame([("video", 3, "S1_w01", 100, 50), ("video", 1, "A1", 200, 50), ("video", 3, "S2", 249, 30)], "type string, track int, clip string, rec long, dur long")
    protected = spark.createDataFrame([("n", "p1", "A1", 201, 50), ("n", "p2", "A2", 90, 30)], "rule string, pick string, clip string, rec long, dur long")
    # p1 has only its own picture (and an overlap of two frames); S1 lies over p2
    assert rows(rules.check_readback(r, items, protected)) == [("e", "broken", "S1"), ("m", "broken", "S9"), ("n", "broken", "p2 S1_w01")]


def test_plan_bins_and_feeders(spark):
    s = spark.createDataFrame([("a/1", "2026-01-01", ["cut"], [(["reel"], ["r1"], "Ana")])], "id string, day string, feeds array<string>, capture array<struct<feeds:array<string>,registers:array<string>,operator:string>>")
    assert rows(schedule.feeders(s)) == [("cut", ["a/1"]), ("reel", ["a/1"])]
    assigned = spark.createDataFrame([("c1", "a/1"), ("c2", None), ("c3", "a/1")], "id string, session string")
    placed = spark.createDataFrame([("c1", "2026-01-01/a-1"), ("c2", "x"), ("c3", "old"), ("c4", "y")], "id string, bin string")
    assert rows(schedule.plan_bins(assigned, s, placed), "id", "action") == [("c1", "ok"), ("c2", "unassigned"), ("c3", "move"), ("c4", "unknown")]


def test_vocabulary_and_trims(spark):
    items = spark.createDataFrame([(1, "i1", ["harbour", "boats", "the"]), (1, "i2", ["nothing"])], "cut int, item string, words array<string>")
    picks = spark.createDataFrame([(1, "p1", 1, ["boats", "harbour"]), (1, "p2", 2, ["boats", "sea"]), (1, "p3", 3, ["harbour", "boats"])], "cut int, pick string, ord int, said array<string>")
    got = {r["item"]: (r["pick"], r["shared"]) for r in choose.attach_by_vocabulary(items, picks, ["cut"], "item", "words", "said", "ord").collect()}
    assert got["i1"] == ("p1", 2) and got["i2"] == ("p1", 0)
    things = spark.createDataFrame([("i1", "A", 0.0, 5.0), ("i2", "A", 10.0, 12.0), ("i3", "B", 0.0, 1.0)], "item string, clip string, src_t0 double, src_t1 double")
    trims = spark.createDataFrame([(1, "A", 4.0, 6.0, "warm"), (2, "A", None, None, "flat")], "ord int, clip string, t0 double, t1 double, grade string")
    assert rows(cuts.trim_for(things, trims), "item", "grade") == [("i1", "warm"), ("i2", "flat"), ("i3", None)]


def test_medians_tracks_and_timelines(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", float("nan")), ("a", 2.0), ("b", 5.0), ("b", None)], "k string, v double")
    assert rows(df.groupBy("k").agg(series.median_of_enough("v", 3).alias("m"))) == [("a", 2.0), ("b", None)]
    r = spark.createDataFrame([("x", 2, 30), ("x", 1, 10), ("x", 3, 5)], "cut string, o int, dur int")
    assert rows(cuts.alternate_tracks(r, ["cut"], ["o"]), "o", "track") == [(1, 1), (2, 2), (3, 1)]
    assert rows(cuts.selects_timeline(r, ["cut"], ["o"]), "o", "rec") == [(1, 0), (2, 34), (3, 88)]
    span = one(spark, cuts.item_span(F.lit(0), F.lit(48), F.lit(50), F.lit(25.0)))[0]
    assert (span["t0"], span["t1"]) == (2.0, 4.0)


def test_repeats_feedback_and_species(spark):
    c = spark.createDataFrame([("t", 1, "hook", "S1", "S2", "ok"), ("t", 2, "bite", "S1", "S2", "ok"), ("t", 3, "bite", "S1", "S3", "ok"), ("t", 4, "bite", "S1", "S2", "excluded")], "k string, o int, kind string, first string, last string, status string")
    assert rows(talk.merge_repeats(c, ["k"], "o"), "o", "also_proposed_as") == [(1, ["bite"]), (3, []), (4, None)]
    card = [("p1", "A", "video", 3, None), ("p2", "A", "video", 0, "shaky"), ("p3", "B", "video", 3, None), ("p3", "B", "bare", 3, None), ("p4", "C", "video", 0, "dull")]
    got = {(r["pick"], r["clip"]): (r["keep"], r["bad"], r["barred"]) for r in choose.feedback(spark.createDataFrame(card, "pick string, clip string, kind string, score int, technical string")).collect()}
    assert got == {("p1", "A"): (True, False, True), ("p2", "A"): (False, True, True), ("p3", "B"): (False, False, False), ("p4", "C"): (False, True, False)}
    picks = spark.createDataFrame([(1, "p1", "A", "a heron stands", 0.0, 5.0), (1, "p2", "B", "two herons", 5.0, 9.0), (1, "p3", "C", "sheron", 9.0, 12.0)], "cut int, pick string, clip string, text string, t0 double, t1 double")
    pictures = spark.createDataFrame([(1, "video", "V1", 1.0, 3.0), (1, "bare", None, 5.0, 9.0)], "cut int, type string, clip string, dest_in_s double, dest_out_s double")
    assert rows(cuts.species_claims(picks, pictures, spark.createDataFrame([("heron",)], "species string"), ["cut"])) == [(1, "p1", "heron", "V1"), (1, "p2", "heron", "B")]


def test_stretches_sessions_and_words(spark):
    picks = spark.createDataFrame([(1, 1, "p1", "A", 0.0, 4.0), (1, 1, "p2", "B", 4.0, 9.0)], "cut int, beat int, pick string, clip string, t0 double, t1 double")
    laid = spark.createDataFrame([(1, 1, "video", "V", 10.0, 2.0, 6.0), (1, 1, "bare", None, None, 3.97, 4.0)], "cut int, beat int, type string, clip string, in_s double, dest_in_s double, dest_out_s double")
    got = [(r["pick"], r["t0"], r["t1"], r["src_in"]) for r in cuts.stretches(picks, laid, ["cut"]).orderBy("t0").collect() if r["type"] == "video"]
    assert got == [("p1", 2.0, 4.0, 10.0), ("p2", 4.0, 6.0, 12.0)]
    assert cuts.stretches(picks, laid, ["cut"]).where("type = 'bare'").count() == 0  # a sliver
    clips = spark.createDataFrame([("c", "d1"), ("e", "d9")], "clip string, day string")
    sessions = spark.createDataFrame([("s1", "L", "d1"), ("s2", "L", "d2")], "session string, side string, day string")
    scores = spark.createDataFrame([("c", "s1", 0.3, 1, 0.1), ("c", "s2", 0.9, 2, 0.5), ("e", "s1", 0.3, 1, 0.1), ("e", "s2", 0.9, 2, 0.5)], "clip string, session string, r double, lag int, margin double")
    assert rows(evidence.best_sessions(clips, sessions, scores), "clip", "session") == [("c", "s1"), ("e", "s2")]
    words = spark.createDataFrame([("A", "in", 1.0, 1.5), ("A", "edge", 1.9, 2.2), ("A", "out", 3.0, 3.2)], "clip string, w string, s double, e double")
    p = spark.createDataFrame([("A", "p", 1.0, 2.0)], "clip string, pick string, in_s double, out_s double")
    assert rows(evidence.words_kept(words, p, ["clip"]), "w") == [("in",)]
    assert rows(evidence.words_kept(words, p, ["clip"], 0.06, middle=True), "w") == [("edge",), ("in",)]
    runs = F.expr("array(named_struct('t0', 0.0D, 't1', 4.0D), named_struct('t0', 6.0D, 't1', 9.0D))")
    assert one(spark, intervals.clamp_to_runs(F.lit(5.0), F.lit(8.0), runs, F.lit(1.0)))[0] is not None


def test_jump_cuts_between_bare_neighbours(spark):
    picks = spark.createDataFrame([(1, 1, "A_w01", 0.0, 2.0), (1, 2, "A_w02", 2.0, 5.0), (1, 3, "A_w01", 5.0, 6.0), (1, 4, "B", 6.0, 8.0), (2, 1, "A_w01", 0.0, 2.0)], "beat int, o int, clip string, t0 double, t1 double")
    shown = spark.createDataFrame([(1, "bare", 0.0, 1.96), (1, "video", 1.96, 5.5), (1, "bare", 5.5, 8.0)], "beat int, kind string, t0 double, t1 double")
    assert rows(verdicts.jump_cuts(picks, shown, ["beat"], "o")) == [(1, 1, 2.0)]


def test_as_of_in_buckets_is_the_same(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(int(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 300), rng.random(300) * 100, strict=True))], "k int, i int, at double")
    spans = spark.createDataFrame([(int(k), f"s{i}", float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 40), 20 + rng.random(40) * 60, strict=True))], "k int, s string, t0 double")
    plain, dealt = (rows(intervals.as_of(points, spans, ["k"], "at", width=w), "i", "s") for w in (None, 7.0))
    assert plain == dealt and len(plain) == 300
    cut = points.select("k", F.col("at").alias("t0"), (F.col("at") + 1.5).alias("t1"))
    keep = spans.select("k", "t0", (F.col("t0") + 9.0).alias("t1"))
    assert rows(intervals.minus(keep, cut, ["k"])) == rows(intervals.minus(keep, cut, ["k"], width=5.0))


def test_texts_maps_and_verdicts(spark):
    from chronoweave.operators import textops

    runs = F.expr("array(named_struct('t0', 5.04D, 't1', 61.5D), named_struct('t0', 125.0D, 't1', 600.0D))")
    assert one(spark, textops.runs_text(runs), textops.long_clock(F.lit(3725.9)), textops.long_clock(F.lit(59.0))) == ("0:05.0-1:01.5, 2:05.0-10:00.0", "01:02:05", "00:00:59")
    a, b = F.expr("map('x', '1', 'y', '2')"), F.expr("map('y', '3', 'z', '4')")
    assert one(spark, textops.overridden(a, b), textops.overridden(F.expr("cast(null as map<string,string>)"), b)) == ({"x": "1", "y": "3", "z": "4"}, {"y": "3", "z": "4"})
    n = F.lit(None).cast("double")
    got = one(spark, *[verdicts.candidate_verdict(F.lit(x) if x is not None else n, F.lit(y), F.lit(r)) for x, y, r in ((3.0, 0.0, "good"), (2.5, 1.0, "good"), (None, 1.0, "good"), (1.0, 4.0, "good"), (1.0, 1.0, "  "))])
    assert [g["why"] for g in got] == [None, "standalone is not an integer 0-3", "standalone is not an integer 0-3", "strength is not an integer 0-3", "no reason"]
    assert [g["status"] for g in got] == ["ok", "invalid", "invalid", "invalid", "invalid"]


def test_containing_by_grams(spark):
    import random

    from chronoweave.operators import textops

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.choice([0, 1, 2, 5, 40, 200]))) for _ in range(60)] + [None, "é\U0001f600\n" * 20, "xx" * 40]
    marks = sorted({t[i : i + k] for t in texts if t for i, k in [(rng.randrange(len(t)), rng.choice([1, 2, 3, 7, 15, 31, 60]))]} | {"\U0001f600\né", "absent" * 8, "x" * 33, ""})
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    m = spark.createDataFrame([(i, w, "x") for i, w in enumerate(marks)] + [(999, None, None)], "no int, mark string, colour string")
    both = lambda t, w: t and w and (w in t or t in w)
    for way, holds in ((False, lambda t, w: t and w and w in t), (True, both)):
        found = textops.containing(d, m, "text", "mark", way)
        assert found.columns == ["id", "text", "no", "mark", "colour"]
        got = sorted((r["id"], r["no"]) for r in found.collect())
        assert got == sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(marks) if holds(t, w))
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert textops.containing(d, m.limit(0), "text", "mark").count() == 0 and textops.containing(d.limit(0), m, "text", "mark", True).count() == 0

"""Operators on small cases whose answers are worked out by hand or by a plain loop."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import choose, correlate, cuts, intervals, lay, moves, reconcile, rules, schedule, series, talk, textops, verdicts


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# intervals


def covered(spans):
    return {x for a, b in spans for x in range(a, b)}


@pytest.fixture(scope="module")
def two_sides(spark):
    r = random.Random(4)
    make = lambda n: [(k, a, a + r.randrange(0, 9)) for k in "ab" for a in (r.randrange(60) for _ in range(n))]
    a, b = make(12) + [("c", 1, 5), ("d", None, 4)], make(9) + [("e", 0, 3)]
    frame = lambda x: spark.createDataFrame(x, "k string, t0 int, t1 int")
    return a, b, frame(a), frame(b)


def by_key(spans):
    return {k: covered([(a, b) for q, a, b in spans if q == k and a is not None]) for k in "abcde"}


def test_interval_algebra(two_sides):
    a, b, da, db = two_sides
    for width in (None, 5):
        merged = rows(intervals.union(da, ["k"], width=width))
        assert by_key(merged) == by_key(a)
        starts = sorted((k, x) for k, x, _ in merged)
        assert not {(k, y) for k, _, y in merged} & set(starts)  # touching ones are one
    left = rows(intervals.minus(da, db, ["k"]))
    assert by_key(left) == {k: by_key(a)[k] - by_key(b)[k] for k in "abcde"}
    both = rows(intervals.intersect(intervals.union(da, ["k"]), intervals.union(db, ["k"]), ["k"], 7))
    assert by_key(both) == {k: by_key(a)[k] & by_key(b)[k] for k in "abcde"}


@pytest.mark.parametrize("width", [1, 4, 100])
def test_overlap_join(two_sides, width):
    a, b, da, db = two_sides
    right = db.select("k", F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    want = sorted((k, x, y, p, q) for k, x, y in a for h, p, q in b if h == k and x is not None and y > x and q > p and q > x and p < y)
    assert sorted(rows(intervals.overlap_join(da, right, ["k"], ("t0", "t1"), ("b0", "b1"), width))) == want
    outer = rows(intervals.overlap_join(da, right, ["k"], ("t0", "t1"), ("b0", "b1"), width, "left"))
    assert {r[:3] for r in outer} == {tuple(r) for r in a}


def test_clamp(spark):
    runs = "array(named_struct('t0', 0D, 't1', 4D), named_struct('t0', 5D, 't1', 20D))"
    df = spark.sql(f"select * from values (1D, 3D), (6D, 19D), (3D, 9D), (30D, 40D) as t(a, b)").withColumn("r", F.expr(runs))
    out = [tuple(x[0]) if x[0] else None for x in rows(df.select(intervals.clamp_to_runs(F.col("a"), F.col("b"), F.col("r"), F.lit(2.0))))]
    assert out == [(1, 3), (6, 19), (5, 9), None]
    assert rows(df.select(intervals.clamp_to_runs(F.col("a"), F.col("b"), F.lit(None).cast("array<struct<t0:double,t1:double>>"), F.lit(2.0))).limit(1))[0][0] == (1.0, 3.0)


def test_pick_spans(spark):
    picks = spark.createDataFrame([(1, 1, 0, 2.0, None), (1, 1, 1, 3.0, 1), (1, 2, 0, 9.0, 2), (1, 3, 0, 4.0, 1)], "cut int, beat int, j int, duration_s double, tier int")
    beats = spark.createDataFrame([(1, 1, 1.0), (1, 2, 5.0), (1, 3, None)], "cut int, beat int, gap_after_s double")
    spans = lambda gaps: [(r[0], r[1]) for r in rows(intervals.pick_spans(picks, beats, ["cut"], 1, gaps).orderBy("beat", "j").select("t0", "t1"))]
    assert spans(False) == [(0, 2), (2, 5), (6, 10)]
    assert spans(True) == [(0, 2), (2, 5), (11, 15)]


def test_spoken_seconds_knows_silence_from_ignorance(spark):
    spans = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 50.0, 60.0), ("z", 3, 0.0, 5.0)], "src string, id int, t0 double, t1 double")
    words = spark.createDataFrame([("a", "hi", 1.0, 2.5)], "src string, w string, s double, e double")
    got = {r["id"]: r["spoken_s"] for r in intervals.spoken_seconds(spans, words, ["src"], ["id"], 10.0).collect()}
    assert got == {1: 1.5, 2: 0.0, 3: None}


# schedules


def test_clocks(spark):
    df = spark.createDataFrame(
        [
            (1, "2026-03-13T22:30:00Z", None, "creation_time_utc", 0.0, "start", 0.0),
            (2, "2026-03-14T09:30:00Z", None, "creation_time_local", 0.0, "start", 0.0),
            (3, "2026-04-04T00:00:00Z", None, "creation_time_utc", 0.0, "start", 0.0),
            (4, "2026-04-05T00:00:00Z", None, "creation_time_utc", 0.0, "start", 0.0),
            (5, "2026-03-13T23:00:00Z", None, "creation_time_utc", -90.0, "end", 600.0),
            (6, "2026-03-13T22:31:05Z", "09:30:00:12", "timecode", 0.0, "start", 0.0),
            (7, "2026-03-13T13:05:00Z", "23:50:00:00", "timecode", 0.0, "start", 0.0),
            (8, None, None, "creation_time_utc", 0.0, "start", 0.0), (9, "2026-03-13T22:30:00Z", "nope", "timecode", 0.0, "start", 0.0),
            (10, "soon", None, "creation_time_utc", 0.0, "start", 0.0),
        ],
        "id int, created string, tc string, clock string, off double, stamp string, dur double",
    )
    start, why = schedule.true_start(F.col("created"), F.col("tc"), F.lit(25.0), F.col("clock"), F.col("off"), F.col("stamp"), F.col("dur"), "Australia/Sydney")
    got = {r["id"]: (r["s"], r["w"]) for r in df.select("id", start.alias("s"), why.alias("w")).collect()}
    at = dt.datetime
    assert got[1][0] == at(2026, 3, 14, 9, 30) and got[2][0] == at(2026, 3, 14, 9, 30)
    assert (got[3][0].hour, got[4][0].hour) == (11, 10)  # the clocks go back between them
    assert got[5][0] == at(2026, 3, 14, 9, 48, 30)
    assert got[6][0] == at(2026, 3, 14, 9, 30, 0, 480_000)
    assert got[7][0] == at(2026, 3, 13, 23, 50)
    assert got[8] == (None, "no creation time") and got[9][1] == "no readable timecode" and got[10][1] == "creation time not readable"


SESSIONS = "id string, day string, start_min int, end_min int, cameras array<string>"


def test_missing_ends_and_conflicts(spark):
    s = spark.createDataFrame([("a", "d", 600, None, ["x"]), ("b", "d", 620, 700, ["y"]), ("c", "d", 660, None, []), ("e", "f", 5, None, []), ("g", "f", None, 9, [])], SESSIONS)
    w = schedule.session_windows(s)
    assert {r["id"]: r["end_min"] for r in w.collect()} == {"a": 660, "b": 700, "c": 1440, "e": 1440}
    assert [(r["a_id"], r["b_id"]) for r in schedule.session_conflicts(w).collect()] == [("b", "c")]


def test_assignment_reasons(spark):
    s = spark.createDataFrame([("am", "d", 540, 720, []), ("x", "d", 600, 660, ["x"]), ("pm", "d", 720, 800, []), ("late", "d", 900, 960, ["y"])], SESSIONS)
    clips = spark.createDataFrame(
        [(1, None, "d", 600.0, 10.0), (2, "y", None, None, 10.0), (3, "y", "q", 600.0, 1.0), (4, "y", "d", 10.0, 1.0), (5, "x", "d", 610.0, 1.0), (6, "y", "d", 719.0, 600.0), (7, "y", "d", 959.0, 6000.0)],
        "id int, camera string, day string, minute double, duration_s double",
    )
    got = {r["id"]: (r["session"], r["reason"], r["spans_boundary"], r["ends_in"]) for r in schedule.assign(clips, s).collect()}
    assert got[1] == (None, "no camera", None, None) and got[2][1] == "no time" and got[3][1] == "day not in the schedule"
    assert got[4][1] == "outside every session" and got[5][1] == "ambiguous: am, x"
    assert got[6] == ("am", None, True, "pm") and got[7] == ("late", None, True, None)


def test_cameras_and_reports(spark):
    cams = spark.createDataFrame([(1, "none", None, None), (2, "A", "gx", None), (3, "B", "GX", "card2"), (4, "C", None, "/card2/")], "ord int, camera string, prefix string, path_contains string")
    clips = spark.createDataFrame([("GX01", "/m/card1/f"), ("gx02", "/m/CARD2/f"), ("q", "/CARD2/f"), ("q2", "/z")], "id string, path string")
    assert {r["id"]: r["camera"] for r in schedule.match_cameras(clips, cams).collect()} == {"GX01": "A", "gx02": "A", "q": "C", "q2": None}
    items = spark.createDataFrame([("t-01", "t", "cut"), ("t-03", "t", "delivered"), ("u-1", "u", None)], "id string, type string, status string")
    types = spark.createDataFrame([("t", 4), ("u", 1)], "id string, count int")
    assert sorted(r["id"] for r in schedule.stubs(items, types).collect()) == ["t-02", "t-04"]
    facts = spark.createDataFrame([("t-03", True, True, ["broken"])], "id string, has_cut boolean, has_render boolean, masters array<string>")
    assert {r["id"]: r["gaps"] for r in schedule.evidence_gaps(items, facts).collect()} == {"t-01": ["cut: no cut"], "t-03": ["delivered: loudness broken"], "u-1": []}


def test_validation(spark):
    of = lambda data, ddl: spark.createDataFrame(data, ddl)
    faults = schedule.validate(
        of([("d1",), ("d1",)], "day string"), of([("A", None, None, "sundial")], "camera string, prefix string, path_contains string, clock string"), of([("p",)], "id string"), of([("r",)], "id string"),
        of([("s", "d9", 50, 40, ["A", "Z"], ["r"], ["t"], [("q", ["t9"], ["r9"])])], "id string, day string, start_min int, end_min int, cameras array<string>, registers array<string>, feeds array<string>, capture array<struct<operator:string,feeds:array<string>,registers:array<string>>>"),
        of([("t", -1)], "id string, count int"), of([("i", "t7", "lost", ["nobody"], ["s", "s9"])], "id string, type string, status string, people array<string>, sessions array<string>"),
    )
    found = {(r["path"], r["message"]) for r in faults.collect()}
    assert ("days.d1", "is listed 2 times") in found and ("sessions.s", "unknown day d9") in found and ("sessions.s", "ends before it starts") in found
    assert ("sessions.s.cameras", "unknown camera Z") in found and ("items.i.status", "unknown status lost") in found
    assert len(found) == 14


# series


def test_series(spark):
    r = random.Random(1)
    xs = [r.uniform(-3, 3) for _ in range(40)]
    df = spark.createDataFrame([("s", i, x, float(i % 7)) for i, x in enumerate(xs)], "k string, i int, x double, y double")
    pad = [2 * xs[0] - xs[k] for k in range(6, 0, -1)] + xs + [2 * xs[-1] - xs[-1 - k] for k in range(1, 7)]
    got = [x[0] for x in rows(series.centred_mean(df, ["k"], ["i"], "x", 6).orderBy("i").select("smooth"))]
    assert got == pytest.approx([sum(pad[i : i + 13]) / 13 for i in range(40)])
    few = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0)], "k string, i int, x double")
    assert [x[0] for x in rows(series.centred_mean(few, ["k"], ["i"], "x", 6).select("smooth"))] == [2, 2]
    assert rows(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(series.upper_median("x")))[0][0] == 3
    still = spark.createDataFrame([("a", i, 0.1, 0.0, 30) for i in range(20)] + [("b", i, 5.0 * (-1) ** i, 0.0, 30) for i in range(20)] + [("c", 0, 1.0, 0.0, 30)], "k string, i int, dx double, dy double, n int")
    stats = {x["k"]: x for x in series.shake_stats(still, ["k"], "i", "dx", "dy", "n").collect()}
    assert stats["a"]["shake"] < 0.01 < stats["b"]["shake"] and stats["c"]["status"] == "unchecked" and stats["c"]["shake"] is None


def test_moves(spark):
    v = [0.0] * 20 + [5.0] * 60 + [0.0] * 20
    df = spark.createDataFrame([("a", i / 12, x, 0.0) for i, x in enumerate(v)], "k string, t double, vx double, vy double")
    found = moves.move_segments(df, "k", "t", "vx", "vy").orderBy("segment").collect()
    assert [f["moving"] for f in found] == [False, True, False] and found[1]["direction"] == pytest.approx(1)
    why = spark.range(1).select(series.clean_reasons(F.lit(0.95), F.lit(0.1), F.lit(1.0), F.lit(0.0), F.lit(2.0)), series.clean_reasons(F.lit(None).cast("double"), F.lit(0.1), F.lit(1.0), F.lit(0.0), F.lit(4.0))).first()
    assert why[0] == ["2.0 s long"] and why[1] == ["direction"]


def test_waveform_and_lag(spark):
    r = random.Random(2)
    x = [r.gauss(0, 1) for _ in range(800)]
    df = spark.createDataFrame([(1, x, x), (2, x, [r.gauss(0, 1) for _ in range(800)]), (3, None, x)], "id int, a array<double>, b array<double>")
    got = {q["id"]: (q["windows"], q["lost"]) for q in correlate.waveform_match(df, "a", "b", rate=400).collect()}
    assert got == {1: (8, 0), 2: (8, 8), 3: (0, 0)}
    shifted = spark.createDataFrame([(1, x[:50], [0.0, 0.0, 0.0] + x[:47])], "id int, a array<double>, b array<double>")
    best = series.best_match(series.correlate(shifted, ["id"], "a", "b", range(-5, 6)), ["id"], "r", "lag", 1).first()
    assert best["lag"] == -3 and best["r"] > 0.99


# words


def test_tokens(spark):
    t = spark.createDataFrame([("We're 5, can't DON'T dont x'll 1000 “hi”",), ("",), (None,)], "t string").select(textops.tokens(F.col("t"))).collect()
    assert t[0][0] == "we are five can not do not do not x'll thousand hi".split() and not t[1][0] and not t[2][0]


@pytest.mark.parametrize(
    "said,heard,flag,risks",
    [
        ("we must not go there today", "we must go there today", True, [("polarity", "dropped", "not")]),
        ("there are five boats here", "there are six boats here", True, [("quantity", "substituted", "five")]),
        ("a long line of words", "a long line of words", False, []), ("", "", False, []),
        ("the garden grows well", "um the garden grows well", False, []), ("the garden grows well", "um ah the garden grows well", True, []),
        ("the garden grows well", "the gardens grows well", False, []), ("he walked home slowly", "he walked we home slowly", False, []),
    ],
)
def test_edits(spark, said, heard, flag, risks):
    df = spark.createDataFrame([(said, heard)], "e string, h string")
    e = textops.token_edits(df, "e", "h").first()["edits"]
    assert (e["flag"], [tuple(r)[:3] for r in e["risks"]]) == (flag, risks)


def test_edits_in_full(spark):
    rows = [
        ("Ana grows five olive trees in the valley", "and Anna grows six olive in the valley over there now", "and then", "now we"),
        ("two hundred metres of silk", "two hundred meters of silk", None, None),
        ("they said nothing about the long road to the sea", "they set no thing a bout allowed along wrote to the sea", "", ""),
        ("we walk", "", "", ""), ("", "um ah", "um", ""), ("let's go they're x'll've", "let us go they are x'll have", "", ""),
    ]
    df = spark.createDataFrame(rows, "e string, h string, b string, a string").coalesce(1)
    got = [r["edits"].asDict(True) for r in textops.token_edits(df, "e", "h", "b", "a", names=["Ana"], spellings={"Ana": ["anna"]}).collect()]
    one = got[0]
    assert (one["omissions"], one["leak_head"], one["leak_tail"], one["substitutions"]) == (["trees"], [], ["over", "there"], ["five -> six"])
    assert one["risks"] == [{"cls": "quantity", "kind": "substituted", "token": "five", "heard": "six", "expected": "five", "at": 2}] and one["flag"]
    assert got[1]["coverage"] == 1.0 and not got[1]["flag"]
    assert {r["cls"] for r in got[2]["risks"]} == {"polarity"} and got[2]["coverage"] < 0.8
    assert got[3]["coverage"] == 0.0 and got[3]["omissions"] == ["we", "walk"] and [r["kind"] for r in got[3]["risks"]] == ["dropped"]
    assert got[4]["coverage"] == 1.0 and got[4]["leak_head"] == ["ah"] and got[4]["leak_tail"] == [] and not got[4]["flag"]
    assert got[5]["coverage"] == 1.0 and got[5]["expected"] == 7
    said = textops.token_edits(df, "e", "h", "b", "a").select(F.explode(textops.edit_reasons(F.col("edits")))).first()[0]
    assert said.startswith("coverage") or said.startswith("quantity substituted: 'five' -> 'six'") or "leaked" in said


def test_steps_rebuild_both_sides(spark):
    rng = np.random.default_rng(4)
    words = ["not", "go", "there", "five", "boats", "we", "garden", "gardens", "only"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), " ".join(rng.choice(words, rng.integers(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "e string, h string").select(textops.tokens(F.col("e")).alias("e"), textops.tokens(F.col("h")).alias("h"))
    for r in textops.edit_steps(df, "e", "h").collect():
        assert [t for s in r["steps"] for t in s["said"]] == r["e"]
        assert [s["at"] for s in r["steps"]] == [sum(len(x["said"]) for x in r["steps"][:i]) for i in range(len(r["steps"]))]
        got = [t for s in r["steps"] for t in s["got"]]
        assert len(got) == len(r["h"]) and all(a == b or {a, b} == {"garden", "gardens"} for a, b in zip(got, r["h"], strict=True))


def test_names_of_units(spark):
    r = spark.createDataFrame([("A_s01_w02",)], "u string").select(textops.base_clip(F.col("u")), textops.source_of(F.col("u")), textops.window_source(F.col("u"))).first()
    assert tuple(r) == ("A", "A_s01", "A_s01")
    first = spark.createDataFrame([("“Émile's here",)], "t string").select(textops.first_token(F.col("t"))).first()[0]
    assert first == "émile's"


def test_recheck(spark):
    t, f = F.lit(True), F.lit(False)
    got = spark.range(1).select(*[textops.recheck(*c) for c in ((f, f, f, F.lit(0)), (t, f, t, F.lit(0)), (t, f, t, F.lit(None).cast("int")), (t, t, t, F.lit(0)), (t, t, f, F.lit(0)))]).first()
    assert list(got) == ["cleared", "waveform_intact", "confirmed", "intent_mismatch", "unresolved"]


# talks


def test_sentences(spark):
    words = [("t", w, float(i), i + 0.5) for i, w in enumerate("Hello there. Then we".split())] + [("t", "go.", 10.0, 10.4)]
    words += [("t", f"w{i}", 20 + i * 1.0 + (0.3 if i > 25 else 0), 20 + i * 1.0 + 0.9 + (0.3 if i > 25 else 0)) for i in range(40)]
    got = talk.sentences(spark.createDataFrame(words, "k string, w string, s double, e double"), ["k"]).orderBy("n").collect()
    assert [g["id"] for g in got][:3] == ["S0001", "S0002", "S0003"]
    assert got[0]["text"] == "Hello" or got[0]["text"].startswith("Hello")
    assert all(g["t1"] - g["t0"] <= 30 for g in got) and sum(g["words"] for g in got) == len(words)
    assert any(g["text"].startswith("w26") for g in got)  # halved at the longest pause


def test_beats_and_windows(spark):
    s = spark.createDataFrame([("k", i, f"S{i}") for i in range(1, 7)], "k string, n int, id string")
    ok = spark.createDataFrame([("k", 1, "a", "S1", "S3"), ("k", 2, "b", "S4", "S6")], "k string, n int, title string, first string, last string")
    bad = spark.createDataFrame([("k", 1, "", "S1", "S3"), ("k", 2, "b", "S5", "S9")], ok.schema)
    assert talk.beat_faults(ok, s, ["k"]).count() == 0
    assert {r["fault"] for r in talk.beat_faults(bad, s, ["k"]).collect()} >= {"no title", "gap before", "unknown sentence id"}
    w = spark.range(1).select(talk.token_windows(F.array(*[F.lit(x) for x in (4, 4, 4, 4, 30, 4)]), 12, 1)).first()[0]
    assert [(x["first"], x["last"]) for x in w] == [(0, 2), (2, 3), (4, 4), (5, 5)]
    beats = spark.createDataFrame([("k", 1, 0, 9), ("k", 2, 6, 11), ("k", 2, 12, 20)], "k string, window int, first int, last int")
    lohi = spark.createDataFrame([("k", 1, 0, 9), ("k", 2, 6, 20)], "k string, window int, lo int, hi int")
    assert sorted((r["first"], r["last"]) for r in talk.merge_windows(beats, lohi, ["k"]).collect()) == [(0, 7), (8, 11), (12, 20)]


def test_gate(spark):
    s = spark.createDataFrame([("k", f"S{i}", i, i * 5.0, i * 5.0 + 4.5, "And so on." if i == 2 else "Good words.", 0.5, 0.1 if i == 3 else 0.5, i == 5) for i in range(1, 7)], "k string, id string, n int, t0 double, t1 double, text string, head_room double, tail_room double, off_mic boolean")
    beats = spark.createDataFrame([("k", 1, 1, 6)], "k string, beat int, lo int, hi int")
    c = spark.createDataFrame(
        [("k", 1, "bite", "S2", "S3", "none", "sea"), ("k", 2, "Hook ", "S1", "S1", None, "sea"), ("k", 3, "bite", "S4", "S6", "none", "x"), ("k", 4, "song", "S1", "S2", "none", "x"), ("k", 5, "bite", "S3", "S1", "none", " "), ("k", 6, "closer", "S9", "S1", "none", "x"), ("k", 7, "bite", "S1", "S1", "none", "x")],
        "k string, c int, kind string, first string, last string, register string, cover_brief string",
    ).withColumn("beat", F.lit(1))
    got = {r["c"]: (r["status"], r["reasons"], r["flags"]) for r in talk.gate(c, s, beats, ["k"]).collect()}
    assert got[1] == ("ok", [], ["dangling_start:and", "tight_out"]) and got[2][0] == "ok"
    assert got[3][:2] == ("excluded", ["contains an off-mic sentence"]) and got[4][0] == got[5][0] == got[6][0] == "invalid"
    assert got[5][1] == ["ids out of order or outside the beat", "no cover brief"] and got[7][1] == ["too short"]


def test_sections(spark):
    lines = ["# A", "a", "## B", "b1", "### c", "b2", "## D", "d"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, i int, t string")
    assert [r["t"] for r in talk.section_lines(df, ["k"], "i", "t", "b").orderBy("i").collect()] == ["b1", "### c", "b2"]
    assert [r["heading"] for r in talk.last_heading(df, ["k"], "i", "t").orderBy("i").collect()] == ["A", "A", "B", "B", "c", "c", "D", "D"]


# choices


def test_suppression_follows_the_order(spark):
    r = random.Random(3)
    data = [(k, i, r.random(), a, a + r.randrange(1, 30)) for k in "ab" for i, a in enumerate(r.randrange(400) for _ in range(60))]
    df = spark.createDataFrame(data, "k string, id int, score double, t0 int, t1 int")
    got = {(x["k"], x["id"]) for x in choose.suppress_overlaps(df, ["k"], ["-score", "id"]).collect()}
    want = set()
    for k in "ab":
        kept = []
        for _, i, _, a, b in sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1])):
            if all(b <= x or a >= y for x, y in kept):
                kept.append((a, b))
                want.add((k, i))
    assert got == want


def test_choice_and_reuse(spark):
    picks = spark.createDataFrame([("f", i, f"p{i}", i == 4) for i in range(6)], "film string, ord int, pick string, bare boolean")
    c = [("f", f"p{i}", 0, "x", 3.0, True, False, False) for i in range(3)] + [("f", f"p{i}", 1, "y", 2.0, True, False, False) for i in range(3)] + [("f", "p3", 0, "z", None, False, False, False), ("f", "p5", 0, "w", 3.0, True, True, False)]
    cand = spark.createDataFrame(c, "film string, pick string, i int, shot string, score double, accepted boolean, barred boolean, placeholder boolean")
    got = {r["pick"]: (r["shot"], r["status"]) for r in choose.choose(picks, cand, ["film"]).collect()}
    assert got == {"p0": ("x", "ok"), "p1": ("x", "ok"), "p2": ("x", "ok"), "p3": (None, "unchecked"), "p4": (None, "ok"), "p5": (None, "ok")}


def test_rules(spark):
    data = [("a", 1, "t", "2024-01", None, []), ("b", 2, "t", "2024-03", None, []), ("c", 3, "t", "2024-03", None, []), ("d", 4, None, None, "superseded", ["e"]), ("e", 5, None, "2024", None, []), ("f", 6, None, None, None, ["zz"])]
    r = choose.resolve_rules(spark.createDataFrame(data, "id string, ord int, topic string, decided string, status string, supersedes array<string>"))
    assert {x["id"]: x["why"] for x in r.collect()} == {"a": "later decision c", "b": "later decision c", "c": None, "d": "marked superseded", "e": "superseded by d", "f": None}


RULE = "id string, ord int, kind string, decision string, decided string, terms array<string>, clips array<string>, clip string, span_in double, span_out double, prefix string, scope_clip string, scope_text string, scope_title string, scope_notes string, scope_last boolean, why string"


def test_rule_checks(spark):
    def rule(id_, kind, **k):
        names = [c.split()[0] for c in RULE.split(", ")]
        return tuple({"id": id_, "ord": 1, "kind": kind, "decision": "d", **k}.get(n) for n in names)

    given = [
        rule("words", "words_forbidden", terms=["tiger"]), rule("span", "clip_span_excluded", clip="A", span_in=1.0, span_out=3.0), rule("need", "must_be_present", clips=["A", "Q"]),
        rule("out", "clips_excluded", clips=["Z"]), rule("bare", "no_cover", scope_title="intro"), rule("cover", "cover_required", scope_title="intro", scope_last=True),
        rule("later", "no_cover", scope_title="end"), rule("note", "note"), rule("gone", "must_be_present", clips=["QQ"], why="old"),
    ]
    picks = spark.createDataFrame([("b1p0", 1, "A", "We saw a tiger", 0.0, 4.0, 0.0, 4.0), ("b1p1", 1, "B", "and left", 9.0, 12.0, 4.0, 7.0), ("b2p0", 2, "B", "bye", 0.0, 2.0, 8.0, 10.0)], "pick string, beat int, clip string, text string, in_s double, out_s double, t0 double, t1 double")
    beats = spark.createDataFrame([(1, "Intro", None), (2, "The end", None)], "beat int, title string, notes string")
    rows_ = spark.createDataFrame([(1, "video", "C_s01", 0.0, 2.0, 1.0, 3.0), (1, "bare", None, None, None, 4.0, 7.0), (2, "video", "D", 0.0, 2.0, None, None)], "beat int, type string, clip string, in_s double, out_s double, dest_in_s double, dest_out_s double")
    got = {r["rule"]: (r["status"], r["evidence"]) for r in rules.check_cut(spark.createDataFrame(given, RULE), picks, beats, rows_).collect()}
    assert got["words"] == ("broken", "tiger") and got["span"][0] == "broken" and got["need"] == ("broken", "Q") and got["out"][0] == "honoured"
    assert got["bare"] == ("broken", "b1p0 C_s01") and got["cover"] == ("broken", "b1p1") and got["later"][0] == "not_testable"
    assert got["note"][0] == "noted" and "gone" not in got


# reconciliation


def test_conform(spark):
    plan = spark.createDataFrame([("p1", "v", 100, 10), ("p2", "v", 102, 10), ("p3", "v", 300, 5), ("p4", "w", 1, 1)], "plan_id string, t string, rec int, dur int")
    found = spark.createDataFrame([("f1", "v", 101, 10), ("f2", "v", 103, 14), ("f3", "v", 303, 5), ("f4", "w", 1, None)], "found_id string, t string, rec int, dur int")
    got = {(r["plan_id"], r["found_id"], r["status"]) for r in reconcile.conform(plan, found, ["t"], "rec", 2, ["rec", "plan_id"], [("dur", 2)]).collect()}
    assert got == {("p1", "f1", "ok"), ("p2", "f2", "mismatch"), ("p3", None, "missing"), (None, "f3", "unexpected"), ("p4", "f4", "mismatch")}


def test_keyed_tables(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "z", 5.0), (9, "q", 1.0)], "k int, s string, v double")
    assert rows(reconcile.update_keyed(a, new, ["k"]), "k") == [(1, "x", 1.0), (2, "z", 5.0)]
    assert rows(reconcile.append_new(a, new, ["k"]).select("k"), "k") == [(1,), (2,), (9,)]


# verdicts


def test_unknown_is_not_clean(spark):
    none = F.lit(None).cast("double")
    r = spark.range(1).select(
        verdicts.gain_for(none, none), verdicts.gain_for(F.lit(-60.0), none), verdicts.exposure_flags(F.lit(20.0), F.lit(20), F.lit(1), none), verdicts.delivery(none, F.lit(-3.0), -24, 1, -1.5),
        verdicts.channels(none, F.lit(1.0)), verdicts.decibels(F.lit(0.0)), verdicts.frame_rate(F.lit("24000/1001")), verdicts.frame_rate(F.lit("25/")), verdicts.frame_rate(F.lit("1/0")),
        verdicts.leveler_for(F.lit(-58.0)), verdicts.strict_score(F.lit("2.7")), verdicts.thinned(F.lit(10)), verdicts.clean_share(F.lit(None).cast("array<struct<t0:double,t1:double>>"), F.lit(0.0), F.lit(9.0)),
    ).first()
    assert list(r)[:6] == [None, -1.5, None, "unchecked", "unchecked", None]
    assert r[6] == pytest.approx(23.976, abs=1e-3) and list(r)[7:] == [25.0, None, 4.0, None, [0, 3, 6, 9], "unmeasured"]
    labels = spark.range(1).select(
        verdicts.judgement(F.lit("2.7"), F.lit("fits"), F.array(F.lit("a")), F.array(F.lit("a")), ["fits"]), verdicts.judgement(F.lit("x"), F.lit("no"), F.array(F.lit("b")), F.array(F.lit("a")), ["fits"])
    ).first()
    assert (labels[0]["status"], labels[0]["score"]) == ("ok", 2) and labels[1]["score"] is None and len(labels[1]["problems"]) == 3


def test_moves_have_names(spark):
    def named(lat, vert, zoom, rot, **region):
        r = {k: F.lit(region.get(k)).cast("double") for k in ("vx_c", "vx_e", "vx_t", "vx_b", "vy_t", "vy_b")}
        return spark.range(1).select(verdicts.move_label(F.lit(lat), F.lit(vert), F.lit(zoom), F.lit(rot), r)).first()[0]

    assert named(0.1, 0.1, 0.0, 0.0) == "hover" and named(1.0, 0.0, 0.0, 0.0) == "slow pan left"
    assert named(-6.0, 3.5, 0.0, 0.0) == "fast pan right + tilt up" and named(3.0, 0.0, 0.0, 0.0, vx_c=1.0, vx_e=5.0) == "steady orbit right"
    assert named(0.0, -3.0, 0.0, 0.0, vy_t=1.0, vy_b=3.0) == "steady descend"


# cuts


def test_cut_points(spark):
    df = spark.createDataFrame([(0.0, 100.0, [40.0, 52.0, 70.0]), (0.0, 100.0, []), (0.0, 40.0, [20.0])], "a double, b double, p array<double>")
    assert [r[0] for r in df.select(cuts.cut_points(F.col("a"), F.col("b"), F.col("p"))).collect()] == [[40.0, 70.0], [pytest.approx(100 / 3), pytest.approx(200 / 3)], []]


def test_crossfades(spark):
    rows = [("f", 1, "a", 0.0, 2.0, 10.0, 50, 3, False), ("f", 2, "b", 2.25, 1.75, 20.0, 8, 50, None), ("f", 3, "c", 9.0, 1.0, 30.0, 0, 0, True), ("f", 4, "d", 10.0, 1.0, 40.0, 20, 1, True), ("g", 1, "e", 5.0, 1.0, 0.0, 9, 40, False)]
    picks = spark.createDataFrame([(*r[:6], r[5] + r[4], *r[6:]) for r in rows], "film string, ord int, pick string, t0 double, duration_s double, in_s double, out_s double, max_head int, max_tail int, hard_in boolean")
    audio = lay.lay_audio(picks, "film")
    assert "FlatMapGroups" not in audio._jdf.queryExecution().toString()
    columns = ["pick", "rec", "dur", "head", "tail", "fade_in", "fade_out", "hole", "track"]
    got = [tuple(r) for r in audio.orderBy("film", "ord").select(*columns).collect()]
    assert got == [
        ("a", 0, 48, 0, 3, 12, 5, 0, 1), ("b", 54, 42, 8, 50, 5, 2, 70, 2), ("c", 216, 24, 0, 0, 2, 12, 0, 1), ("d", 240, 24, 12, 1, 2, 12, 0, 2), ("e", 120, 24, 0, 12, 12, 12, 0, 1),
    ]
    v = [("f", 1, 0, "video", 3.0, 30.0, False, 0.0, 2.0), ("f", 1, 1, "bare", 0.0, 24.0, False, 2.0, 2.01), ("f", 2, 0, "video", 1.0, 24.0, False, 2.25, 3.0), ("f", 2, 1, "placeholder", 9.0, 30.0, True, 3.0, 4.0), ("f", 3, 0, "video", 0.0, 25.0, False, 9.0, 9.4)]
    rows = spark.createDataFrame(v, "film string, beat int, k int, type string, in_s double, fps double, card boolean, dest_in_s double, dest_out_s double")
    beats = spark.createDataFrame([("f", 1, 2.0, 0.26), ("f", 2, 4.0, 5.0), ("f", 3, 10.0, 0.0)], "film string, beat int, end_s double, gap_after_s double")
    video = lay.lay_video(rows, beats, "film")
    got = [tuple(r) for r in video.orderBy("rec").select("beat", "rec", "dur", "sf", "ef", "covers_gap").collect()]
    # the first row covers its gap to the next beat's frame at 30 frames a second; a card never does, short rows are not laid
    assert got == [(1, 0, 54, 90, 158, True), (2, 72, 24, 0, 24, False)]
    assert [tuple(r) for r in lay.holes(audio, video, "film").collect()] == [("f", "b", 146, 70, 572, 642)]
    spanned = video.union(video.limit(1).withColumns({"rec": F.lit(140).cast("long"), "dur": F.lit(100).cast("long")}))
    assert lay.holes(audio, spanned, "film").count() == 0
    assert {tuple(r) for r in lay.end_frame(audio, video, "film").collect()} == {("f", 265), ("g", 156)}
    limits = spark.createDataFrame([(-60.0, -40.0), (-30.0, -3.0), (-20.0, -9.0), (None, -1.0), (-30.0, None)], "l double, p double")
    got = [r[0] and tuple(r[0]) for r in limits.select(lay.gain_limit(F.col("l"), F.col("p"), verdicts.gain_for(F.col("l"), F.col("p")))).collect()]
    assert got == [("capped", 36.0), ("peak", 4.5), None, ("unmeasured", None), None]
    made = lay.markers(spark.createDataFrame([("f", 1, 0.5, "one", None)], "film string, beat int, start_s double, title string, notes string"), rows.withColumn("text", F.lit("card")), "film")
    assert {tuple(r) for r in made.collect()} == {("f", 12, "B01 one", ""), ("f", 73, "PLACEHOLDER", "card")}


def test_word_room(spark):
    picks = spark.createDataFrame([("s", "p", 5.0, 8.0), ("s", "q", 0.5, 90.0)], "src string, pick string, in_s double, out_s double")
    words = spark.createDataFrame([("s", 3.0, 4.0), ("s", 5.0, 8.01), ("s", 9.0, 9.5)], "src string, s double, e double")
    got = {r["pick"]: (round(r["max_head_s"], 2), round(r["max_tail_s"], 2)) for r in cuts.word_room(picks, words, ["src"]).collect()}
    assert got == {"p": (0.95, 0.95), "q": (0.5, 3.0)}


def test_legacy_layout(spark):
    r = spark.createDataFrame([(1, 0, "video", "a", 3.0), (1, 1, "bare", None, 2.0), (1, 2, "video", "b", 9.0), (1, 3, "video", "c", 1.0)], "beat int, k int, type string, clip string, duration_s double")
    beats = spark.createDataFrame([(1, 5.5), (2, 4.0)], "beat int, room double")
    got = [(x["beat"], x["type"], x["clip"], x["t0"], x["t1"]) for x in cuts.legacy_layout(r, beats, ["beat"]).orderBy("beat", "t0").collect()]
    assert got == [(1, "video", "a", 0.0, 3.0), (1, "bare", None, 3.0, 5.0), (1, "bare", None, 5.0, 5.5), (2, "bare", None, 0.0, 4.0)]


def test_upper_medians_hold_no_group(spark):
    r = random.Random(4)
    groups = {("a", 1): [r.choice([1.0, 2.0, 2.5, 9.0]) for _ in range(500)], ("b", None): [r.gauss(0, 1) ** 3 for _ in range(777)], (None, 2): [4.0, None, 3.0], ("n", 3): [1.0, math.nan, math.nan], ("e", 4): [None]}
    df = spark.createDataFrame([(*k, x) for k, v in groups.items() for x in v], "k string, j int, x double")
    found = {(q["k"], q["j"]): q["median"] for q in series.upper_medians(df, ["k", "j"], "x", buckets=8).collect()}
    assert found.keys() == groups.keys() and found["e", 4] is None and math.isnan(found["n", 3])
    for k in [("a", 1), ("b", None), (None, 2)]:
        have = sorted(x for x in groups[k] if x is not None)
        assert found[k] == have[len(have) // 2]


@pytest.mark.parametrize("name", ["upper_median_by_context", "loudness_by_user"])
def test_median_queries_collect_no_group(spark, name):
    from chronoweave.plans import registry
    from tests.conftest import SMALL

    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan

"""Evidence, audits and unit look-ups on small cases."""

from pyspark.sql import functions as F

from chronoweave.operators import evidence


def test_observations_and_audits(spark):
    text = "array<string>"
    df = spark.createDataFrame(
        [(1, ["a"], []), (2, [], []), (3, None, []), (4, ["a", " "], ["", "u"])], f"id int, facts {text}, unsure {text}"
    )
    got = {r["id"]: len(r["e"]) for r in df.select("id", evidence.observation_errors(F.col("facts"), F.col("unsure")).alias("e")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    good, bad = ("omission", "mood", "c", ["e1"], "r"), ("rumour", "x", " ", ["e1", "e1"], "r")
    audits = spark.createDataFrame(
        [(1, ["e2", "e1"], [good]), (2, ["e1"], [good]), (3, ["e1", "e2"], None), (4, ["e1", "e2"], [bad]), (5, ["e1", "e2"], [])],
        f"id int, reviewed {text}, findings {evidence.FINDINGS}",
    )
    errors = evidence.audit_errors(F.col("reviewed"), F.array(F.lit("e1"), F.lit("e2")), F.col("findings"), F.array(F.lit("mood")))
    rows = {r["id"]: (len(r["e"]), r["s"], r["old"]) for r in audits.select("id", errors.alias("e"), evidence.audit_status(F.lit("x"), F.lit("x"), errors, F.col("findings")).alias("s"), evidence.audit_status(F.lit("x"), F.lit("y"), errors, F.col("findings")).alias("old")).collect()}
    assert {k: v[0] for k, v in rows.items()} == {1: 0, 2: 1, 3: 1, 4: 4, 5: 0}
    assert {k: v[1] for k, v in rows.items()} == {1: "needs_review", 2: "unchecked", 3: "unchecked", 4: "unchecked", 5: "no_issue_detected"}
    assert {v[2] for v in rows.values()} == {"unchecked"}


def test_units(spark):
    shots = spark.createDataFrame([("A_s01", "A", 1.0), ("B_s01", "B", 2.0), ("C_s01", "C", 3.0)], "shot_id string, source_id string, in_s double")
    windows = spark.createDataFrame([("A_s01_w01", "A", "A_s01"), ("Z_w01", "Z", "Z")], "shot_id string, source_id string, parent_shot_id string")
    u = evidence.units(shots, windows)
    assert u.count() == 5 and [r["shot_id"] for r in evidence.orphan_windows(shots, windows).collect()] == ["Z_w01"]
    notes = spark.createDataFrame([("A_s01", "sea", None), ("A_s01_w01", "sea", None), ("B_s01", "", None), ("C_s01", "x", "failed")], "shot_id string, subject string, error string")
    assert [r["shot_id"] for r in evidence.catalogue(u, notes).collect()] == ["A_s01_w01"]
    assert evidence.catalogue(u, notes, ["A"]).count() == 0


def test_sessions_and_stretches(spark):
    clips = spark.createDataFrame([("c", "d1"), ("q", "d9")], "clip string, day string")
    sessions = spark.createDataFrame([("s1", "L", "d1"), ("s2", "L", "d2"), ("s3", "R", "d1")], "session string, side string, day string")
    scores = spark.createDataFrame([(c, s, r, 0, 0.1) for c in "cq" for s, r in (("s1", 0.4), ("s2", 0.9), ("s3", 0.2))], "clip string, session string, r double, lag int, margin double")
    got = {(r["clip"], r["side"]): r["session"] for r in evidence.best_sessions(clips, sessions, scores).collect()}
    assert got == {("c", "L"): "s1", ("c", "R"): "s3", ("q", "L"): "s2", ("q", "R"): "s3"}
    st = spark.createDataFrame([(1, "p1", 0.0, 1.0), (1, None, 0.9, 3.0)], "beat int, pick string, t0 double, t1 double")
    picks = spark.createDataFrame([(1, "p1", 0.0, 1.0), (1, "p2", 1.0, 3.0)], st.schema)
    assert sorted(r["pick"] for r in evidence.stretch_picks(st, picks).collect()) == ["p1", "p2"]
    words = spark.createDataFrame([("k", "in", 1.0, 1.5), ("k", "edge", 1.97, 2.04), ("k", "half", 1.8, 2.3)], "k string, w string, s double, e double")
    p = spark.createDataFrame([("k", "p", 0.0, 2.0)], "k string, pick string, in_s double, out_s double")
    assert sorted(r["w"] for r in evidence.words_kept(words, p, ["k"]).collect()) == ["edge", "in"]
    assert sorted(r["w"] for r in evidence.words_kept(words, p, ["k"], slack=0.1, middle=True).collect()) == ["edge", "half", "in"]

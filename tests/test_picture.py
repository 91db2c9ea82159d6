"""Picture rows: every branch fills its pick, and every bare row says why."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import picture, reconcile

PICKS = "film string, ord int, beat int, pick string, t0 double, duration_s double, shot string, alternatives array<string>, status string, note string, protected string, never string, card_s double, segments array<struct<until_s:double,shot:string,note:string>>"
VERDICTS = "film string, pick string, shot string, score int, watchable boolean, from_s double, reason string"
SHOTS = "film string, shot string, in_s double, out_s double, runs array<struct<t0:double,t1:double>>, barred string"


def build(spark, picks, verdicts, shots):
    """picks: (seconds, shot, alternatives, further fields); all verdicts are good unless said otherwise."""
    rows, at = [], 0.0
    for i, (seconds, shot, alternatives, more) in enumerate(picks):
        r = dict(film="f", ord=i, beat=1 + i // 4, pick=f"p{i}", t0=at, duration_s=seconds, shot=shot, alternatives=alternatives, status="ok") | more
        rows.append(tuple(r.get(c.split()[0]) for c in PICKS.split(", ")))
        at += seconds
    p = spark.createDataFrame(rows, PICKS)
    v = spark.createDataFrame([("f", *x) for x in verdicts], VERDICTS)
    s = spark.createDataFrame([("f", *x) for x in shots], SHOTS)
    made = picture.build_rows(picture.offers(p, v, s, "film"), "film")
    # the rows of a film are one chain of picks, to 0.02 s
    found = made.orderBy("dest_in_s").collect()
    assert found[0]["dest_in_s"] == 0 and found[-1]["dest_out_s"] == pytest.approx(at, abs=0.021)
    for a, b in zip(found, found[1:]):
        assert a["dest_out_s"] == pytest.approx(b["dest_in_s"], abs=0.021)
    for r in found:
        assert r["type"] != "bare" or r["note"]
        assert r["out_s"] - r["in_s"] == pytest.approx(r["dest_out_s"] - r["dest_in_s"], abs=0.021)
    for i, (seconds, *_) in enumerate(picks):  # each pick's rows lie within it, unless the row before ran on
        own = [r for r in found if r["pick"] == f"p{i}" and len(r["picks"]) == 1]
        assert all(r["dest_in_s"] >= rows[i][4] - 0.021 and r["dest_out_s"] <= rows[i][4] + seconds + 0.021 for r in own)
    return [(r["pick"], r["type"], r["shot"], r["in_s"], r["out_s"], r["note"]) for r in found], made, p


def good(*pairs, from_s=None):
    return [(p, s, 3, True, from_s, "fits") for p, s in pairs]


LONG, TEN, SIX = ("long", 10.0, 60.0, None, None), ("ten", 100.0, 110.0, None, None), ("six", 0.0, 6.0, None, None)


def test_plain_and_bare(spark):
    got, _, _ = build(
        spark,
        [(5.0, "long", [], {}), (4.0, None, [], {}), (4.0, None, [], {"note": "on her face"}), (0.5, "long", [], {}), (6.0, "long", [], {"status": "unchecked", "note": "late"}),
         (3.0, "long", [], {"protected": "r7"}), (3.0, "gone", [], {}), (3.0, "bad", ["ten"], {}), (3.0, "long", ["ten"], {"never": "lo"}), (3.0, "long", [], {})],
        good(("p0", "long"), ("p3", "long"), ("p4", "long"), ("p5", "long"), ("p7", "bad"), ("p7", "ten"), ("p8", "long"), ("p8", "ten")) + [("p9", "long", 3, False, None, "blur")],
        [LONG, TEN, ("bad", 0.0, 9.0, None, "shakes")],
    )
    assert got == [
        ("p0", "video", "long", 10, 15, "fits"), ("p1", "bare", None, 0, 4, "the speaker carries it"), ("p2", "bare", None, 0, 4, "on her face"), ("p3", "bare", None, 0, 0.5, "under a second; the speaker carries it"),
        ("p4", "bare", None, 0, 6, "PROVISIONAL: no accepted verdict; late"), ("p5", "bare", None, 0, 3, "held bare by rule r7"), ("p6", "bare", None, 0, 3, "gone is not in the catalogue"),
        ("p7", "bare", None, 0, 3, "bad is no cover: shakes"), ("p8", "bare", None, 0, 3, "long may not stand over this source"), ("p9", "bare", None, 0, 3, "no watchable shot; the speaker carries it"),
    ]


def test_rows_run_on_and_repeat(spark):
    got, made, _ = build(
        spark,
        [(5.0, "long", [], {}), (4.0, "long", [], {}), (3.0, "ten", [], {}), (8.0, "long", [], {}), (9.0, "ten", [], {}), (40.0, "long", [], {})],
        good(*[(f"p{i}", s) for i, s in enumerate(["long", "long", "ten", "long", "ten", "long"])]), [LONG, TEN],
    )
    # the second pick joins the first row; ten has 7 s behind its first use, so it is shown again for 9
    assert got == [
        ("p0", "video", "long", 10, 19, "fits"), ("p2", "video", "ten", 100, 103, "fits"), ("p3", "video", "long", 19, 27, "fits"),
        ("p4", "video", "ten", 100, 109, "fits; shows footage again"), ("p5", "video", "long", 10, 50, "fits; shows footage again"),
    ]
    assert [r["picks"] for r in made.where("pick = 'p0'").collect()] == [["p0", "p1"]]


def test_long_picks_share_offers(spark):
    alternatives = ["ten", "six", "weak"]
    v = good(("p0", "long"), ("p0", "ten"), ("p0", "six"), ("p1", "six"), ("p1", "ten"), ("p2", "six")) + [("p0", "weak", 1, True, None, "")]
    got, _, _ = build(spark, [(33.0, "long", alternatives, {}), (30.0, "six", ["ten"], {}), (20.0, "six", [], {})], v, [LONG, TEN, SIX, ("weak", 0.0, 90.0, None, None)])
    # parts of 11: ten lacks 1, six lacks 6, so the first row gives 6 more; the second pick has 16 s of footage
    assert [g[:5] for g in got[:3]] == [("p0", "video", "long", 10, 27), ("p0", "video", "ten", 100, 110), ("p0", "video", "six", 0, 6)]
    assert [g[:3] for g in got[3:]] == [("p1", "video", "six"), ("p1", "video", "ten"), ("p1", "bare", None), ("p2", "video", "six"), ("p2", "bare", None)]
    assert got[5][5] == "ten ran short; the speaker fills the rest" and got[5][4] == pytest.approx(14)


def test_unwatchable_choice_gives_way(spark):
    v = [("p0", "long", 3, False, None, "blur"), *good(("p0", "ten"))]
    got, _, _ = build(spark, [(5.0, "long", ["ten"], {})], v, [LONG, TEN])
    assert got == [("p0", "video", "ten", 100, 105, "fits")]


def test_steady_parts_and_starts(spark):
    runs = [(2.0, 6.0), (10.0, 30.0)]
    shaky = ("shaky", 0.0, 40.0, runs, None)
    got, _, _ = build(spark, [(5.0, "shaky", [], {}), (6.0, "shaky", [], {}), (3.0, "ten", [], {})], good(("p0", "shaky")) + good(("p1", "shaky"), from_s=9.0) + good(("p2", "ten"), from_s=108.0), [shaky, TEN])
    assert [g[:5] for g in got] == [("p0", "video", "shaky", 2, 6), ("p0", "bare", None, 0, 1), ("p1", "video", "shaky", 10, 16), ("p2", "video", "ten", 108, 110), ("p2", "bare", None, 0, 1)]
    assert all(any(a - 0.01 <= g[3] and g[4] <= b + 0.01 for a, b in runs) for g in got if g[2] == "shaky")
    # the last accepted second of a shot leaves too little
    got, _, _ = build(spark, [(3.0, "ten", [], {})], good(("p0", "ten"), from_s=109.5), [TEN])
    assert got == [("p0", "bare", None, 0, 3, "no accepted second to show; the speaker fills the rest")]


def test_cards_and_segments(spark):
    segments = [(2.0, "long", None), (3.5, None, "her face"), (6.0, "ten", None), (7.0, "long", None)]
    v = good(("p0", "long"), ("p1", "long")) + [("p1", "ten", 1, True, None, "")]
    got, _, _ = build(spark, [(10.0, "long", [], {"card_s": 20.0}), (9.0, "long", [], {"segments": segments}), (0.5, "long", [], {"card_s": 4.0})], v, [LONG, TEN])
    assert [g[:3] for g in got] == [
        ("p0", "placeholder", "long"), ("p0", "video", "long"), ("p1", "video", "long"), ("p1", "bare", None), ("p1", "bare", None), ("p1", "video", "long"), ("p1", "bare", None), ("p2", "placeholder", "long"),
    ]
    assert [g[5] for g in got if g[1] == "bare"] == ["her face", "ten has no accepted verdict for these words", "behind the last segment"]
    assert [round(g[4] - g[3], 2) for g in got if g[0] == "p1"] == [2, 1.5, 2.5, 1, 2]


def test_invariants_hold(spark):
    _, made, picks = build(spark, [(5.0, "long", [], {}), (30.0, "six", ["ten"], {}), (2.0, None, [], {}), (8.0, "ten", [], {})], good(("p0", "long"), ("p1", "six"), ("p1", "ten"), ("p3", "ten")), [LONG, TEN, SIX])
    placed = made.withColumn("duration_s", F.col("dest_out_s") - F.col("dest_in_s")).withColumn("k", F.row_number().over(Window.partitionBy("beat").orderBy("dest_in_s")))
    assert reconcile.placement_faults(placed, picks, ["film"]).count() == 0
    empty = picks.limit(0)
    assert picture.build_rows(picture.offers(empty, spark.createDataFrame([], VERDICTS), spark.createDataFrame([], SHOTS), "film"), "film").count() == 0

"""What a review of the third round found."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import evidence
from chronoweave.plans import registry
from tests.test_queries import plain


@pytest.fixture
def against(spark, tmp_path):
    """Compares a query with its SQL on tables given as DuckDB selects."""

    def run(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet'")
            c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(registry.ORACLES[name]).df()
        assert plain(got) == plain(want)
        return got

    return run


def test_words_kept_in_wide_buckets(spark):
    """Words without length count too, and no side of the bucket join is broadcast."""
    at = 1_700_000_000.0
    words = spark.createDataFrame([("u", 1, at + 5, at + 5), ("u", 2, at - 10, at + 9), ("u", 3, at + 21590, at + 21650), ("u", 4, at + 99999, at + 99999)], "k string, w int, s double, e double")
    picks = spark.createDataFrame([("u", "p", at, at + 21600)], "k string, pick string, in_s double, out_s double")
    found = evidence.words_kept(words, picks, ["k"], middle=True, width=21600.0, inside="whole")
    assert {(r["w"], r["whole"]) for r in found.collect()} == {(1, True)}
    assert {r["w"] for r in evidence.words_kept(words, picks, ["k"], width=21600.0).collect()} == {1}
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_faults_write_and_shuffle_nothing(spark):
    """All rules are told inside a document's row, null members count as missing, deep and odd texts too."""
    from chronoweave.sources import documents

    docs = spark.createDataFrame([(1, '{"project": null, "days": {"d": "2026-05-01"}, "sessions": [{"id": "a"}, {"id": "a", "day": "e", "x": {"y": [[1]]}}]}'), (2, "[]")], "doc int, text string")
    found = documents.faults(docs, documents.SCHEDULE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "ExistingRDD[doc#" in plan.replace("Scan ", "")
    assert {tuple(r) for r in found.collect()} == {
        (1, "project", "is required"), (1, "sessions[0].day", "is required"), (1, "sessions[0].start", "is required"), (1, "sessions[1].start", "is required"),
        (1, "sessions[0].id", "'a' is listed more than once"), (1, "sessions[1].id", "'a' is listed more than once"), (1, "sessions[1].day", "'e' is not a known day"), (1, "sessions[1].x", "is an unknown key"),
    }


def test_tokens_and_their_sql_write_out_contractions(against):
    texts = ["I don't know, we CAN'T; they're won't let's", "dont wouldnt've i'm him'm n't x'll 've", "one\x0btwo 3 'quoted' shan't 12 KK İx", "", None, "naïve l'été 5 don''t"]
    rows = ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})" for i, t in enumerate(texts))
    documents = f"SELECT * FROM (VALUES {rows}) d(doc_id, text)"
    assert against("tokenise_normalise", documents=documents)["n_tokens"].sum() > 30
    assert against("critical_token_counts", documents=documents).set_index("cls")["n"]["polarity"] >= 6


def events_of(rows):
    """rows: event_id, microseconds, user_id, event_type, value."""
    each = ", ".join(f"({i}, make_timestamp({us}), {u}, '{t}', {v}::DOUBLE)" for i, us, u, t, v in rows)
    return f"SELECT * FROM (VALUES {each}) e(event_id, ts, user_id, event_type, value)"


def test_word_room_to_the_microsecond(against):
    """Words right on a limit are met, and halves of a place round up, on both sides."""
    rows, start = [], 1_704_067_200_000_000
    for i in range(300):
        at = start + i * 1_234_567
        rows += [(3 * i, at, i, "error", 1), (3 * i + 1, at - 980_000 - i * 31_250, i, "view", 1), (3 * i + 2, at + 980_000 + i * 31_250, i, "view", 1)]
    got = against("word_room", events=events_of(rows))
    assert set(got["event_id"]) == {3 * i for i in range(300)} and got["head"].max() < 100 and got[got["user_id"] == 34]["head"].item() == 1.9925


def test_talk_levels_on_halves(against):
    """Percentiles that lie right between two tenths round up on both sides."""
    rows = [(600 * k + 30 * j, 1_704_067_200_000_000 + k, k, "view", round(20 + k * 0.01 + j * 1.25, 2)) for k in range(400) for j in range(6)]
    got = against("talk_levels", events=events_of(rows))
    assert len(got) == 400 and got[got["user_id"] == 0]["level"].item() == 25.6


def test_stable_runs_at_the_limit(against):
    """A mean of 60 is under the limit in whatever order its values are added."""
    day, rows = 86_400_000_000, []
    for u in range(60):
        values = [round(60 + (k * 7 + u) % 13 * 0.01 + 0.1 * k, 2) for k in range(4)]
        values = [*values, *[round(120 - v, 2) for v in reversed(values)]]
        rows += [(u * 1000 + k, 1_704_067_200_000_000 + k * day // 2, u, "view", values[k % 8]) for k in range(60)]
    got = against("stable_runs", events=events_of(rows))
    assert set(got["user_id"]) == set(range(60))


def test_conform_takes_the_nearest_and_so_does_its_sql(against):
    """Crowded seconds: planned rows choose in order, whatever their ids say."""
    rows = [(i, 1_704_067_200_000_000 + i * 700_000 % 40_000_000, i % 2, "view", i % 30) for i in range(400)]
    got = against("conform_diffs", events=events_of(rows))
    assert {"ok", "mismatch", "missing"} <= set(got["status"])
    assert (got.dropna()["plan_id"].astype(int) + 1_000_000_000 != got.dropna()["found_id"].astype(int)).any()


def test_sentences_are_halved_until_none_is_too_long(spark):
    """Pauses that shorten from word to word take one word off in each round, more rounds than there once were."""
    from chronoweave.operators import talk

    words, at = [], 0.0
    for i in range(60):
        words.append(("k", f"w{i:02d}", at, at + 0.5))
        at += 1.05 - i * 0.005
    found = talk.sentences(spark.createDataFrame(words, "k string, w string, s double, e double"), ["k"], pause=9.0, longest=5.0)
    rows = found.orderBy("n").collect()
    assert max(r["t1"] - r["t0"] for r in rows) <= 5 and " ".join(r["text"] for r in rows) == " ".join(w[1] for w in words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") < 8


def test_token_edits_of_many_rows_in_one_task(spark):
    """Rows are aligned a few at a time, and each keeps its own steps."""
    from chronoweave.operators import textops

    df = spark.range(3 * textops.ROWS + 5).coalesce(1).select("id", F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" was not here")).alias("a"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" was here")).alias("b"))
    got = textops.token_edits(df, "a", "b").select("id", "edits.matched", "edits.omissions").collect()
    assert len(got) == 3 * textops.ROWS + 5 and all(r["matched"] == 3 and r["omissions"] == ["not"] for r in got)


def test_search_holds_no_vector_as_python_objects():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from chronoweave.functions import vectors

    rng = np.random.default_rng(1)
    q, rows = rng.normal(size=(1000, 64)), rng.normal(size=(10_000, 64)).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 10_000)], pa.int64()), pa.array([rows[0], None, [1.0], *rows[3:]])], names=["id", "v"])
    tracemalloc.start()
    out = pa.Table.from_batches(list(vectors._best(SimpleNamespace(value=(np.arange(1000), q)), 3, 9)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 3000 and not {0, 1, 2} & set(out["id"].to_pylist()) and peak < 50e6


def test_choice_streams_films(spark):
    """No film is a group of its own; films in one task don't share what was used."""
    from chronoweave.operators import choose

    picks = spark.createDataFrame([(f, o, 10 * f + o, False) for f in range(3) for o in range(4)], "film int, ord int, pick int, bare boolean").coalesce(1)
    options = spark.createDataFrame([(f, 10 * f + o, i, s, x, True, False, False) for f in range(3) for o in range(4) for i, (s, x) in enumerate([("a", 3.0), ("b", 2.5)])], "film int, pick int, i int, shot string, score double, accepted boolean, barred boolean, placeholder boolean")
    found = choose.choose(picks, options, ["film"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["shot"] for r in found.orderBy("pick").collect()] == ["a", "a", "b", "b"] * 3


def test_picture_rows_join_nothing(spark):
    """picks that carry their verdicts meet their shots in one sorted stream, with the same rows as by verdicts of their own."""
    from chronoweave.operators import picture
    from tests import test_picture as given
    from tests.conftest import SMALL

    plan = registry.QUERIES["picture_totals"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and plan.count("Exchange") <= 4

    default = dict(film="f", beat=1, duration_s=5.0, alternatives=["b", None, "a"], status="ok")
    more = [dict(shot="a"), dict(shot="b", never="b"), dict(shot="c"), dict(shot=None), dict(shot="a", film=None), dict(shot="d", alternatives=None), dict(shot="b", duration_s=40.0, segments=[(3.0, "a", None), (9.0, "b", "x")]), dict(shot="a", card_s=2.0)]
    rows = [default | dict(ord=i, pick=f"p{i}", t0=float(10 * i)) | m for i, m in enumerate(more)]
    p = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in given.PICKS.split(", ")) for r in rows], given.PICKS)
    said = [("f", f"p{i}", s, n, w, None, None) for i in range(8) for s, n, w in (("a", 3, True), ("b", 1 + i % 3, i != 1), ("d", None, None))]
    v = spark.createDataFrame(said, given.VERDICTS)
    s = spark.createDataFrame([("f", "a", 0.0, 60.0, None, None), ("f", "b", 0.0, 9.0, [(1.0, 8.0)], None), ("f", "d", 0.0, 9.0, None, "shakes")], given.SHOTS)
    verdict = F.struct("shot", "score", "watchable", "from_s", "reason")
    carried = p.join(v.groupBy("film", "pick").agg(F.collect_list(verdict).alias("judged")), ["film", "pick"], "left")
    one, two = (picture.build_rows(o, "film").orderBy(F.col("film").isNull(), "dest_in_s").collect() for o in (picture.offers(p, v, s, "film"), picture.offers(carried, None, s, "film")))
    assert one == two
    assert {(r["pick"], r["note"]) for r in one if r["type"] == "bare" and not r["dest_in_s"] % 10} == {
        ("p1", "b may not stand over this source"), ("p2", "c is not in the catalogue"), ("p3", "the speaker carries it"), ("p4", "no watchable shot; the speaker carries it"), ("p5", "d is no cover: shakes"),
    }
    with pytest.raises(Exception, match="listed more than once"):
        picture.build_rows(picture.offers(p, v, s.unionByName(s), "film"), "film").collect()


def test_sessions_of_clips_sort_scores_once(spark):
    """scores are not joined back to themselves nor gathered by session, and days without a session still count as none."""
    import random

    rng = random.Random(13)
    days = ["d0", "d1", "d2", None]
    sessions = [(f"s{i}", rng.choice("LR"), rng.choice(days)) for i in range(9)]
    clips = [(f"c{i}", rng.choice([*days, "d9"])) for i in range(40)] + [("c1", "d0"), ("c2", "d1")]
    scores = [(f"c{i}", s[0], rng.choice([0.1, 0.5, None]), i, 0.1) for i in range(40) for s in sessions if rng.random() < 0.6]
    frames = [spark.createDataFrame(r, t) for r, t in ((clips, "clip string, day string"), (sessions, "session string, side string, day string"), (scores, "clip string, session string, r double, lag int, margin double"))]
    found = evidence.best_sessions(*frames)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "_part" in plan
    rows = [(c, side, (r is not None, r or 0.0, s), r, day == d) for c, day in clips for k, s, r, _, _ in scores if k == c for n, side, d in sessions if n == s]
    want = {}
    for c, side, order, r, same in rows:
        if same or not any(x[4] for x in rows if x[0] == c):
            want[c, side] = max(want.get((c, side), ((False,), None)), (order, r), key=lambda x: x[0])
    got = {(x["clip"], x["side"]): (x["session"], x["r"]) for x in found.collect()}
    assert got == {k: (o[2], r) for k, (o, r) in want.items()} and len(got) > 40

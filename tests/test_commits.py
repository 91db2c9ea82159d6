"""Sinks that commit, streams with shared state, and restarts."""

import datetime
import glob
import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.sources import ledger
from chronoweave.streaming import events as stream
from chronoweave.streaming import shared


def test_two_writers(spark, tmp_path):
    folder, like = str(tmp_path / "t"), spark.createDataFrame([], "k long, v string")
    rows = lambda: sorted(map(tuple, ledger.read_appended(spark, folder, like).collect()), key=lambda r: (r[0] is not None, r))
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (None, "m")], like.schema)
    assert ledger.append_keyed(first, folder, ["k"]) == 1 and rows() == [(None, "m"), (1, "a"), (2, "c")]
    assert ledger.append_keyed(first, folder, ["k"]) == 2 and len(rows()) == 3  # an append of known keys adds none
    # many writers with one key in common and one of their own: every key is there once
    failed = []

    def add(i):
        try:
            ledger.append_keyed(spark.createDataFrame([(100, f"w{i}"), (200 + i, f"w{i}")], like.schema), folder, ["k"], attempts=20)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=add, args=(i,)) for i in range(5)]
    [w.start() for w in writers], [w.join() for w in writers]
    assert not failed
    keys = [r[0] for r in rows()]
    assert sorted(k for k in keys if k and k >= 100) == [100, 200, 201, 202, 203, 204]
    # a writer that read an old version is refused, and leaves nothing
    before = set(glob.glob(f"{folder}/data/*"))
    with pytest.raises(Exception, match="taken by another writer"):
        spark.createDataFrame([(7, "x")], like.schema).write.format("keyed_append").mode("append").option("path", folder).option("version", 0).save()
    assert set(glob.glob(f"{folder}/data/*")) == before and (7, "x") not in rows()


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder, like = str(tmp_path / "t"), spark.createDataFrame([], "k long, v string")
    ledger.append_keyed(spark.createDataFrame([(1, "a")], like.schema), folder, ["k"])
    files = lambda: sorted(os.listdir(f"{folder}/data"))
    before = files()
    bad = spark.range(2, 4000, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") == 3900, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("keyed_append").mode("append").option("path", folder).option("version", 1).save()
    assert ledger.read_appended(spark, folder, like).count() == 1 and files() == before


def test_killed_tasks_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.dataSource.register(ledger.KeyedAppend)
    # one task fails while the others are in the middle of their files; they are killed and report nothing
    bad = spark.range(0, 40_000_000, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") == 31_000_000, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("keyed_append").mode("append").option("path", folder).option("version", 0).save()
    assert os.listdir(f"{folder}/data") == []


@pytest.mark.parametrize("sink", [ledger._AppendWriter, ledger._ReportWriter])
def test_a_task_that_outlives_the_abort(tmp_path, sink):
    folder, batch = str(tmp_path / "t"), pa.record_batch({"line": ["x"]})
    writer = sink({"path": folder, "version": "0", "report": "cut.md"})

    def late():
        yield batch
        writer.abort([None])
        yield batch
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(late())
    assert os.listdir(f"{folder}/data") == []
    with pytest.raises(FileNotFoundError):  # one that begins behind the abort
        writer.write(iter([batch]))


def test_report(spark, tmp_path):
    folder = str(tmp_path / "r")
    scores = spark.createDataFrame([("b", 2.5, None), ("a|x", 1.0, "two\nlines")], "clip string, score double, why string")
    lines = ledger.text_lines(spark, ["# Cut 9", ""], 0).union(ledger.table_lines(scores, ["clip", "score", "why"], ["clip"], 1)).union(ledger.text_lines(spark, ["", "end"], 2))
    ledger.write_report(lines, folder, "cut.md")
    want = "# Cut 9\n\n| clip | score | why |\n|---|---|---|\n| a x | 1.0 | two lines |\n| b | 2.5 | - |\n\nend\n"
    assert open(f"{folder}/cut.md", encoding="utf-8").read() == want and os.listdir(f"{folder}/data") == []
    broken = lines.withColumn("line", F.when(F.col("section") == 2, F.raise_error(F.lit("no end")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no end"):
        ledger.write_report(broken, folder, "cut.md")
    assert open(f"{folder}/cut.md", encoding="utf-8").read() == want and os.listdir(f"{folder}/data") == []


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", shared.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minute):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drain(df, folder, checkpoint):
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_shot_uses_over_restarts(rocks, tmp_path):
    spark, source, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    schema = "film string, shot string, in_s double, out_s double, ord int, at timestamp"
    os.makedirs(source)
    live = shared.shot_uses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "film", "at", "1 minute", 600.0)
    batches = [
        [("f", "a", 0.0, 5.0, 1, at(0)), ("f", "b", 0.0, 5.0, 2, at(0)), ("f", "a", 5.0, 9.0, 3, at(1)), ("g", "a", 1.0, 2.0, 1, at(1)), ("f", None, 0.0, 1.0, 4, at(1))],
        [("f", "a", 2.0, 4.0, 5, at(5))],
        [("h", "z", 0.0, 1.0, 1, at(100))],  # the watermark passes f and g
        [("h", "z", 1.0, 2.0, 2, at(101)), ("f", "a", 0.0, 5.0, 9, at(101))],
    ]
    for rows in batches:  # every batch is a new run from the checkpoint
        feed(spark, source, rows, schema)
        drain(live, out, str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted([
        ("f", "a", 1, 0.0, "fresh"), ("f", "b", 1, 0.0, "fresh"), ("f", "a", 2, 5.0, "fresh"), ("g", "a", 1, 1.0, "fresh"), ("f", "a", 3, 9.0, "repeats"),
        ("h", "z", 1, 0.0, "fresh"), ("f", "a", 3, 9.0, "closed"), ("f", "b", 1, 5.0, "closed"), ("g", "a", 1, 2.0, "closed"), ("h", "z", 2, 1.0, "fresh"),
        ("f", "a", 1, 0.0, "fresh"),  # f begins anew: its state was gone
    ])


def test_clips_meet_sessions(spark, tmp_path):
    clips, sessions, out = (str(tmp_path / n) for n in ("c", "s", "o"))
    os.makedirs(clips), os.makedirs(sessions)
    c = spark.readStream.schema("id int, day int, at timestamp").option("maxFilesPerTrigger", 1).parquet(clips)
    s = spark.readStream.schema("session string, day int, t0 timestamp, t1 timestamp").option("maxFilesPerTrigger", 1).parquet(sessions)
    live = shared.assign_stream(c, s, ["day"], "at", "t0", "t1", "10 minutes", "2 hours").select("id", "session")
    steps = [
        ([(1, 1, at(5)), (2, 1, at(70)), (3, 2, at(5))], [("s1", 1, at(0), at(60))]),
        ([(4, 1, at(30)), (5, 1, at(65))], [("s2", 1, at(60), at(90))]),
        ([(9, 1, at(600))], [("s9", 1, at(590), at(700))]),
        ([(10, 1, at(900))], [("s10", 1, at(890), at(1000))]),
    ]
    for a, b in steps:
        feed(spark, clips, a, "id int, day int, at timestamp")
        feed(spark, sessions, b, "session string, day int, t0 timestamp, t1 timestamp")
        drain(live, out, str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert {(1, "s1"), (4, "s1"), (2, "s2"), (5, "s2"), (9, "s9"), (10, "s10"), (3, None)} == got


def test_upsert_refuses_and_cleans(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    os.makedirs(source)
    live = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda cp: stream.upsert(live, folder, str(tmp_path / cp), ["k"], parts=4).trigger(availableNow=True).start().awaitTermination()
    for i in range(6):
        feed(spark, source, [(k, f"{i}") for k in range(20)], "k long, v string")
        run("cp")
    assert len(stream._numbers(spark, f"{folder}/index")) == 2
    left = [(n, p) for n in stream._numbers(spark, f"{folder}/parts") for p in stream._numbers(spark, f"{folder}/parts/{n}", "_part=")]
    assert {n for n, _ in left} == {4, 5}
    assert stream.latest(spark, folder, spark.createDataFrame([], "k long, v string")).where("v = '5'").count() == 20
    with pytest.raises(Exception, match="of another checkpoint"):
        run("other")

"""Sources, sinks and streams on small files."""

import datetime
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from chronoweave.sources import sinks, tables
from chronoweave.streaming import events as stream
from tests.conftest import SMALL

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path):
    run = lambda t, m=None: f"<w:r>{f'<w:rPr><w:highlight w:val={chr(34)}{m}{chr(34)}/></w:rPr>' if m else ''}<w:t>{t}</w:t></w:r>"
    body = f"<w:document {NS}><w:body><w:p>{run('plain')}{run('mark', 'red')}{run('ed', 'red')}{run('x', 'blue')}</w:p><w:p><w:commentRangeStart w:id='0'/><w:commentRangeStart w:id='1'/>{run('long ')}<w:commentRangeEnd w:id='1'/>{run('anchor')}<w:commentRangeEnd w:id='0'/></w:p></w:body></w:document>"
    notes = f"<w:comments {NS}>" + "".join(f"<w:comment w:id='{i}' w:author='ann'><w:p>{run('why')}</w:p></w:comment>" for i in (0, 1)) + "</w:comments>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", notes)


def test_documents(spark, tmp_path):
    docx(tmp_path / "a.docx")
    assert [(r["marker"], r["text"]) for r in tables.marked_runs(spark, str(tmp_path)).orderBy("run").collect()] == [("red", "marked"), ("blue", "x")]
    assert [(r["author"], r["comment"], r["anchor"]) for r in tables.comments(spark, str(tmp_path)).collect()] == [("ann", "why", "long anchor")]


def test_files_and_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.MP4", "a.mov", ".hidden.mp4", "notes.txt"):
        (tmp_path / "in" / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in tables.list_videos(spark, str(tmp_path)).collect()] == ["a.mov", "b.MP4"]
    words = [{"w": "hi", "s": 0.0, "e": 0.4, "p": 0.9}]
    (tmp_path / "t.json").write_text(json.dumps({"src": {"language": "en", "segments": [{"start": 0, "end": 1, "text": "hi", "no_speech": 0.7, "words": words}]}}))
    w = tables.words(spark, str(tmp_path / "t.json"))
    assert [(r["source"], r["w"], r["p"]) for r in w.collect()] == [("src", "hi", 0.9)]
    kept, dropped = tables.split_confident(w)
    assert (kept.count(), dropped.count()) == (0, 1)


@pytest.mark.parametrize("chunk", [7, 64, 8 << 20])
def test_members_are_those_of_the_whole(spark, tmp_path, chunk):
    import json
    import random

    from chronoweave.sources import members

    rng = random.Random(chunk)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "a", " ", "\n", "\\\\"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 12)))
    whole = {f"{text()}{i}": {"t": text(), "n": [rng.random(), {"x": text()}]} for i in range(40)} | {"null": None}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(" \n{ }", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"one":{"t":"\\\\\\""}}', encoding="utf-8")
    schema = "struct<t:string>"
    for name in ("a", "b", "c"):
        path = str(tmp_path / f"{name}.json")
        want, got = tables.keyed_json(spark, path, schema), members.keyed_members(spark, path, schema, chunk)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert members.keyed_members(spark, str(tmp_path / "*.json"), schema, chunk).count() == 42


def test_a_large_object_is_read_in_many_tasks(spark, tmp_path):
    from chronoweave.sources import members

    path = tmp_path / "large.json"
    with open(path, "w") as out:
        out.write("{")
        for i in range(40_000):
            out.write(("," if i else "") + f'"k{i}":{{"t":"{"x{y," * 1000}","n":{i}}}')
        out.write("}")
    assert path.stat().st_size > 150_000_000
    got = members.keyed_members(spark, str(path), "struct<t:string,n:long>")
    assert got.rdd.getNumPartitions() > 15
    assert got.agg(F.count("*"), F.sum("value.n"), F.min(F.length("value.t")), F.max(F.length("value.t"))).first() == (40_000, 40_000 * 39_999 // 2, 4000, 4000)


def test_configuration(spark):
    assert tables.load_config('{"a": 2}', {"a": 1, "b": 3}) == {"a": 2, "b": 3} and tables.first_profile(None, {}, {"x": 1}) == {"x": 1}
    for bad in ('{"z": 1}', "[]"):
        with pytest.raises(ValueError):
            tables.load_config(bad, {"a": 1})
    assert tables.keyed_list(spark, [{"id": "s", "cameras": "A"}], "id string, cameras array<string>").first()["cameras"] == ["A"]
    with pytest.raises(ValueError):
        tables.keyed_list(spark, [{"nope": 1}], "id string")


def test_tags_and_names(spark):
    df = spark.sql("select map('Make', 'Acme', 'encoder', 'e1') as t, array(named_struct('tags', map('CREATION_TIME', '2026'))) as s, '/m/20260314_093000_tx2.wav' as path, 'I: -23.1 LUFS  I: -22.0 LUFS' as report")
    r = df.select(tables.camera_tags(F.col("t"), F.lit("")).alias("c"), tables.first_tag(F.col("t"), F.col("s"), "creation_time").alias("d"), tables.measured(F.col("report"), "I").alias("m")).first()
    assert tuple(r["c"]) == ("Acme", "e1") and r["d"] == "2026" and r["m"] == -22.0
    s = tables.recorder_sessions(df.select("path")).first()
    assert (s["session"], s["part"], s["start"].hour) == ("20260314093000", 2, 9)
    chunks = spark.sql("select 'a' as k, timestamp_ntz'2026-01-01 00:00:00' as start, 10.0D as duration_s union all select 'a', timestamp_ntz'2026-01-01 00:00:11', 5.0D union all select 'a', timestamp_ntz'2026-01-01 00:01:00', 5.0D")
    assert [r["gap_s"] for r in tables.contiguous(chunks, ["k"]).collect()] == [44.0]


def test_sinks(spark, tmp_path):
    df, path = spark.range(5).toDF("k").withColumn("v", F.col("k") * 2), str(tmp_path / "out")
    sinks.write_with_manifest(df, path, {"in": df}, "v1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write(df, path)
    assert sinks.unchanged(spark, path, {"in": df.orderBy(F.desc("k"))}, "v1") and not sinks.unchanged(spark, path, {"in": df.limit(4)}, "v1")
    assert not sinks.unchanged(spark, str(tmp_path / "none"), {}, "v1")
    assert sinks.append_new(spark, path, spark.range(3, 8).toDF("k").withColumn("v", F.lit(0).cast("long")), ["k"]) == 8
    sinks.write_keyed(df.withColumn("p", F.col("k") % 2), str(tmp_path / "k"), "p")
    sinks.write_keyed(df.where("k = 1").withColumn("p", F.lit(1)), str(tmp_path / "k"), "p")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "k")).collect()) == [0, 1, 2, 4]
    sinks.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "o int, line string"), str(tmp_path / "l"), ["o"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    sinks.write_selects(spark.createDataFrame([("x", "hook", 1)], "id string, kind string, rank int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == list(sinks.SELECTS)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(source))
    live = stream.read(spark, str(source), files_per_batch=10)

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}{id(df)}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out")

    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    key = ["event_type", "t0", "n"]
    assert same(run(stream.tumbling(live, "ts", "1 day"), "complete").select(key), stream.tumbling(e, "ts", "1 day").select(key))
    # all but the sessions that the watermark has not passed when the input ends
    done, whole = run(stream.sessions(live, "ts", "6 hours", "1 hour"), "append"), stream.sessions(e, "ts", "6 hours")
    rows = lambda df: {tuple(r) for r in df.select("user_id", F.col("t0").cast("timestamp"), F.col("t1").cast("timestamp"), "n").collect()}
    edge = e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0] - datetime.timedelta(hours=1, seconds=1)
    assert rows(done) and rows(done) <= rows(whole) and all(r[2] > edge for r in rows(whole) - rows(done))
    assert run(stream.first_seen(live, "ts", ["user_id"], "3650 days"), "append").count() == e.select("user_id").distinct().count()
    totals = run(stream.running_totals(live, "user_id", "value"), "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert same(totals, e.groupBy("user_id").agg(F.count("*").alias("n")))


def test_upsert_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    batches = [[(i, f"a{i}") for i in range(40)], [(i, f"b{i}") for i in range(30, 60)], [(5, "c5"), (35, "c35")]]
    want = {}
    for rows in batches:
        want |= dict(rows)
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)
        stream.upsert(live, folder, str(tmp_path / "cp"), ["k"], parts=8).trigger(availableNow=True).start().awaitTermination()
        got = stream.latest(spark, folder, spark.createDataFrame([], "k long, v string"))
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
    # the last batch wrote its two keys' parts only
    assert spark.read.parquet(f"{folder}/parts/2").select("_part").distinct().count() <= 2
    # what the index names is gone: the next batch fails and nothing is lost in silence
    import shutil

    shutil.move(f"{folder}/index/2", f"{tmp_path}/away")
    spark.createDataFrame([(99, "d")], "k long, v string").write.mode("append").parquet(source)
    failing = stream.upsert(live, folder, str(tmp_path / "cp"), ["k"], parts=8).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="(?s)PATH_NOT_FOUND|does not exist"):
        failing.awaitTermination()
    shutil.move(f"{tmp_path}/away", f"{folder}/index/2")
    stream.upsert(live, folder, str(tmp_path / "cp"), ["k"], parts=8).trigger(availableNow=True).start().awaitTermination()
    got = stream.latest(spark, folder, spark.createDataFrame([], "k long, v string"))
    assert sorted(map(tuple, got.collect())) == sorted((want | {99: "d"}).items())


def test_late_rows_are_kept_apart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    for rows in ("(1, timestamp'2026-01-01 10:00:00')", "(2, timestamp'2026-01-01 09:30:00'), (3, timestamp'2026-01-01 08:00:00'), (4, null)", "(5, timestamp'2026-01-01 08:59:59')"):
        spark.sql(f"select cast(col1 as long) as k, col2 as at from values {rows}").coalesce(1).write.mode("append").parquet(source)
        stream.keep_late(live, "at", "1 hour", folder, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    ids = lambda kind: sorted(r["k"] for i in range(3) for r in spark.read.schema("k long").parquet(f"{folder}/{kind}/{i}").collect())
    assert ids("late") == [3, 5] and ids("rows") == [1, 2, 4]


def test_rest_works_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['chronoweave.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')] and len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_envelope_conflicts_and_manifest(spark):
    samples = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 4.0, 0.0, 0.0, 1.0])], "src string, i long, x double")
    got = {r["i"]: (r["rms"], r["db"]) for r in tables.envelope(samples, ["src"], "i", "x", 2).collect()}
    assert got[0] == (pytest.approx(12.5**0.5), pytest.approx(20 * math.log10(12.5**0.5))) and got[1] == (0.0, None) and got[2] == (1.0, 0.0)
    clips = spark.createDataFrame([("p", "walk"), ("p", "drone"), ("q", "walk"), ("q", "walk")], "path string, role string")
    assert [tuple(r) for r in tables.catalogue_conflicts(clips).collect()] == [("p", ["drone", "walk"])]
    one = sinks.manifest(spark, {"clips": clips}, "t1", {"rows": 4}).first()[0]
    again = sinks.manifest(spark, {"clips": clips.repartition(3)}, "t1", {"rows": 4}).first()[0]
    assert one == again != sinks.manifest(spark, {"clips": clips.limit(3)}, "t1", {"rows": 4}).first()[0]


def test_defects_and_selects(spark):
    from chronoweave.operators import talk, textops

    kind = "struct<risks:array<string>,omissions:array<string>,insertions:array<string>>"
    df = spark.createDataFrame([((["a", "b"], [], ["x"]), (["b", "a", "a"], [], ["x"])), ((["a"], [], []), (["a"], ["w"], []))], f"one {kind}, two {kind}")
    assert [r[0] for r in df.select(textops.same_defect(F.col("one"), F.col("two"))).collect()] == [True, False]
    ranked = spark.createDataFrame([("t", 1, 9.0, 25.0, 0.1, 5.0)], "talk string, id int, t0 double, t1 double, head_room double, tail_room double")
    chunks = spark.createDataFrame([("t", "c1", 0.0, 10.0), ("t", "c2", 10.0, 25.2), ("t", "c3", 25.2, 40.0)], "talk string, source string, c0 double, c1 double")
    got = [(r["source"], round(r["in_s"], 3), round(r["out_s"], 3), r["part"], r["parts"]) for r in talk.selects(ranked, chunks, ["talk"]).orderBy("part").collect()]
    assert got == [("c1", 8.9, 10.0, 1, 3), ("c2", 0.0, 15.2, 2, 3), ("c3", 0.0, 0.1, 3, 3)]

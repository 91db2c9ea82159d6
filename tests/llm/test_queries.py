"""The registered queries on the smallest tables, and the pipeline's stages against brute force."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL

CONTRACT = {
    "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "probabilities"],
    "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_line_dedup": ["doc_id", "n_removed", "removed", "kept_sha256"],
    "op8_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query(spark, name):
    from chronoweave.llm import catalogue

    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    assert list(got.columns) == CONTRACT[name]
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len(got) == n and got.doc_id.is_unique
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        want = con.sql(catalogue.ORACLES[name]).df()[list(got.columns)]
        a, b = (x.sort_values("doc_id").reset_index(drop=True).astype(str) for x in (got, want))
        assert (a == b).all().all()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text, patterns, good):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if good(k, m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def personal(k, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {"email": True, "ip": k != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[k]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {"assign": r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def secret_good(k, m):
    return len(m[2] if k == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[k]


@pytest.mark.parametrize("name,patterns,good", [("op4_personal_data", PERSONAL, personal), ("op5_secrets", SECRET, secret_good)])
def test_base_spans_of_queries(spark, name, patterns, good):
    from chronoweave.llm import catalogue

    folder = SMALL.replace("sf0.001", "sf0.01")  # the smallest tables hold no secrets
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalogue.QUERIES[name](spark, folder).collect()
    assert len(rows) == len(texts) and sum(bool(r["spans"]) for r in rows) > 3
    for r in rows:
        want = base_spans(texts[r["doc_id"]], patterns, good)
        assert [r[f"n_{k}"] for k in patterns] == [sum(w.startswith(k + ":") for w in want) for k in patterns]
        assert r["base_sha256"] == sha(",".join(want)) and not set(want) - set(r["spans"].split(","))


def test_media_query(spark):
    from chronoweave.llm import catalogue

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in catalogue.QUERIES["op8_media"](spark, SMALL).collect():
        data = texts[r["doc_id"]]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and f"samples={len(payload) // 64};" in r["feature"]


def test_licence_query(spark):
    from chronoweave.llm import catalogue

    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    some = 0
    for r in catalogue.QUERIES["op9_license_scan"](spark, SMALL).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and not {x for _, x in places} - set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        some += bool(places)
    assert some


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL)
        made.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 3:  # filters
            assert after.columns == docs.columns and 0.5 * docs.count() < after.count() <= docs.count()
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        elif i == 3:
            assert after.columns == docs.columns and after.count() == docs.count()
            assert after.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
        else:
            assert after.count() == docs.count() and after.where("not round_trip").count() == 0
        docs = after
    assert sorted(r[0] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert docs.count() < first.count()


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = "aB3" * 9
    odd = [
        (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "   ", None, "s", 3), (9004, "a quiet walk by the old river wall today", "en", None, 40),
        (9004, "a quiet walk by the old river wall today", "en", None, 40), (None, "no id but some seven words of text", "en", "s", 34), (9005, f"password = {key} was left in a note", "en", "s", 60),
        (9006, "word " * 60_000, "en", "s", 300_000),
    ]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int").selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in docs.dtypes])
    for n, some in enumerate((docs.unionByName(more), docs.limit(0))):
        some = some.withColumn("row", F.lit("clash")).withColumn("score", F.lit(1.5)).withColumn("a.b", F.lit("dotted"))
        columns = some.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, some, SMALL)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == columns
            made.write.parquet(str(tmp_path / f"{n}{name}"))
            some = spark.read.parquet(str(tmp_path / f"{n}{name}"))
        rows = some.collect()
        assert all(r["round_trip"] for r in rows) and (n == 0) == bool(rows)
        if n == 0:
            ids = [r["doc_id"] for r in rows]
            assert ids.count(9004) == 1 and ids.count(None) == 1 and {9001, 9002, 9003} & set(ids) and 9006 in ids
            assert next(r["n_tokens"] for r in rows if r["doc_id"] == 9005) < 15

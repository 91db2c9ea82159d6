"""Queries on texts, verdicts, references and keyed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import reconcile, schedule, series, textops, verdicts
from chronoweave.session import table

from .common import HOUR, SQL_EVENTS, collector, events

QUERIES, ORACLES, query = collector()

# verdicts and summaries

SQL_JUDGED = """j AS (SELECT d.doc_id, d.lang, d.n_chars AS dur, CASE WHEN l.doc_id IS NULL THEN 'unchecked' ELSE 'ok' END AS status,
  CAST(l.quality * 2 + l.toxic AS BIGINT) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score where they are labelled; the others are unchecked, not clean."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = l.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("score"))
    return d.select("doc_id", "lang", F.col("n_chars").alias("dur")).join(known, "doc_id", "left").withColumn("status", F.when(F.col("score").isNull(), "unchecked").otherwise("ok"))


@query(f"WITH {SQL_JUDGED} SELECT lang, round(sum(score * dur) FILTER (WHERE status = 'ok') / CAST(sum(dur) FILTER (WHERE status = 'ok') AS DOUBLE), 6) AS score, CAST(coalesce(sum(dur) FILTER (WHERE status <> 'ok'), 0) AS BIGINT) AS unchecked_s FROM j GROUP BY lang")
def weighted_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.weighted_score(judged(spark, sf_dir), ["lang"]).withColumn("score", F.round("score", 6))


@query(f"WITH {SQL_JUDGED} SELECT CAST(k AS BIGINT) AS score, CAST(coalesce(sum(dur), 0) AS BIGINT) AS seconds FROM unnest(range(0, 4)) AS t(k) LEFT JOIN j ON score = k GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.score_histogram(judged(spark, sf_dir))


@query(f"""WITH {SQL_JUDGED} SELECT lang, count(*) FILTER (WHERE status = 'ok') AS judged, count(*) FILTER (WHERE status <> 'ok') AS unchecked,
  CAST(coalesce(sum(dur) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS judged_s, CAST(coalesce(sum(dur) FILTER (WHERE status <> 'ok'), 0) AS BIGINT) AS unchecked_s FROM j GROUP BY lang""")
def judge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.coverage(judged(spark, sf_dir), ["lang"])


@query("""WITH t AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'bare' ELSE 'video' END AS kind, length(coalesce(text, '')) AS dur FROM conversations)
SELECT conv_id, CAST(sum(dur) AS BIGINT) AS seconds, CAST(coalesce(sum(dur) FILTER (WHERE kind = 'bare'), 0) AS BIGINT) AS bare,
  round(coalesce(sum(dur) FILTER (WHERE kind = 'bare'), 0) / CAST(nullif(sum(dur), 0) AS DOUBLE) * 100, 6) AS bare_pct, count(*) FILTER (WHERE kind <> 'bare') AS shots,
  round(avg(dur) FILTER (WHERE kind <> 'bare'), 6) AS mean_hold, CAST(coalesce(max(dur) FILTER (WHERE kind = 'bare'), 0) AS BIGINT) AS longest_bare FROM t GROUP BY conv_id""")
def rhythm_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", "bare").otherwise("video").alias("kind"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("dur"))
    return verdicts.rhythm(c, ["conv_id"]).withColumns({"bare_pct": F.round("bare_pct", 6), "mean_hold": F.round("mean_hold", 6)})


@query("""SELECT event_type, n, confident, best, sources FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 100) AS confident, max(value) AS best, count(DISTINCT user_id) AS sources FROM events GROUP BY 1)""")
def species_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("species"), (F.col("value") / 200).alias("confidence"), F.col("user_id").alias("source"))
    found = verdicts.species_summary(e)
    return found.select(F.col("species").alias("event_type"), "n", "confident", F.round(F.col("best") * 200, 6).alias("best"), "sources")


@query("""WITH n AS (SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1),
m AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS species, sum(CAST(round(value * 100) AS BIGINT)) AS s FROM events GROUP BY 1, 2)
SELECT user_id, species, round(s / CAST(n AS DOUBLE), 6) AS mean, CAST(r AS INT) AS rank FROM (SELECT m.user_id, species, s, n, row_number() OVER (PARTITION BY m.user_id ORDER BY s / CAST(n AS DOUBLE) DESC, species) AS r FROM m JOIN n USING (user_id)) WHERE r <= 5""")
def top5_mean_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("species"), F.round(F.col("value") * 100).cast("long").alias("score"))
    return verdicts.mean_over_views(e, ["user_id"], "event_id").withColumn("mean", F.round("mean", 6))


@query("""SELECT l_orderkey, l_linenumber, round_even(least(30, -24 + l_quantity, -1.5 - l_discount * 100), 1) AS gain, CASE WHEN l_quantity - 54 > 0.05 THEN round_even(least(6, l_quantity - 54), 1) ELSE 0.0 END AS leveler FROM lineitem""".replace("-24 + l_quantity", "CAST(-24 + l_quantity AS DOUBLE)"))
def gain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = -F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdicts.gain_for(loud, F.col("l_discount") * 100).alias("gain"), verdicts.leveler_for(loud).alias("leveler"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unchecked' WHEN abs(o_totalprice - 250000) <= 50000 AND o_custkey % 10 <= 6.1 THEN 'honoured' ELSE 'broken' END AS verdict FROM orders""")
def delivery_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", verdicts.delivery(F.col("o_totalprice"), (F.col("o_custkey") % 10).cast("double"), 250000, 50000, 6).alias("verdict"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value < 45 THEN 'dark' END, CASE WHEN value > 185 THEN 'bright' END, CASE WHEN value * 2 >= 250 AND value > 150 THEN 'clipped highlights' END,
  CASE WHEN user_id % 10 <= 3 AND value < 70 THEN 'crushed blacks' END, CASE WHEN event_id % 30 < 12 THEN 'desaturated' END], lambda x: x IS NOT NULL), ',') AS flags FROM events""")
def exposure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(verdicts.exposure_flags(v, v * 2, F.col("user_id") % 10, F.col("event_id") % 30), ",").alias("flags"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_transform(range(0, CAST(l_linenumber AS BIGINT)), lambda i: CAST(CAST(round((CASE WHEN l_linenumber = 1 THEN l_quantity / 2
  ELSE least(0.25, l_quantity * 0.05) + (l_quantity - 2 * least(0.25, l_quantity * 0.05)) / (l_linenumber - 1) * i END) * 1000) AS BIGINT) AS VARCHAR)), ',') AS times FROM lineitem""")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = verdicts.sample_times(F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(times, lambda t: F.round(t * 1000).cast("long").cast("string")), ",").alias("times"))


@query("""SELECT user_id, status, count(*) AS n FROM (SELECT user_id, CASE WHEN floor(value / 50) BETWEEN 0 AND 3 AND event_type IN ('view', 'click') THEN 'ok' ELSE 'invalid' END AS status FROM events) GROUP BY ALL""")
def judgement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    verdict = verdicts.judgement((F.col("value") / 50).cast("string"), F.col("event_type"), F.array().cast("array<string>"), F.array().cast("array<string>"), ["view", "click"])
    return e.select("user_id", verdict.alias("v")).groupBy("user_id", F.col("v.status").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, CASE WHEN t.toxic = 1 THEN 'toxic' WHEN t.quality = 0 THEN 'low quality' WHEN d.n_chars < 500 THEN 'short' END AS why FROM documents d LEFT JOIN labels t USING (doc_id)""")
def catalogue_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    units = d.select(F.col("doc_id").alias("id"))
    why = lambda df, key, text: df.select(F.col(key).alias("id"), F.lit(text).alias("why"))
    reasons = [why(d.where("n_chars < 500"), "doc_id", "short"), why(l.where("quality = 0"), "doc_id", "low quality"), why(l.where("toxic = 1"), "doc_id", "toxic")]
    return verdicts.narrow_catalogue(units, reasons).withColumnRenamed("id", "doc_id")


# texts


def _sql_tokens() -> str:
    """The tokens k (doc_id, i, t) of documents, by the rules of `textops.tokens`: words between ASCII whitespace, held to
    a-z, 0-9 and apostrophes; contractions written out, whole words first, then endings behind two characters; numbers spelt."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    plain = " ".join(f"WHEN '{w}' THEN {text(w[:-2] + "n't")}" for w in textops.NO_APOSTROPHE)
    whole = " ".join(f"WHEN t = {text(c)} THEN {text(full)}" for c, full in textops.CONTRACTIONS.items() if len(c) > 3)
    ends = " ".join(f"WHEN length(t) >= {len(c) + 2} AND ends_with(t, {text(c)}) THEN t[:length(t) - {len(c)}] || {text(' ' + full)}" for c, full in textops.CONTRACTIONS.items() if len(c) <= 3)
    numbers = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in textops.NUMBERS.items())
    return rf"""r AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+') AS xs FROM documents),
w AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM r),
a AS (SELECT doc_id, i, regexp_replace(lower(x), '[^a-z0-9'']', '', 'g') AS t FROM w), b AS (SELECT doc_id, i, CASE t {plain} ELSE t END AS t FROM a),
c AS (SELECT doc_id, i, string_split(CASE {whole} {ends} ELSE t END, ' ') AS ts FROM b),
d AS (SELECT doc_id, i * 4 + generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM c),
k AS (SELECT doc_id, i, CASE t {numbers} ELSE t END AS t FROM d WHERE length(t) > 0)"""


SQL_TOKENS = _sql_tokens()


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", textops.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"""WITH {SQL_TOKENS} SELECT d.doc_id, count(t) AS n_tokens, md5(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS digest FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def tokenise_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query(f"""WITH {SQL_TOKENS} SELECT cls, count(*) AS n FROM (SELECT CASE WHEN t IN {_in(textops.POLARITY)} OR t LIKE '%n''t' THEN 'polarity' WHEN t IN {_in(textops.QUANTITY)} OR regexp_full_match(t, '[0-9]+(st|nd|rd|th)?') THEN 'quantity'
  WHEN t IN {_in(textops.MODALITY)} THEN 'modality' WHEN t IN {_in(textops.ACTOR)} THEN 'actor' END AS cls FROM k) WHERE cls IS NOT NULL GROUP BY cls""")
def critical_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = tokenised(spark, sf_dir).select(F.explode("tokens").alias("t")).select(textops.critical(F.col("t")).alias("cls"))
    return each.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(coalesce(text, '')), ' ')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t)
SELECT conv_id, turn, round(len(list_intersect(w, v)) / CAST(len(list_distinct(list_concat(w, v))) AS DOUBLE), 6) AS overlap FROM p WHERE v IS NOT NULL""")
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("w"))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("v", before).where("v is not null")
    return pairs.select("conv_id", "turn", F.round(textops.jaccard(F.col("w"), F.col("v")), 6).alias("overlap"))


@query("""SELECT doc_id, count(*) AS marks FROM documents d JOIN (SELECT DISTINCT unnest(string_split(text, chr(10))) AS mark FROM benchmark) b ON length(mark) > 20 AND contains(d.text, mark) GROUP BY doc_id""")
def marked_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("mark")).where(F.length("mark") > 20).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return textops.containing(d, marks, "text", "mark").groupBy("doc_id").agg(F.count("*").alias("marks"))


@query("""SELECT lang, source, doc_id, n FROM (SELECT lang, source, doc_id, CAST(length(coalesce(text, '')) AS INT) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return reconcile.keep_longest(d, ["lang", "source"], "text", ["doc_id"], ["doc_id", "n"])


@query("""SELECT doc_id, left(sha256(coalesce(lang, '') || chr(10) || chr(0) || chr(10) || coalesce(text, '')), 16) AS hash FROM documents""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document; a null part is hashed as an empty one."""
    d, empty = table(spark, sf_dir, "documents"), F.lit("")
    return d.select("doc_id", textops.content_hash(F.coalesce("lang", empty), F.coalesce("text", empty)).alias("hash"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(textops.embedded_json(F.col("props"), "k int")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'cover' WHEN contains(lower(p_type), 'promo') THEN 'sync' WHEN p_name LIKE 'red%' THEN 'scenic' END AS role FROM part""")
def first_match_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "small", None, "cover"), (2, None, "promo", "sync"), (3, "red", None, "scenic")], "ord int, prefix string, part string, role string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    fits = lambda r: F.coalesce(F.col("p_name").startswith(r["prefix"]), F.lit(True)) & F.coalesce(F.lower("p_type").contains(r["part"]), F.lit(True))
    return schedule.first_match(p, rules, fits).select("p_partkey", "role")


@query("""SELECT page_id, coalesce(CASE WHEN url LIKE 'http://m.%' THEN 'mobile' WHEN url LIKE 'https://m.%' THEN 'mobile' WHEN url LIKE 'https://%' THEN 'secure' END, 'default') AS role FROM pages""")
def prefix_role_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([(1, "http://m.", "mobile"), (2, "https://m.", "mobile"), (3, "https://", "secure")], "ord int, prefix string, role string")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return schedule.first_match(p, roles, lambda r: F.col("url").startswith(r["prefix"])).select("page_id", F.coalesce("role", F.lit("default")).alias("role"))


@query("""SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS clock, CAST(CAST(floor(value) AS BIGINT) // 60 AS INT) || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS length FROM events""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", textops.clock_text(schedule.minute_of_day(F.col("ts"))).alias("clock"), textops.time_text(F.col("value")).alias("length"))


# references and keyed records

@query("""SELECT 'l_partkey' AS reference, CAST(l_partkey AS VARCHAR) AS value, count(*) AS rows FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 2
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 300) GROUP BY 2""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    checks = [
        ("l_partkey", t("lineitem"), "l_partkey", t("part").where("p_size > 5"), "p_partkey"), ("o_custkey", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("labels", t("labels"), "doc_id", t("documents").where("n_chars > 300"), "doc_id"),
    ]
    found = [reconcile.missing_references(a, c, b, r).select(F.lit(n).alias("reference"), "value", "rows") for n, a, c, b, r in checks]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_type AS value, count(*) AS rows FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def enum_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.unknown_values(table(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase"])


@query("""SELECT p_partkey, p_name, coalesce(CASE WHEN q > 700 THEN p_retailprice + q END, p_retailprice) AS p_retailprice FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    new = sums.join(part, "p_partkey").select("p_partkey", F.when(F.col("q") > 700, F.col("p_retailprice") + F.col("q")).alias("p_retailprice"))
    return reconcile.update_keyed(part, new, ["p_partkey"])


# vectors and streams in batch form

@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0)
SELECT query, vec_id, CAST(r AS INT) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS r FROM q JOIN embeddings e ON e.vec_id <> q.vec_id) WHERE r <= 3""")
def cosine_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every twentieth vector; it is searched against all rows."""
    from chronoweave.functions.vectors import top_cosines

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = top_cosines(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q")), e, ("query", "q"), ("vec_id", "v"), 3)
    return found.select("query", "vec_id", "rank")


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, k, CASE WHEN k >= 0 THEN x[1 + k:] ELSE x[:len(x) + k] END AS x, CASE WHEN k >= 0 THEN y[:len(y) - k] ELSE y[1 - k:] END AS y FROM p, unnest(range(-2, 3)) AS t(k)),
c AS (SELECT vec_id, k, corr(a, b) AS r FROM (SELECT vec_id, k, unnest(CAST(x AS DOUBLE[])) AS a, unnest(CAST(y AS DOUBLE[])) AS b FROM s) GROUP BY ALL)
SELECT vec_id, CAST(k AS INT) AS lag, round(r, 6) AS r FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC) = 1""")
def xcorr_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    found = series.best_match(series.correlate(pairs, ["vec_id"], "x", "y", range(-2, 3)), ["vec_id"], "r", "lag", guard=1)
    return found.select("vec_id", "lag", F.round("r", 6).alias("r"))


@query(f"""WITH {SQL_EVENTS}, g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e))
SELECT user_id, min(us) AS t0, max(us) + {6 * HOUR} AS t1, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, s""")
def session_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.streaming.events import sessions

    e = events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    found = sessions(e, "ts", "6 hours")
    return found.select("user_id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH {SQL_EVENTS} SELECT event_type, us // {HOUR} * {HOUR} AS t0, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.streaming.events import tumbling

    e = events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    return tumbling(e, "ts", "1 hour").select("event_type", F.unix_micros("t0").alias("t0"), "n", F.round("total", 4).alias("total"))

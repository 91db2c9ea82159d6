"""Queries on ranking, choice, decisions and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import choose, reconcile, talk, textops, verdicts
from chronoweave.session import table

from .common import SQL_EVENTS, collector, events

QUERIES, ORACLES, query = collector()


@query("""SELECT lang, doc_id, n_chars, CAST(r AS INT) AS rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 12""")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return choose.top(d, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 12)


#: Events as sentences of three seconds and more; each proposes itself and the next one, some of them badly.
SQL_CANDIDATES = """s AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
c AS (SELECT *, lead(event_type) OVER w AS type2, lead(value) OVER w AS value2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY n)),
k AS (SELECT *, ['hook', 'bite', 'closer', 'aside'][1 + event_id % 4] AS kind, round((n + 1) * 3.0 + value2 / 20 - n * 3.0, 2) AS d FROM c),
r AS (SELECT *, list_filter([CASE WHEN kind = 'aside' THEN 'unknown kind aside' END, CASE WHEN type2 IS NULL THEN 'unknown sentence id' END, CASE WHEN event_id % 7 = 0 THEN 'no cover brief' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN 'error' IN (event_type, type2) THEN 'contains an off-mic sentence' END, CASE WHEN d < CASE kind WHEN 'bite' THEN 6 ELSE 3 END THEN 'too short' END, CASE WHEN d > CASE kind WHEN 'hook' THEN 12 WHEN 'bite' THEN 30 ELSE 15 END THEN 'too long' END], lambda x: x IS NOT NULL) AS out_,
  list_filter([CASE WHEN event_id % 5 = 0 THEN 'dangling_start:and' END, CASE WHEN event_id % 6 = 0 THEN 'room_unmeasured' END, CASE WHEN event_id % 6 <> 0 AND value / 1000 < 0.15 THEN 'tight_in' END, CASE WHEN value2 / 1000 < 0.15 THEN 'tight_out' END], lambda x: x IS NOT NULL) AS flags FROM k)"""


@query(f"""WITH {SQL_CANDIDATES} SELECT event_id, CASE WHEN len(bad) > 0 THEN 'invalid' WHEN len(out_) > 0 THEN 'excluded' ELSE 'ok' END AS status,
  array_to_string(CASE WHEN len(bad) > 0 THEN bad ELSE out_ END, ';') AS reasons, CASE WHEN len(bad) > 0 THEN '' ELSE array_to_string(flags, ';') END AS flags FROM r""")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("n", F.row_number().over(w))
    i, n = F.col("event_id"), F.col("n")
    sentences = e.select(
        "user_id", i.cast("string").alias("id"), "n", (n * 3.0).alias("t0"), (n * 3.0 + F.col("value") / 20).alias("t1"),
        F.concat(F.when(i % 5 == 0, "And ").otherwise(""), "event_type").alias("text"),
        F.when(i % 6 != 0, F.col("value") / 1000).alias("head_room"), (F.col("value") / 1000).alias("tail_room"), (F.col("event_type") == "error").alias("off_mic"),
    )
    kinds = F.array(*[F.lit(k) for k in ("hook", "bite", "closer", "aside")])
    proposed = e.select(
        "user_id", "event_id", F.get(kinds, (i % 4).cast("int")).alias("kind"), i.cast("string").alias("first"),
        F.coalesce(F.lead("event_id").over(w).cast("string"), F.lit("none")).alias("last"), F.lit(None).cast("string").alias("register"),
        F.when(i % 7 == 0, "").otherwise("a street").alias("cover_brief"), F.lit(1).alias("beat"),
    )
    beats = e.groupBy("user_id").agg(F.lit(1).alias("beat"), F.lit(1).alias("lo"), F.max("n").alias("hi"))
    found = talk.gate(proposed, sentences, beats, ["user_id"])
    return found.select("event_id", "status", F.array_join("reasons", ";").alias("reasons"), F.array_join("flags", ";").alias("flags"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS film, o_orderkey AS pick, o_orderkey % 9 = 0 AS bare, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
c AS (SELECT l_orderkey AS pick, list(struct_pack(i := i, shot := CAST(l_suppkey % 3 AS VARCHAR), score := CASE WHEN l_partkey % 50 = 0 THEN 2.5::DOUBLE WHEN l_returnflag <> 'R' THEN l_quantity / 20.0::DOUBLE END) ORDER BY i) AS options FROM n WHERE l_partkey % 11 <> 0 GROUP BY 1),
p AS (SELECT film, o.pick, r, bare, coalesce(options, []) AS options FROM o LEFT JOIN c ON c.pick = o.pick),
f AS (
  SELECT film, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS pick, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS shot, '' AS status, '' AS note FROM (SELECT DISTINCT film FROM p)
  UNION ALL
  SELECT film, r, pick, CASE WHEN note = '' THEN list_append(used, shot) ELSE used END, CASE WHEN note = '' THEN shot END, CASE WHEN note = 'no verdict accepted' THEN 'unchecked' ELSE 'ok' END, note FROM (
    SELECT film, r, pick, used, best[3] AS shot, CASE WHEN bare THEN 'bare by choice' WHEN len(options) = 0 THEN 'no candidate' WHEN best IS NULL THEN 'no verdict accepted' WHEN best[1] < 1 THEN 'best is under 1' ELSE '' END AS note FROM (
      SELECT p.film, p.r, p.pick, p.bare, p.options, f.used, list_sort(list_transform(list_filter(p.options, lambda x: x.score IS NOT NULL), lambda x: row(x.score - 0.75 * greatest(0, len(list_filter(f.used, lambda u: u = x.shot)) - 1), -x.i, x.shot)))[-1] AS best
      FROM f JOIN p ON p.film = f.film AND p.r = f.r + 1)))
SELECT pick, shot, status, note FROM f WHERE r > 0""")
def shot_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as picks of a film, their lines as candidates; three shots are used again and again."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    picks = o.select(F.col("o_custkey").alias("film"), at.alias("ord"), F.col("o_orderkey").alias("pick"), (F.col("o_orderkey") % 9 == 0).alias("bare"))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = l.select(
        F.col("l_orderkey").alias("pick"), i.alias("i"), (F.col("l_suppkey") % 3).cast("string").alias("shot"), (F.col("l_quantity") / F.lit(20.0)).alias("score"),
        (F.col("l_returnflag") != "R").alias("accepted"), (F.col("l_partkey") % 11 == 0).alias("barred"), (F.col("l_partkey") % 50 == 0).alias("placeholder"),
    )
    return choose.choose(picks, lines.join(picks.select("film", "pick"), "pick"), ["film"]).select("pick", "shot", "status", "note")


@query("""WITH s AS (SELECT l_partkey AS part, l_suppkey AS supp, count(*) AS n, sum(CAST(round(l_quantity) AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
SELECT part, supp, CAST(q - 5 * greatest(0, n - 1) AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY part ORDER BY q - 5 * greatest(0, n - 1) DESC, supp) = 1""")
def choose_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    s = l.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("q"))
    scored = s.withColumn("score", F.col("q") - 5 * F.greatest(F.lit(0), F.col("n") - 1))
    return choose.best(scored, ["part"], F.struct("score", -F.col("supp")), ["supp", "score"])


@query(f"""WITH RECURSIVE {SQL_EVENTS},
i AS (SELECT event_id, event_type, user_id, us AS t0, until AS t1, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM e WHERE until > us),
f AS (
  SELECT user_id, r, [struct_pack(a := t0, b := t1)] AS kept, event_id, true AS taken FROM i WHERE r = 1
  UNION ALL
  SELECT i.user_id, i.r, CASE WHEN len(list_filter(f.kept, lambda k: k.a < i.t1 AND i.t0 < k.b)) = 0 THEN list_append(f.kept, struct_pack(a := i.t0, b := i.t1)) ELSE f.kept END,
    i.event_id, len(list_filter(f.kept, lambda k: k.a < i.t1 AND i.t0 < k.b)) = 0 FROM f JOIN i ON i.user_id = f.user_id AND i.r = f.r + 1
)
SELECT user_id, event_id FROM f WHERE taken""")
def greedy_overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", "value", F.col("us").alias("t0"), F.col("until").alias("t1")).where("t1 > t0")
    return choose.suppress_overlaps(e, ["user_id"], ["-value", "event_id"]).select("user_id", "event_id")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS topic, o_orderdate AS decided, CASE WHEN o_orderstatus = 'P' THEN 'superseded' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 7 END AS old FROM orders),
o AS (SELECT r.*, b.id AS by_ FROM r LEFT JOIN r b ON b.old = r.id),
w AS (SELECT topic, max_by(id, (decided, id)) AS winner FROM o WHERE by_ IS NULL AND status IS NULL GROUP BY topic)
SELECT id, CASE WHEN by_ IS NOT NULL THEN 'superseded by ' || by_ WHEN status IS NOT NULL THEN 'marked superseded' WHEN winner <> id THEN 'later decision ' || winner END AS why FROM o LEFT JOIN w USING (topic)""")
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rules = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("topic"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided"),
        F.when(F.col("o_orderstatus") == "P", "superseded").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, F.array(F.col("o_orderkey") - 7)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"),
    )
    return choose.resolve_rules(rules).select("id", "why")


SQL_PLAN = """p AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts) // 1000000 AS s, CAST(round(value) AS BIGINT) AS dur FROM events),
f AS (SELECT id + 1000000000 AS fid, user_id, event_type, s + id % 3 - 1 AS s, CASE WHEN id % 17 = 0 THEN dur + 9 ELSE dur END AS dur FROM p WHERE id % 13 <> 0)"""


@query(f"""WITH RECURSIVE {SQL_PLAN},
u AS (SELECT user_id, event_type, s, 0 AS side, id FROM p UNION ALL SELECT user_id, event_type, s, 1, fid FROM f),
g AS (SELECT *, CASE WHEN s - lag(s) OVER o > 2 THEN 1 ELSE 0 END AS opens FROM u WINDOW o AS (PARTITION BY user_id, event_type ORDER BY s, side, id)),
h AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY s, side, id ROWS UNBOUNDED PRECEDING) AS chain FROM g),
c AS (SELECT list(struct_pack(s := s, id := id) ORDER BY s, id) FILTER (WHERE side = 0) AS plans, list(struct_pack(s := s, id := CAST(id AS VARCHAR)) ORDER BY s, CAST(id AS VARCHAR)) FILTER (WHERE side = 1) AS free
  FROM h GROUP BY user_id, event_type, chain HAVING count(*) FILTER (WHERE side = 0) > 0 AND count(*) FILTER (WHERE side = 1) > 0),
m AS (
  SELECT plans, free, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS fid FROM c
  UNION ALL
  SELECT plans[2:], CASE WHEN best IS NULL THEN free ELSE list_filter(free, lambda x: x.id <> best[3]) END, plans[1].id, best[3] FROM (
    SELECT plans, free, list_sort(list_transform(list_filter(free, lambda x: abs(x.s - plans[1].s) <= 2), lambda x: row(abs(x.s - plans[1].s), x.s, x.id)))[1] AS best FROM m WHERE len(plans) > 0)),
r AS (SELECT id, CAST(fid AS BIGINT) AS fid FROM m WHERE fid IS NOT NULL),
j AS (SELECT r.id, r.fid, p.dur AS a, f.dur AS b, coalesce(abs(p.dur - f.dur) > 2, p.dur IS NOT NULL OR f.dur IS NOT NULL) AS differs FROM r JOIN p ON p.id = r.id JOIN f ON f.fid = r.fid)
SELECT CAST(id AS VARCHAR) AS plan_id, CAST(fid AS VARCHAR) AS found_id, CASE WHEN differs THEN 'mismatch' ELSE 'ok' END AS status,
  CASE WHEN differs THEN 'dur ' || coalesce(CAST(a AS VARCHAR), 'none') || ' / ' || coalesce(CAST(b AS VARCHAR), 'none') ELSE '' END AS diffs FROM j
UNION ALL SELECT CAST(id AS VARCHAR), NULL, 'missing', '' FROM p WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT NULL, CAST(fid AS VARCHAR), 'unexpected', '' FROM f WHERE fid NOT IN (SELECT fid FROM r)""")
def conform_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    plan = e.select(F.col("event_id").alias("plan_id"), "user_id", "event_type", F.floor(F.col("us") / 1_000_000).alias("s"), F.round("value").cast("long").alias("dur"))
    i = F.col("plan_id")
    found = plan.where(i % 13 != 0).select(
        (i + 1_000_000_000).alias("found_id"), "user_id", "event_type", (F.col("s") + i % 3 - 1).alias("s"), F.when(i % 17 == 0, F.col("dur") + 9).otherwise(F.col("dur")).alias("dur")
    )
    out = reconcile.conform(plan, found, ["user_id", "event_type"], "s", 2, ["s", "plan_id"], [("dur", 2)])
    return out.withColumn("diffs", F.array_join("diffs", "; "))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS k, l_quantity AS d, sum(l_quantity) OVER w - l_quantity + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END AS a, sum(l_quantity) OVER w AS b FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY l_orderkey ORDER BY b), 0) AS before FROM r)
SELECT l_orderkey AS beat, fault, count(*) AS n FROM (
  SELECT l_orderkey, 'does not follow' AS fault FROM s WHERE abs(a - before) > 0.05
  UNION ALL SELECT l_orderkey, 'is not as long as it says' FROM s WHERE abs(b - a - d) > 0.05) GROUP BY ALL""")
def placement_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("l_quantity").over(w)
    rows = l.select(
        F.lit(1).alias("cut"), F.col("l_orderkey").alias("beat"), F.count(F.lit(1)).over(w).cast("int").alias("k"), F.col("l_quantity").alias("duration_s"),
        (end - F.col("l_quantity") + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0)).alias("dest_in_s"), end.alias("dest_out_s"),
    )
    picks = l.select(F.lit(1).alias("cut"), F.col("l_orderkey").alias("beat"), F.col("l_quantity").alias("duration_s"))
    faults = reconcile.placement_faults(rows, picks, ["cut"])
    return faults.groupBy("beat", F.regexp_replace("fault", r"^row \d+ ", "").alias("fault")).agg(F.count("*").alias("n"))


@query()
def token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it: what was kept, dropped and put in."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.lag("text").over(w).alias("expected"), F.col("text").alias("heard")).where("expected is not null")
    e = textops.token_edits(pairs, "expected", "heard")
    return e.select("conv_id", "turn", "edits.coverage", "edits.matched", "edits.expected", "edits.flag", F.size("edits.risks").alias("risks"), F.array_join(textops.edit_reasons(F.col("edits")), "; ").alias("reasons"))


#: Turns as picks of 1 to 7 seconds, two from each clip; every third turn has no picture.
SQL_TURNS = """t AS (SELECT conv_id, turn, turn // 2 AS role, 1 + length(coalesce(text, '')) % 7 AS d, turn % 3 = 0 AS bare FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = 1 + F.length(F.coalesce("text", F.lit(""))) % 7
    end = F.sum("d").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("string").alias("clip"), F.when(F.col("turn") % 3 == 0, "bare").otherwise("video").alias("kind"), d.cast("double").alias("d"))
    return each.select("*", (end - F.col("d")).alias("t0"), end.alias("t1"))


@query(f"""WITH {SQL_TURNS}, w AS (SELECT *, lead(role) OVER o AS after, lead(bare) OVER o AS bare2, sum(d) OVER (o ROWS UNBOUNDED PRECEDING) AS t1 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(t1 AS DOUBLE) AS at FROM w WHERE role = after AND (bare OR bare2)""")
def jump_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return verdicts.jump_cuts(t, t, ["conv_id"], "turn")


@query(f"""WITH {SQL_TURNS}, w AS (SELECT *, lead(role) OVER o AS after, lead(bare) OVER o AS bare2 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(sum(d) AS DOUBLE) AS seconds, CAST(sum(CASE WHEN bare THEN d ELSE 0 END) AS DOUBLE) AS bare, round(100.0 * sum(CASE WHEN bare THEN d ELSE 0 END) / sum(d), 6) AS bare_pct, count(*) FILTER (WHERE role = after AND (bare OR bare2)) AS jump_cuts FROM w""")
def rhythm_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    found = verdicts.rhythm_total(verdicts.rhythm(t, ["conv_id"], seconds="d"), verdicts.jump_cuts(t, t, ["conv_id"], "turn"))
    return found.select("seconds", "bare", F.round("bare_pct", 6).alias("bare_pct"), "jump_cuts")

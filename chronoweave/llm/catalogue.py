"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage, table

from . import bpe, decontaminate, dialogue, license_scan, media, pii, secret, simhash, spelling, substring, suffix, token_files, toxicity

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def id_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(id_and_text(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: Words as the contracts have them, for DuckDB.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = rf"regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT m FROM p),
places AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
),
found AS (SELECT doc_id, places.m AS m, i, item FROM places JOIN p ON places.m = p.m AND places.s = p.s),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, m, i FROM found)) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(id_and_text(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(id_and_text(spark, sf_dir), keep=["doc_id"], with_kept=False)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select(
        "row.doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(id_and_text(spark, sf_dir), keep=["doc_id"])
    return both.select(
        "row.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def span_list(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def span_digest(spans: str, kinds: tuple[str, ...]) -> list[F.Column]:
    """n_<kind> for each base kind, base_sha256 and spans."""
    count = [F.size(F.filter(spans, _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    joined = F.array_join(F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return [*count, F.sha2(joined, 256).alias("base_sha256"), span_list(spans).alias("spans")]


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark, sf_dir)
    found = secret.find_secrets(docs, secret.fit(docs), keep=["doc_id"])
    scores = F.array_join(F.transform("spans", lambda x: F.format_string("%.3f", x["score"])), ",").alias("scores")
    return found.select("row.doc_id", *span_digest("spans", secret.KINDS), scores)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id,
        (F.coalesce(toxicity.bucket(doc_id, toxicity.FOLDS), F.lit(1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(id_and_text(spark, sf_dir))
    return cut.select(
        "row.doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLES["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, i, line, len(parts) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
units AS (
  SELECT *, trim(regexp_replace({SQL_LOWER.replace('text', 'line')}, '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS unit FROM lines
),
ranked AS (
  SELECT *, length(unit) > 0 AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, a) > 1 AS gone
  FROM units
)
SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(line) + CASE WHEN i < n THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE gone), '') AS removed,
  sha256(coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(id_and_text(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", *[f.name for f in media.FIELDS])


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(id_and_text(spark, sf_dir))
    word = F.transform("base_places", lambda p: p["word"].cast("long"))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(spark, sf_dir)
    found = pii.find_personal(docs, pii.fit(docs), keep=["doc_id"])
    base = found.withColumn("base", F.filter("spans", lambda x: x["base"] == 1))
    count = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    sure = F.array_join(F.transform("spans", lambda x: F.format_string("%.3f:%.3f", x["votes"], x["shape"])), ",").alias("probabilities")
    return base.select("row.doc_id", *count, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), sure)


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.store(id_and_text(spark, sf_dir))
    return token_files.read(spark, folder).withColumnRenamed("key", "doc_id")


def _damaged(run: F.Column) -> F.Column:
    """The contract's fault: where 199 divides the checksum of document and run, one letter goes."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cut_lineage(spelling.count_words(id_and_text(spark, sf_dir), edit=_damaged))
    return spelling.group(words).select("word", "form", "root", "n", "n_near", "form_n")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults: nulls become a space, then by checksum a row goes, is emptied, loses its stops, is repeated or is the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("h != 0").select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "h")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).drop("h", "copy")


@query
def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, messages = dialogue.repair(damage(conversations))
    every = conversations.select("conv_id").distinct().withColumn("talk", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(summary, "talk", "left").join(dialogue.digest(messages), "talk", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )

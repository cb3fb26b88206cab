"""The ``opN_`` queries: each maps the given tables to an operator's records, and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as live event messages."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("event_id"), F.col("text").alias("message"))


@query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import encode_messages

    return encode_messages(messages(spark, sf), vocabulary_path(), digests=True).withColumnRenamed("event_id", "doc_id")


@query
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from ..session import shared_dir
    from .tokenfiles import token_checks, write_token_files

    folder = f"{shared_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    files = write_token_files(messages(spark, sf), folder, vocabulary_path(), end_id=2)
    return token_checks(files).withColumnRenamed("event_id", "doc_id")


@query
def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from .secrets import find_secrets

    base = ["assign", "access", "hex"]
    found = find_secrets(messages(spark, sf)).drop("redacted")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("event_id").alias("doc_id"), *[counted(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def label_texts(spark: SparkSession, sf: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """``documents`` or ``benchmark`` as label texts of images."""
    return spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias("image"), F.col("text").alias("value"))


@query
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .decontam import find_leaked_labels

    found = find_leaked_labels(label_texts(spark, sf), label_texts(spark, sf, "benchmark", "item_id"))
    return found.select(
        F.col("image").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.col("leaked").alias("contaminated"), "longest", "longest_item", "longest_at",
    )


@query
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .substrings import remove_repeated_passages

    found = remove_repeated_passages(messages(spark, sf))
    return found.select(F.col("event_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .vectors import near_copy_detections

    given = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("det_id"), F.col("label").alias("class_name"), "embedding")
    return near_copy_detections(given).withColumnRenamed("det_id", "vec_id")


@query
def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard import alike_labels

    return alike_labels(label_texts(spark, sf)).withColumnRenamed("image", "doc_id")


#: Host, path and verdict of the rules that come before the reputation.
ADDRESS_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query
def op3_urls(spark: SparkSession, sf: str) -> DataFrame:
    from .urls import Rule, screen_media_addresses

    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("frame_id"), F.col("url").alias("image_path"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    # a page's address names the document it shows; its outcome is that document's label
    shown = pages.select("frame_id", F.regexp_extract("image_path", r"/([0-9]{1,18})", 1).alias("_n")).where("_n <> ''")
    outcomes = shown.join(labels, F.col("_n").cast("long") == labels["doc_id"]).select("frame_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    found = screen_media_addresses(pages, outcomes, [Rule(*r) for r in ADDRESS_RULES])
    return found.select(F.col("frame_id").alias("page_id"), "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"))


def fold(key: str, of: int, out: int):
    """Whether a row is held out: the remainder of the CRC-32 of its id as text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of == out


@query
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    events = messages(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~fold("doc_id", 4, 2)).select(F.col("doc_id").alias("event_id"), "quality")
    scored = score_quality(events, fit_quality(events, labels))
    return scored.select(F.col("event_id").alias("doc_id"), fold("event_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf: str):
    from .toxicity import fit_toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~fold("doc_id", 5, 0)).select(F.col("doc_id").alias("event_id"), "toxic")
    return fit_toxicity(messages(spark, sf), labels)


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from .toxicity import score_toxicity

    scored = score_toxicity(messages(spark, sf), toxicity_model(spark, sf))
    return scored.select(F.col("event_id").alias("doc_id"), fold("event_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The faults that every conversation gets by the CRC-32 of its id and turn; ``_n`` copies of a row stand next to each other."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(h == 0, 0).when(h == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), copies.alias("_n"))


@query
def op11_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    from .logs import LogForm, audit_event_logs, log_digests, repair_event_logs

    talks = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    pieces = repair_event_logs(damaged(talks), "conv_id", "turn", "role", "text", LogForm("system", "user", "assistant"))
    digests = log_digests(pieces, "conv_id").select(F.col("conv_id").alias("_id"), "digest")
    audits = audit_event_logs(pieces, "conv_id", of=talks)
    found = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return found.select(*audits.columns, F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from .negatives import mine_hard_negatives

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = rows.select(F.col("vec_id").alias("det_id"), label.alias("class_name"), "embedding", (F.col("vec_id") % 50 == 0).alias("is_anchor"))
    return mine_hard_negatives(given)


ORACLES["op12_hard_negatives"] = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike,
         list_sum([z[1] * z[2] FOR z IN list_zip(a.v, r.v)])::BIGINT AS score
  FROM given a JOIN given r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""


@query
def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from ..session import shared_dir
    from .archives import archive_frames, read_archives

    folder = f"{shared_dir(spark)}/llm-archives-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archive_frames(pages.select(F.col("page_id").alias("frame_id"), F.col("url").alias("image_path"), F.col("html").alias("document")), folder)
    found = read_archives(spark, folder)
    return found.select(
        F.col("frame_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"), "intact",
    )


ORACLES["op13_warc"] = """
WITH given AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM given)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, true AS intact
FROM sized
"""

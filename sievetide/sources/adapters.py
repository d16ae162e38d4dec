"""A review's entities, projected from the given tables; SQL has the same projections for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReviewConfig, Subject
from ..operators import cascade

#: The subject and the words of the sample review: invented, but common in the sample texts.
CONFIG = ReviewConfig(subject=Subject(name="the la"), keywords=("license", "licensed"))
EXTS = (".pdf", ".docx", ".xlsx", ".html", ".eml", ".txt", ".mp4", ".png", ".htm")
EVENT_STATES = {"view": "pending", "click": "kept", "purchase": "discarded"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as loose files of nine types. Some have a password, a keyword in the name or an unreadable text; pictures and chat exports have what decoders and judges say of them."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (k % 9 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    png, name = ext == ".png", F.when(k % 31 == 0, "license_plan-").otherwise("doc-")
    one_of = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))
    return docs.select(
        k.alias("id"), F.col("source").alias("request"), F.concat(name, k.cast("string"), ext).alias("name"), ext.alias("ext"), F.when((ext != ".pdf") | (k % 11 != 0), text).alias("text"),
        F.octet_length(text).cast("long").alias("bytes"), (k % 29 == 0).alias("protected"), F.sha2(text, 256).alias("content_hash"), F.when(ext == ".xlsx", F.sha2(F.lower(text), 256)).alias("content_key"),
        (k % 2 == 0).alias("sheet_hit"), F.when(png & (k % 5 != 0), (k % 900 + 1).cast("int")).alias("width"), F.when(png & (k % 5 != 0), (k * 7 % 700 + 1).cast("int")).alias("height"),
        one_of("decoration", None, None).alias("vision"), one_of("discard", "keep", "review", None).alias("picture_verdict"), F.when(ext == ".htm", one_of("keyword", "subject_absent", "files_filter", None)).alias("chat_rule"),
    )


FILES = """files AS (SELECT *, CASE WHEN ext <> '.pdf' OR id % 11 <> 0 THEN whole END AS text, CAST(strlen(whole) AS BIGINT) AS bytes, CASE WHEN id % 31 = 0 THEN 'license_plan-' ELSE 'doc-' END || id || ext AS name,
  CASE WHEN ext = '.png' AND id % 5 <> 0 THEN id % 900 + 1 END AS width, CASE WHEN ext = '.png' AND id % 5 <> 0 THEN id * 7 % 700 + 1 END AS height
  FROM (SELECT doc_id AS id, source AS request, (['.pdf','.docx','.xlsx','.html','.eml','.txt','.mp4','.png','.htm'])[doc_id % 9 + 1] AS ext, coalesce(text, '') AS whole FROM documents))"""

KEYWORD_SQL = "regexp_matches({x}, '(?i)(^|[^A-Za-z0-9])(license|licensed)($|[^A-Za-z0-9])')"
MENTION_SQL = "regexp_matches({x}, '(?i)(^|[^a-z0-9])(the la|the)($|[^a-z0-9])')"
_NOTICE = r"^this (?:e-?mail|email|message)(?: and any attachments?)?\b.*\b(?:confidential|privileged)\b|^confidentiality (?:notice|disclaimer)\b"
_SIGN_OFF = r"^--\s*$|^sent from my\b|^(?:kind|best|warm) regards[,!]?\s*$|^(?:many )?thanks[,!]?\s*$|^(?:yours|sincerely)[,!]?\s*$"
NOTICE_CUT = "regexp_replace({x}, '(?im)(?:" + _NOTICE + r")[\s\S]*', '')"
SIGNATURE_CUT = "regexp_replace({x}, '(?im)(?:" + _SIGN_OFF + "|" + _NOTICE + r")[\s\S]*', '')"


def screened(spark: SparkSession, d: str) -> DataFrame:
    """files with the cascade's state and rule."""
    return cascade.file_cascade(files(spark, d), CONFIG)


_PICTURE = """CASE WHEN width IS NULL THEN 'unreadable_image' WHEN width <= 2 OR height <= 2 OR greatest(width, height) <= 64 OR bytes < 5000 OR (width >= 5 * height AND height <= 160) THEN 'signature_image'
  WHEN width * height < 490000 AND bytes < 100000 AND id % 3 = 0 THEN 'signature_image' WHEN id % 4 = 0 THEN 'ai_file' ELSE 'files_filter' END"""
SCREENED = f"""{FILES}, early AS (SELECT *, CASE WHEN id % 29 = 0 THEN 'password' WHEN id % 31 = 0 AND ext NOT IN ('.html', '.htm', '.eml') THEN 'keyword' END AS first_rule FROM files),
ruled AS (SELECT *, CASE WHEN first_rule IS NOT NULL THEN first_rule WHEN ext = '.mp4' THEN 'unsupported_type' WHEN ext = '.png' THEN {_PICTURE}
  WHEN ext = '.htm' AND id % 4 = 0 THEN 'keyword' WHEN ext = '.htm' AND id % 4 = 1 THEN 'subject_absent' WHEN ext = '.htm' AND id % 4 = 2 THEN CASE WHEN bytes = 0 THEN 'empty_output' ELSE 'files_filter' END
  WHEN text IS NULL THEN CASE WHEN bytes = 0 THEN 'empty_output' ELSE 'files_filter' END
  WHEN CASE WHEN ext IN ('.html', '.htm', '.eml') THEN {KEYWORD_SQL.format(x=SIGNATURE_CUT.format(x='text'))} ELSE {KEYWORD_SQL.format(x=NOTICE_CUT.format(x='text'))} END THEN 'keyword'
  WHEN CASE WHEN ext = '.xlsx' THEN id % 2 <> 0 ELSE NOT {MENTION_SQL.format(x='text')} END THEN 'subject_absent' WHEN bytes = 0 THEN 'empty_output' ELSE 'files_filter' END AS r FROM early),
keyed AS (SELECT *, sha256(whole) AS h, CASE WHEN r <> 'files_filter' OR (ext = '.htm' AND id % 4 <> 3) THEN NULL WHEN ext = '.pdf' THEN 'pdf:' || sha256(lower(text)) WHEN ext = '.xlsx' THEN sha256(lower(text))
  WHEN ext IN ('.html', '.htm', '.eml', '.txt') AND length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) >= 8 THEN sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) END AS k FROM ruled),
ranked AS (SELECT *, first_rule IS NULL AND id > min(id) FILTER (r = 'files_filter') OVER (PARTITION BY h) AS same_bytes, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY id) > 1 AS same_text FROM keyed),
screened AS (SELECT id, request, name, ext, bytes, CASE WHEN r <> 'files_filter' OR coalesce(same_bytes, false) OR same_text THEN 'discarded' ELSE 'kept' END AS state, CASE WHEN coalesce(same_bytes, false) OR same_text THEN 'dup' ELSE r END AS rule FROM ranked)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """screened files with the judge's verdict on what is left: labels stand for its answers; without one an item goes to review."""
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = screened(spark, d).join(labels, "id", "left")
    left = F.col("state") == "kept"
    verdict = F.when(F.col("quality").isNull(), "review").when((F.col("toxic") == 1) | (F.col("quality") == 0), "discarded").otherwise("kept")
    return j.select(
        "id", "request", F.lit("file").alias("kind"), F.lit("files_folder").alias("origin"), F.when(left, verdict).otherwise(F.col("state")).alias("state"), F.when(left, "ai_file").otherwise(F.col("rule")).alias("rule"),
        F.col("name").alias("label"), F.when(left, "judge").otherwise(F.col("decided_by")).alias("decided_by"), "quality", "toxic",
    )


JUDGED = f"""{SCREENED}, lab AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
items AS (SELECT s.id, request, 'file' AS kind, 'files_folder' AS origin, CASE WHEN state <> 'kept' THEN state WHEN quality IS NULL THEN 'review' WHEN toxic = 1 OR quality = 0 THEN 'discarded' ELSE 'kept' END AS state,
  CASE WHEN state = 'kept' THEN 'ai_file' ELSE rule END AS rule, name AS label, CASE WHEN state = 'kept' OR rule = 'ai_file' THEN 'judge' ELSE 'rule' END AS decided_by, quality, toxic FROM screened s LEFT JOIN lab USING (id))"""


def mails(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("request"), F.concat(F.lit("archive-"), (F.col("doc_id") % 3).cast("string")).alias("file_id"),
        F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.concat(F.lit("mid-"), F.md5(text))).alias("message_id"), F.concat(F.lit("user"), (F.col("doc_id") % 50).cast("string"), F.lit("@work.example")).alias("sender"),
        F.when(F.col("doc_id") % 23 == 0, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array(F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string"), F.lit("@home.example")))).alias("recipients"),
        F.substring_index(text, "\n", 1).alias("subject"), text.alias("body"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("attachment_names"),
    )


MAILS = "mails AS (SELECT doc_id AS id, doc_id AS seq, source AS request, 'archive-' || (doc_id % 3) AS file_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE 'mid-' || md5(coalesce(text, '')) END AS message_id, 'user' || (doc_id % 50) || '@work.example' AS sender, CASE WHEN doc_id % 23 = 0 THEN [] ELSE ['user' || (doc_id % 7) || '@home.example'] END AS recipients, split_part(coalesce(text, ''), chr(10), 1) AS subject, coalesce(text, '') AS body FROM documents)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), F.col("role").alias("author"), "text")


def item_events(spark: SparkSession, d: str) -> DataFrame:
    """events as histories of 150 or more items: the event's type gives the state."""
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "kept").when(F.col("event_type") == "purchase", "discarded").otherwise("review")
    return e.select(F.col("user_id").alias("item_id"), F.col("event_id"), F.col("ts").alias("at"), state.alias("state"), F.when(state == "discarded", "keyword").alias("rule"), F.col("value"))


ITEM_EVENTS = "item_events AS (SELECT user_id AS item_id, event_id, ts AS \"at\", CASE WHEN event_type = 'click' THEN 'kept' WHEN event_type = 'purchase' THEN 'discarded' ELSE 'review' END AS state, CASE WHEN event_type = 'purchase' THEN 'keyword' END AS rule, value FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("queued", "leased", "running", "completed", "failed", "completed", "completed"))), (F.col("event_id") % 7 + 1).cast("int"))
    phase = F.element_at(F.array(*map(F.lit, ("parse", "extract", "ai", "render", "files"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), phase.alias("phase"), status.alias("status"), (F.col("event_id") % 97).cast("string").alias("dedupe_key"), F.concat(F.lit("case-"), (F.col("user_id") % 11).cast("string")).alias("case_key"), F.col("user_id").alias("file"),
        (F.col("event_id") % 3).cast("int").alias("priority"), (F.col("event_id") % 6 + 1).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("lease_expires_at"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


JOBS = "jobs AS (SELECT event_id AS id, (['parse','extract','ai','render','files'])[event_id % 5 + 1] AS phase, (['queued','leased','running','completed','failed','completed','completed'])[event_id % 7 + 1] AS status, CAST(event_id % 97 AS VARCHAR) AS dedupe_key, 'case-' || (user_id % 11) AS case_key, user_id AS file, CAST(event_id % 3 AS INT) AS priority, CAST(event_id % 6 + 1 AS INT) AS attempts, 5 AS max_attempts, ts AS created_at, ts AS available_at, ts + INTERVAL 60 SECONDS AS lease_expires_at, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a request's sources: the line is the wave."""
    n = lambda c: F.col(c).cast("long")
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "A", "failed").otherwise("pending")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("wave"), F.when(F.col("l_returnflag") == "N", "pst").otherwise("files").alias("kind"),
        n("l_quantity").alias("total_emails"), (n("l_quantity") - F.col("l_linenumber")).alias("unique_emails"), F.col("l_linenumber").cast("long").alias("duplicate_emails"), (n("l_quantity") % 5).alias("ai_approved_count"), (n("l_quantity") % 3).alias("ai_discarded_count"),
        n("l_quantity").alias("files_total"), (n("l_partkey") % 40).alias("files_processed"), (n("l_suppkey") % 20).alias("files_skipped"), (n("l_partkey") % 4).alias("files_duplicates"), n("l_extendedprice").alias("metadata_duration_ms"), (n("l_partkey") % 100).alias("analyze_duration_ms"),
        (n("l_suppkey") % 100).alias("extract_duration_ms"), n("l_quantity").alias("ai_duration_ms"), (n("l_orderkey") % 60).alias("pdf_duration_ms"), (n("l_quantity") % 13).alias("files_duration_ms"), (n("l_quantity") % 7).alias("files_paused_ms"), status.alias("status"), F.col("l_shipdate").alias("at"),
    )


SOURCE_ROWS = "source_rows AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS request, l_linenumber AS wave, CASE WHEN l_returnflag = 'N' THEN 'pst' ELSE 'files' END AS kind, CAST(l_quantity AS BIGINT) AS total_emails, CAST(l_quantity AS BIGINT) - l_linenumber AS unique_emails, CAST(l_linenumber AS BIGINT) AS duplicate_emails, CAST(l_quantity AS BIGINT) % 5 AS ai_approved_count, CAST(l_quantity AS BIGINT) % 3 AS ai_discarded_count, CAST(l_quantity AS BIGINT) AS files_total, l_partkey % 40 AS files_processed, l_suppkey % 20 AS files_skipped, l_partkey % 4 AS files_duplicates, CAST(trunc(l_extendedprice) AS BIGINT) AS metadata_duration_ms, l_partkey % 100 AS analyze_duration_ms, l_suppkey % 100 AS extract_duration_ms, CAST(l_quantity AS BIGINT) AS ai_duration_ms, l_orderkey % 60 AS pdf_duration_ms, CAST(l_quantity AS BIGINT) % 13 AS files_duration_ms, CAST(l_quantity AS BIGINT) % 7 AS files_paused_ms, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'pending' END AS status, l_shipdate AS \"at\" FROM lineitem)"


def images(spark: SparkSession, d: str) -> DataFrame:
    """parts as pictures in mails: sizes and names from their numbers."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("photo.jpg", "logo.png", "image001.png", "scan-7.png", "banner_top.gif", "x/linkedin.png"))), (k % 6 + 1).cast("int"))
    return p.select(k.alias("id"), name.alias("name"), (k % 900 + 1).cast("int").alias("width"), (k * 7 % 700 + 1).cast("int").alias("height"), (k * 131 % 150_000).alias("bytes"), (k % 4 == 0).alias("inline"), (k % 300).cast("string").alias("image_hash"), (k % 61).alias("mail"))


IMAGES = "images AS (SELECT p_partkey AS id, (['photo.jpg','logo.png','image001.png','scan-7.png','banner_top.gif','x/linkedin.png'])[p_partkey % 6 + 1] AS name, CAST(p_partkey % 900 + 1 AS INT) AS width, CAST(p_partkey * 7 % 700 + 1 AS INT) AS height, p_partkey * 131 % 150000 AS bytes, p_partkey % 4 = 0 AS inline, CAST(p_partkey % 300 AS VARCHAR) AS image_hash, p_partkey % 61 AS mail FROM part)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The lines of documents as workbooks: a row for each line, a cell for each of its words, a sheet for every fifty lines."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("book"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("r", "line"))
    words = rows.select("book", F.concat(F.lit("S"), F.floor(F.col("r") / 50).cast("string")).alias("sheet"), (F.col("r") + 1).cast("int").alias("row"), F.posexplode(F.split("line", " ")).alias("c", "value"))
    return words.select("book", "sheet", "row", (F.col("c") + 1).cast("int").alias("col"), "value")


CELLS = """lines AS (SELECT doc_id AS book, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
cells AS (SELECT book, 'S' || ((row - 1) // 50) AS sheet, CAST(row AS INT) AS row, CAST(unnest(range(1, len(ws) + 1)) AS INT) AS col, unnest(ws) AS value FROM (SELECT book, row, string_split(line, ' ') AS ws FROM lines))"""


def attachments(spark: SparkSession, d: str) -> DataFrame:
    """documents as attachments of delivered mails: pictures and documents, with what decoders and judges say of them."""
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".png", ".docx", ".xlsx", ".pdf", ".txt", ".png"))), (k % 6 + 1).cast("int"))
    text, png = F.coalesce("text", F.lit("")), ext == ".png"
    one_of = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))
    return table(spark, d, "documents").select(
        k.alias("id"), F.concat(F.when(k % 13 == 0, "licensed-").otherwise("att-"), k.cast("string"), ext).alias("name"), ext.alias("ext"), F.when(k % 19 != 0, text).alias("text"), F.octet_length(text).cast("long").alias("bytes"), png.alias("is_image"),
        (k % 7 == 0).alias("embedded"), (k % 10 < 5).alias("unrenderable"), F.when(png & (k % 5 != 0), (k % 900 + 1).cast("int")).alias("width"), F.when(png & (k % 5 != 0), (k * 7 % 700 + 1).cast("int")).alias("height"),
        (k % 40).cast("string").alias("image_hash"), F.when(k % 40 < 5, 5).otherwise(1).alias("recurs"), one_of("decoration", None, None, None, None).alias("vision"), one_of("discard", "keep", None, None, None, None, None).alias("picture_verdict"),
        one_of("password", "zip_error", "unsupported_type", *[None] * 14).alias("dropped"), (k % 3 != 0).alias("screened"), one_of("discard", "keep", "review", None).alias("screen"), (k % 2 == 0).alias("sheet_hit"),
    )


_ATTACHED = """SELECT *, (['.png', '.docx', '.xlsx', '.pdf', '.txt', '.png'])[id % 6 + 1] AS ext, CASE WHEN id % 6 IN (0, 5) AND id % 5 <> 0 THEN id % 900 + 1 END AS width, CASE WHEN id % 6 IN (0, 5) AND id % 5 <> 0 THEN id * 7 % 700 + 1 END AS height
  FROM (SELECT doc_id AS id, CASE WHEN doc_id % 19 <> 0 THEN coalesce(text, '') END AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents)"""
ATTACHMENTS = f"""attached AS ({_ATTACHED}),
classed AS (SELECT *, ext = '.png' AS image, width <= 2 OR height <= 2 OR greatest(width, height) <= 64 OR bytes < 5000 OR (width >= 5 * height AND height <= 160) AS signature, width * height >= 490000 OR bytes >= 100000 AS large FROM attached),
alone AS (SELECT *, CASE WHEN image AND id % 7 = 0 THEN 'embedded_in_email' WHEN image AND width IS NULL AND id % 10 >= 5 THEN 'unreadable_image' WHEN image AND width IS NULL THEN 'image_review' WHEN image AND (signature OR (NOT large AND id % 40 < 5)) THEN 'signature_image'
  WHEN image AND NOT large AND id % 5 = 0 THEN 'signature_image' WHEN image AND id % 7 = 0 THEN 'ai_file' WHEN image AND id % 7 = 1 AND id % 13 = 0 THEN 'keyword' WHEN image AND id % 7 = 1 THEN 'ai_image' WHEN image THEN 'image_review'
  WHEN id % 17 = 0 THEN 'password' WHEN id % 17 = 1 THEN 'zip_error' WHEN id % 17 = 2 THEN 'unsupported_type' WHEN id % 3 <> 0 AND id % 4 = 0 THEN 'ai_file' WHEN id % 13 = 0 THEN 'keyword' WHEN text IS NULL THEN 'unreadable'
  WHEN {KEYWORD_SQL.format(x=NOTICE_CUT.format(x='text'))} THEN 'keyword' WHEN CASE WHEN ext = '.xlsx' THEN id % 2 <> 0 ELSE NOT {MENTION_SQL.format(x='text')} END THEN 'subject_absent' ELSE 'attachment_delivered' END AS r,
  image AND id % 7 <> 0 AND CASE WHEN width IS NULL THEN id % 10 < 5 ELSE NOT signature AND (large OR id % 40 >= 5) END AS asked FROM classed),
sent AS (SELECT id % 40 AS h, min(id) AS first FROM alone WHERE r = 'image_review' GROUP BY ALL)
SELECT id, CASE WHEN asked AND id > first THEN 'dup' ELSE r END AS rule, CASE WHEN asked AND id > first THEN 'discarded' WHEN r IN ('embedded_in_email', 'ai_image', 'attachment_delivered') THEN 'kept' WHEN r = 'image_review' THEN 'review' ELSE 'discarded' END AS state FROM alone LEFT JOIN sent ON id % 40 = h"""

__all__ = ["ATTACHMENTS", "CELLS", "CONFIG", "FILES", "IMAGES", "ITEM_EVENTS", "JOBS", "JUDGED", "MAILS", "SCREENED", "SIGNATURE_CUT", "SOURCE_ROWS", "attachments", "cells", "files", "images", "item_events", "jobs", "judged", "mails", "messages", "screened", "source_rows", "table"]

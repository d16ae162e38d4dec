"""Queries over statuses, back-fills, joins, sets and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import subject as S
from ..functions import text as T
from ..operators import jobs, ledger, numbering, status, verdicts
from ..operators.dedup import mark_mail_duplicates
from ..sources import adapters as A
from .base import query
from .decisions import DECIDED, HASHED, decided, hashed


@query("k3_verdict_rows", f"WITH {DECIDED} SELECT 'doc-' || id AS file, verdict, CASE WHEN verdict = 'review' THEN 'no judgement' ELSE 'judged' END AS reason FROM decided")
def k3(spark, d):
    return decided(spark, d).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("file"), "verdict", F.when(F.col("verdict") == "review", "no judgement").otherwise("judged").alias("reason"))


@query("p7_p13_parties", "SELECT doc_id AS id, doc_id % 3 = 0 AS to_personal, doc_id % 2 = 0 AS direct FROM documents")
def p713(spark, d):
    block = F.concat(F.lit("From: "), F.when(F.col("doc_id") % 2 == 0, "Vera <vera@work.example>").otherwise("x@y"), F.lit("\nSubject: s\nTo: "), F.when(F.col("doc_id") % 3 == 0, "b@x, VO@home.example").otherwise("b@x"), F.lit("\n"))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.sent_to_in_text(block, "vo@home.example").alias("to_personal"), S.direct_party(block, "vera@work.example").alias("direct"))


@query("t3_t4_mail_cleanup", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'No Recipient' WHEN 1 THEN lower(c_name) WHEN 2 THEN 'Exchange Internal User' ELSE c_name END AS party, c_name || chr(10) || 'b c' AS body FROM (SELECT * REPLACE (replace(c_name, '-', '#') AS c_name) FROM customer)")
def t34(spark, d):
    name = F.replace("c_name", F.lit("-"), F.lit("#"))
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("/O=EXCHANGELABS/CN=a-b-"), name)).when(k == 2, "/CN=Recipients").otherwise(name)
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.exchange_name(raw).alias("party"), T.clean_mail_body(F.lit(""), F.concat(F.lit("<style>p{}</style><p>"), name, F.lit("</p>\r\n\r\n\r\n<b>b   c</b>"))).alias("body"))


@query("t6_headers", "SELECT c_custkey AS id, c_name AS value, 'x' || chr(10) || c_mktsegment AS rest FROM customer")
def t6(spark, d):
    block = F.concat(F.lit("From: a\nSubject:  "), F.col("c_name"), F.lit("\n"))
    body = F.concat(F.lit("-----Original Message-----\nx\n"), F.col("c_mktsegment"), F.lit("\nSent: today"))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.header_value(block, "subject").alias("value"), F.trim(F.regexp_replace(T.strip_quoted_headers(body), r"^\n+|\n+$", "")).alias("rest"))


@query("t11_row_tokens", "SELECT c_custkey AS id, array_to_string(list_distinct_ordered, '|') AS tokens FROM (SELECT *, ['anna ' || lower(c_mktsegment), 'anna', lower(c_mktsegment), 'al', 'c' || c_custkey || '@x.example'] || CASE WHEN length('c' || c_custkey) >= 3 THEN ['c' || c_custkey] ELSE [] END AS list_distinct_ordered FROM customer)")
def t11(spark, d):
    email = F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@x.example"))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(status.row_tokens(F.concat(F.lit("Anna  "), F.col("c_mktsegment")), email, F.lit(None), F.array(F.lit(" AL "))), "|").alias("tokens"))


@query("a11_phase_progress", f"WITH {A.SOURCE_ROWS}, t AS (SELECT request, wave, max(files_processed) AS b, arg_max(files_skipped, (files_processed, id)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY request, wave, id, files_processed ORDER BY files_skipped DESC) AS n FROM source_rows) WHERE n = 1 GROUP BY ALL), b AS (SELECT request, CAST(sum(b) AS BIGINT) AS batches FROM t GROUP BY request) SELECT request, CAST(sum(total_emails) AS BIGINT) AS total, CAST(sum(least(unique_emails, total_emails)) AS BIGINT) AS done, any_value(batches) AS batches FROM source_rows JOIN b USING (request) GROUP BY request")
def a11(spark, d):
    rows = A.source_rows(spark, d).select("request", "wave", "id", F.col("total_emails").alias("total"), F.col("unique_emails").alias("done"), F.col("files_processed").alias("batches"), F.col("files_skipped").alias("batches_done"))
    return status.phase_progress(rows).drop("batches_done")


@query("a19_elapsed", "SELECT o_custkey AS request, CAST(epoch_ms(max(o_orderdate)) - epoch_ms(min(o_orderdate)) AS BIGINT) AS elapsed_ms FROM orders GROUP BY o_custkey")
def a19(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return status.elapsed(A.table(spark, d, "orders").select(F.col("o_custkey").alias("request"), ms.alias("submitted_ms"), ms.alias("completed_ms")), "request")


@query("a26_files_state", f"WITH {DECIDED} SELECT count(*) AS total, count(*) FILTER (verdict = 'keep') AS kept, count(*) FILTER (verdict = 'discard') AS discarded, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (quality IS NULL) AS unjudged FROM decided")
def a26(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    v = F.col("verdict")
    return decided(spark, d).agg(F.count("*").alias("total"), n(v == "keep", "kept"), n(v == "discard", "discarded"), n(v == "review", "review"), n(F.col("quality").isNull(), "unjudged"))


@query("a30_token_estimate", "SELECT source AS request, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def a30(spark, d):
    return A.table(spark, d, "documents").groupBy(F.col("source").alias("request")).agg(F.sum(F.ceil(F.length("text") / 4.0)).cast("long").alias("tokens"))


@query("j1_j5_backfill", f"WITH {HASHED} SELECT id, file_id, CASE file_id WHEN 'archive-2' THEN NULL ELSE 'r-' || file_id END AS request, CASE WHEN is_duplicate THEN 'discarded' ELSE 'pending' END AS state, CASE WHEN is_duplicate THEN 'dup' END AS rule FROM marked WHERE id % 4 <> 0")
def j15(spark, d):
    m = mark_mail_duplicates(hashed(spark, d))
    sources = m.select("file_id").distinct().filter("file_id != 'archive-2'").withColumn("request", F.concat(F.lit("r-"), "file_id"))
    return status.backfill_items(m.drop("request"), sources, m.filter("id % 4 = 0").select("id"))


@query("j6_queue_copy", f"WITH {A.JOBS} SELECT j.id, CASE WHEN q.k IS NOT NULL THEN 'claimed' ELSE j.status END AS status FROM jobs j LEFT JOIN (SELECT id, k FROM jobs WHERE k > 50) q USING (id)")
def j6(spark, d):
    j = A.jobs(spark, d).select("id", "status", "k")
    new = j.filter("k > 50").select("id", F.lit("claimed").alias("status"))
    return ledger.upsert(j.select("id", "status"), new, "id")


@query("j7_move_runs", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'email' ELSE 'files' END AS kind FROM orders WHERE o_orderkey % 5 <> 0")
def j7(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return status.move_runs(o.filter("id % 5 = 0"), o.filter("id % 2 = 0").withColumn("kind", F.lit("email")), o.filter("id % 2 = 1").withColumn("kind", F.lit("files")))


@query("j12_screened_attachments", "SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'review' WHEN quality = 1 THEN 'keep' ELSE 'discard' END AS verdict FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def j12(spark, d):
    v = A.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q")).select("id", F.when(F.col("q") == 1, "keep").otherwise("discard").alias("verdict"))
    return status.screened(A.table(spark, d, "documents").select(F.col("doc_id").alias("id")), v, "id")


@query("j15_folder_siblings", "WITH p AS (SELECT page_id AS id, array_to_string(string_split(regexp_replace(url, '^https?://', ''), '/')[1:2], '/') AS case_key FROM pages) SELECT a.id, count(b.id) AS archives FROM p a LEFT JOIN p b ON a.case_key = b.case_key AND b.id % 3 = 0 GROUP BY a.id")
def j15s(spark, d):
    from ..functions.ids import case_key

    p = A.table(spark, d, "pages").select(F.col("page_id").alias("id"), case_key(F.regexp_replace("url", "^https?://", "")).alias("case_key"))
    n = p.filter("id % 3 = 0").groupBy("case_key").agg(F.count("*").alias("archives"))
    return p.join(n, "case_key", "left").select("id", F.coalesce("archives", F.lit(0)).alias("archives"))


@query("j18_usage", "SELECT c_mktsegment AS request, count(*) AS runs, CAST(sum(o_orderkey % 1000) AS BIGINT) AS tokens FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def j18(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("request")).agg(F.count("*").alias("runs"), F.sum(F.col("o_orderkey") % 1000).alias("tokens"))


@query("o6_o7_next_job", f"WITH {A.JOBS}, q AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY priority, created_at, id) AS n FROM jobs WHERE status = 'queued' AND available_at <= TIMESTAMP '2024-01-20 00:00:00' AND k < 30) SELECT id FROM q WHERE n = 1 ORDER BY priority, created_at, id LIMIT 1")
def o67(spark, d):
    return jobs.next_job(A.jobs(spark, d).filter("status = 'queued' AND k < 30"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id")


@query("o5_r15_history_page", "SELECT page_id AS id FROM pages WHERE url = 'http://x' OR starts_with(url, 'http://') ORDER BY page_id DESC LIMIT 50 OFFSET 10")
def o5(spark, d):
    p = A.table(spark, d, "pages")
    return status.page(p.filter(F.col("url").startswith("http://") | status.in_case(F.col("url"), "http://x")).select(F.col("page_id").alias("id")), [F.desc("id")], 50, 10)


@query("u1_u2_sets", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a|b' ELSE 'a|b|c' END AS tokens, CASE WHEN c_custkey % 2 = 0 THEN 'mail' ELSE 'both' END AS scope FROM customer")
def u12(spark, d):
    words = F.array_distinct(F.filter(F.array(F.lit("a"), F.lit("b"), F.when(F.col("c_custkey") % 2 == 1, "c"), F.lit("a")), lambda x: x.isNotNull()))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(words, "|").alias("tokens"), numbering.wave_scope(F.lit("mail"), F.when(F.col("c_custkey") % 2 == 1, "files").otherwise("mail")).alias("scope"))


@query("u4_u5_manifest", "SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT page_id + 1000000 FROM pages")
def u45(spark, d):
    docs, pages = A.table(spark, d, "documents").select(F.col("doc_id").alias("id")), A.table(spark, d, "pages").select((F.col("page_id") + 1_000_000).alias("id"))
    return docs.join(docs.filter("id % 7 = 3"), "id", "left_anti").unionByName(pages)


@query("u6_ai_queue", f"WITH {A.JUDGED} SELECT id FROM items WHERE state = 'review' AND id IN (SELECT doc_id FROM documents WHERE length(text) > 500) AND id % 13 <> 0")
def u6(spark, d):
    payloads = A.table(spark, d, "documents").filter(F.length("text") > 500).select(F.col("doc_id").alias("id"))
    items = A.judged(spark, d).filter("state = 'review'")
    return items.join(payloads, "id", "left_semi").join(items.filter("id % 13 = 0").select("id"), "id", "left_anti").select("id")


@query(
    "v5_first_pass",
    """SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'pending' WHEN doc_id % 5 = 0 OR toxic = 1 OR quality <> 1 THEN 'discarded' ELSE 'kept' END AS state,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'Invalid AI output format.' WHEN toxic = 1 THEN 'Confidential (legal_privileged): so' ELSE 'so' END AS reason,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 OR toxic = 1 THEN false ELSE doc_id % 3 = 0 END AS second_pass,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN CAST(least(100, greatest(0, floor(doc_id % 240 / 2.0 - 5 + 0.5))) AS INT) END AS p_keep FROM labels""",
)
def v5(spark, d):
    labels = A.table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    said = F.struct(
        F.when(F.col("quality") == 1, "keep").otherwise("discard").alias("decision"), F.lit("so").alias("reason"), (F.col("id") % 3 == 0).alias("needs_second_pass"),
        F.when(F.col("toxic") == 1, "legal_privileged").when(F.col("id") % 2 == 0, "unheard_of").alias("sensitivity"), (F.col("id") % 240 / 2 - 5).alias("confidence"),
    )
    raw = F.when(F.col("id") % 5 == 0, "broken").when(F.col("id") % 4 == 0, F.concat(F.lit("```json\n"), F.to_json(said), F.lit("\n```"))).otherwise(F.to_json(said))
    return verdicts.apply_first_pass(labels.select("id"), labels.filter("id % 7 != 0").select("id", raw.alias("raw"))).select("id", "state", "reason", "second_pass", "p_keep")


@query("r1_stage", "SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus, CASE WHEN l_returnflag = 'A' THEN 'failed parse' WHEN l_linestatus = 'O' THEN 'queued render' WHEN l_returnflag = 'R' THEN 'active ai' ELSE 'completed' END AS stage FROM lineitem")
def r1(spark, d):
    li = A.table(spark, d, "lineitem")
    p = F.array(
        F.struct(F.lit("parse").alias("phase"), F.when(F.col("l_returnflag") == "A", "failed").otherwise("completed").alias("status")), F.struct(F.lit("ai").alias("phase"), F.when(F.col("l_returnflag") == "R", "processing").otherwise("completed").alias("status")),
        F.struct(F.lit("render").alias("phase"), F.when(F.col("l_linestatus") == "O", "queued").otherwise("completed").alias("status")),
    )
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linestatus", status.stage(p).alias("stage"))


@query("r2_o8_summary", f"WITH {A.SOURCE_ROWS} SELECT request, bool_or(status = 'failed') AS has_failure, false AS in_progress, bool_and(status = 'completed') AS completed, arg_min(id, (wave, id)) FILTER (status = 'failed') AS first_failed FROM source_rows GROUP BY request")
def r2(spark, d):
    return status.summary(A.source_rows(spark, d).withColumn("rank", F.col("wave")), "request")


@query("r12_r13_small_rules", f"WITH {A.JOBS} SELECT max(greatest(1, least(16, k))) AS most, bool_or(status IN ('queued', 'leased', 'running')) AS polling FROM jobs")
def r1213(spark, d):
    j = A.jobs(spark, d)
    return status.polling(j).crossJoin(F.broadcast(j.agg(F.max(status.clamp(F.col("k"), 1, 16, 4)).alias("most"))))  # two single rows


@query("r14_upload_preview", "SELECT o_orderpriority AS source, count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS bytes, count(*) FILTER (o_orderkey % 3 = 0) AS uploaded FROM orders GROUP BY o_orderpriority")
def r14(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("source"))
    return status.upload_preview(o, o.filter("id % 3 = 0"), "id", "size", "source")


@query("j17_k10_delivered_mail", f"WITH {A.MAILS}, l AS (SELECT id, row_number() OVER (PARTITION BY request ORDER BY id) AS n FROM mails WHERE id % 2 = 0) SELECT l.n, m.id, m.subject FROM l JOIN mails m USING (id)")
def j17(spark, d):
    m = A.mails(spark, d)
    book = numbering.number_rows(m.filter("id % 2 = 0"), ["request"], ["id"], name="n").select("id", F.col("n").cast("long").alias("n"))
    return book.join(m.select("id", "subject"), "id")


@query(
    "w12_sample",
    """WITH l AS (SELECT doc_id AS id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(substr(text, 601), chr(10)) AS ls FROM documents WHERE length(text) > 1200)), m AS (SELECT id, i, substr(line, 1, 100) AS cut, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'the ')),
    k AS (SELECT *, sum(length(cut) + 1) OVER (PARTITION BY id ORDER BY i) AS used FROM m WHERE n <= 5), f AS (SELECT id, string_agg(cut, chr(10) ORDER BY i) AS t FROM k WHERE used <= 600 GROUP BY id) SELECT doc_id AS id, CASE WHEN length(text) <= 1200 THEN text WHEN t IS NULL THEN substr(text, 1, 600) ELSE substr(text, 1, 600) || chr(10) || '…' || chr(10) || t END AS text FROM documents LEFT JOIN f ON f.id = doc_id""",
)
def w12(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.sample(F.col("text"), ["license", "the "], 1200, 600, 5, 100).alias("text"))


@query("d10_sent_once", f"WITH {A.IMAGES} SELECT id, row_number() OVER (PARTITION BY image_hash ORDER BY id) = 1 AS send FROM images")
def d10(spark, d):
    from ..operators.dedup import mark_duplicates

    return mark_duplicates(A.images(spark, d), ["image_hash"], ["id"]).select("id", (~F.col("is_duplicate")).alias("send"))


@query("p12_strong_signal", "SELECT doc_id AS id, doc_id % 5 = 0 OR len(regexp_extract_all(text, '(?i)\\bfrom\\b')) >= 2 AS strong FROM documents")
def p12(spark, d):
    from ..config import Subject

    me = Subject(name="from", email="v@work.example")
    sender = F.when(F.col("doc_id") % 5 == 0, "V <v@work.example>").otherwise("x@y")
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), S.strong_signal(sender, F.lit(""), F.lit(""), F.col("text"), me).alias("strong"))

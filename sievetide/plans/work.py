"""Queries over source rows, jobs, runs, costs, uploads and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ReviewConfig
from ..operators import delivery, insights, jobs, numbering
from ..sources import adapters as A
from ..streaming import feeds
from .base import query

BIG = "CAST(coalesce(sum({}), 0) AS BIGINT)"
_STATS = {
    "mail_sources": ("kind = 'pst'", "1"), "mail_scanned": ("kind = 'pst'", "total_emails"), "mail_duplicates": ("kind = 'pst'", "duplicate_emails"), "mail_unique": ("kind = 'pst'", "unique_emails"),
    "mail_excluded": ("kind = 'pst'", "ai_discarded_count"), "mail_selected": ("kind = 'pst'", "ai_approved_count"), "files_found": ("kind <> 'pst'", "greatest(files_total, files_processed + files_skipped)"), "files_delivered": ("kind <> 'pst'", "files_processed"),
    "files_skipped": ("kind <> 'pst'", "files_skipped"), "files_duplicates": ("kind <> 'pst'", "files_duplicates"), "files_ai_discarded": ("kind <> 'pst'", "0"),
    "work_ms": ("true", "metadata_duration_ms + analyze_duration_ms + extract_duration_ms + ai_duration_ms + pdf_duration_ms + greatest(0, files_duration_ms - files_paused_ms)"),
}
STATS_SQL = ", ".join(f"{BIG.format(f'CASE WHEN {c} THEN {v} END')} AS {k}" for k, (c, v) in _STATS.items())


@query("a8_request_stats", f"WITH {A.SOURCE_ROWS} SELECT wave, {STATS_SQL} FROM source_rows GROUP BY wave")
def a8(spark, d):
    return insights.request_stats(A.source_rows(spark, d))


@query("a9_case_stats", f"WITH {A.SOURCE_ROWS} SELECT o_custkey AS case_id, wave, {STATS_SQL} FROM source_rows JOIN orders ON o_orderkey = request GROUP BY ALL")
def a9(spark, d):
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("case_id"))
    return insights.request_stats(A.source_rows(spark, d).join(orders, "request"), by=("case_id", "wave"))


@query("a10_phase_timing", f"WITH {A.SOURCE_ROWS} SELECT kind, CAST(sum(metadata_duration_ms) AS BIGINT) AS metadata_ms, CAST(sum(ai_duration_ms) AS BIGINT) AS ai_ms, CAST(sum(greatest(0, files_duration_ms - files_paused_ms)) AS BIGINT) AS files_ms FROM source_rows GROUP BY kind")
def a10(spark, d):
    return A.source_rows(spark, d).groupBy("kind").agg(F.sum("metadata_duration_ms").alias("metadata_ms"), F.sum("ai_duration_ms").alias("ai_ms"), F.sum(F.greatest(F.lit(0), F.col("files_duration_ms") - F.col("files_paused_ms"))).alias("files_ms"))


_BUSY = "CASE WHEN status = 'pending' AND files_processed % 7 = 0 THEN 'pending_analysis' WHEN status = 'pending' AND files_processed % 7 = 1 THEN 'scanning_metadata' WHEN status = 'pending' AND files_processed % 7 = 2 THEN 'extracting' WHEN status = 'pending' AND files_processed % 7 = 3 THEN 'analyzing' ELSE status END"


@query(
    "a12_phase_status",
    f"""WITH {A.SOURCE_ROWS}, s AS (SELECT request, id, wave, {_BUSY} AS status FROM source_rows) SELECT request, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('scanning_metadata', 'processing', 'pending_analysis')) THEN 'processing' ELSE arg_min(status, (id, status)) END AS parse,
    CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'extracting') THEN 'extracting' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'pending' END AS extract,
    CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'processing') THEN 'processing' ELSE 'pending' END AS render FROM s GROUP BY request""",
)
def a12(spark, d):
    s = A.source_rows(spark, d).withColumn("status", F.expr(_BUSY))
    return s.groupBy("request").agg(insights.parse_status().alias("parse"), insights.extract_status().alias("extract"), insights.render_status("status").alias("render"))


@query("a12_combined_status", f"WITH {A.SOURCE_ROWS}, s AS (SELECT request, list(status ORDER BY wave) AS ss FROM source_rows GROUP BY request) SELECT request, CASE WHEN list_contains(ss, 'failed') THEN 'failed' WHEN len(list_filter(ss, lambda x: x <> 'completed')) = 0 THEN 'completed' ELSE 'pending' END AS status FROM s")
def a12c(spark, d):
    s = A.source_rows(spark, d).groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.struct("wave", "status"))), lambda x: x["status"]).alias("ss"))
    return s.select("request", insights.combined_status(F.col("ss")).alias("status"))


@query("a13_render_progress", f"WITH {A.SOURCE_ROWS} SELECT request, CAST(sum(CASE WHEN status = 'completed' THEN greatest(total_emails, 1) ELSE ai_approved_count END) AS BIGINT) AS total FROM source_rows GROUP BY request")
def a13(spark, d):
    return A.source_rows(spark, d).groupBy("request").agg(F.sum(F.when(F.col("status") == "completed", F.greatest("total_emails", F.lit(1))).otherwise(F.col("ai_approved_count"))).alias("total"))


@query("a22_a23_case_history", f"WITH {A.SOURCE_ROWS} SELECT o_custkey AS case_id, CAST(sum(total_emails) AS BIGINT) AS emails, CAST(sum(files_total) AS BIGINT) AS files, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'success' ELSE 'partial' END AS outcome FROM source_rows JOIN orders ON o_orderkey = request GROUP BY o_custkey")
def a22(spark, d):
    orders = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("case_id"))
    return A.source_rows(spark, d).join(orders, "request").groupBy("case_id").agg(F.sum("total_emails").alias("emails"), F.sum("files_total").alias("files"), insights.outcome_of_rows(F.col("status")).alias("outcome"))


@query("a21_earlier_waves", f"WITH {A.SOURCE_ROWS} SELECT request, count(*) AS n, CAST(sum(total_emails) AS BIGINT) AS size FROM source_rows WHERE wave <> 2 GROUP BY request")
def a21(spark, d):
    return A.source_rows(spark, d).filter("wave != 2").groupBy("request").agg(F.count("*").alias("n"), F.sum("total_emails").alias("size"))


@query("a27_r16_lifecycle", f"WITH {A.SOURCE_ROWS}, a AS (SELECT DISTINCT l_orderkey AS request FROM lineitem WHERE l_partkey % 17 = 0) SELECT request, bool_and(status = 'completed' OR (status = 'failed' AND a.request IS NULL)) AS done FROM source_rows s LEFT JOIN a USING (request) GROUP BY request")
def a27(spark, d):
    active = A.table(spark, d, "lineitem").filter("l_partkey % 17 = 0").select(F.col("l_orderkey").alias("request"), F.lit(True).alias("active")).distinct()
    s = A.source_rows(spark, d).join(active, "request", "left")
    return s.groupBy("request").agg(F.bool_and((F.col("status") == "completed") | ((F.col("status") == "failed") & F.col("active").isNull())).alias("done"))


@query("a28_w11_coordinators", f"WITH {A.SOURCE_ROWS} SELECT request, min(id) AS coordinator FROM source_rows GROUP BY request")
def a28(spark, d):
    return jobs.coordinators(A.source_rows(spark, d), "request")


@query("j16_siblings", f"WITH {A.SOURCE_ROWS} SELECT id, count(*) OVER (PARTITION BY request, kind) - 1 AS siblings FROM source_rows")
def j16(spark, d):
    from pyspark.sql.window import Window as W

    return A.source_rows(spark, d).select("id", (F.count("*").over(W.partitionBy("request", "kind")) - 1).alias("siblings"))


@query("j2_j3_case_chain", f"WITH {A.SOURCE_ROWS} SELECT s.id, c_name AS case_name, coalesce(nullif(CASE WHEN wave % 2 = 0 THEN '' ELSE o_orderpriority END, ''), c_mktsegment) AS subject FROM source_rows s LEFT JOIN orders ON o_orderkey = request LEFT JOIN customer ON c_custkey = o_custkey")
def j23(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    j = A.source_rows(spark, d).join(o, F.col("o_orderkey") == F.col("request"), "left").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = F.when(F.col("wave") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    return j.select("id", F.col("c_name").alias("case_name"), F.coalesce(F.nullif(own, F.lit("")), "c_mktsegment").alias("subject"))


@query("a20_ai_cost", "SELECT source AS request, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS records, (CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) * 0.5::DOUBLE + count(*) * 120 * 2.5::DOUBLE) / 1e6 AS usd FROM documents GROUP BY source")
def a20(spark, d):
    runs = A.table(spark, d, "documents").select(F.col("source").alias("request"), F.ceil(F.length("text") / 4.0).alias("tokens"), F.lit(1).alias("records"))
    return insights.ai_cost(runs)


@query("a14_upload_status", "SELECT o_orderpriority AS source, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS uploaded, count(*) FILTER (o_orderkey % 3 = 0) AS mail, count(*) - count(*) FILTER (o_orderkey % 3 = 0) AS files FROM orders GROUP BY o_orderpriority")
def a14(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "F", "uploaded").otherwise("pending").alias("status"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Emails/").otherwise("Documents/"), F.col("o_orderkey").cast("string")).alias("path"))
    return delivery.upload_counts(o)


@query("k8_outbox", "SELECT o_orderkey AS path FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderstatus <> 'F')")
def k8(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("uploaded").alias("status"))
    return delivery.to_enqueue(o.drop("status"), o.filter("path % 2 = 0")).select("path")


@query(
    "k12_deliverable",
    """SELECT o_orderkey AS id, len(p) >= 2 AND coalesce(p[1] IN ('Emails', 'Messages', 'Documents', 'For Human Review') AND p[2] <> 'Unconverted', false) AS deliverable FROM (SELECT o_orderkey,
    list_filter(regexp_split_to_array((['Emails/', 'Messages/', 'Documents/', 'For Human Review/', 'Discarded/', 'Unconverted/', 'Files/', 'tmp/'])[o_orderkey % 8 + 1] || (['a/b.pdf', 'Unconverted/b.pdf', 'b/Unconverted/c.pdf', '', 'b\\c.pdf'])[o_orderkey % 5 + 1], '[\\\\/]'), lambda x: x <> '') AS p FROM orders)""",
)
def k12(spark, d):
    k = F.col("o_orderkey")
    tops, rest = ("Emails/", "Messages/", "Documents/", "For Human Review/", "Discarded/", "Unconverted/", "Files/", "tmp/"), ("a/b.pdf", "Unconverted/b.pdf", "b/Unconverted/c.pdf", "", "b\\c.pdf")
    one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return A.table(spark, d, "orders").select(k.alias("id"), delivery.deliverable(F.concat(one_of(tops), one_of(rest))).alias("deliverable"))


@query("t20_unique_names", "SELECT p_partkey AS id, p_brand || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def t20(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".pdf")).alias("name"))
    return numbering.disambiguated(p, [], "name", ["id"]).select("id", "unique_name")


@query("a29_highest_number", "SELECT p_brand AS request, CAST(max(p_size) AS INT) AS top, lpad(CAST(max(p_size) AS VARCHAR), CAST(greatest(2, length(CAST(count(*) AS VARCHAR))) AS INT), '0') AS padded FROM part GROUP BY p_brand")
def a29(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_brand").alias("request"), F.concat(F.lit("Email "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".pdf")).alias("name"))
    g = p.groupBy("request").agg(numbering.highest(F.col("name"), "Email").alias("top"), F.count("*").alias("n"))
    return g.select("request", "top", numbering.padded(F.col("top"), F.col("n")).alias("padded"))


@query("p21_unfinished_names", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS unfinished FROM part")
def p21(spark, d):
    name = F.concat(F.lit("Document "), F.when(F.col("p_partkey") % 2 == 0, F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 16)).otherwise(F.col("p_partkey").cast("string")), F.lit(".pdf"))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), numbering.unfinished_name(name).alias("unfinished"))


@query("r5_r6_waves", f"WITH {A.SOURCE_ROWS} SELECT id, CASE WHEN kind = 'pst' AND wave % 2 = 0 THEN 'both' WHEN kind = 'pst' THEN 'mail' WHEN wave % 2 = 0 THEN 'files' ELSE 'both' END AS scope, CASE WHEN wave % 3 = 0 THEN 7 WHEN wave > 1 THEN 5 ELSE 0 END AS base FROM source_rows")
def r56(spark, d):
    mine, before = F.when(F.col("kind") == "pst", "mail").otherwise("files"), F.when(F.col("wave") % 2 == 0, "files").otherwise("mail")
    return A.source_rows(spark, d).select("id", numbering.wave_scope(mine, before).alias("scope"), numbering.numbering_base(F.when(F.col("wave") % 3 == 0, 7), F.col("wave"), F.lit(5)).alias("base"))


@query("w8_activity", "SELECT c_custkey AS request, p.position, p.label, CAST(1000 + CASE p.position WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 60 END AS BIGINT) AS at_ms FROM customer, (VALUES (1, 'Read'), (2, 'Prepare'), (3, 'Judge')) p(position, label)")
def w8(spark, d):
    starts = A.table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.lit(1000).alias("started_ms"))
    phases = starts.select("request", F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("label"), F.lit(i * 10).alias("ms")) for i, n in ((1, "Read"), (2, "Prepare"), (3, "Judge"))])).alias("p")).select("request", "p.*")
    return insights.activity(starts, phases)


_ACTIVE = "status IN ('queued', 'leased', 'running')"


@query("a15_job_fan_in", f"WITH {A.JOBS} SELECT case_key, phase, count(*) FILTER ({_ACTIVE}) AS active, count(*) FILTER (status IN ('failed', 'dead_letter')) AS failed, count(*) FILTER (status = 'completed') AS completed FROM jobs GROUP BY ALL")
def a15(spark, d):
    return jobs.fan_in(A.jobs(spark, d), ("case_key", "phase"))


@query("a16_batch_totals", f"WITH {A.JOBS} SELECT file, CAST(sum(k) AS BIGINT) AS k FROM jobs GROUP BY file")
def a16(spark, d):
    j = A.jobs(spark, d).select(F.col("id").alias("job_id"), "file", "k")
    return jobs.batch_totals(j.unionByName(j), ("file",), ("k",))


@query("a17_admitted_cases", f"WITH {A.JOBS} SELECT case_key, min(created_at) AS since FROM jobs WHERE {_ACTIVE} GROUP BY case_key")
def a17(spark, d):
    return jobs.admitted(A.jobs(spark, d))


@query("a18_u3_fallback_sources", f"WITH {A.JOBS}, n AS (SELECT *, id % 7 AS m FROM jobs) SELECT file * 100 + k AS file FROM jobs GROUP BY file, k HAVING bool_or(status IN ('failed', 'dead_letter')) AND NOT bool_or(status = 'completed' OR {_ACTIVE})")
def a18(spark, d):
    return jobs.fallback_sources(A.jobs(spark, d).withColumn("file", F.col("file") * 100 + F.col("k")))


@query("w5_latest_jobs", f"WITH {A.JOBS} SELECT phase, dedupe_key, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM jobs GROUP BY ALL")
def w5(spark, d):
    return jobs.latest(A.jobs(spark, d), ["phase", "dedupe_key"], ["created_at", "id"]).select("phase", "dedupe_key", "id", "status")


@query("j8_jobs_of_latest_run", f"WITH {A.JOBS}, r AS (SELECT case_key, arg_max(k, (created_at, k)) AS run FROM jobs GROUP BY case_key) SELECT jobs.id, run FROM jobs JOIN r ON r.case_key = jobs.case_key AND r.run = jobs.k")
def j8(spark, d):
    j = A.jobs(spark, d)
    return jobs.of_latest_run(j.withColumn("run", F.col("k")), j.select("case_key", "created_at", F.col("k").alias("run")), "case_key").select("id", "run")


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("j9_o6_claimable", f"WITH {A.JOBS}, q AS (SELECT *, row_number() OVER (PARTITION BY case_key, phase ORDER BY priority, created_at, id) AS n FROM jobs WHERE status = 'queued' AND available_at <= {_NOW}) SELECT id FROM q WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM jobs r WHERE r.case_key = q.case_key AND r.phase = q.phase AND r.status IN ('leased', 'running') AND r.k > 98)")
def j9(spark, d):
    j = A.jobs(spark, d).withColumn("g", F.concat_ws("|", "case_key", "phase"))
    j = j.filter("status = 'queued' OR (status IN ('leased', 'running') AND k > 98)")
    return jobs.claimable(j, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "g").select("id")


@query("j10_revivable", f"WITH {A.JOBS} SELECT id FROM jobs j WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM jobs a WHERE a.phase = j.phase AND a.dedupe_key = j.dedupe_key AND a.status IN ('queued', 'leased', 'running') AND a.k > 60)")
def j10(spark, d):
    return jobs.revivable(A.jobs(spark, d).filter("status = 'failed' OR k > 60")).select("id")


@query("x2_enqueue", f"WITH {A.JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY phase, dedupe_key ORDER BY created_at, id) AS r FROM jobs WHERE k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM jobs a WHERE a.phase = jobs.phase AND a.dedupe_key = jobs.dedupe_key AND a.status IN ('queued', 'leased', 'running') AND a.k % 2 = 1 AND a.k > 70)) SELECT id FROM n WHERE r = 1")
def x2(spark, d):
    j = A.jobs(spark, d)
    return jobs.enqueue(j.filter("k % 2 = 1 AND k > 70"), j.filter("k % 2 = 0")).select("id")


@query("x3_x4_after_failure", f"WITH {A.JOBS} SELECT id, CASE WHEN attempts < 5 THEN 'queued' ELSE 'dead_letter' END AS next_status, CASE WHEN attempts < 5 THEN CAST(least(300, 5 * pow(2, attempts - 1)) AS INT) END AS delay_s, CASE WHEN status IN ('leased', 'running') AND lease_expires_at < {_NOW} THEN 'queued' ELSE status END AS status FROM jobs")
def x34(spark, d):
    j = jobs.requeue_expired(A.jobs(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return jobs.after_failure(j).select("id", "next_status", "delay_s", "status")


@query("x5_stale_claims", f"WITH {A.JOBS} SELECT id, CASE WHEN age >= 1800 THEN 'give_up' WHEN age >= 900 THEN 'reclaim' ELSE 'fresh' END AS claim FROM (SELECT id, epoch({_NOW}) - floor(epoch(created_at)) AS age FROM jobs)")
def x5(spark, d):
    return jobs.stale_claims(A.jobs(spark, d).withColumnRenamed("created_at", "claimed_at"), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id", "claim")


@query("r4_exhausted", f"WITH {A.JOBS} SELECT id, upper(substr(phase, 1, 1)) || substr(phase, 2) || ' gave up after ' || attempts || CASE WHEN attempts = 1 THEN ' attempt' ELSE ' attempts' END AS message FROM jobs WHERE status = 'failed'")
def r4(spark, d):
    return A.jobs(spark, d).filter("status = 'failed'").select("id", jobs.exhausted_message(F.col("phase"), F.col("attempts"), F.lit(None).cast("string")).alias("message"))


@query("r17_retry_phase", f"WITH {A.SOURCE_ROWS} SELECT id, CASE WHEN kind = 'files' AND status <> 'completed' THEN 'files' WHEN status = 'failed' THEN 'render' WHEN wave % 2 = 0 THEN 'ai' WHEN total_emails > 10 THEN 'extract' ELSE 'parse' END AS phase FROM source_rows")
def r17(spark, d):
    return A.source_rows(spark, d).select("id", jobs.retry_phase(F.when(F.col("kind") == "files", F.col("status")), F.col("status"), F.when(F.col("wave") % 2 == 0, "failed").otherwise("completed"), F.col("total_emails") > 10, F.col("total_emails")).alias("phase"))


@query("a31_retry_targets", f"WITH {A.JOBS} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY case_key, phase ORDER BY id) AS n FROM jobs WHERE status = 'failed') WHERE phase NOT IN ('ai', 'render') OR n = 1")
def a31(spark, d):
    return jobs.retry_targets(A.jobs(spark, d).withColumnRenamed("case_key", "request")).select("id")


@query("r10_r11_routing", f"WITH {A.FILES} SELECT id, bytes > 9000 AS large, CASE WHEN ext IN ('.docx', '.xlsx') AND bytes >= 5000 THEN 'large' ELSE 'normal' END AS lane FROM files")
def r1011(spark, d):
    pages = F.ceil(F.col("bytes") / 300.0)
    return A.files(spark, d).select("id", (pages > ReviewConfig().large_pages).alias("large"), F.when(F.col("ext").isin(".docx", ".xlsx") & (F.col("bytes") >= 5000), "large").otherwise("normal").alias("lane"))


@query("r8_required_fields", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_missing FROM customer")
def r8(spark, d):
    given = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("x"), F.lit("1"))).when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.size(delivery.missing_fields(F.array(F.lit("a"), F.lit("b")), given)).alias("n_missing"))


@query("x8_tumbling_stream", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x8(spark, d):
    s = feeds.tumbling(feeds.event_stream(spark, d, "events"), "1 day", "1 hour", "event_type")
    return feeds.collected(s).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x8_sliding_stream", "SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), CASE WHEN hour(ts) >= 12 THEN date_trunc('day', ts) + INTERVAL 12 HOURS ELSE date_trunc('day', ts) - INTERVAL 12 HOURS END]) AS w FROM events) GROUP BY w")
def x8s(spark, d):
    return feeds.collected(feeds.sliding(feeds.event_stream(spark, d, "events"), "1 day", "12 hours", "1 hour")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x8_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def x8x(spark, d):
    return feeds.sessions(A.table(spark, d, "events"), "1 hour", "user_id")


@query("x1_change_feed", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def x1(spark, d):
    s = feeds.event_stream(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return feeds.collected(feeds.on_change(s, "user_id", "event_type"), "append")


@query("x6_throttle_stream")
def x6(spark, d):
    s = feeds.event_stream(spark, d, "events").select("ts", "user_id", "event_type")
    return feeds.collected(feeds.once_per_key(s, ["user_id", "event_type"], "1 hour"), "append")

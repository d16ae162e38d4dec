"""Derived states of requests and small rules of the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(phases: Column) -> Column:
    """Of an array of (phase, status) in pipeline order: the first failed phase, else the first queued, else the first active, else completed or pending."""
    first = lambda statuses: F.get(F.filter(phases, lambda p: p["status"].isin(*statuses)), F.lit(0))["phase"]
    label = lambda kind, phase: F.when(phase.isNotNull(), F.concat(F.lit(f"{kind} "), phase))
    done = F.when(F.forall(phases, lambda p: p["status"] == "completed"), "completed").otherwise("pending")
    return F.coalesce(label("failed", first(("failed",))), label("queued", first(("queued",))), label("active", first(("processing", "extracting", "running"))), done)


def summary(rows: DataFrame, by: str) -> DataFrame:
    """For each case: whether anything failed, runs, or all is complete, and the first failed row by preference (rank)."""
    s = F.col("status")
    return rows.groupBy(by).agg(F.bool_or(s == "failed").alias("has_failure"), F.bool_or(s.isin("processing", "running")).alias("in_progress"), F.bool_and(s == "completed").alias("completed"), F.min_by(F.when(s == "failed", F.col("id")), F.struct((s != "failed").alias("no"), F.col("rank"), F.col("id"))).alias("first_failed"))


def phase_progress(rows: DataFrame, by: str = "request") -> DataFrame:
    """done and total of each request: the rows' counters, and of coordinators one for each wave, that with most batches."""
    top = rows.groupBy(by, "wave").agg(F.max("batches").alias("b"), F.max_by("batches_done", F.struct("batches", "id")).alias("d"))
    batches = top.groupBy(by).agg(F.sum("b").alias("batches"), F.sum("d").alias("batches_done"))
    return rows.groupBy(by).agg(F.sum("total").alias("total"), F.sum(F.least("done", "total")).alias("done")).join(batches, by)


def elapsed(runs: DataFrame, by: str, submitted: str = "submitted_ms", completed: str = "completed_ms", fallback: int = 0) -> DataFrame:
    """Milliseconds from the first submission to the last completion, not under 0."""
    span = F.max(completed) - F.min(submitted)
    return runs.groupBy(by).agg(F.coalesce(F.greatest(F.lit(0), span), F.lit(fallback)).cast("long").alias("elapsed_ms"))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def polling(rows: DataFrame) -> DataFrame:
    """One row: whether any row is still at work."""
    return rows.agg(F.coalesce(F.bool_or(F.col("status").isin("queued", "leased", "processing", "running")), F.lit(False)).alias("polling"))


def upload_preview(files: DataFrame, done: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """Files and bytes to upload, and how many are there already."""
    j = files.join(done.select(key).distinct().withColumn("st_done", F.lit(True)), key, "left")
    return j.groupBy(by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count("st_done").alias("uploaded"))


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of at most 500 rows in a total order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def in_case(path: Column, key: str) -> Column:
    """The case itself or anything below it."""
    return (path == key) | path.startswith(key.rstrip("/") + "/")


def row_tokens(name: Column, email: Column, personal: Column, aliases: Column, least: int = 3) -> Column:
    """The subject's tokens where every row has a subject of its own."""
    clean = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    n = clean(name)
    parts = F.split(n, " ")
    long_enough = lambda x: F.when(F.length(x) >= least, x)
    local = lambda x: long_enough(F.substring_index(clean(x), "@", 1))
    words = F.concat(F.array(n, long_enough(parts[0]), long_enough(F.element_at(parts, -1))), F.transform(aliases, clean), F.array(clean(email), local(email), clean(personal), local(personal)))
    return F.array_distinct(F.filter(words, lambda w: w.isNotNull() & (w != "")))


def backfill_items(emails: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """Items for e-mails that have none: discarded copies, or pending, with their source's request."""
    j = emails.join(sources, "file_id", "left").join(items.select("id"), "id", "left_anti")
    return j.select("id", "file_id", "request", F.when(F.col("is_duplicate"), "discarded").otherwise("pending").alias("state"), F.when(F.col("is_duplicate"), "dup").alias("rule"))


def move_runs(into: DataFrame, *tables: DataFrame) -> DataFrame:
    """The rows of several tables that the one table lacks."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.dropDuplicates(["id"]).join(into.select("id"), "id", "left_anti")


def screened(attachments: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Attachments with their content's verdict; without one they go to review."""
    return attachments.join(verdicts, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("review")))

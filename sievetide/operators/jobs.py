"""The durable job queue, seen from its rows and events: what is active, latest, expired, next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ACTIVE = ("queued", "leased", "running")


def fan_in(jobs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy(*by).agg(F.count_if(s.isin(*ACTIVE)).alias("active"), F.count_if(s.isin("failed", "dead_letter")).alias("failed"), F.count_if(s == "completed").alias("completed"))


def latest(jobs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group."""
    rest = [c for c in jobs.columns if c not in by]
    return jobs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("jb")).select(*by, *[f"jb.{c}" for c in rest])


def of_latest_run(jobs: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """The jobs that belong to their group's latest run."""
    last = runs.groupBy(by).agg(F.max_by("run", F.struct("created_at", "run")).alias("run"))
    return jobs.join(last, [by, "run"])


def admitted(jobs: DataFrame) -> DataFrame:
    """Cases with active jobs, the one that has waited longest first."""
    return jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("case_key").agg(F.min("created_at").alias("since")).orderBy("since", "case_key")


def claimable(jobs: DataFrame, now: Column, group: str = "file") -> DataFrame:
    """Queued jobs that are due, unless another job of their group runs or waits before them."""
    due = jobs.filter((F.col("status") == "queued") & (F.col("available_at") <= now))
    running = jobs.filter(F.col("status").isin("leased", "running")).select(group).distinct()
    first = due.groupBy(group).agg(F.min(F.struct("priority", "created_at", "id")).alias("jb"))
    free = due.join(first, group).filter(F.struct("priority", "created_at", "id") == F.col("jb")).drop("jb")
    return free.join(running, group, "left_anti")


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    return claimable(jobs, now).orderBy("priority", "created_at", "id").limit(1)


def revivable(jobs: DataFrame) -> DataFrame:
    """Failed jobs without another active one of their phase and key."""
    active = jobs.filter(F.col("status").isin(*ACTIVE)).select("phase", "dedupe_key").distinct()
    return jobs.filter(F.col("status").isin("failed", "dead_letter")).join(active, ["phase", "dedupe_key"], "left_anti")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The new jobs that no active one stands for: one of each phase and key, the first."""
    active = jobs.filter(F.col("status").isin(*ACTIVE)).select("phase", "dedupe_key").distinct()
    w = W.partitionBy("phase", "dedupe_key").orderBy("created_at", "id")
    return new.join(active, ["phase", "dedupe_key"], "left_anti").withColumn("jb_k", F.row_number().over(w)).filter("jb_k = 1").drop("jb_k")


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(300), F.lit(5) * F.pow(F.lit(2.0), attempts - 1)).cast("int")


def after_failure(jobs: DataFrame) -> DataFrame:
    """What a failed attempt makes of a job: queued again after a pause, or dead after the last attempt."""
    more = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumn("next_status", F.when(more, "queued").otherwise("dead_letter")).withColumn("delay_s", F.when(more, backoff_seconds(F.col("attempts"))))


def requeue_expired(jobs: DataFrame, now: Column) -> DataFrame:
    expired = F.col("status").isin("leased", "running") & (F.col("lease_expires_at") < now)
    return jobs.withColumn("status", F.when(expired, "queued").otherwise(F.col("status")))


def stale_claims(claims: DataFrame, now: Column) -> DataFrame:
    """Claims by age: fresh, to be reclaimed after 15 minutes, given up after 30."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("claimed_at").cast("timestamp"))
    return claims.withColumn("claim", F.when(age >= 1800, "give_up").when(age >= 900, "reclaim").otherwise("fresh"))


def batch_totals(results: DataFrame, by: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """Sums over jobs, each counted once however often it reported."""
    return results.dropDuplicates(["job_id"]).groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def fallback_sources(jobs: DataFrame) -> DataFrame:
    """Sources that failed and have neither a completed nor an active job."""
    s = F.col("status")
    g = jobs.groupBy("file").agg(F.bool_or(s.isin("failed", "dead_letter")).alias("bad"), F.bool_or((s == "completed") | s.isin(*ACTIVE)).alias("good"))
    return g.filter("bad AND NOT good").select("file")


def exhausted_message(phase: Column, attempts: Column, error: Column) -> Column:
    return F.concat(F.initcap(phase), F.lit(" gave up after "), attempts.cast("string"), F.when(attempts == 1, " attempt").otherwise(" attempts"), F.when(error.isNotNull(), F.concat(F.lit(": "), error)).otherwise(""))


def retry_phase(files_status: Column, render_status: Column, ai_status: Column, has_artifact: Column, total: Column) -> Column:
    return F.when(files_status.isNotNull() & (files_status != "completed"), "files").when(render_status == "failed", "render").when(ai_status == "failed", "ai").when(has_artifact & (total > 0), "extract").otherwise("parse")


def retry_targets(rows: DataFrame) -> DataFrame:
    """Failed rows to retry: every one of parse and extract, one for each request of ai and render."""
    bad = rows.filter("status = 'failed'")
    single = F.col("phase").isin("ai", "render")
    w = W.partitionBy("request", "phase").orderBy("id")
    return bad.withColumn("jb_k", F.row_number().over(w)).filter(~single | (F.col("jb_k") == 1)).drop("jb_k")


def coordinators(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min("id").alias("coordinator"))

"""Funnels, outcomes, statistics and statuses over items and source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AI_RULES, FUNNEL_RULES, OUTCOMES


def rounded(x: Column) -> Column:
    """Half up, for numbers of at least 0."""
    return F.floor(x + F.lit(0.5)).cast("long")


def total(condition: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")


def outcome_groups(items: DataFrame, by: tuple[str, ...] = ("state", "rule")) -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("count"))


def funnel(groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """groups (state, rule, count) as one row, or one for each by: what every step removed and left, and what the judge did."""
    n, gone = F.col("count"), F.col("state") == "discarded"
    ai = F.col("rule").isin(*AI_RULES)
    aggs = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("received")]
    aggs += [total(gone & F.col("rule").isin(*rules), n).alias(f"{k}_removed") for k, rules in FUNNEL_RULES.items()]
    aggs += [total(ai & (F.col("state") == s), n).alias(f"ai_{s}") for s in ("kept", "discarded", "review")]
    aggs += [total(F.col("state") == "review", n).alias("for_review")]
    out = groups.groupBy(*by).agg(*aggs) if by else groups.agg(*aggs)
    left = F.col("received")
    for k in FUNNEL_RULES:
        left = left - F.col(f"{k}_removed")
        out = out.withColumn(f"after_{k}", left)
    removed = F.col("received") - F.col("after_subject")
    percent = lambda part, whole: F.when(whole > 0, rounded(part * 100.0 / whole)).otherwise(0).cast("long")
    out = out.withColumn("ai_waiting", F.greatest(F.lit(0), F.col("after_subject") - F.col("ai_kept") - F.col("ai_discarded") - F.col("ai_review")))
    return out.withColumn("removed_percent", percent(removed, F.col("received"))).withColumn("kept_percent", percent(F.col("ai_kept") + F.col("ai_review"), F.col("after_subject")))


def outcome(state: Column, rule: Column) -> Column:
    """Where an item ended: duplicate or one of OUTCOMES."""
    by_rule = F.when(rule.isin(*FUNNEL_RULES["duplicates"]), "duplicate")
    for k in ("type", "keyword", "subject"):
        by_rule = by_rule.when(rule.isin(*FUNNEL_RULES[k]), k)
    return F.when(state == "kept", "kept").when(state == "review", "review").when(state == "pending", "waiting").otherwise(by_rule.when(rule.isin(*AI_RULES), "ai_discarded").otherwise("other"))


def outcome_bars(groups: DataFrame) -> DataFrame:
    """groups (kind, state, rule, count) as kind, received, duplicates, unique, segment, position, n: segments of a kind add up to unique."""
    g = groups.withColumn("segment", outcome(F.col("state"), F.col("rule")))
    sums = g.groupBy("kind").agg(F.sum("count").alias("received"), total(F.col("segment") == "duplicate", F.col("count")).alias("duplicates"))
    parts = g.filter("segment != 'duplicate'").groupBy("kind", "segment").agg(F.sum("count").alias("n")).filter("n > 0")
    position = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("segment")).cast("int")
    return sums.join(parts, "kind").select("kind", "received", "duplicates", (F.col("received") - F.col("duplicates")).alias("unique"), "segment", position.alias("position"), "n")


def rules_for_step(step: str) -> tuple[str, ...] | None:
    return AI_RULES if step == "ai" else FUNNEL_RULES.get(step)


def tab_filter(tab: str) -> Column:
    if tab == "emails":
        return (F.col("origin") == "pst") & (F.col("kind") == "email")
    return F.col("origin") == "attachment" if tab == "attachments" else (F.col("origin") == "files_folder") & (F.col("kind") != "chat_message")


def filter_items(items: DataFrame, tab: str | None = None, step: str | None = None, rule: str | None = None, state: str | None = None, q: str | None = None) -> DataFrame:
    """The decisions panel's filter: all conditions that are given."""
    out = items
    if tab:
        out = out.filter(tab_filter(tab))
    if step and (rules := rules_for_step(step)):
        out = out.filter(F.col("rule").isin(*rules))
    for column, value in (("rule", rule), ("state", state)):
        out = out.filter(F.col(column) == value) if value else out
    return out.filter(F.lower("label").contains(q.lower())) if q else out


def analysis_label(decided_by: Column, rule: Column, state: Column, rereview: Column) -> Column:
    by_rule = decided_by.isNull() | (decided_by == "") | (decided_by == "rule") | (rule.isNotNull() & ~rule.isin(*AI_RULES))
    return F.when((state == "pending") & rereview, "2nd analysis").when(by_rule, "Rule").when(decided_by.rlike("5[.-]5"), "2nd analysis").otherwise("1st analysis")


def request_stats(rows: DataFrame, discarded: DataFrame | None = None, by: tuple[str, ...] = ("wave",)) -> DataFrame:
    """Mail and files funnels and work time of source rows, by wave, or with rollup totals for by=()."""
    if discarded is not None:
        rows = rows.join(discarded, rows["id"] == discarded["file_id"], "left").drop("file_id")
    else:
        rows = rows.withColumn("ai_discarded", F.lit(0))
    mail = F.col("kind") == "pst"
    found = F.greatest(F.col("files_total"), F.col("files_processed") + F.col("files_skipped"))
    sums = {
        "mail_sources": (mail, F.lit(1)), "mail_scanned": (mail, F.col("total_emails")), "mail_duplicates": (mail, F.col("duplicate_emails")), "mail_unique": (mail, F.col("unique_emails")),
        "mail_excluded": (mail, F.col("ai_discarded_count")), "mail_selected": (mail, F.col("ai_approved_count")), "files_found": (~mail, found), "files_delivered": (~mail, F.col("files_processed")),
        "files_skipped": (~mail, F.col("files_skipped")), "files_duplicates": (~mail, F.col("files_duplicates")), "files_ai_discarded": (~mail, F.coalesce("ai_discarded", F.lit(0))), "work_ms": (F.lit(True), work_ms()),
    }
    return rows.groupBy(*by).agg(*[total(c, v).alias(k) for k, (c, v) in sums.items()])


def work_ms() -> Column:
    plain = sum((F.col(f"{p}_duration_ms") for p in ("metadata", "analyze", "extract", "ai", "pdf")), F.lit(0))
    return plain + F.greatest(F.lit(0), F.col("files_duration_ms") - F.col("files_paused_ms"))


# Statuses of a source that is being parsed.
PARSING = ("scanning_metadata", "processing", "pending_analysis")


def parse_status(status: str = "status") -> Column:
    """Fan-in of the parse phase over a group's rows: any failure, any activity, else the status of the first id."""
    s = F.col(status)
    return F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s.isin(*PARSING)), "processing").otherwise(F.coalesce(F.min_by(s, F.struct(F.col("id"), s)), F.lit("pending")))


def extract_status(status: str = "status") -> Column:
    s = F.col(status)
    return F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "extracting"), "extracting").when(F.bool_and(s == "completed"), "completed").otherwise("pending")


def render_status(status: str = "pdf_status") -> Column:
    s = F.col(status)
    return F.when(F.bool_or(s == "failed"), "failed").when(F.bool_and(s == "completed"), "completed").when(F.bool_or(s == "processing"), "processing").otherwise("pending")


def combined_status(statuses: Column) -> Column:
    """Of an array of statuses: failed, completed if all are, else the last active one, else pending."""
    active = F.filter(statuses, lambda s: ~s.isin("pending", "completed"))
    return F.when(F.array_contains(statuses, "failed"), "failed").when((F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "completed"), "completed").otherwise(F.coalesce(F.get(F.reverse(active), F.lit(0)), F.lit("pending")))


def activity(starts: DataFrame, phases: DataFrame) -> DataFrame:
    """When each phase of a request ended: its start plus the times of the phases up to it. phases: (request, position, label, ms)."""
    from pyspark.sql.window import Window as W

    clock = F.sum("ms").over(W.partitionBy("request").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return phases.join(starts, "request").select("request", "position", "label", (F.col("started_ms") + clock).cast("long").alias("at_ms"))


def ai_cost(runs: DataFrame, by: tuple[str, ...] = ("request",), record_tokens: int = 120, usd_in: float = 0.5, usd_out: float = 2.5) -> DataFrame:
    """tokens, records and USD by request, at prices for a million tokens."""
    out = runs.groupBy(*by).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("records").cast("long").alias("records"))
    return out.withColumn("usd", (F.col("tokens") * usd_in + F.col("records") * record_tokens * usd_out) / 1e6)


def outcome_of_rows(status: Column) -> Column:
    """Terminal outcome of a group: failed if any row failed, success if all completed, else partial."""
    return F.when(F.bool_or(status == "failed"), "failed").when(F.bool_and(status == "completed"), "success").otherwise("partial")


def coverage(emails: DataFrame, items: DataFrame, by: str = "file_id") -> DataFrame:
    """For each source: emails, items, emails without item, items without email, pending ones, and the first 20 missing ids.

    An aggregate for each side of a full outer join on the id: nothing is collected but 20 ids a source.
    """
    both = emails.select(F.col("id"), F.col(by), F.lit(True).alias("in_e")).join(items.select("id", F.col(by).alias("by_i"), "state", F.lit(True).alias("in_i")), "id", "full_outer")
    g = both.withColumn("src", F.coalesce(by, "by_i"))
    missing = F.col("in_e").isNotNull() & F.col("in_i").isNull()
    out = g.groupBy("src").agg(F.count("in_e").alias("emails"), F.count("in_i").alias("items"), F.count_if(missing).alias("missing"), F.count_if(F.col("in_e").isNull()).alias("orphans"), F.count_if(F.col("state") == "pending").alias("pending"))
    from pyspark.sql.window import Window as W

    first = g.filter(missing).withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("id"))).filter("k <= 20").groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_missing"))
    return out.join(first, "src", "left").withColumnRenamed("src", by)

"""Deliverables: manifests, trails, completeness, outboxes and request files for a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label

# The folders that are delivered.
DELIVERED_TOPS = ("Emails", "Messages", "Documents", "For Human Review")
HEADER = ("time", "decision", "item", "kind", "origin", "parent", "rule", "reason", "decided_by")


def trail(items: DataFrame) -> DataFrame:
    """The audit trail's columns, ordered by kind, origin and id."""
    out = items.select(F.col("at").alias("time"), F.col("state").alias("decision"), label(F.col("label"), F.col("id")).alias("item"), "kind", "origin", "parent", "rule", "reason", "decided_by", F.col("id").alias("tr_id"))
    return out.orderBy("kind", "origin", "tr_id").drop("tr_id")


def discarded_trail(items: DataFrame) -> DataFrame:
    """Discarded and reviewed rows, if anything was discarded at all."""
    some = items.filter("state = 'discarded'").limit(1).select(F.lit(True).alias("tr_some"))
    return items.filter("state IN ('discarded', 'review')").join(F.broadcast(some), F.lit(True), "left_semi")  # one row


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all).mode("overwrite").csv(path)


def request_lines(items: DataFrame, model: str, template: str) -> DataFrame:
    """One JSON line for each item: its id and a chat request with a tool that must be used. template: text before the item's."""
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit(template), F.col("text")).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.struct(F.lit("tool").alias("type"), F.lit("judge").alias("name")).alias("tool_choice"))
    return items.select(F.to_json(F.struct(F.col("id").cast("string").alias("custom_id"), body.alias("body"))).alias("value"))


def write_requests(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def deliverable(path: Column) -> Column:
    """Paths inside the delivered folders, but not the fallback copies in their Unconverted folders."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    return (F.size(parts) >= 2) & F.coalesce(F.get(parts, F.lit(0)).isin(*DELIVERED_TOPS) & (F.get(parts, F.lit(1)) != "Unconverted"), F.lit(False))


def disposition(state: Column, rule: Column, converted: Column) -> Column:
    """The folder that a file ends in."""
    return F.when(state == "discarded", "Discarded").when(state == "review", "Review").when(~converted & ~F.coalesce(rule, F.lit("")).isin("password", "subject_absent"), "Unconverted").otherwise("Delivered")


def to_enqueue(files: DataFrame, outbox: DataFrame) -> DataFrame:
    """Files whose path, size and time are not in the outbox yet, or whose upload failed."""
    done = outbox.filter("status != 'failed'").select("path", "size", "mtime")
    return files.join(done, ["path", "size", "mtime"], "left_anti").withColumn("status", F.lit("pending"))


def upload_counts(outbox: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Uploads of each source: all, done, and those of mail; the rest are files."""
    mail = F.col("path").startswith("Emails/")
    out = outbox.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "uploaded").alias("uploaded"), F.count_if(mail).alias("mail"))
    return out.withColumn("files", F.col("total") - F.col("mail"))


def complete(kept: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Kept items that were not delivered; none, if the delivery is complete."""
    return kept.join(delivered, key, "left_anti")


def gate(kept: Column, delivered: Column, skipped: Column) -> Column:
    return delivered + skipped >= kept


def missing_fields(required: Column, given: Column) -> Column:
    """Required fields without a value in the map given."""
    return F.filter(required, lambda f: F.trim(F.coalesce(F.try_element_at(given, f), F.lit(""))) == "")

"""The append-only history of decisions, and tables that new rows join only if they are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STATE = ("state", "rule", "reason", "decided_by")


def changes(events: DataFrame, key: str, order: list[str], compared: tuple[str, ...] = STATE) -> DataFrame:
    """The events of each key that differ from the one before in a compared column; nulls are equal to nulls."""
    w = W.partitionBy(key).orderBy(*order)
    value = F.struct(*compared)
    return events.withColumn("lg_before", F.lag(value).over(w)).withColumn("lg_k", F.row_number().over(w)).filter((F.col("lg_k") == 1) | ~value.eqNullSafe(F.col("lg_before"))).drop("lg_before", "lg_k")


def current(events: DataFrame, key: str, order: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Each key's last event. The last is an aggregate, so long histories are combined before the shuffle."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("lg")).select(key, *[f"lg.{c}" for c in columns])


def append_changes(ledger: DataFrame, decisions: DataFrame, key: str, order: list[str], compared: tuple[str, ...]) -> DataFrame:
    """The decisions that differ from the ledger's last entry of their key: what a run has to append. Again, it appends nothing."""
    last = current(ledger, key, order, compared)
    last = last.select(F.col(key).alias("lg_key"), F.struct(*compared).alias("lg_last"))
    j = decisions.join(last, F.col(key) == F.col("lg_key"), "left")
    return j.filter(F.col("lg_key").isNull() | ~F.struct(*compared).eqNullSafe(F.col("lg_last"))).drop("lg_key", "lg_last")


def history(items: DataFrame, events: DataFrame) -> DataFrame:
    """Every item with its events in order."""
    e = events.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "state", "rule"))).alias("events"))
    return items.join(e, items["id"] == e["item_id"], "left").drop("item_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's row where there is one, else old's."""
    columns = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("up_key"), *[F.col(c).alias(f"up_{c}") for c in columns])
    j = old.join(n, F.col(key) == F.col("up_key"), "full_outer")
    new_row = F.col("up_key").isNotNull()
    return j.select(F.coalesce(key, "up_key").alias(key), *[F.when(new_row, F.col(f"up_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def prune(rows: DataFrame, present: DataFrame, key: str, protected: Column) -> DataFrame:
    """rows whose file is still there, or that are protected."""
    gone = rows.filter(~F.coalesce(protected, F.lit(False))).join(present, key, "left_anti")
    return rows.join(gone.select(key), key, "left_anti")

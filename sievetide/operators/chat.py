"""Chat excerpts around the messages that cite the subject, and messages seen elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def excerpts(messages: DataFrame, cites: Column, context: int = 5, chat: str = "chat", seq: str = "seq") -> DataFrame:
    """chat, excerpt, first, last, n_candidates: windows of context messages on each side of the citing ones, joined where they touch.

    seq counts a chat's messages from 0. Chats are dealt by hash; only bounds, not messages, are in the windows.
    """
    ends = messages.groupBy(chat).agg(F.max(seq).alias("cx_end"))
    own = messages.filter(cites).select(chat, seq).join(ends, chat)
    own = own.withColumn("cx_from", F.greatest(F.lit(0), F.col(seq) - context)).withColumn("cx_to", F.least("cx_end", F.col(seq) + context))
    order = W.partitionBy(chat).orderBy(seq)
    reach = F.max("cx_to").over(order.rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("cx_new", F.when(F.col("cx_from") <= reach + 1, 0).otherwise(1))
    own = own.withColumn("excerpt", F.sum("cx_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(chat, "excerpt").agg(F.min("cx_from").alias("first"), F.max("cx_to").alias("last"), F.count("*").alias("n_candidates"))


def excerpt_texts(messages: DataFrame, spans: DataFrame, chat: str = "chat", seq: str = "seq") -> DataFrame:
    """chat, excerpt and the joined text of its messages.

    Excerpts of a chat don't overlap: each message belongs to the last excerpt that begins at it or before, if that reaches
    so far. One pass over a chat's messages finds it.
    """
    starts = spans.select(chat, F.col("first").alias(seq), F.struct("excerpt", "last").alias("cx"))
    own = F.last("cx", ignorenulls=True).over(W.partitionBy(chat).orderBy(seq))
    inside = messages.join(starts, [chat, seq], "left").withColumn("cx", own).filter(F.col(seq) <= F.col("cx.last")).withColumn("excerpt", F.col("cx.excerpt"))
    line = F.struct(seq, F.concat_ws(" ", "author", F.lit("\n"), "text").alias("t"))
    return inside.groupBy(chat, "excerpt").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda m: m["t"]), "\n").alias("text"))


def flag_large(messages: DataFrame, chat: str = "chat", least: int = 100) -> DataFrame:
    return messages.groupBy(chat).agg(F.count("*").alias("n_messages")).withColumn("large", F.col("n_messages") >= least)


def chat_decision(spans: DataFrame, chats: DataFrame, chat: str = "chat") -> DataFrame:
    """state and rule of each chat: absent without excerpts, keyword if all excerpts have one (column keyword), else kept."""
    per = spans.groupBy(chat).agg(F.count("*").alias("n_excerpts"), F.bool_and("keyword").alias("all_keyword"))
    out = chats.select(chat).distinct().join(per, chat, "left")
    return out.select(
        chat, F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"), F.when(F.col("n_excerpts").isNull() | F.col("all_keyword"), "discarded").otherwise("kept").alias("state"),
        F.when(F.col("n_excerpts").isNull(), "subject_absent").when(F.col("all_keyword"), "keyword").otherwise("files_filter").alias("rule"),
    )

"""First-seen-wins deduplication in its variants. Every order is explicit and total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ids, text
from ..tables import written


def number_repeats(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """occurrence 0 for the first row of each key, 1 for the next, and so on."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def _marked(df: DataFrame, rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: whether rows, which are those of df, hold an earlier one with the same key."""
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    first = rows.filter(has_key).groupBy(*[F.col(k).alias(f"dd_key{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order)).alias("dd_first"))
    first = first.withColumn("dd_at", F.xxhash64(*[f"dd_key{i}" for i in range(len(keys))]))
    left = df.withColumn("dd_own", F.when(has_key, F.xxhash64(*keys)).otherwise(F.xxhash64(F.lit("none"), *order)))
    on = F.col("dd_own") == F.col("dd_at")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"dd_key{i}"))
    later = F.coalesce(F.struct(*order) != F.col("dd_first"), F.lit(False))
    return left.join(first, on, "left").select(*[c for c in df.columns if c != name], later.alias(name))


def mark_duplicates(df: DataFrame, keys: list[str], order: list[str], name: str = "is_duplicate") -> DataFrame:
    """Whether an earlier row has the same key; a key with a null is nobody's duplicate.

    The first of each key comes from an aggregate that is combined before the shuffle, so a hot key's rows never meet
    in one task, and rows without a key are dealt by their order columns. df is written once and read for both sides:
    give it ids, keys and what else the result needs, not whole texts.
    """
    rows = written(df)
    return _marked(rows, rows, keys, order, name)


def mark_mail_duplicates(mails: DataFrame) -> DataFrame:
    """Per request the first of each e-mail hash; later ones, and ones whose message id of over five characters was seen, are duplicates."""
    rows = written(mails)
    out = _marked(rows, rows, ["request", "email_hash"], ["seq"], "same_hash")
    out = _marked(out, rows, ["request", "message_id"], ["seq"], "same_id")
    return out.withColumn("is_duplicate", F.col("same_hash") | (F.col("same_id") & (F.length("message_id") > 5))).drop("same_hash", "same_id")


def content_key(x: Column, least: int = 8) -> Column:
    """Hash of a text's ASCII letters and digits; null under the least length, which never counts as a duplicate."""
    key = ids.letters_digits(x)
    return F.when(F.length(key) >= least, ids.sha(key))


def text_key(x: Column) -> Column:
    return ids.sha(F.lower(x))


def drop_content_duplicates(df: DataFrame, column: str, order: list[str], least: int = 8) -> DataFrame:
    marked = mark_duplicates(df.withColumn("dd_key", content_key(F.col(column), least)), ["dd_key"], order, "dd_dup")
    return marked.filter(F.col("dd_key").isNull() | ~F.col("dd_dup")).drop("dd_key", "dd_dup")


def workbook_key(cells: DataFrame, by: list[str]) -> DataFrame:
    """A hash of each workbook's visible content: sheet, address and normalised text of its cells that are not empty.

    cells (sheet, row, col, value). A cell's text counts in its own sheet and place, so moved cells make another workbook.
    Each row of a sheet is hashed first, so that what meets for one workbook is a hash a row.
    """
    rows = cells.withColumn("v", text.nfkc("value")).filter("v != ''")
    line = rows.groupBy(*by, "sheet", "row").agg(ids.sha(F.to_json(F.sort_array(F.collect_list(F.struct("col", "v"))))).alias("h"))
    return line.groupBy(*by).agg(ids.sha(F.to_json(F.sort_array(F.collect_list(F.struct("sheet", "row", "h"))))).alias("content_key"))


def judge_once(df: DataFrame, key: str, judge) -> DataFrame:
    """judge(one row for each key) gives (key, verdict); every row gets its key's verdict, missing ones review."""
    verdicts = judge(df.dropDuplicates([key]))
    return df.join(verdicts, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("review")))


def new_snapshots(snapshots: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots whose signature is not there yet."""
    return snapshots.join(known.select(*keys).distinct(), keys, "left_anti")

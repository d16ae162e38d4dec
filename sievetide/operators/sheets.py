"""Spreadsheets as cells (sheet, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.subject import cell_matches


def matching_rows(cells: DataFrame, words: list[str], by: list[str], header_row: int = 1) -> DataFrame:
    """The header row and the rows in which a cell contains an identifier."""
    hit = cells.groupBy(*by, "row").agg(F.bool_or(cell_matches(F.col("value"), words)).alias("sh_hit"))
    keep = hit.filter(F.col("sh_hit") | (F.col("row") == header_row)).select(*by, "row")
    return cells.join(keep, [*by, "row"], "left_semi")


def column_pages(widths, limit: int = 140):
    """The page of each column: columns fill a page up to limit units, in order. widths: an array column."""
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("page"), F.expr("CAST(array() AS ARRAY<INT>)").alias("out"))

    def step(acc, w):
        fits = (acc["used"] + w <= limit) | (acc["used"] == 0)
        page = F.when(fits, acc["page"]).otherwise(acc["page"] + 1)
        return F.struct(F.when(fits, acc["used"] + w).otherwise(w).alias("used"), page.alias("page"), F.concat(acc["out"], F.array(page)).alias("out"))

    return F.aggregate(widths, start, step, lambda acc: acc["out"])

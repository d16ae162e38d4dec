"""Gapless numbers, stable over retries, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..tables import written


def number_rows(df: DataFrame, by: list[str], order: list[str], base: Column | int = 0, name: str = "number") -> DataFrame:
    """base + 1, base + 2, ... in each group (by; none: the whole table), in the order of columns that tell its rows apart.

    Sorted ranges of all rows, written once, are numbered each from where the ranges before it leave its groups: however
    large a group is, no task holds more than a range of it.
    """
    rows = written(df.repartitionByRange(*by, *order).withColumn("nb_part", F.spark_partition_id()))
    sizes = rows.groupBy("nb_part", *by).agg(F.count("*").alias("nb_n"))
    before = F.coalesce(F.sum("nb_n").over(W.partitionBy(*by).orderBy("nb_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("nb_part").alias("nb_at"), before.alias("nb_before"), *[F.col(c).alias(f"nb_by{i}") for i, c in enumerate(by)])
    on = F.col("nb_part") == F.col("nb_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"nb_by{i}"))
    own = F.row_number().over(W.partitionBy("nb_part", *by).orderBy(*order))
    number = (F.lit(base) if isinstance(base, int) else base) + F.col("nb_before") + F.col("nb_own")
    out = rows.withColumn("nb_own", own).join(sizes, on).withColumn(name, number)
    return out.select(*[c for c in df.columns if c != name], name)


def number_all(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """1 to n over a whole table."""
    return number_rows(df, [], [order], name=name)


def number_with_ledger(df: DataFrame, ledger: DataFrame, key: str, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """The ledger's number where it has one, else the next ones after its highest, in order."""
    top = ledger.groupBy(*by).agg(F.max("n").alias("nb_top"))
    j = written(df.join(ledger.select(key, F.col("n").alias("nb_n")), key, "left").join(top, by, "left"))
    fresh = number_rows(j.filter("nb_n IS NULL"), by, order, F.coalesce("nb_top", F.lit(0)), name)
    return fresh.unionByName(j.filter("nb_n IS NOT NULL").withColumn(name, F.col("nb_n").cast("long"))).drop("nb_n", "nb_top")


def chunk(df: DataFrame, size: int, by: list[str], order: list[str], name: str = "chunk") -> DataFrame:
    return number_rows(df, by, order, name="nb_number").withColumn(name, F.floor((F.col("nb_number") - 1) / F.lit(size)).cast("int")).drop("nb_number")


def highest(names: Column, prefix: str) -> Column:
    """Aggregate: the highest number in names like 'Email 07.pdf'; 0 without one."""
    return F.coalesce(F.max(F.regexp_extract(names, rf"^{prefix} (\d+)\b", 1).try_cast("int")), F.lit(0))


def padded(n: Column, count: Column, least: int = 2) -> Column:
    return F.lpad(n.cast("string"), F.greatest(F.lit(least), F.length(count.cast("string"))), "0")


def unfinished_name(name: Column, prefix: str = "Document") -> Column:
    return name.rlike(rf"^{prefix} [0-9a-f]{{16}}(\.|$)")


def disambiguated(df: DataFrame, by: list[str], name: str, order: list) -> DataFrame:
    """Repeated names get (2), (3) ... before their ending."""
    k = F.row_number().over(W.partitionBy(*by, name).orderBy(*order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("unique_name", F.when(k > 1, F.concat(stem, F.lit(" ("), k.cast("string"), F.lit(")"), ext)).otherwise(F.col(name)))


def wave_scope(scope: Column, earlier: Column) -> Column:
    """mail and files together are both."""
    return F.when(scope == earlier, scope).when(scope.isNull() | earlier.isNull(), F.coalesce(scope, earlier)).otherwise("both")


def numbering_base(base: Column, wave: Column, top: Column) -> Column:
    return F.coalesce(base, F.when(wave > 1, top).otherwise(F.lit(0)))

"""What the operators share: reading tables, row identity, hash-seeded numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: Words are runs of characters other than the space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, by Spark's own reader, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table to the cluster's shared checkpoint folder and read again, so that a lost executor loses nothing.

    The folder of this application's tables goes when Python exits; without spark.checkpoint.dir only a local master has one.
    """
    return written(df)


def fenced(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names that no operator gives, and the new name of each: whatever docs calls its columns, none clashes."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def key_text(*parts) -> Column:
    """The parts joined by bars; a null counts as the word null."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash_u32(text: Column) -> Column:
    """The first 32 bits of the text's MD5, a number that DuckDB can make too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(text: Column) -> Column:
    """A number strictly between 0 and 1, from 52 bits of the text's MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: Rows of an Arrow batch. Spark's default of 10,000 rows with long texts fills memory in the JVM and in Python.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, as they are made when a result is computed, not when an operator is called."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def sliced(batches, rows: int = 500, n_bytes: int = 1 << 25):
    """Arrow batches in slices of at most so many rows, and of about so many bytes, so that a worker turns few long texts into Python strings at a time."""
    for batch in batches:
        own = max(1, min(rows, n_bytes * batch.num_rows // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, own):
            yield batch.slice(i, own)

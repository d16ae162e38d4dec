"""Operator 3: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fenced, hash_unit, key_text, read_table

#: Rates beyond this are the sum of several Poisson draws with rates of at most this.
PART = 16.0
#: A draw of rate PART exceeds this with a probability far under 2**-52, the step of the seed.
TERMS = 80
#: So many sources at most are broadcast; beyond it the rates are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Copies of a document that one task unfolds.
BLOCK = 1000
SEED = 20261


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, budget: float = 1.0) -> tuple[DataFrame, float]:
    """One row for each source: mix_source and rate, its mean repetition rate; and the highest rate.

    The rate is budget * all bytes * weight / (all weights * the source's bytes), so that a source's expected
    bytes are its share of the budget. An empty text counts as one byte. A null source is a source of its own.
    Up to MAX_BROADCAST_SOURCES sources come as a broadcast table; beyond that they are a written table, so that the join
    with it reads plain shuffles, of which Spark can split a hot source's rows.
    """
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    sums = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).alias("source_bytes"))
    weight: Column = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sums = sums.withColumn("weight", weight)
    few = sums.limit(MAX_BROADCAST_SOURCES + 1).collect()
    small = len(few) <= MAX_BROADCAST_SOURCES
    if small:
        total, weights_sum = sum(r["source_bytes"] for r in few), sum(r["weight"] for r in few)
        sums = docs.sparkSession.createDataFrame(few, sums.schema)
    else:
        total, weights_sum = sums.agg(F.sum("source_bytes"), F.sum("weight")).first()
    rate = F.lit(float(budget)) * F.lit(total or 0) * F.col("weight") / (F.lit(weights_sum or 1.0) * F.col("source_bytes"))
    rates = sums.select("mix_source", rate.alias("rate"))
    rates = rates if small else checkpointed(rates)
    return F.broadcast(rates) if small else rates, rates.agg(F.max("rate")).first()[0] or 0.0


def poisson_count(rate: Column, seed_text: Column) -> Column:
    """Inverse of the Poisson distribution at hash-seeded uniform numbers: how many terms of the distribution function lie below."""
    parts = F.greatest(F.ceil(rate / F.lit(PART)), F.lit(1)).cast("int")

    def one(i: Column) -> Column:
        u, mean = hash_unit(F.concat(seed_text, F.lit("|"), i.cast("string"))), rate / parts
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), u.alias("u"), F.lit(0).alias("n"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * mean / k
            return F.struct(p.alias("p"), (acc["below"] + p).alias("below"), acc["u"].alias("u"), (acc["n"] + F.when(acc["below"] < acc["u"], 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + one(i))).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """Repeats each document by its Poisson count and shuffles all copies.

    Adds copy (1, 2, ...) and shuffle_key to the columns of docs; rows lie in partitions by the key's hash and are
    sorted by it there, so each partition is a random part in random order. The count depends on the seed, the
    doc_id and the text only: rows equal in both get equal counts. Columns of docs named copy or shuffle_key are replaced. Nulls: a null source is a source of its own, a
    null doc_id is hashed as the word null, a null text as an empty one. An empty table gives an empty table. Hash
    seeds make a run repeatable after executors are lost.
    """
    own, name = fenced(docs)
    text = F.col(name["text"])
    rates, most = source_rates(docs.select("text", "source"), weights, default_weight, budget)
    seed_text = key_text(seed, F.col(name["doc_id"]), F.md5(F.coalesce(text, F.lit(""))))
    drawn = own.join(rates, F.col(name["source"]).eqNullSafe(F.col("mix_source"))).withColumn("seed", seed_text).withColumn("n", poisson_count(F.col("rate"), F.col("seed"))).filter("n > 0").drop("rate", "mix_source")
    first, last = F.lit(1), F.col("n")
    if most > BLOCK:
        # Some documents come so often that one task would be long at it: blocks of copies are dealt before they are unfolded.
        drawn = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")))).repartition("seed", "block")
        first, last = F.col("block") * BLOCK + 1, F.least(F.col("n"), (F.col("block") + 1) * BLOCK)
    out = drawn.withColumn("copy", F.explode(F.sequence(first, last))).withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("order"), F.col("seed"), F.col("copy").cast("string"))))
    kept = [F.col(name[c]).alias(c) for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    return out.select(*kept, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed so that every source has the same weight, with a budget of the corpus's own size."""
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def mix_sql(table: str = "documents", seed: int = SEED, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows by DuckDB."""
    return f"""
WITH RECURSIVE d AS (SELECT *, concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, ''))) AS mix_seed FROM {table}),
sums AS (SELECT source AS mix_source, CAST(sum(greatest(strlen(coalesce(text, '')), 1)) AS BIGINT) AS source_bytes FROM {table} GROUP BY source),
rates AS (SELECT mix_source, CAST(1.0 AS DOUBLE) * (SELECT sum(source_bytes) FROM sums) * CAST(1.0 AS DOUBLE) / ((SELECT CAST(count(*) AS DOUBLE) FROM sums) * source_bytes) AS rate FROM sums),
parted AS (SELECT *, CAST(greatest(ceil(rate / {PART}), 1) AS INT) AS parts FROM rates),
cdf AS (
  SELECT mix_source, 1 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS below, rate / parts AS mean FROM parted
  UNION ALL SELECT mix_source, k + 1, p * mean / k, below + p * mean / k, mean FROM cdf WHERE k < {TERMS}),
drawn AS (SELECT mix_seed, d.source, i.i, (CAST('0x' || substr(md5(mix_seed || '|' || i.i), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM (SELECT DISTINCT mix_seed, source FROM d) d JOIN parted p ON d.source IS NOT DISTINCT FROM p.mix_source, range(1, p.parts + 1) i(i)),
counts AS (SELECT mix_seed, source, count(*) FILTER (below < u) AS n FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.mix_source GROUP BY mix_seed, source)
SELECT {columns}, CAST(c.c AS INT) AS copy, md5(concat_ws('|', 'order', mix_seed, CAST(c.c AS VARCHAR))) AS shuffle_key
FROM (SELECT d.*, n FROM d JOIN counts ON d.mix_seed = counts.mix_seed AND d.source IS NOT DISTINCT FROM counts.source) x, range(1, n + 1) c(c)
"""

"""Operator 8: packing into optimal length buckets, with token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fenced, hash_u32, key_text, read_table

#: Lengths up to this have histogram cells of their own; beyond it a cell keeps the leading EXACT_BITS bits.
EXACT_BITS = 12
N_BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows in a shard, in which batches form: a window never holds many more rows than this.
SHARD_ROWS = 20_000
SEED = 8261


def token_estimate(text: Column) -> Column:
    """A token for each four bytes of UTF-8, rounded up; one at least, also for a null or empty text."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4.0)), F.lit(1)).cast("long")


def length_cell(n: Column) -> Column:
    """The upper end of a length's histogram cell. At most 2**12 * 52 cells exist, whatever the corpus."""
    step = F.greatest(F.floor(F.log2(n.cast("double"))) - F.lit(EXACT_BITS - 1), F.lit(0)).cast("int")
    width = F.pow(F.lit(2.0), step).cast("long")
    return (F.ceil(n / width) * width).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, k: int) -> list[int]:
    """Upper bucket ends that minimise padding, by dynamic programming over the histogram.

    lengths: each cell's longest length, ascending. The padding of one bucket over cells i+1..j,
    lengths[j] * rows - tokens, is Monge, so the leftmost best split moves right with j: each of the k rounds
    settles the middle of every open range, O(D log D) altogether. Of equal splits the leftmost counts.
    """
    d, k = len(lengths), min(k, len(lengths))
    if not d:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)
    ends = np.concatenate([[0], lengths]).astype(np.int64)
    cost = lambda i, j: ends[j] * (n[j] - n[i]) - (s[j] - s[i])
    best = cost(np.zeros(d + 1, np.int64), np.arange(d + 1))
    splits = []
    for used in range(2, k + 1):
        now, split = np.full(d + 1, np.iinfo(np.int64).max // 2), np.zeros(d + 1, np.int64)
        ranges = [(used, d, used - 1, d - 1)]
        while ranges:
            r = np.array(ranges, np.int64)
            mid = (r[:, 0] + r[:, 1]) // 2
            first, last = r[:, 2], np.minimum(r[:, 3], mid - 1)
            width = last - first + 1
            start = np.concatenate([[0], np.cumsum(width)[:-1]])
            i = np.arange(width.sum()) - np.repeat(start - first, width)
            total = best[i] + cost(i, np.repeat(mid, width))
            low = np.minimum.reduceat(total, start)
            at = np.flatnonzero(total == np.repeat(low, width))
            owner = np.searchsorted(start, at, side="right") - 1
            leftmost = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            now[mid], split[mid] = low, i[leftmost]
            ranges = [(a, m - 1, b, o) for a, m, b, o in zip(r[:, 0], mid, r[:, 2], i[leftmost], strict=True) if a <= m - 1] + [(m + 1, z, o, e) for m, z, o, e in zip(mid, r[:, 1], i[leftmost], r[:, 3], strict=True) if m + 1 <= z]
        best = now
        splits.append(split)
    j, out = d, [int(lengths[d - 1])]
    for split in reversed(splits):
        j = int(split[j])
        out.append(int(ends[j]))
    return sorted(out)


def pack(docs: DataFrame, length: str | None = None, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """Adds n_tokens, bucket, bucket_len, shard, batch and slot to the columns of docs.

    A bucket holds the lengths up to bucket_len and above the bucket before. Its rows are dealt by hash into
    shards of about shard_rows, so no task ever holds a bucket; in a shard they are numbered in hash order and cut
    into batches of max(1, token_budget // bucket_len) rows, each padded to bucket_len. A document longer than the
    budget is a batch of its own: nothing is cut or dropped. Only the histogram comes to the driver, at most 213k
    cells for any corpus. length: the column of token counts, at least 1 each; without one, a quarter of the bytes. Null
    and empty texts have length 1; a null doc_id is dealt by its text. Rows equal in doc_id and text share a shard and
    stand beside each other. An empty table gives an empty table. Columns of docs with the names of new ones are replaced.
    """
    own, name = fenced(docs)
    text, doc_id = F.col(name["text"]), F.col(name["doc_id"])
    rows = own.withColumn("n_tokens", token_estimate(text) if length is None else F.greatest(F.col(name[length]), F.lit(1)).cast("long"))
    cells = rows.groupBy(length_cell(F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()
    cells.sort(key=lambda r: r["cell"])
    lengths, counts, sums = (np.array([r[c] for r in cells], np.int64) for c in ("longest", "n", "tokens"))
    ends = optimal_boundaries(lengths, counts, sums, n_buckets)
    of = np.searchsorted(np.array(ends, np.int64), lengths) if ends else np.zeros(0, np.int64)
    shards = [max(1, -(-int(counts[of == b].sum()) // shard_rows)) for b in range(len(ends))] or [1]
    ends = ends or [1]

    def by_bucket(values: list[int], kind: str) -> Column:
        out = F.lit(values[-1])
        for end, value in reversed(list(zip(ends[:-1], values[:-1], strict=True))):
            out = F.when(F.col("n_tokens") <= end, value).otherwise(out)
        return out.cast(kind)

    key = key_text(seed, doc_id, F.md5(F.coalesce(text, F.lit(""))))
    order = W.partitionBy("bucket", "shard").orderBy("key", doc_id.asc_nulls_first())
    new = ["n_tokens", "bucket", "bucket_len", "shard", "batch", "slot"]
    out = (
        rows.withColumn("bucket", by_bucket(list(range(1, len(ends) + 1)), "int"))
        .withColumn("bucket_len", by_bucket(ends, "long"))
        .withColumn("key", F.md5(key))
        .withColumn("shard", (hash_u32(key) % by_bucket(shards, "long")).cast("int"))
        .withColumn("row", F.row_number().over(order) - 1)
        .withColumn("cap", F.greatest(F.floor(F.lit(token_budget) / F.col("bucket_len")), F.lit(1)).cast("long"))
        .withColumn("batch", F.floor(F.col("row") / F.col("cap")).cast("long"))
        .withColumn("slot", (F.col("row") % F.col("cap")).cast("int"))
    )
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns if c.lower() not in new], *new)


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot, with the padding it brings."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs).select("doc_id", "source", "n_tokens", "bucket", "bucket_len", "shard", "batch", "slot", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def pack_sql(table: str = "documents", columns: str = "doc_id, source") -> str:
    """The same rows by DuckDB: the dynamic programme as one CTE for each number of buckets."""
    rounds = "".join(
        f""",
b{k} AS (SELECT j, min(cost) AS cost, arg_min(i, (cost, i)) AS split FROM (
  SELECT c.j, p.j AS i, p.cost + c.longest * (c.n - q.n) - (c.s - q.s) AS cost FROM b{k - 1} p JOIN cum q ON q.j = p.j JOIN cum c ON c.j > p.j) GROUP BY j)"""
        for k in range(2, N_BUCKETS + 1)
    )
    chain = "".join(f", e{k - 1} AS (SELECT split AS j FROM b{k} JOIN e{k} USING (j))" for k in range(N_BUCKETS, 1, -1))
    ends = " UNION ALL ".join(f"SELECT j FROM e{k}" for k in range(1, N_BUCKETS + 1))
    key = f"concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))"
    return f"""
WITH t AS (SELECT *, CAST(greatest(ceil(strlen(coalesce(text, '')) / 4.0), 1) AS BIGINT) AS n_tokens, {key} AS k FROM {table}),
celled AS (SELECT n_tokens, CAST(ceil(n_tokens / w) * w AS BIGINT) AS cell FROM (SELECT n_tokens, CAST(pow(2, greatest(floor(log2(n_tokens)) - {EXACT_BITS - 1}, 0)) AS BIGINT) AS w FROM t)),
cells AS (SELECT cell, max(n_tokens) AS longest, count(*) AS n, sum(n_tokens) AS s FROM celled GROUP BY cell),
cum AS (SELECT row_number() OVER (ORDER BY cell) AS j, longest, CAST(sum(n) OVER (ORDER BY cell) AS HUGEINT) AS n, CAST(sum(s) OVER (ORDER BY cell) AS HUGEINT) AS s FROM cells),
b1 AS (SELECT j, longest * n - s AS cost FROM cum){rounds},
e{N_BUCKETS} AS (SELECT max(j) AS j FROM cum){chain},
ends AS (SELECT row_number() OVER (ORDER BY j) AS bucket, longest AS bucket_len FROM cum WHERE j IN ({ends})),
placed AS (SELECT t.*, (SELECT min(bucket) FROM ends WHERE bucket_len >= n_tokens) AS bucket FROM t),
sized AS (SELECT bucket, greatest(CAST(ceil(count(*) / {float(SHARD_ROWS)}) AS BIGINT), 1) AS shards FROM placed GROUP BY bucket),
dealt AS (SELECT placed.*, ends.bucket_len, CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % shards AS shard, greatest({TOKEN_BUDGET} // ends.bucket_len, 1) AS cap FROM placed JOIN ends USING (bucket) JOIN sized USING (bucket)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY md5(k), doc_id NULLS FIRST) - 1 AS r FROM dealt)
SELECT {columns}, n_tokens, CAST(bucket AS INT) AS bucket, bucket_len, CAST(shard AS INT) AS shard, CAST(r // cap AS BIGINT) AS batch, CAST(r % cap AS INT) AS slot, bucket_len - n_tokens AS padding FROM numbered
"""

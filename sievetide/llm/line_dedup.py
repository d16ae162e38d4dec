"""Operator 10: line dedup by winnowing over line hashes.

A window is the shortest run of a document's lines with at least MIN_WORDS words that begins, or ends, at a line; lines
without a word stand outside. Each window's fingerprint is its least line hash (the first of equal ones). Two runs
of equal lines with MIN_WORDS words hold a window in common and so a fingerprint: only windows whose fingerprint
occurs at two positions can repeat. Their positions are joined by the hash of the window's lines. Windows that begin at
the lines of a match, and those that end at them, extend it both ways until the lines differ: together they
cover exactly the lines that stand in a run of MIN_WORDS words or more which occurs earlier, in any document.

Lines and windows are told apart by 128 bits of hashes with their words and characters. All of it is DataFrame operations.
Every join has at most one row for each key on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, checkpointed, fenced, read_table

MIN_WORDS = 50


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with ld_text, ld_hash and doc_id."""
    return docs.withColumn("ld_text", F.coalesce(F.col(text), F.lit(""))).withColumn("ld_hash", F.xxhash64("ld_text")).withColumn("doc_id", F.col(doc_id))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, ld_hash, pos, h, nw, nc: the lines with a word, once for each different document, partitioned by document."""
    lines = docs.select("doc_id", "ld_hash", F.posexplode(F.split("ld_text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("nw", F.regexp_count("line", F.lit(WORD))).filter("nw > 0")
    lines = lines.select("doc_id", "ld_hash", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"), "nw", F.length("line").alias("nc")).repartition("doc_id", "ld_hash")
    return lines.groupBy("doc_id", "ld_hash", "pos").agg(F.first("h").alias("h"), F.first("h2").alias("h2"), F.first("nw").alias("nw"), F.first("nc").alias("nc"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, ld_hash, first, last, key, print_hash, print_pos: two rows a line at most."""
    by = W.partitionBy("doc_id", "ld_hash")
    upto = F.sum("nw").over(by.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto.cast("long")).withColumn("before", F.col("upto") - F.col("nw"))

    def window(frame, name: str) -> Column:
        return F.struct(
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.sum("nw").over(frame).alias("words"),
            F.struct(F.xxhash64(F.collect_list("h").over(frame)).alias("h"), F.xxhash64(F.lit(7), F.collect_list("h2").over(frame)).alias("h2"), F.sum("nw").over(frame).alias("nw"), F.sum("nc").over(frame).alias("nc")).alias("key"),
            F.min(F.struct("h", "pos")).over(frame).alias("print"),
        ).alias(name)

    forward = by.orderBy("before").rangeBetween(0, min_words - 1)
    backward = by.orderBy("upto").rangeBetween(1 - min_words, 0)
    both = lines.select("doc_id", "ld_hash", window(forward, "f"), window(backward, "b"))
    both = both.select("doc_id", "ld_hash", F.explode(F.array("f", "b")).alias("w")).filter(F.col("w.words") >= min_words)
    return both.select("doc_id", "ld_hash", "w.first", "w.last", "w.key", F.col("w.print.h").alias("print_hash"), F.col("w.print.pos").alias("print_pos"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, ld_hash, first, last: the maximal runs of lines to delete, of docs with the columns of _keyed."""
    windows = checkpointed(_windows(_lines(docs), min_words))
    place = F.struct("doc_id", "ld_hash", "print_pos")
    # Both sides of a join are written, so that it reads plain shuffles, of which Spark can split a very common print's or window's rows.
    prints = checkpointed(windows.groupBy("print_hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("print_hash"))
    met = checkpointed(windows.join(prints, "print_hash", "left_semi").select("doc_id", "ld_hash", "first", "last", "key"))
    begins = F.struct("doc_id", "ld_hash", "first")
    earliest = checkpointed(met.groupBy("key").agg(F.min(begins).alias("at"), F.max(begins).alias("to")).filter("at != to").select("key", "at"))
    later = met.join(earliest, "key").filter(F.col("at") < begins)
    order = W.partitionBy("doc_id", "ld_hash").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = later.select("doc_id", "ld_hash", "first", "last").withColumn("starts", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "ld_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without later repeated runs, and n_lines and n_deleted (replaced if docs has them).

    A line goes if it stands in a run of lines of one document, min_words words or more, that occurs as a run at an
    earlier place. Places are ordered by doc_id (null first), text hash and line. Lines without a word never part a
    run; those inside a deleted run go with it. Rows equal in doc_id and text are one document and get equal
    results. A null or empty text has nothing to delete and stays as it is; a document may end up empty. An empty
    table gives an empty table.
    """
    own, name = fenced(docs)
    keyed = _keyed(own, name["text"], name["doc_id"])
    runs = repeated_runs(keyed.select("doc_id", "ld_hash", "ld_text"), min_words)
    runs = runs.groupBy(F.col("doc_id").alias("ld_id"), F.col("ld_hash").alias("ld_other")).agg(F.collect_list(F.struct("first", "last")).alias("ld_runs"))
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("ld_id")) & (F.col("ld_hash") == F.col("ld_other")), "left")
    lines = F.split("ld_text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("ld_runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    out = joined.withColumn("ld_kept", F.when(F.col("ld_runs").isNotNull(), kept)).withColumn("n_lines", F.size(lines))
    text = F.when(F.col("ld_kept").isNull(), F.col(name["text"])).otherwise(F.array_join("ld_kept", "\n"))
    return out.select(
        *[(text if c == "text" else F.col(name[c])).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")],
        "n_lines", F.when(F.col("ld_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("ld_kept")).cast("int").alias("n_deleted"),
    )


def op10_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines."""
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def dedup_sql(table: str = "documents", columns: str = "doc_id, lang, source") -> str:
    """The same rows by DuckDB, from the lines themselves, without hashes of lines or fingerprints."""
    return f"""
WITH d AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS nw FROM l),
s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM w WHERE nw > 0),
f AS (SELECT doc_id, min(pos) OVER x AS first, max(pos) OVER x AS last, sum(nw) OVER x AS words, md5(array_to_string(list(line) OVER x, chr(10))) AS k
  FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY upto - nw RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
b AS (SELECT doc_id, min(pos) OVER x AS first, max(pos) OVER x AS last, sum(nw) OVER x AS words, md5(array_to_string(list(line) OVER x, chr(10))) AS k
  FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
a AS (SELECT * FROM (SELECT * FROM f UNION SELECT * FROM b) WHERE words >= {MIN_WORDS}),
later AS (SELECT doc_id, first, last FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY doc_id, first) AS r FROM a) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN later ON l.doc_id = later.doc_id AND l.pos BETWEEN later.first AND later.last),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, CAST(count(*) AS INT) AS n_lines, CAST(count(gone.pos) AS INT) AS n_deleted
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT {columns}, coalesce(kept.text, '') AS text, n_lines, n_deleted FROM {table} JOIN kept USING (doc_id)
""".replace(f"{columns}, coalesce", ", ".join(f"{table}.{c.strip()}" for c in columns.split(",")) + ", coalesce")

"""Scans of folders and logs by Spark's readers, so any store they know will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, size, mtime of all files below root; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root).select("path", "content")


def mail_archives(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, "*.{pst,PST}")


def visible(path: Column) -> Column:
    """Neither hidden nor JSON."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~name.startswith(".") & ~F.lower(name).endswith(".json")


def in_files_folder(path: Column) -> Column:
    """The outermost folder named files, in any case, that a path lies in; null without one."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*?/files)/", 1), F.lit(""))


def folder_summary(listing: DataFrame) -> DataFrame:
    folder = in_files_folder(F.col("path"))
    return listing.filter(visible(F.col("path"))).withColumn("folder", folder).filter("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def requests_found(listing: DataFrame, depth: int = 0) -> DataFrame:
    """Case and request folders with what they hold: counts of archives and files, and the scope that follows. depth: folders before the case."""
    p = F.split("path", "/")
    kind = F.lower(F.get(p, F.lit(depth + 2)))
    rows = listing.withColumn("case", F.get(p, F.lit(depth))).withColumn("request", F.get(p, F.lit(depth + 1))).withColumn("kind", kind).filter("kind IN ('pst', 'files')")
    out = rows.groupBy("case", "request").agg(F.count_if(F.col("kind") == "pst").alias("archives"), F.count_if(F.col("kind") == "files").alias("files"))
    return out.withColumn("scope", F.when((F.col("archives") > 0) & (F.col("files") > 0), "both").when(F.col("archives") > 0, "mail").otherwise("files"))


def inside(path: Column, root: Column) -> Column:
    clean = lambda x: F.rtrim(F.regexp_replace(x, r"/+", "/"), F.lit("/"))
    return F.startswith(clean(path), F.concat(clean(root), F.lit("/")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that was cut short is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A render ledger: h, n, skip."""
    return json_lines(spark, path, "h STRING, n BIGINT, skip BOOLEAN").filter("h IS NOT NULL")


def judge_output(spark: SparkSession, path: str) -> DataFrame:
    """id and raw answer of a judge's output lines."""
    schema = "custom_id STRING, response STRUCT<body: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>"
    out = json_lines(spark, path, schema).filter("custom_id IS NOT NULL")
    return out.select(F.col("custom_id").alias("id"), F.get("response.body.choices", F.lit(0))["message"]["content"].alias("raw"))

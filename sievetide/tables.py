"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir; it goes when Python exits.

    Where the setting is missing, a local master gets a temporary folder; on a cluster that is an error, as other machines
    would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/sievetide-tables"
    own = f"{root}/tables-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_delete, spark, own)
    return own


def written(df: DataFrame) -> DataFrame:
    """df written as a table and read again: computed once however often it is used, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

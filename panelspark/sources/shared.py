"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that `written` has made, by application.
WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a new one of our own if driver and executors are
    one machine, as in tests; on a cluster that is an error, since executors would not see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what several branches of a plan use is computed once, and a lost
    executor costs a read of it. The table stays until `clear` is called."""
    session = df.sparkSession
    path = f"{shared_folder(session)}/panelspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.setdefault(session.sparkContext.applicationId, []).append(path)
    return session.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that `written` has made in this application, and say how many: call it when no frame that reads
    them is needed any more."""
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)

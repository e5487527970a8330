"""Tables that a query writes for itself: computed once, read by several legs, and of a size that Spark knows.

A join with such a table is broadcast or shuffled by Spark's own threshold on its bytes, without a job that counts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder.  Where none is named, a single machine takes the warehouse, and a
    cluster, whose executors need not see that, gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def fresh_folder(spark: SparkSession, label: str) -> str:
    return until_exit(spark, f"{shared_folder(spark)}/sparkloom-{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read back; a lost executor costs a reread."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

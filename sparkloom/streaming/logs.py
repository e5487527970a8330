"""A request log as a stream: JSON by date and model, and the latest request of each model.

Each micro-batch has folders of its own, which are written over when it is played again.  The latest requests of a batch are those of the batch before it
and its own, so that a batch reads what one other wrote, whatever the length of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.operators import serving as R


def dated(requests: DataFrame, model: str = "model", ts: str = "ts") -> DataFrame:
    """Requests with the folders that they go to: the day, and the model's name as a file's; no name and no time have folders too."""
    day = F.coalesce(F.date_format(F.col(ts), "yyyy-MM-dd"), F.lit("none"))
    return requests.withColumns({"log_date": day, "log_model": X.file_name(F.col(model))})


def write_log(path: str, order: tuple[str, ...] = ("ts", "event_id"), key: str = "model"):
    """For ``foreachBatch``."""

    def write(rows: DataFrame, batch: int) -> None:
        dated(rows, key).write.mode("overwrite").partitionBy("log_date", "log_model").json(f"{path}/requests/batch={batch}")
        before = _latest(rows.sparkSession, path, rows.schema, batch)
        both = rows if before is None else rows.unionByName(before)
        R.latest(both, key, list(order)).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/latest/batch={batch}")

    return write


def _latest(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame | None:
    """What the last batch (before ``below``) left; None where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/latest")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return None
    found = [int(f.getPath().getName().partition("=")[2]) for f in store.listStatus(folder) if store.exists(f.getPath().suffix("/_SUCCESS"))]
    found = [n for n in found if below is None or n < below]
    return spark.read.schema(schema).parquet(f"{path}/latest/batch={max(found)}") if found else None


def latest_requests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest request of each model so far."""
    found = _latest(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def logged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole log; days and models that aren't asked for aren't read."""
    folders = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("log_date", T.StringType()), T.StructField("log_model", T.StringType())])
    return spark.read.schema(folders).json(f"{path}/requests")

"""The request log: days and models as folders, a crash between write and commit, the latest of each model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import serving as R
from sparkloom.plans import service
from sparkloom.streaming import logs as L
from tests.oracle import DATA


def test_log_survives_a_crash(spark, tmp_path):
    requests = service.requests(spark, DATA).withColumn("model", F.when(F.col("event_id") % 9 != 0, F.concat(F.col("model"), F.lit("/v:1"))))
    schema, path = requests.schema, str(tmp_path / "log")
    for rest in range(3):
        requests.filter(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plain, crashed = L.write_log(path), []

    def write(rows, batch):
        plain(rows, batch)
        if batch == 1 and not crashed:
            crashed.append(batch)
            raise RuntimeError("lost")

    def started():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    assert L.latest_requests(spark, path, schema).count() == 0
    with pytest.raises(Exception, match="lost"):
        started().awaitTermination(120)
    assert started().awaitTermination(120) and crashed
    log = L.logged(spark, path, schema)
    assert log.count() == requests.count() == log.select("event_id").distinct().count()
    assert {r[0] for r in log.filter("model IS NULL").select("log_model").distinct().collect()} == {"default"}
    assert all("/" not in r[0] and ":" not in r[0] for r in log.select("log_model").distinct().collect())
    one = log.filter("log_date = '2024-01-02' AND log_model = 'view_v_1'")
    assert one.count() == requests.filter("to_date(ts) = '2024-01-02' AND model = 'view/v:1'").count()
    want = R.latest(requests, "model", ["ts", "event_id"])
    assert {(r.model, r.event_id) for r in L.latest_requests(spark, path, schema).collect()} == {(r.model, r.event_id) for r in want.collect()}

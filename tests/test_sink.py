"""The event sink: shuffled files, a crash between write and commit, repeated and late deltas, silent requests."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import sink as K
from sparkloom.streaming import split as Z

SCHEMA = "req_id long, seq long, delta string, last boolean"


@pytest.fixture(autouse=True)
def batches_end(spark):
    """With timers, batches without data go on for ever, so that an ``availableNow`` query would not end."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("req_id", "seq", "event", "payload").collect())


def started(spark, tmp_path, silence_ms, write):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    events = K.event_stream(stream, "blocks", silence_ms)
    return events.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()


def test_events_survive_a_crash_and_any_order(spark, tmp_path):
    """Deltas in shuffled files, some twice; the second batch is written and lost, and the query started again."""
    texts = {1: "<think>\nplan a</think>\n\nanswer “a”", 2: "no thought", 3: "<think>never closed", 4: "x"}
    rows = []
    for r, text in texts.items():
        pieces = [text[i : i + 3] for i in range(0, len(text), 3)]
        rows += [(r, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    shuffled = rows + rows[:5]
    random.Random(6).shuffle(shuffled)
    for i in range(8):
        spark.createDataFrame(shuffled[i::8], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plain, crashed = K.write_once(str(tmp_path / "out")), []

    def write(df, batch):
        plain(df, batch)
        if batch == 1 and not crashed:
            crashed.append(batch)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        started(spark, tmp_path, 600_000, write).awaitTermination(120)
    assert started(spark, tmp_path, 600_000, write).awaitTermination(120)
    want = Z.event_rows(Z.split_batch(spark.createDataFrame(rows, SCHEMA).select("req_id", "seq", "delta")), "blocks")
    assert crashed and rows_of(K.written_events(spark, str(tmp_path / "out"))) == rows_of(want)


def test_silent_requests_are_closed(spark, tmp_path):
    """A request with a gap that never says ``last``: a timer plays what waits and ends it; what comes after that is ignored."""
    write = K.write_once(str(tmp_path / "out"))
    batches = [[(1, 0, "one ", False), (1, 2, "three", False)], [(2, 0, "x", True)], [(1, 1, "two ", False), (3, 0, "y", True)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert started(spark, tmp_path, 500, write).awaitTermination(120)
        time.sleep(1)
    got = K.written_events(spark, str(tmp_path / "out")).filter("req_id = 1").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got))) and got[-1].event == "message_stop"
    said = "".join(json.loads(r.payload)["text"] for r in got[1:-1])
    assert said == "one three"
    assert K.written_events(spark, str(tmp_path / "out")).filter("req_id IN (2, 3)").filter(F.col("event") == "message_stop").count() == 2

"""A server's events as a stream: deltas in any order become numbered events, each written once.

Deltas wait in a map by seq until all before them have come; repeated ones are ignored.  A request that says nothing for ``silence_ms`` is closed by a
timer, with what waits behind a gap played in order.  A closed request is remembered for ``memory_ms``, so that deltas that come again open no new one.
Rows of a micro-batch go to a folder of its own that is written over when the batch is played again.

Timers keep micro-batches without data going, so that silent requests end; a query that is to stop at the end of its input (``availableNow``) needs
``spark.sql.streaming.noDataMicroBatches.enabled`` off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming import split as Z

OUT = "req_id long, seq long, kind string, field string, text string"
EVENTS = "req_id long, seq long, event string, payload string"


class EventProcessor(StatefulProcessor):
    """(req_id, seq, delta, last) to numbered rows: ``first``, one ``delta`` a piece, ``last``."""

    def __init__(self, silence_ms: int = 300_000, memory_ms: int = 3_600_000):
        self.silence_ms, self.memory_ms = silence_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, told long, phase string, held string")
        self.waiting = handle.getMapState("waiting", "seq long", "delta string, last boolean")
        self.closed = handle.getValueState("closed", "yes boolean", self.memory_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            for _ in rows:
                pass
            return
        place = self.at.get()[0] if self.at.exists() else 0
        for part in rows:
            for seq, delta, last in zip(part["seq"], part["delta"], part["last"], strict=True):
                if seq >= place and not self.waiting.containsKey((int(seq),)):
                    self.waiting.updateValue((int(seq),), (delta, bool(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield from self._played(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            yield from self._played(key, True)

    def _played(self, key, closing: bool) -> Iterator[pd.DataFrame]:
        """All deltas that are next; when closing, the ones behind gaps too."""
        place, told, phase, held = self.at.get() if self.at.exists() else (0, 0, None, None)
        splitter, out, ended = Z.Thinking() if phase is None else Z.Thinking(phase, held), [], False
        if not told:
            out.append((0, "first", None, None))
            told = 1

        def tell(pieces) -> None:
            nonlocal told
            for field, text in sorted(pieces, key=lambda p: p[0] != "reasoning"):
                out.append((told, "delta", field, text))
                told += 1

        ahead = sorted(k[0] for k in self.waiting.keys()) if closing else None  # noqa: SIM118  a state, not a dict
        while not ended:
            if closing:
                if not ahead:
                    break
                place = ahead.pop(0)
            elif not self.waiting.containsKey((place,)):
                break
            delta, last = self.waiting.getValue((place,))
            self.waiting.removeKey((place,))
            tell(_merged(splitter.feed(delta or "")))
            place, ended = place + 1, last
        if ended or closing:
            tell(_merged(splitter.flush()))
            out.append((told, "last", None, str(told - 1)))
            self.at.clear()
            self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.closed.update((True,))
        else:
            self.at.update((place, told, splitter.phase, splitter.held))
        texts = lambda k: pd.Series([r[k] for r in out], dtype=object)  # noqa: E731  plain strings, for Arrow
        yield pd.DataFrame({"req_id": [key[0]] * len(out), "seq": [r[0] for r in out], "kind": texts(1), "field": texts(2), "text": texts(3)})

    def close(self) -> None:
        pass


def _merged(pieces) -> list[tuple[str, str]]:
    """One piece a field of what a delta gave."""
    said: dict[str, str] = {}
    for field, text in pieces:
        said[field] = said.get(field, "") + text
    return [(f, t) for f, t in said.items() if t]


def event_stream(deltas: DataFrame, framing: str, silence_ms: int = 300_000, memory_ms: int = 3_600_000) -> DataFrame:
    """A streaming frame (req_id, seq, delta, last) to req_id, seq, event, payload, as ``split.event_rows`` tells whole streams."""
    first, middle, last = Z.FRAMINGS[framing]
    rows = deltas.groupBy("req_id").transformWithStateInPandas(EventProcessor(silence_ms, memory_ms), OUT, "Update", "ProcessingTime")
    event = F.when(F.col("kind") == "first", first).when(F.col("kind") == "last", last).otherwise(middle)
    payload = (
        F.when(F.col("kind") == "first", F.to_json(F.struct(F.lit("assistant").alias("role"))))
        .when(F.col("kind") == "last", F.to_json(F.struct(F.col("text").cast("long").alias("deltas"))))
        .otherwise(F.to_json(F.struct("field", "text")))
    )
    return rows.select("req_id", "seq", event.alias("event"), payload.alias("payload"))


def write_once(path: str):
    """For ``foreachBatch``: a batch's rows in a folder of its own, which a batch that is played again writes over."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def written_events(spark, path: str) -> DataFrame:
    """The events that are there so far."""
    return spark.read.schema(f"{EVENTS}, batch long").parquet(path).drop("batch")

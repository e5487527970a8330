"""Keyed text splitting over ordered deltas: thinking tags and stop words, in batches and in streams.

Each request's deltas are one sequence by ``seq``.  The state between two deltas is a phase and the characters held back, so
a delta costs its own length; the same step function serves ``applyInPandas`` and ``transformWithStateInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OPEN, CLOSE = "<think>", "</think>"
OUT = "req_id long, seq long, field string, text string"


def think_step(phase: str, text: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(phase, held, emitted) after the characters ``text``, which begin with what was held before.

    A request is ``new`` until it is known whether it opens with a tag, then ``thought`` up to the closing tag, and ``answer``
    afterwards; in ``bare`` the answer has not begun, so that line feeds are still dropped.  A thought keeps back a tag's length,
    which a tag that is cut in two can't exceed."""
    emitted: list[tuple[str, str]] = []
    while text:
        if phase == "new":
            if OPEN.startswith(text) and text != OPEN:
                break
            opened = text.startswith(OPEN)
            phase, text = ("thought", text[len(OPEN) :]) if opened else ("bare" if len(text) < len(OPEN) else "answer", text)
        elif phase == "thought":
            shut = text.find(CLOSE)
            cut = max(0, len(text) - len(CLOSE)) if shut < 0 else shut
            emitted += [("reasoning", text[:cut])] if cut else []
            text = text[cut:]
            if shut < 0:
                break
            phase, text = "bare", text[len(CLOSE) :]
        else:
            shown = text if phase == "answer" else text.lstrip("\n")
            emitted += [("content", shown)] if shown else []
            phase, text = "answer" if shown else phase, ""
    return phase, text, emitted


@dataclass
class Thinking:
    """One request's place in ``think_step``."""

    phase: str = "new"
    held: str = ""

    def feed(self, delta: str) -> list[tuple[str, str]]:
        self.phase, self.held, emitted = think_step(self.phase, self.held + delta)
        return emitted

    def flush(self) -> list[tuple[str, str]]:
        rest, self.held = self.held, ""
        return [("reasoning" if self.phase == "thought" else "content", rest)] if rest else []


@dataclass
class Stops:
    """Passes text on until a stop word; one character less than the longest is held back."""

    words: tuple[str, ...] = ()
    held: str = ""
    done: bool = False

    def feed(self, delta: str) -> list[tuple[str, str]]:
        if self.done or not delta:
            return []
        text, keep = self.held + delta, max(map(len, self.words), default=1) - 1
        at = min((i for i in map(text.find, self.words) if i >= 0), default=-1)
        if at >= 0:
            self.done, self.held, text = True, "", text[:at]
        else:
            self.held, text = text[len(text) - min(keep, len(text)) :], text[: len(text) - min(keep, len(text))]
        return [("content", text)] if text else []

    def flush(self) -> list[tuple[str, str]]:
        text, self.held = self.held, ""
        return [("content", text)] if text else []


def _rows(splitter, deltas: pd.DataFrame, last: bool) -> Iterator[tuple]:
    seq = -1
    for seq, delta in zip(deltas["seq"], deltas["delta"], strict=True):
        for field, text in splitter.feed(delta or ""):
            yield seq, field, text
    if last:
        for field, text in splitter.flush():
            yield seq + 1, field, text


def _framed(req_id: int, rows: list[tuple]) -> pd.DataFrame:
    texts = lambda k: pd.Series([r[k] for r in rows], dtype=object)  # noqa: E731  plain strings, for Arrow
    return pd.DataFrame({"req_id": [req_id] * len(rows), "seq": [r[0] for r in rows], "field": texts(1), "text": texts(2)})


def split_batch(deltas: DataFrame, make=Thinking) -> DataFrame:
    """req_id, seq, field, text for whole streams (req_id, seq, delta); what is held at the end comes one past the last seq."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(_rows(make(), pdf.sort_values("seq"), True))
        return _framed(pdf["req_id"].iloc[0], rows)

    return deltas.groupBy("req_id").applyInPandas(work, OUT)


class SplitProcessor(StatefulProcessor):
    """A splitter as a keyed streaming operator; deltas arrive by seq, and ``last`` marks a request's end.

    A splitter's kind gives ``state_schema``, ``begin`` from what was kept, and ``state_of`` what is to be kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("split", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        splitter = self.begin(self.state.get() if self.state.exists() else None)
        deltas = pd.concat(list(rows)).sort_values("seq")
        ended = bool(deltas["last"].any())
        made = list(_rows(splitter, deltas, ended))
        if ended:
            self.state.clear()
        else:
            self.state.update(self.state_of(splitter))
        yield _framed(key[0], made)

    def close(self) -> None:
        pass


class ThinkingProcessor(SplitProcessor):
    state_schema = "phase string, held string"

    def begin(self, now):
        return Thinking(*now) if now else Thinking()

    def state_of(self, splitter) -> tuple:
        return splitter.phase, splitter.held


class StopProcessor(SplitProcessor):
    state_schema = "held string, done boolean"

    def __init__(self, words: tuple[str, ...]):
        self.words = words

    def begin(self, now):
        return Stops(self.words, *now) if now else Stops(self.words)

    def state_of(self, splitter) -> tuple:
        return splitter.held, splitter.done


def split_stream(deltas: DataFrame, processor: SplitProcessor | None = None) -> DataFrame:
    """A streaming frame (req_id, seq, delta, last) to req_id, seq, field, text."""
    return deltas.groupBy("req_id").transformWithStateInPandas(processor or ThinkingProcessor(), OUT, "Update", "None")


def stop_stream(deltas: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """A streaming frame (req_id, seq, delta, last), each request cut at its first stop word."""
    return split_stream(deltas, StopProcessor(words))


def whole(events: DataFrame) -> DataFrame:
    """req_id, reasoning, content: what the deltas of a request say together, in order."""
    said = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("seq", "text"))))
    joined = lambda name: F.array_join(F.transform(name, lambda x: x["text"]), "").alias(name)
    gathered = events.groupBy("req_id").agg(said("reasoning").alias("reasoning"), said("content").alias("content"))
    return gathered.select("req_id", joined("reasoning"), joined("content"))


def blocks(events: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """req_id, block, field, text: runs of deltas of the same field as numbered blocks, in order.

    A request of ``requests(req_id)`` without any delta is one empty block of content.  A request's deltas are one sequence, so
    the unit of work is a request, as long as its answer."""
    by = Window.partitionBy("req_id").orderBy("seq", F.col("field") != "reasoning")  # one delta may end a thought and begin the answer
    new = F.coalesce((F.col("field") != F.lag("field").over(by)).cast("int"), F.lit(0))
    numbered = events.withColumn("new", new).withColumn("block", F.sum("new").over(by))
    piece = F.array_sort(F.collect_list(F.struct("seq", "text")))
    made = numbered.groupBy("req_id", "block").agg(F.any_value("field").alias("field"), F.array_join(F.transform(piece, lambda x: x["text"]), "").alias("text"))
    if requests is None:
        return made
    silent = requests.select("req_id").distinct().join(events.select("req_id").distinct(), "req_id", "left_anti")
    return made.unionByName(silent.select("req_id", F.lit(0).cast("long").alias("block"), F.lit("content").alias("field"), F.lit("").alias("text")))


def deltas_of(cumulative: DataFrame) -> DataFrame:
    """req_id, seq, delta from growing texts; a text that is no longer than the longest before it gives nothing."""
    by = Window.partitionBy("req_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.length("text")).over(by), F.lit(0))
    grown = cumulative.withColumn("seen", seen).filter(F.length("text") > F.col("seen"))
    return grown.select("req_id", "seq", F.substring("text", F.col("seen") + 1, F.length("text")).alias("delta"))


def call_events(calls: DataFrame, protocol: str = "blocks") -> DataFrame:
    """req_id, call, step, event, payload of each call in ``calls array<struct<id, name, arguments>>``.

    ``blocks`` tells a call in three events, start, delta and stop; ``chunks`` in two, the header and the arguments."""
    each = calls.select("req_id", F.posexplode("calls").alias("call", "c"))
    head, body = F.to_json(F.struct("c.id", "c.name")), F.col("c.arguments")
    told = {"blocks": (("start", head), ("delta", body), ("stop", F.lit(""))), "chunks": (("header", head), ("arguments", body))}[protocol]
    steps = F.array(*[F.struct(F.lit(event).alias("event"), payload.alias("payload")) for event, payload in told])
    return each.select("req_id", "call", F.posexplode(steps).alias("step", "e")).select("req_id", "call", "step", "e.event", "e.payload")


#: Framings of event rows: names of the first, a delta's and the last event.
FRAMINGS = {
    "chunks": ("role", "delta", "done"),
    "blocks": ("message_start", "content_block_delta", "message_stop"),
    "knowledge": ("start", "delta", "end"),
}


def event_rows(deltas: DataFrame, framing: str) -> DataFrame:
    """req_id, seq, event, payload: the rows of a server's event stream for split deltas (req_id, seq, field, text).

    Every request has a first event and a last one with the number of its deltas; payloads are JSON.  Numbers come from the
    deltas' order in their request."""
    first, middle, last = FRAMINGS[framing]
    by = Window.partitionBy("req_id").orderBy("seq", F.col("field") != "reasoning")
    body = deltas.select("req_id", F.row_number().over(by).cast("long").alias("seq"), F.lit(middle).alias("event"), F.to_json(F.struct("field", "text")).alias("payload"))
    ends = deltas.groupBy("req_id").agg(F.count("*").alias("n"))
    edge = lambda seq, event, payload: ends.select("req_id", seq.cast("long").alias("seq"), F.lit(event).alias("event"), payload.alias("payload"))
    start = edge(F.lit(0), first, F.to_json(F.struct(F.lit("assistant").alias("role"))))
    stop = edge(F.col("n") + 1, last, F.to_json(F.struct(F.col("n").alias("deltas"))))
    return start.unionByName(body).unionByName(stop)

"""The quote gate on typed state: sessions as keys of a stream, each with its own value, map and list state and a timer.

A delta that comes too early waits in a map by its number. When a session has ended only that is kept of it, so that rows which come after the
end are told, one by one, instead of opening it again; a timer clears it. A session that goes quiet before its end is flushed by the timer
as if it had ended, and says so. Time is that of the rows, so that it runs the same whenever it is run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.verify import LETTERS
from ..sources.shared import shared_dir
from .gate import _COLUMNS, OUTPUT, Gate, _events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a session's gate carries from batch to batch.
GATE = "header string, coverage string, trim boolean, open int, quote string, armenian long, cyrillic long, rejected long, accepted long"


class GateSessions(StatefulProcessor):
    """Deltas (session, seq from 0, delta, is_last, texts, at) to the events of `gate`, with `late` for rows after the end, and `expired`
    before the end of sessions that went quiet."""

    def __init__(self, quiet_ms: int, letters: re.Pattern | None, language: str | None):
        self.quiet_ms, self.letters, self.language = quiet_ms, letters, language

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.gate = handle.getValueState("gate", GATE)
        self.ended = handle.getValueState("ended", "seq long")
        self.early = handle.getMapState("early", "seq long", "delta string, is_last boolean")
        self.texts = handle.getListState("texts", "text string")

    def _gate(self) -> Gate:
        texts = [t for (t,) in self.texts.get()] if self.texts.exists() else []
        state = None
        if self.gate.exists():
            header, coverage, trim, open_, quote, armenian, cyrillic, rejected, accepted = self.gate.get()
            state = {"header": header, "coverage": coverage, "trim": trim, "open": open_, "quote": quote, "scripts": [armenian, cyrillic], "rejected": rejected, "accepted": accepted}
        return Gate(texts, state, self.letters, self.language)

    def _keep(self, gate: Gate) -> None:
        s = gate.state()
        self.gate.update((s["header"], s["coverage"], s["trim"], s["open"], s["quote"], *map(int, s["scripts"]), s["rejected"], s["accepted"]))

    def _close(self, seq: int) -> None:
        for state in (self.next, self.gate, self.early, self.texts):
            state.clear()
        self.ended.update((seq,))

    def _wait(self, timer_values: Any, seen_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timer_values.getCurrentWatermarkInMs(), seen_ms or 0) + self.quiet_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        due: dict[int, tuple[str, bool]] = {}
        texts: list[str] | None = None
        seen = None
        for frame in rows:
            at = frame["at"].max()
            if not pd.isna(at):
                seen = max(seen or 0, int(at.timestamp() * 1000))
            for seq, delta, is_last, given in zip(frame["seq"].tolist(), frame["delta"].tolist(), frame["is_last"].tolist(), frame["texts"].tolist(), strict=True):
                due[int(seq)] = (delta or "", bool(is_last))
                if given is not None and len(given):
                    texts = [t or "" for t in given]
        if self.ended.exists():
            yield pd.DataFrame([(key[0], seq, 0, "late", delta) for seq, (delta, _) in sorted(due.items())], columns=_COLUMNS)
            return
        if texts is not None:
            self.texts.put([(t,) for t in texts])
        now = self.next.get()[0] if self.next.exists() else 0
        out += [(key[0], seq, 0, "late", delta) for seq, (delta, _) in sorted(due.items()) if seq < now]
        due = {seq: row for seq, row in due.items() if seq >= now}
        waiting = self.early.exists()
        gate, last = None, False
        while not last:
            if now in due:
                delta, last = due.pop(now)
            elif waiting and self.early.containsKey((now,)):
                delta, last = self.early.getValue((now,))
                self.early.removeKey((now,))
            else:
                break
            gate = gate or self._gate()
            out += _events(key[0], now, gate, gate.feed(delta), last)
            now += 1
        if last:
            out += [(key[0], seq, 0, "late", delta) for seq, (delta, _) in sorted(due.items())]
            if waiting:
                out += [(key[0], seq, 0, "late", delta) for (seq,), (delta, _) in sorted(self.early.iterator())]
            self._close(now)
        else:
            for seq, row in due.items():
                self.early.updateValue((seq,), row)
            if gate:
                self._keep(gate)
            self.next.update((now,))
        self._wait(timerValues, seen)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            self.ended.clear()
            yield pd.DataFrame([], columns=_COLUMNS)
            return
        now = self.next.get()[0] if self.next.exists() else 0
        held = len(list(self.early.keys())) if self.early.exists() else 0
        out = [(key[0], now, 0, "expired", json.dumps({"waiting": held}))] + _events(key[0], now, self._gate(), "", True)
        self._close(now)
        self._wait(timerValues, None)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def gate_sessions(deltas: DataFrame, quiet_ms: int = 600_000, letters: re.Pattern | None = LETTERS, language: str | None = None) -> DataFrame:
    """Events of a stream of deltas (session, seq, delta, is_last, texts, at) that has a watermark on `at`; the session's texts come with any of its
    rows before they are needed. State stores have to be of the kind that `PROVIDER` names."""
    columns = deltas.select("session", "seq", "delta", "is_last", "texts", "at")
    return columns.groupBy("session").transformWithStateInPandas(GateSessions(quiet_ms, letters, language), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def run_gate_over_files(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000, delay: str = "10 minutes", out: str | None = None, checkpoint: str | None = None, **options: Any) -> DataFrame:
    """What the gate makes of the Parquet files of a folder, in batches, to the last that is there; run again with the same `out` and `checkpoint` it goes on
    from where it was."""
    out, checkpoint = out or shared_dir(spark, "gate-events"), checkpoint or shared_dir(spark, "gate-state")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder).withWatermark("at", delay)
        query = gate_sessions(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(OUTPUT).parquet(out)

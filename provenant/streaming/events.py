"""The events of an answer as rows, their frames on a wire, and frames read back from pieces of any size.

Events are (session, n, type, payload): the stages as they begin, chunks as soon as they are found, deltas, and at the end done, or error in
place of what didn't come. A frame is an `event:` and a `data:` line ended by a blank line; lines end in LF or CRLF. Pieces are bytes, so that they may end
within a character; what has come of an unfinished frame waits, in a stream as keyed state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The stages of an answer in their order, and the kinds of events.
STAGES = ("understanding", "searching", "reading", "writing")
KINDS = ("stage", "chunks", "delta", "done", "error")
FRAME = "session long, n long, type string, payload string"


def protocol(answers: DataFrame, deltas: DataFrame) -> DataFrame:
    """Events of `answers` (session, chunks, result, error), chunks and result as JSON, and their deltas (session, seq, text), numbered from 0. An answer
    with an error has the stages up to the one that failed: the second if it has no chunks, else the fourth."""
    stage_of = lambda i: F.to_json(F.struct(F.lit(STAGES[i]).alias("stage")))
    part = lambda at, kind, payload: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("type"), payload.alias("payload"))
    found, failed = F.col("chunks").isNotNull(), F.col("error").isNotNull()
    begun = F.array(part(0, "stage", stage_of(0)), part(1, "stage", stage_of(1)))
    going = F.when(found, F.array(part(2, "chunks", F.col("chunks")), part(3, "stage", stage_of(2)), part(4, "stage", stage_of(3)))).otherwise(F.expr("cast(array() as array<struct<at: int, type: string, payload: string>>)"))
    end = F.array(F.when(failed, part(6, "error", F.to_json(F.struct(F.col("error"))))).otherwise(part(6, "done", F.col("result"))))
    ends = answers.select("session", F.inline(F.concat(begun, going, end)))
    said = deltas.select("session", F.lit(5).alias("at"), F.col("seq"), F.lit("delta").alias("type"), F.to_json(F.struct("text")).alias("payload"))
    rows = ends.withColumn("seq", F.lit(0).cast("long")).unionByName(said)
    return rows.select("session", (F.row_number().over(Window.partitionBy("session").orderBy("at", "seq")) - 1).cast("long").alias("n"), "type", "payload")


def frame_of(type_: Column, payload: Column, line_end: str = "\n") -> Column:
    return F.concat(F.lit("event: "), type_, F.lit(f"{line_end}data: "), payload, F.lit(line_end * 2))


def parsed_frame(frame: Column) -> tuple[Column, Column]:
    """Type and payload: of each kind of line the first. Frames without data are none."""
    return F.coalesce(F.nullif(F.regexp_extract(frame, "(?m)^event: ?([^\\r\\n]*)", 1), F.lit("")), F.lit("message")), F.nullif(F.regexp_extract(frame, "(?m)^data: ([^\\r\\n]*)", 1), F.lit(""))


def read_frames(pieces: DataFrame) -> DataFrame:
    """(session, n, type, payload) of pieces (session, seq, piece), piece binary; an unfinished frame at the end counts. A session's pieces come together, so
    sessions are to be answers, not lasting connections; for those there is the stream."""
    whole = pieces.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("piece").alias("h")))).alias("all"))
    text = F.decode(F.unhex(F.array_join(F.transform("all", lambda x: x["h"]), "")), "UTF-8")
    frames = whole.select("session", F.posexplode(F.filter(F.split(text, "\\r?\\n\\r?\\n"), lambda f: f.rlike("(?m)^data: ."))).alias("n", "frame"))
    kind, payload = parsed_frame(F.col("frame"))
    return frames.select("session", F.col("n").cast("long").alias("n"), kind.alias("type"), payload.alias("payload"))


class FrameReader(StatefulProcessor):
    """Pieces (session, seq from 0, piece) to frames as they are complete. Held are a tail, the next piece's number, that of the next frame, and
    pieces that came too early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "tail binary, seq long, n long")
        self.early = handle.getMapState("early", "seq long", "piece binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tail, now, n = self.held.get() if self.held.exists() else (b"", 0, 0)
        due = {int(s): bytes(p or b"") for frame in rows for s, p in zip(frame["seq"].tolist(), frame["piece"].tolist(), strict=True)}
        waiting = self.early.exists()
        held = [bytes(tail)]
        while True:
            if now in due:
                held.append(due.pop(now))
            elif waiting and self.early.containsKey((now,)):
                held.append(bytes(self.early.getValue((now,))[0]))
                self.early.removeKey((now,))
            else:
                break
            now += 1
        for seq, piece in due.items():
            if seq > now:
                self.early.updateValue((seq,), (piece,))
        *frames, tail = re.split(rb"\r?\n\r?\n", b"".join(held))
        out = []
        for frame in frames:
            data = re.search(rb"^data: ([^\r\n]+)", frame, re.M)
            if data:
                kind = re.search(rb"^event: ?([^\r\n]+)", frame, re.M)
                out.append((key[0], n, (kind[1] if kind else b"message").decode(), data[1].decode()))
                n += 1
        self.held.update((tail, now, n))
        yield pd.DataFrame(out, columns=["session", "n", "type", "payload"])

    def close(self) -> None:
        pass


def frames_stream(pieces: DataFrame) -> DataFrame:
    """The stream twin of `read_frames`: frames that are complete. State stores as for sessions.PROVIDER."""
    return pieces.select("session", "seq", "piece").groupBy("session").transformWithStateInPandas(FrameReader(), outputStructType=FRAME, outputMode="Append", timeMode="None")


def stage_timings(marks: DataFrame, stages: list[str], first: str) -> DataFrame:
    """(session, one column of milliseconds a stage, first, total) for marks (session, stage, at, a timestamp): from a stage's first mark to that of the next
    one that was reached; to the first mark of `first`; and to the last of all. Null where a stage wasn't reached."""
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    each = marks.groupBy("session").agg(*[F.min(F.when(F.col("stage") == s, ms)).alias(f"_{i}") for i, s in enumerate(stages)], F.min(ms).alias("_start"), F.max(ms).alias("_end"), F.min(F.when(F.col("stage") == first, ms)).alias("_first"))
    all_of = F.array(*[F.col(f"_{j}") for j in range(len(stages))], F.col("_end"))

    def span(own: Column) -> Column:
        return F.coalesce(F.array_min(F.filter(all_of, lambda t: t > own)), own) - own

    spans = [span(F.col(f"_{i}")).alias(s) for i, s in enumerate(stages)]
    return each.select("session", *spans, (F.col("_first") - F.col("_start")).alias("first"), (F.col("_end") - F.col("_start")).alias("total"))

"""Verification of a stream of deltas: a coverage header is taken off, then quotes are held until they are closed and
checked. Deltas are rows (session, seq, delta, is_last); order within a session is by seq.

`Gate` is the whole automaton for one session. Streams keep its state per session between batches, waiting for a
missing seq; batches run it over a session's ordered rows. Its output doesn't depend on where deltas are cut, and what
a quote must be to be checked is `verify.checkable`, as for whole answers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.verify import LETTERS, COVERAGE, NOTICES, PAIRS, checkable, match, normalised, notice_in, script_counts

HELD_HEADER = 64
CLOSING = {"hy": "\n\nՄի քանի մեջբերում չի հաստատվել։", "ru": "\n\nНесколько цитат не подтверждены."}
#: n numbers what one delta brings about.
OUTPUT = "session long, seq long, n int, type string, payload string"
_COLUMNS = ["session", "seq", "n", "type", "payload"]


class Gate:
    """State of one session; feed and flush return what may be shown. Notices are in the language given, or in that of
    what has been shown so far and the quote."""

    def __init__(self, sources: list[str], state: dict | None = None, letters: re.Pattern | None = LETTERS, language: str | None = None):
        self.sources = [normalised(s or "") for s in sources]
        self.letters, self.language = letters, language
        s = state or {}
        self.header = s.get("header", "")  # text held until the first line is complete; None once that is settled
        self.coverage = s.get("coverage")
        self.trim = s.get("trim", False)
        self.open = s.get("open", -1)  # the pair of marks that is open
        self.quote = s.get("quote", "")
        self.scripts = s.get("scripts", [0, 0])  # letters shown, Armenian and Cyrillic
        self.rejected = s.get("rejected", 0)
        self.accepted = s.get("accepted", 0)

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("header", "coverage", "trim", "open", "quote", "scripts", "rejected", "accepted")}

    def feed(self, delta: str) -> str:
        return self._quotes(self._header(delta))

    def _header(self, delta: str) -> str:
        if self.header is None:
            if self.trim:
                delta = delta.lstrip()
                self.trim = not delta
            return delta
        self.header += delta
        if "\n" in self.header or len(self.header) >= HELD_HEADER:
            return self._settle()
        return ""

    def _settle(self) -> str:
        first, line_end, rest = self.header.partition("\n")
        text, self.header = self.header, None
        if found := re.match(COVERAGE, first, re.IGNORECASE):
            self.coverage = found[1].lower()
            text = rest.lstrip()
            self.trim = not text
        return text

    def _quotes(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            if self.open < 0:
                marks = [(p, i) for i, (opening, _) in enumerate(PAIRS) if (p := text.find(opening, at)) >= 0]
                end, pair = min(marks, default=(len(text), -1))
                out.append(self._shown(text[at:end]))
                if pair >= 0:
                    self.open, self.quote = pair, ""
                at = end + 1
            else:
                end = text.find(PAIRS[self.open][1], at)
                self.quote += text[at : end if end >= 0 else len(text)]
                if end >= 0:
                    out.append(self._closed())
                at = end + 1 if end >= 0 else len(text)
        return "".join(out)

    def _shown(self, text: str) -> str:
        self.scripts = [a + b for a, b in zip(self.scripts, script_counts(text), strict=True)]
        return text

    def _notice(self, text: str) -> str:
        return NOTICES[self.language] if self.language else notice_in(*(a + b for a, b in zip(self.scripts, script_counts(text), strict=True)))

    def _closed(self) -> str:
        quote, (start, end) = self.quote, PAIRS[self.open]
        self.open, self.quote = -1, ""
        if checkable(quote, self.letters):
            if not any(match(quote, s) for s in self.sources):
                self.rejected += 1
                return self._shown(self._notice(quote))
            self.accepted += 1
        return self._shown(start + quote + end)

    def flush(self) -> str:
        out = self._quotes(self._settle()) if self.header is not None else ""
        if self.open >= 0:  # never closed: checked as it is
            out += self._closed()
        if self.rejected >= 2:
            notice = self._notice("")
            out += CLOSING[next(k for k, v in NOTICES.items() if v == notice)]
        return out


def _events(session: int, seq: int, gate: Gate, text: str, last: bool) -> list[tuple]:
    rows = [(session, seq, 0, "delta", text)] if text else []
    if last:
        if tail := gate.flush():
            rows.append((session, seq, 1, "delta", tail))
        rows.append((session, seq, 2, "done", json.dumps({"coverage": gate.coverage, "accepted": gate.accepted, "rejected": gate.rejected}, ensure_ascii=False)))
    return rows


def gate_batch(deltas: DataFrame, sources: DataFrame, letters: re.Pattern | None = LETTERS, language: str | None = None) -> DataFrame:
    """The batch twin: deltas (session, seq, delta) with sources (session, texts). A session's rows, sources first, come in
    order to one task, which goes through them as a stream: nothing but the gate's own state is held."""
    first = sources.select("session", F.lit(0).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("delta"), "texts")
    rows = deltas.select("session", F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), "delta", F.lit(None).cast("array<string>").alias("texts"))
    n_parts = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by a hash: by the session itself, as both sides may be already, Spark leaves the shuffle out, and then the sides' partitions may be cut differently
    ordered = first.unionByName(rows).repartition(n_parts, F.xxhash64("session")).sortWithinPartitions("session", "part", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, seq, gate, texts = None, None, None, []

        def ended() -> list[tuple]:
            return _events(session, seq, gate, "", True) if gate else []

        for frame in frames:
            out = []
            for now, part, n, delta, given in zip(frame["session"].tolist(), frame["part"].tolist(), frame["seq"].tolist(), frame["delta"].tolist(), frame["texts"].tolist(), strict=True):
                if now != session:
                    out += ended()
                    session, gate, texts = now, None, []
                if part == 0:
                    texts = texts + list(given) if given is not None else texts
                    continue
                gate = gate or Gate(texts, None, letters, language)
                seq = int(n)
                out += _events(session, seq, gate, gate.feed(delta or ""), False)
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(ended(), columns=_COLUMNS)

    return ordered.mapInPandas(run, OUTPUT)


def gate_stream(deltas: DataFrame, letters: re.Pattern | None = LETTERS, language: str | None = None) -> DataFrame:
    """Stream twin: deltas (session, seq from 0, delta, is_last, texts) where texts come with a session's first row.
    Rows that arrive early wait in state for those before them."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"next": 0, "gate": None, "texts": [], "early": {}}
        for frame in frames:
            for r in frame.itertuples():
                held["early"][str(r.seq)] = [r.delta or "", bool(r.is_last)]
                if r.texts is not None and len(r.texts):
                    held["texts"] = list(r.texts)
        gate, out, ended = Gate(held["texts"], held["gate"], letters, language), [], False
        while (now := held["early"].pop(str(held["next"]), None)) is not None:
            out += _events(key[0], held["next"], gate, gate.feed(now[0]), now[1])
            held["next"] += 1
            ended |= now[1]
        if ended:
            state.remove()
        else:
            held["gate"] = gate.state()
            state.update((json.dumps(held, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return deltas.groupBy("session").applyInPandasWithState(run, OUTPUT, "held string", "append", GroupStateTimeout.NoTimeout)


def frames(chunks: list[str]) -> list[str]:
    """Server-sent frames put together again from pieces of any size: frames end at a blank line."""
    held, out = "", []
    for chunk in chunks:
        held = (held + chunk).replace("\r\n", "\n")
        *whole, held = held.split("\n\n")
        out += [w for w in whole if w]
    return out + ([held] if held.strip() else [])

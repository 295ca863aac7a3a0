"""License scan: ordered signature rules over the words of whole texts.

A text's words, in lower case, are put in one line with blanks of their own around each, so that marks, line ends and
comment signs between words don't matter. A rule is tried only on texts that hold all its keywords, which is looked up in the set of
the text's words. All matches of all rules are detections; one that lies within a detection of an earlier
rule is suppressed (a detection within a suppressed one lies within what suppressed that, too, so order doesn't matter).
Base phrases are found beside the rules and always stay.

Defined results: a null text counts as empty and has no words, places or labels, and a score of 0. Repeated rows are scanned each. A
null doc_id stays null. No columns but the id and the text are read. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty
from .license_rules import RULES, Rule, over_words

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
PHRASE_WEIGHT = 0.5

#: What parts words: every ASCII character but digits and letters.
PARTING = bytes(b for b in range(128) if not chr(b).isalnum())

SPAN = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
FOUND = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN)}


class Scanner:
    """The rules, compiled when first needed, and what they find in a text."""

    def __init__(self, rules: list[Rule], phrases: dict[str, str]):
        self.rules, self.phrases = rules, phrases
        self.lower = bytes.maketrans(PARTING + bytes(range(65, 91)), b" " * len(PARTING) + bytes(range(97, 123)))
        self.compiled: dict[str, re.Pattern[bytes]] = {}
        self.by_keyword: dict[bytes, list[tuple[frozenset[bytes], int]]] = {}
        for i, rule in enumerate(rules):  # each stands by one of its keywords, and is tried if the others are there too
            words = [k.encode() for k in rule.keywords]
            self.by_keyword.setdefault(words[0], []).append((frozenset(words), i))
        self.base = [(frozenset(p.encode().split()), over_words(p), label) for p, label in phrases.items()]
        self.triggers = self.by_keyword.keys() | {min(words) for words, _, _ in self.base}

    def _matches(self, pattern: str, line: bytes) -> list[tuple[int, int]]:
        compiled = self.compiled.get(pattern) or self.compiled.setdefault(pattern, re.compile(pattern.encode()))
        return [m.span() for m in compiled.finditer(line)]

    def find(self, text: bytes) -> tuple:
        words = text.translate(self.lower).split()
        distinct = set(words)
        if distinct.isdisjoint(self.triggers):
            return len(words), 0, None, None, "", "", 0.0, []
        line = b" " + b"  ".join(words) + b" "
        blanks = None

        def places(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
            """In words: two blanks stand before each but the first."""
            nonlocal blanks
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            return [(int(a) // 2, int(b) // 2) for a, b in np.searchsorted(blanks, np.array(spans).reshape(-1, 2)).tolist()]

        base = [(at, label) for need, phrase, label in self.base if need <= distinct for at, _ in places(self._matches(phrase, line))]
        tried = sorted(i for k in distinct & self.by_keyword.keys() for need, i in self.by_keyword[k] if need <= distinct)
        found = [(a, b, i) for i in tried for a, b in places(self._matches(self.rules[i].pattern, line))]
        kept = unsuppressed(found)
        base_labels = {label for _, label in base}
        labels = base_labels | {self.rules[i].label for _, _, i in kept}
        score = max([self.rules[i].weight for _, _, i in kept] + [PHRASE_WEIGHT] * bool(base), default=0.0)
        spans = [{"label": self.rules[i].label, "rule": i, "first_word": a, "end_word": b} for a, b, i in kept]
        first, last = (min(base)[0], max(base)[0]) if base else (None, None)
        return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def unsuppressed(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (start, end, rule) that lie in none of an earlier rule, by place. Those of one rule don't overlap, so the ones
    that may hold another begin at most the longest length before it."""
    found = sorted(found)
    longest = max((b - a for a, b, _ in found), default=0)
    kept, low, open_ = [], 0, []
    for n, (a, b, i) in enumerate(found):
        while found[low][0] < a - longest:
            low += 1
        open_ = found[low:n]
        for m in range(n + 1, len(found)):
            if found[m][0] > a:
                break
            open_.append(found[m])
        if not any(x <= a and y >= b and j < i for x, y, j in open_):
            kept.append((a, b, i))
    return kept


def scan_licenses(docs: DataFrame, rules: list[Rule] = RULES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their least and
    greatest start, from 0, or null), base_labels and labels (with the rules'; distinct, sorted, comma-joined), score (the weight of the
    surest detection), spans (what the rules found: label, the rule's rank, first word, end)."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, phrases)
        for batch in batches:
            found = [scanner.find(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found), FOUND.values())] if found else [pa.array([], kind) for kind in FOUND.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *FOUND])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, rule int, first_word long, end_word long>>"
    return rows.mapInArrow(scan, schema)

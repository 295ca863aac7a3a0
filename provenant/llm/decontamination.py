"""Benchmark decontamination: pigeonhole edit matching over words.

An item of n words may differ by k = floor(budget * n) word edits. Cut into k + 1 pieces, at least one piece stands
in any such occurrence unchanged. Documents are scanned for exact pieces; each hit proposes a place, which is
verified with Myers' bit-parallel distance of the whole item to the best-fitting stretch of text there. Items are a
stated query set: they are read by the driver and broadcast in blocks of `block_bytes`, one pass over the documents
each; a pass more for each 4 MB of items is the price of holding one block at a time. If there is more than one, what each
finds is written before the next is sent out, and joined to the documents by id and hash of text at the end.

Words are runs of letters and digits, case-folded; in scripts that don't part words by spaces (Chinese, Japanese,
Thai, Lao, Burmese, Khmer) each character is a word. Items with fewer than `least_words` words match nothing (1
unless asked otherwise). At the budget of 0.2 an item of fewer than five words has no errors to spend: it is one piece,
found where it stands unchanged. Null texts are empty. Repeated items and items with null ids match like
others; ids are listed once, null ids not at all. Repeated rows are judged each; other columns are ignored or
carried. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, text_or_empty, written

_WORDS = re.compile(r"\w+")
#: Thai and Lao, Burmese, Khmer, Japanese, Chinese: letters, marks and digits.
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9"
    "\u3005-\u3007\u3041-\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\uff66-\uff9f"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
)
_IS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED_WORDS = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def item_words(text: str) -> list[str]:
    text = text.casefold()
    if text.isascii() or not _IS_UNSPACED.search(text):
        return _WORDS.findall(text)
    return _MIXED_WORDS.findall(text)


def pieces_of(n: int, errors: int) -> list[tuple[int, int]]:
    """(start, end) of errors + 1 pieces of n words, as even as can be."""
    parts = errors + 1
    edges = [i * n // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def best_distance(masks: dict[str, int], n: int, words: list[str]) -> int:
    """Least edit distance of the pattern of n words with the given position masks to any stretch of `words`."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance, best = full, 0, n, n
    for w in words:
        eq = masks.get(w, 0)
        across = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        right_plus = minus | (~(eq | plus) & full)
        right_minus = plus & eq
        if right_plus & top:
            distance += 1
        elif right_minus & top:
            distance -= 1
        # a stretch may begin anywhere, so nothing is carried into the lowest bit
        right_plus = (right_plus << 1) & full
        right_minus = (right_minus << 1) & full
        plus = right_minus | (~(across | right_plus) & full)
        minus = right_plus & across
        best = min(best, distance)
    return best


class Matcher:
    """Items of one block, ready to be found in texts."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float, least_words: int):
        self.items: list[tuple[int | None, int, int, dict[str, int]]] = []
        #: a piece's longest word -> (piece, where in it that word stands, where in its item the piece stands, item)
        self.anchors: dict[str, list[tuple[list[str], int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = item_words(text)
            if len(words) < max(1, least_words):
                continue
            errors = int(budget * len(words))
            masks: dict[str, int] = defaultdict(int)
            for i, w in enumerate(words):
                masks[w] |= 1 << i
            number = len(self.items)
            self.items.append((item_id, len(words), errors, dict(masks)))
            for a, b in pieces_of(len(words), errors):
                at = max(range(a, b), key=lambda i: len(words[i]))  # noqa: B023
                self.anchors[words[at]].append((words[a:b], at - a, a, number))

    def find(self, text: str) -> dict[int, int]:
        """item number -> least distance, for items within their budget."""
        words = item_words(text)
        anchors = self.anchors
        if anchors.keys().isdisjoint(words):
            return {}
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            for piece, at, offset, number in anchors.get(w, ()):
                start = i - at
                if start < 0 or words[start : start + len(piece)] != piece or found.get(number) == 0:
                    continue
                place = start - offset
                if (number, place) in tried:
                    continue
                tried.add((number, place))
                _, n, errors, masks = self.items[number]
                d = best_distance(masks, n, words[max(0, place - errors) : place + n + errors])
                if d <= errors:
                    found[number] = min(d, found.get(number, d))
        return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), text_or_empty()).toLocalIterator():
        block.append((item_id, text))
        size += 100 + len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, budget: float = 0.2, least_words: int = 1, block_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_items (benchmark items found), item_ids (ascending, comma-joined),
    min_distance (least word edits of any, null if none), contaminated, kept; and the columns in `carry`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"), *kept)
    hits = {"items": pa.list_(pa.int64()), "n_items": pa.int64(), "min_distance": pa.int64()}
    none = {"items": F.expr("cast(array() as array<bigint>)"), "n_items": F.lit(0).cast("long"), "min_distance": F.lit(None).cast("long")}

    def searched(block: list[tuple[int | None, str]], rows: DataFrame, all_rows: bool) -> DataFrame:
        """`rows` with what of the block stands in them; those in which nothing does are left out, unless all_rows."""
        shared = spark.sparkContext.broadcast((block, budget, least_words))
        columns = [c for c in rows.columns if all_rows or c != "text"]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                found = [matcher.find(text) for text in batch.column("text").to_pylist()]
                kept = batch.select(columns) if all_rows else batch.select(columns).take(pa.array([i for i, f in enumerate(found) if f], pa.int64()))
                found = [f for f in found if f or all_rows]
                values = ([[x for n in f if (x := matcher.items[n][0]) is not None] for f in found], [len(f) for f in found], [min(f.values(), default=None) for f in found])
                yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, values, hits.values())], [*columns, *hits])

        return rows.mapInArrow(scan, StructType([*rows.select(*columns).schema, *spark.createDataFrame([], "items array<long>, n_items long, min_distance long").schema]))

    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        rows = rows.withColumns(none)
    elif second is None:
        rows = searched(first, rows, True)
    else:  # one block at a time: what is found is written before the next one is sent out
        parts = [written(searched(block, rows.select("doc_id", "tie", "text"), False).distinct(), "items-found") for block in chain((first, second), blocks)]
        found = reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
        found = found.agg(F.flatten(F.collect_list("items")).alias("items"), F.sum("n_items").alias("n_items"), F.min("min_distance").alias("min_distance"))
        known = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
        rows = known.withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    return rows.select(
        "doc_id",
        "n_items",
        F.array_join(F.array_sort(F.array_distinct("items")).cast("array<string>"), ",").alias("item_ids"),
        "min_distance",
        (F.col("n_items") > 0).alias("contaminated"),
        (F.col("n_items") == 0).alias("kept"),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    )

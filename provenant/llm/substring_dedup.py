"""Substring dedup: repeated runs of words, found through difference-cover anchors.

A window is `window` consecutive words of one document. Words that a window covers whose words also start at any
other place are removed. Instead of hashing all windows, anchors are hashed, shorter runs of words, and only at places
whose remainder modulo a period lies in a difference cover: whatever two places a repeated window starts at, some
shift below the period takes both to cover places, where they share an anchor. Where an anchor is repeated, it is
extended to the windows that hold it, and just these are hashed, with 96 bits, and looked up in full.

Documents are first written to a table bucketed by a row number, so that the later passes over the texts need no
shuffle of them. Hashes that are repeated within a batch are settled there and go on as one row, so no word, line or
passage, however common, brings more rows together than there are batches.

Defined results: words are runs of bytes other than ASCII white space, unchanged; a null text has none; documents
shorter than a window lose nothing; repeated rows, null ids and ties are documents of their own; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, setting, text_or_empty, written
from .tokens import words_of

#: Perfect difference sets: each difference modulo the period but 0 occurs once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of a window; for short windows every place (period 1)."""
    fit = [p for p in COVERS if window - p + 1 >= max(3, window * 2 // 5)]
    return (p := max(fit), COVERS[p]) if fit else (1, (0,))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int, base: int, inverse: int) -> np.ndarray:
    """For each place the hash of `length` words from there: a polynomial modulo 2 ** 64 whose coefficients are the
    words' hashes, from prefix sums and the inverse powers of the base."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(hashes), base, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
    found = (sums[length:] - sums[:-length]) * np.cumprod(np.full(n, inverse, np.uint64))
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def settled(h: np.ndarray, g: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows (h, gp, uid) of a batch's hashes (h, g) at places (uid, pos); gp holds g, pos and whether the hash is
    known to be repeated. Of a hash that the batch repeats, one row stays under it; the others are known already
    and go under keys of their own."""
    order = np.lexsort((g, h))
    h, g, uid, pos = h[order], g[order], uid[order], pos[order]
    after = np.zeros(len(h), bool)  # same as the row before
    after[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    known = after.copy()
    known[:-1] |= after[1:]
    own = (uid.astype(np.uint64) * np.uint64(_BASES[1])) ^ (pos.astype(np.uint64) * np.uint64(_BASES[0]))
    h = np.where(after, own ^ (own >> np.uint64(31)), h)
    gp = (g.astype(np.uint64) << np.uint64(32)) | (pos.astype(np.uint64) << np.uint64(1)) | known.astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(gp.view(np.int64)), pa.array(uid)], ["h", "gp", "uid"])


def repeated_places(rows: DataFrame) -> DataFrame:
    """(uid, places) of those rows (h, gp, uid) whose hash occurs again."""
    same = Window.partitionBy("h", F.shiftrightunsigned("gp", 32))
    counted = rows.select("uid", "gp", F.count("*").over(same).alias("n"), F.max(F.col("gp").bitwiseAND(F.lit(1))).over(same).alias("known"))
    place = F.shiftright(F.col("gp").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    return counted.where("n > 1 or known = 1").select("uid", place.alias("place")).groupBy("uid").agg(F.collect_list("place").alias("places"))


def anchor_rows(window: int):
    period, cover = cover_for(window)
    length = window - period + 1
    inverse = _inverse(_BASES[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, uid, pos = [], [], []
            for i, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                hashes = run_hashes(word_hashes(words), length, _BASES[0], inverse)
                at = np.flatnonzero(np.isin(np.arange(period), cover)[np.arange(len(hashes)) % period])
                h.append(hashes[at])
                pos.append(at)
                uid.append(np.full(len(at), i, np.int64))
            if h:
                hashes = np.concatenate(h)
                yield settled(hashes, np.zeros(len(hashes), np.uint64), np.concatenate(uid), np.concatenate(pos))

    return run


def window_rows(window: int):
    period, _ = cover_for(window)
    inverses = [_inverse(b) for b in _BASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g, uid, pos = [], [], [], []
            for i, text, places in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "places")), strict=True):
                hashes = word_hashes(words_of(text))
                n = len(hashes) - window + 1
                anchors = np.array(places, np.int64)
                edges = np.zeros(n + 1, np.int64)  # windows that start up to period - 1 words before an anchor hold it
                np.add.at(edges, np.clip(anchors - period + 1, 0, n), 1)
                np.add.at(edges, np.clip(anchors + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                h.append(run_hashes(hashes, window, _BASES[0], inverses[0])[at])
                g.append(run_hashes(hashes, window, _BASES[1], inverses[1])[at] >> np.uint64(32))
                pos.append(at)
                uid.append(np.full(len(at), i, np.int64))
            if h:
                yield settled(*map(np.concatenate, (h, g, uid, pos)))

    return run


def removal(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = words_of(text)
                kept = words
                if places:
                    edges = np.zeros(len(words) + 1, np.int64)
                    starts = np.array(places, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                joined = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode())
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    with_text, kept_text, those words. Rows are numbered where they are read, so `docs` is to be a stored table, or what a projection or a
    filter makes of one: after a shuffle, a task that is run again could number them in another order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"substring_dedup_{uuid.uuid4().hex}"
    hashed = "h long, gp long, uid long"
    # each pass is an action of its own; its shuffle files can go when it has ended
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        rows.repartition(buckets, "uid").write.format("parquet").option("compression", "zstd").bucketBy(buckets, "uid").saveAsTable(table)
        texts = spark.table(table)
        anchors = written(repeated_places(texts.select("uid", "text").mapInArrow(anchor_rows(window), hashed)), "repeated-anchors")
        candidates = texts.select("uid", "text").join(anchors.hint("shuffle_hash"), "uid")
        windows = written(repeated_places(candidates.mapInArrow(window_rows(window), hashed)), "repeated-windows")
    kept = texts.join(windows.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "places")
    return kept.mapInArrow(removal(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)

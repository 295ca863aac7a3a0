"""Spelling variants: words whose single edits are probed in Bloom filters, and rarer forms led to commoner ones.

A vocabulary is counted from whole texts. Two words are near if one edit parts them: a code point inserted, deleted or replaced. Each word's
deletions, and its replacements by greater letters, are generated; every pair of near words is among them from one side, as an insertion
is a deletion seen from the other word and a replacement by a lesser letter one by a greater. They are probed in
blocked Bloom filters, one a word length (blocks of 512 bits, a word's bits within one block), which are broadcast; only edits that pass are shuffled, to a join with the
vocabulary, which removes the false ones. Words are rows of bytes there, and an edit's hash is its word's with one
term changed, so a batch's edits are made and probed as arrays.

Filters have 16 bits a word, and are cut in shards of at most `filter_bytes`, by length and then by hash. A shard is broadcast, probed with all
words of the two lengths whose edits can be in it, and its hits are written before the next one, so that memory is bounded for any
vocabulary and none is too large for its filter.

Defined results: a null text has no runs. A null doc_id is written as the empty string in what is hashed. Repeated rows count each. Words
of the same number are taken in code-point order. A word is never near itself. Only the id and the text are read. No rows, or no word often
enough, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, bounded_batches, text_or_empty, written

#: Letters of words: in a class of an expression, and all of them in lower case, in their order.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)

BITS_A_WORD, BITS_SET = 16, 6
BLOCK_LANES = 8  # of 64 bits
PAIRS = {"word": pa.string(), "n": pa.int64(), "edit": pa.string()}


def vocabulary(docs: DataFrame, least_length: int, least_count: int, drop_one_in: int) -> DataFrame:
    """(word, n): runs of letters in lower case, of which one in `drop_one_in` (by a hash of document and run) has lost a letter."""
    lowered = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    long_runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(long_runs).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % drop_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a sum's bits over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(length: int) -> np.ndarray:
    """[place, letter]: a word's hash is the mixed sum of its letters' terms."""
    return _mixed((np.arange(length, dtype=np.uint64)[:, None] << np.uint64(8)) + np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))


def word_sums(letters: np.ndarray) -> np.ndarray:
    terms = _terms(letters.shape[1])
    return sum((terms[i, letters[:, i]] for i in range(letters.shape[1])), np.zeros(len(letters), np.uint64))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's block, and its bits within the block: nine bits of a second hash each."""
    again = _mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    return (hashes >> np.uint64(8)) % np.uint64(blocks), np.stack([(again >> np.uint64(9 * i)) & np.uint64(511) for i in range(BITS_SET)])


class Shard:
    """Words of one length whose hash is `part` modulo `parts`: their filter, once it is filled."""

    def __init__(self, length: int, part: int, parts: int, blocks: int, lanes: np.ndarray | None = None):
        self.length, self.part, self.parts, self.blocks, self.lanes = length, part, parts, blocks, lanes

    def mine(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & np.uint64(0xFF) if self.parts == 1 else (hashes & np.uint64(0xFF)) % np.uint64(self.parts)

    def lane_masks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the words set: lanes of the filter and their bits, each lane once."""
        block, bits = _bits(hashes, self.blocks)
        lane = (block * np.uint64(BLOCK_LANES) + (bits >> np.uint64(6))).ravel()
        mask = (np.uint64(1) << (bits & np.uint64(63))).ravel()
        order = np.argsort(lane, kind="stable")
        lanes, starts = np.unique(lane[order], return_index=True)
        return lanes, np.bitwise_or.reduceat(mask[order], starts) if len(lanes) else mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be words of this shard: indexes of `hashes`."""
        at = np.arange(len(hashes))
        if self.parts > 1:
            at = at[self.mine(hashes) == self.part]
        for i in range(BITS_SET):  # most are out after the first bits
            block, bits = _bits(hashes[at], self.blocks)
            lane = block * np.uint64(BLOCK_LANES) + (bits[i] >> np.uint64(6))
            at = at[(self.lanes[lane] >> (bits[i] & np.uint64(63))) & np.uint64(1) == 1]
        return at


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, letters as a matrix) of a batch's words."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, length)


def deletions(letters: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of the shard that lack one letter of a row: the rows and the words. Of equal letters in a row only the first is left out."""
    n, length = letters.shape
    for i in range(length):
        distinct = np.arange(n) if i == 0 else np.flatnonzero(letters[:, i] != letters[:, i - 1])
        shorter = np.delete(letters[distinct], i, axis=1)
        hit = shard.holds(_mixed(word_sums(shorter)))
        yield distinct[hit], [row.tobytes().decode("latin-1") for row in shorter[hit]]


def replacements(letters: np.ndarray, shard: Shard, rows_at_once: int = 2048) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of the shard with one letter of a row replaced by a greater one."""
    terms = _terms(letters.shape[1])
    for low in range(0, len(letters), rows_at_once):
        some = letters[low : low + rows_at_once]
        sums = word_sums(some)
        for i in range(letters.shape[1]):
            row, letter = np.nonzero(some[:, i, None] < ALPHABET)
            hit = shard.holds(_mixed((sums - terms[i, some[:, i]])[row] + terms[i, ALPHABET][letter]))
            changed = some[row[hit]]
            changed[:, i] = ALPHABET[letter[hit]]
            yield low + row[hit], [word.tobytes().decode("latin-1") for word in changed]


def _shards(lengths: list[tuple[int, int]], filter_bytes: int) -> list[list[Shard]]:
    """Shards for (length, number of words), in groups that are broadcast together."""
    groups: list[list[Shard]] = [[]]
    for length, n in lengths:
        parts = max(1, -(-n * BITS_A_WORD // (8 * filter_bytes)))
        if parts > 256:
            raise ValueError("filter_bytes is too small for this vocabulary")
        for part in range(parts):
            shard = Shard(length, part, parts, max(1, -(-n * BITS_A_WORD // (parts * 64 * BLOCK_LANES))))
            if groups[-1] and 64 * (shard.blocks + sum(s.blocks for s in groups[-1])) > filter_bytes:
                groups.append([])
            groups[-1].append(shard)
    return [g for g in groups if g]


def _filled(spark: SparkSession, words: DataFrame, shards: list[Shard]) -> list[Shard]:
    """The shards with their filters; lanes are combined by Spark, so what comes here is at most the filters themselves."""

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for length, _, letters in _by_length(batch):
                hashes = _mixed(word_sums(letters))
                for k, shard in enumerate(shards):
                    if shard.length == length:
                        mine = hashes if shard.parts == 1 else hashes[shard.mine(hashes) == shard.part]
                        lane, mask = shard.lane_masks(mine)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lane), k, np.int32)), pa.array(lane.astype(np.int64)), pa.array(mask.view(np.int64))], ["shard", "lane", "mask"])

    wanted = words.where(F.length("word").isin([s.length for s in shards])).select("word")
    combined = wanted.mapInArrow(lanes, "shard int, lane long, mask long").groupBy("shard", "lane").agg(F.bit_or("mask").alias("mask")).toArrow()
    k, lane, mask = (combined.column(c).to_numpy() for c in ("shard", "lane", "mask"))
    for i, shard in enumerate(shards):
        shard.lanes = np.zeros(shard.blocks * BLOCK_LANES, np.uint64)
        shard.lanes[lane[k == i]] = mask[k == i].view(np.uint64)
    return shards


def near_words(words: DataFrame, filter_bytes: int = 32 << 20) -> DataFrame:
    """(word, n, near, near_n) for all ordered pairs of near words of `words` (word, n), a written table whose words are distinct."""
    spark = words.sparkSession
    lengths = [tuple(r) for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*")).orderBy("length").collect()]
    cores = spark.sparkContext.defaultParallelism
    candidates = spark.createDataFrame([], "word string, n long, edit string")
    for group in _shards(lengths, filter_bytes):
        filled = [(s.length, s.part, s.parts, s.blocks, s.lanes) for s in _filled(spark, words, group)]
        shared = spark.sparkContext.broadcast(filled)

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shards = [Shard(*s) for s in shared.value]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for length, at, letters in _by_length(batch):
                    rows: list[np.ndarray] = []
                    edits: list[str] = []
                    for shard in shards:
                        made = replacements if shard.length == length else deletions if shard.length == length - 1 else None
                        for hit, edited in made(letters, shard) if made else ():
                            rows.append(at[hit])
                            edits += edited
                    from_rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(from_rows), batch.column("n").take(from_rows), pa.array(edits, pa.string())], list(PAIRS))

        reach = sorted({s.length for s in group} | {s.length + 1 for s in group})
        probing = words.where(F.length("word").isin(reach)).repartition(cores, "word")
        candidates = candidates.unionByName(written(probing.mapInArrow(probe, "word string, n long, edit string"), "spelling-edits"))
        shared.destroy()
    met = candidates.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    pair = lambda a, a_n, b, b_n: F.struct(F.col(a).alias("word"), F.col(a_n).alias("n"), F.col(b).alias("near"), F.col(b_n).alias("near_n"))
    return met.select(F.inline(F.array(pair("word", "n", "edit", "edit_n"), pair("edit", "edit_n", "word", "n"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form), words that have a form: the last word that forms lead to. Forms form no circle. Each
    round doubles the steps that are taken, so a handful do."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = now.groupBy("root").agg(F.count("*").alias("n")).join(next_, "root")
        moved = attach_by_key(now, met, ["root"], "n", now.count())
        moved = written(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, drop_one_in: int = 199, filter_bytes: int = 32 << 20) -> DataFrame:
    """One row per word of `docs`: word, form (its near word of largest number, ties by code points, if that number is at least
    `times` the word's, else null), root (the last that forms lead to, from the word), n, n_near (its near words), form_n (the form's number)."""
    bounded_batches(docs.sparkSession)
    words = written(vocabulary(docs, least_length, least_count, drop_one_in), "vocabulary")
    near = near_words(words, filter_bytes)
    # the least of (-number, word) is the largest number's first word
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"), F.first("n").alias("n"))
    led = F.when(-F.col("best.col1") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n")))
    met = written(best.select("word", "n_near", led.alias("led")).select("word", "n_near", "led.form", "led.form_n"), "near-words")
    ends = roots(met.where("form IS NOT NULL").select("word", "form"))
    found = words.join(met, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

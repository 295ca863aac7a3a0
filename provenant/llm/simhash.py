"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the bitwise majority of its word shingles' hashes; fingerprints that differ in few bits
are linked, and documents whose fingerprints are connected form a class. References, the pivots, are fixed fingerprints
to which each document's distances are computed once; a table of them tells which pairs need to be looked at, and the
bits decide on those. How the table is used depends on the distance:

* `near_duplicates` links fingerprints within a few bits. Two that differ in k bits differ by at most k in each pivot
  distance. A table alone would still have to be compared row by row with all others, so pairs are first bounded by
  equal bits: cut into b bands, fingerprints that differ in k bits agree in at least b - k of them, so each link meets
  in some block of equal bits in b - k bands. Within a block rows are sorted by a pivot distance, only those within k
  of each other there are paired, the largest difference of the other coordinates discards pairs and the bits decide on
  the rest. No link is lost, and b follows from the number of fingerprints so that blocks stay small at any size.
* `keep_one_of_each` links texts that share 0.8 or more of their distinct five-word shingles (those in both, of those in either). The
  cosine of such sets is at least 0.889, so that at most some 0.152 of bits differ. Distances to references that are far from
  everything all lie close to half the bits; what tells texts apart is which reference is nearest. Distances are weighted, a bit by how clear its
  majority is, and the nearest of 512 references (256 fingerprints and their complements), or of several sets of
  them, makes a cell. Texts of that similarity share the nearest of 512 with probability 0.38, unrelated ones 1 in
  512; so cells of a dozen tables with others' references hold a pair with probability `RECALL`, and tables grow
  slower than the fourth root of the documents. Within a cell, a table of distances to fingerprints of the cell itself discards pairs whose
  coordinates differ by more than bits may, and 2048 bits leave candidates. What candidates connect is compared by its shingles, exactly.

Blocks and cells that are large all the same, such as groups of thousands of near copies, are cut into tiles and each
pair of tiles is one unit of work. A unit emits a link from each fingerprint to the first that it is connected with,
so links grow with the rows, never with their pairs.

Defined results: null and empty texts have fingerprint zero and are linked like others; equal fingerprints are one
class; repeated rows are members each; null doc_ids are never a class's id unless all are null; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, bounded_batches, likely_among, text_or_empty, written
from .components import components

#: References of `near_duplicates`, and fingerprints in a tile.
N_PIVOTS, TILE = 32, 8192
#: Words of 64 bits that decide on similarity, bits that one set of references looks at, references in a set.
WORDS, SET_BITS, SET_SIZE = 32, 256, 256
#: The similarity of texts: the share of their distinct shingles that both have. At 0.8 or more the cosine of their sets is at least 0.889, and
#: at most 0.152 of bits are expected to differ.
SHARE = 0.8
#: Of 256 bits and of all, how many may differ for a pair to be compared: at a share of 0.8 at most 39 and 310 do, give or take 6 and 16; at
#: 0.7 49 and 393, of unrelated texts half.
FIRST_APART, ALL_APART = 60, 355
#: Words that are compared first, and of their 128 bits how many may differ: at most 19 do at 0.8, give or take 4, and 64 of unrelated texts.
HEAD_WORDS, HEAD_APART = 2, 34
#: Probability that two texts of cosine 0.889 have the same nearest of 2 ** bits references, as measured; and the
#: probability that such a pair shall share a cell of some table.
SAME_NEAREST = {4: 0.581, 5: 0.527, 6: 0.481, 7: 0.435, 8: 0.411, 9: 0.380}
RECALL = 0.98
#: Fingerprints of a cell, to which the distances of all of them make its table.
OWN_PIVOTS = 8
#: Texts and their bytes in a tile of those that are compared by their shingles.
SHARED_TILE, SHARED_BYTES = 4096, 16 << 20
#: Hashes of a text that are widened to WORDS words at a time.
PART = 1 << 14
#: Handling a row takes as long as comparing so many pairs.
ROW_COST = 100

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, of the whole sequence if it is shorter, of nothing if there are no words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts, ends = (ends - lengths).tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Of hashes (n, words), for each bit from the lowest on, how many have it set: counts of each byte's values first."""
    width = 8 * hashes.shape[1]
    seen = np.zeros(width * 256, np.int64)
    at = np.arange(width) * 256
    for i in range(0, len(hashes), 1 << 12):
        rows = np.ascontiguousarray(hashes[i : i + (1 << 12)].astype("<u8")).view(np.uint8).reshape(-1, width)
        seen += np.bincount((rows + at).ravel(), minlength=width * 256)
    return (seen.reshape(width, 256) @ _BYTE_BITS).ravel()


def fingerprint(text: str, shingle: int) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(text, shingle)
    return int(np.packbits(bit_counts(hashes[:, None]) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, tie (the text's hash), fp (the unsigned bits as a signed long) for each row of `docs`."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(found)], ["doc_id", "tie", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, tie long, fp long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))


# --- blocks of equal bits, for small distances


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 0) for i in range(N_PIVOTS)], np.uint64)


def bands_for(n: int, distance: int) -> int:
    """The number of bands with the least work for n fingerprints: rows in all tables, and pairs in their blocks."""

    def work(bands: int) -> float:
        equal_bits = 64 * (bands - distance) / bands
        return comb(bands, distance) * (n + n * n / 2 ** (equal_bits + 1) / 500)  # a row takes a pair's time some 500 times

    return min(range(distance + 1, distance + 8), key=work)


def masks_for(bands: int, distance: int) -> list[int]:
    """For each choice of bands - distance bands, their bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    band = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(band, bands - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- cells of nearest references, for similarities


def cell_bits_for(n: int) -> tuple[int, int]:
    """(bits of a cell's number, tables) with the least work for n texts."""

    def tables(bits: int) -> int:
        same = SAME_NEAREST[9] ** (bits // 9) * SAME_NEAREST.get(bits % 9, 1.0)
        return ceil(log(1 - RECALL) / log(1 - same))

    choices = [b for b in range(4, 64) if not b % 9 or b % 9 in SAME_NEAREST]
    best = min(choices, key=lambda b: tables(b) * (n * ROW_COST + n * n / 2 ** (b + 1)))
    return best, tables(best)


def reference_set(number: int) -> np.ndarray:
    """(SET_BITS, SET_SIZE) signs of the references of a set."""
    words = np.array([xxhash.xxh64_intdigest(f"reference {number} {i}".encode(), 0) for i in range(SET_BITS * SET_SIZE // 64)], "<u8")
    return np.unpackbits(words.view(np.uint8)).reshape(SET_BITS, SET_SIZE).astype(np.float32) * 2 - 1


class Cells:
    """Cell numbers of documents from how many of their hashes have each bit."""

    def __init__(self, bits: int, tables: int):
        self.parts = [9] * (bits // 9) + [bits % 9] * (bits % 9 > 0)  # bits that each of a table's sets gives
        self.tables = tables
        self.sets = [reference_set(i)[:, : 1 << (b - 1)] for i, b in enumerate(self.parts * tables)]

    def __call__(self, balance: np.ndarray) -> np.ndarray:
        """balance (n, 64 * WORDS), by bit the hashes with it less those without: (n, tables) cell numbers."""
        cells = np.zeros((len(balance), self.tables), np.int64)
        rows = np.arange(len(balance))
        for i, signs in enumerate(self.sets):
            at = i % (64 * WORDS // SET_BITS) * SET_BITS
            # the weighted distance to a reference falls as this agreement rises; the complement's is the opposite
            agreement = balance[:, at : at + SET_BITS] @ signs
            nearest = np.abs(agreement).argmax(1)
            t = i // len(self.parts)
            cells[:, t] = cells[:, t] * (2 * signs.shape[1]) + 2 * nearest + (agreement[rows, nearest] < 0)
        return cells


def _more_hashes(hashes: np.ndarray) -> np.ndarray:
    """(n, WORDS) further hashes of each hash."""
    odd = np.array([xxhash.xxh64_intdigest(f"word {i}".encode(), 0) | 1 for i in range(WORDS)], np.uint64)
    more = (hashes ^ (hashes >> np.uint64(31)))[:, None] * odd
    return more ^ (more >> np.uint64(29))


def signatures(docs: DataFrame, bits: int, tables: int, shingle: int = 5) -> DataFrame:
    """doc_id, tie (the text's hash), bits (8 * WORDS bytes), cells (one of each table) for each row of `docs`."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of = Cells(bits, tables)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512).to_pylist()
                balance, signs = np.zeros((len(part), 64 * WORDS), np.float32), []
                for i, text in enumerate(part):
                    hashes = np.unique(shingle_hashes(text, shingle))
                    counts = sum((bit_counts(_more_hashes(hashes[j : j + PART])) for j in range(0, len(hashes), PART)), np.zeros(64 * WORDS))
                    difference = 2 * counts - len(hashes)
                    signs.append(np.packbits(difference > 0, bitorder="little").tobytes())
                    balance[i] = difference / max(1, len(hashes))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(cells_of(balance).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 512), batch.column("tie").slice(at, 512), pa.array(signs, pa.binary()), cells], ["doc_id", "tie", "bits", "cells"])

    return _texts(docs).mapInArrow(run, "doc_id long, tie long, bits binary, cells array<long>")


# --- pairs within blocks and cells


@dataclass(frozen=True)
class WithinBits:
    """Fingerprints of one word that differ in at most `distance` bits."""

    distance: int

    def table(self, words: np.ndarray) -> np.ndarray:
        """Pivot distances."""
        return np.bitwise_count(words[:, :1] ^ pivots()).astype(np.int8)

    def close(self, words: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = np.abs(table[a] - table[b]).max(1) <= self.distance
        near[near] = np.bitwise_count(words[a[near], 0] ^ words[b[near], 0]) <= self.distance
        return near

    def order(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.argsort(table[:, 0], kind="stable")

    def candidates(self, words: np.ndarray, table: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row from `at` to `to` with any row, rows being in order: no others have to be looked at."""
        first = table[:, 0]
        lo, hi = np.searchsorted(first, first[at] - self.distance), np.searchsorted(first, first[to - 1] + self.distance, "right")
        near = np.ones((to - at, hi - lo), bool)
        for c in range(4):
            near &= np.abs(table[at:to, None, c] - table[None, lo:hi, c]) <= self.distance
        a, b = np.nonzero(near)
        return a + at, b + lo


@dataclass(frozen=True)
class Similar:
    """Bits of WORDS words that differ in at most `first` of the first SET_BITS and `most` of all."""

    first: int
    most: int

    def table(self, words: np.ndarray) -> np.ndarray:
        """Distances to some of the fingerprints themselves, evenly chosen."""
        chosen = words[:: max(1, len(words) // OWN_PIVOTS)][:OWN_PIVOTS]
        return np.stack([np.bitwise_count(words ^ p).sum(1, dtype=np.int16) for p in chosen], axis=1) if len(chosen) else np.zeros((0, 0), np.int16)

    def close(self, words: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) <= self.most

    def order(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.arange(len(words))

    def candidates(self, words: np.ndarray, table: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.ones((to - at, len(words)), bool)
        for c in table.T:
            near &= np.abs(c[at:to, None] - c[None, :]) <= self.most
        a, b = np.nonzero(near)
        a += at
        kept = np.bitwise_count(words[a, : SET_BITS // 64] ^ words[b, : SET_BITS // 64]).sum(1, dtype=np.int64) <= self.first
        return a[kept], b[kept]


def linked_to(words: np.ndarray, near: WithinBits | Similar) -> np.ndarray:
    """For each of a unit's fingerprints the place of one that it is connected with, the same for all that are."""
    table = near.table(words)
    order = near.order(words, table)
    words, table = words[order], table[order]
    n = len(words)
    label = np.arange(n)
    for at in range(0, n, 256):
        a, b = near.candidates(words, table, at, min(at + 256, n))
        a, b = a[a < b], b[a < b]
        for i in range(0, len(a), 1 << 17):  # pairs are looked at in parts, and links at once followed
            x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            is_near = near.close(words, table, x, y)
            for j, k in zip(x[is_near].tolist(), y[is_near].tolist(), strict=True):
                if label[j] != label[k]:
                    label[label == max(label[j], label[k])] = min(label[j], label[k])
    to = np.empty(n, np.int64)
    to[order] = order[label]
    return to


def over_units(handle):
    """Over rows (t, key, lo, hi, node, bits) sorted by the unit t, key, lo, hi: batches of what `handle` makes of whole
    units, given their columns, the first rows of units and their sizes."""
    columns = ("t", "key", "lo", "hi", "node")

    def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        changed = np.zeros(len(rows[0]), bool)
        changed[0] = True
        for c in rows[:4]:
            changed[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changed)
        return handle(rows, starts, np.diff(np.append(starts, len(rows[0]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            now.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<u8").reshape(len(now[0]), -1))
            if held is not None and len(held[0]):
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.ones(len(now[0]), bool)
            for c in now[:4]:
                last &= c == c[-1]
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last unit may go on
            held = [x[cut:] for x in now]
            if cut:
                yield whole([x[:cut] for x in now])
        if held is not None and len(held[0]):
            yield whole(held)

    return run


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows in units of two and three."""
    two, three = starts[sizes == 2], starts[sizes == 3]
    return np.concatenate([two, three, three, three + 1]), np.concatenate([two + 1, three + 1, three + 2, three + 2])


def link_units(near: WithinBits | Similar):
    """Links (a, b) of nodes in units."""

    def links(rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        node, words = rows[4], rows[5]
        a, b = _small_pairs(starts, sizes)
        is_near = near.close(words, near.table(words), a, b) if len(a) else np.zeros(0, bool)
        found = [(node[a[is_near]], node[b[is_near]])]
        for start, size in zip(starts[sizes > 3], sizes[sizes > 3], strict=True):
            of = slice(start, start + size)
            to = linked_to(words[of], near)
            moved = to != np.arange(size)
            found.append((node[of][moved], node[of][to[moved]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], ["a", "b"])

    return over_units(links)


def met_units(most: int):
    """The rows of units, without bits, that differ in at most `most` bits from another row of their unit."""

    def met(rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        words, kept = rows[5], np.zeros(len(rows[0]), bool)
        a, b = _small_pairs(starts, sizes)
        near = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) <= most
        kept[a[near]] = kept[b[near]] = True
        for start, size in zip(starts[sizes > 3], sizes[sizes > 3], strict=True):
            own = words[start : start + size]
            for at in range(0, size, 256):
                apart = np.zeros((min(256, size - at), size), np.int16)
                for w in own.T:
                    apart += np.bitwise_count(w[at : at + 256, None] ^ w[None, :])
                kept[start + at : start + min(at + 256, size)] = (apart <= most).sum(1) > 1  # one is the row itself
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in rows[:5]], ["t", "key", "lo", "hi", "node"])

    return over_units(met)


def in_units(rows: DataFrame) -> DataFrame:
    """Rows (t, key, lo, hi, node, bits) dealt out by unit, in order."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("t", "key", "lo", "hi", "node", "bits")
    return rows.repartition(n_parts, "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "node")


def tiled(met: DataFrame) -> DataFrame:
    """Rows (t, key, m, node, bits), m how many rows the block or cell (t, key) has, once for each pair of tiles (lo, hi)."""
    tiles = F.ceil(F.col("m") / TILE)
    met = met.withColumns({"tiles": tiles, "own": F.pmod(F.xxhash64("node"), tiles)})
    met = met.select("t", "key", "node", "bits", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    return met.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "bits")


def shared_keys(classes: DataFrame, keys: Column, total: int) -> DataFrame:
    """classes (node, bits) as (t, key, m, node, bits) for those keys, an array a table, that more than one class has; `total` is
    how many keys there are."""
    rows = classes.select("node", "bits", F.posexplode(keys).alias("t", "key"))
    blocks = rows.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    return attach_by_key(rows, blocks, ["t", "key"], "m", total).where("m is not null")


def links_by_bits(classes: DataFrame, distance: int, n: int) -> DataFrame:
    """Links (a, b) that connect all classes (node = fp) whose fp differ in at most `distance` bits."""
    masks = masks_for(bands_for(n, distance), distance)
    keys = F.array(*[F.col("node").bitwiseAND(F.lit(_signed(m))) for m in masks])
    own = classes.select("node", F.unhex(F.lpad(F.hex("node"), 16, "0")).alias("bits"))
    return in_units(tiled(shared_keys(own, keys, n * len(masks)))).mapInArrow(link_units(WithinBits(distance)), "a long, b long").distinct()


def links_by_similarity(classes: DataFrame, n: int, tables: int) -> DataFrame:
    """Links (a, b) of classes (node, bits, cells) that share a cell and have similar bits. Most that share a cell are not
    alike: a few words of bits rule them out, and only what is left is joined to its other bits."""
    heads = classes.select("node", F.substring("bits", 1, 8 * HEAD_WORDS).alias("bits"), "cells")
    met = in_units(tiled(shared_keys(heads, F.col("cells"), n * tables))).mapInArrow(met_units(HEAD_APART), "t int, key long, lo long, hi long, node long")
    units = in_units(met.join(classes.select("node", "bits"), "node"))
    return units.mapInArrow(link_units(Similar(FIRST_APART, ALL_APART)), "a long, b long").distinct()


def shared_links(shingle: int):
    """Over rows (comp, lo, hi, own, node, bits, text) sorted by (comp, lo, hi): links (a, b) of nodes whose texts share SHARE of their distinct
    shingles, as many as connect all that are so linked within a unit. Bits tell which pairs are compared, and pairs that
    links connect already aren't."""

    def of_unit(own: list[int], hi: int, lo: int, node: list[int], bits: list[bytes], texts: list[str]) -> Iterator[tuple[int, int]]:
        words = np.frombuffer(b"".join(bits), "<u8").reshape(len(node), -1)
        near_bits = Similar(FIRST_APART, ALL_APART)
        table = near_bits.table(words)
        sets: dict[int, np.ndarray] = {}
        label = np.arange(len(node))
        side = np.array(own)

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(texts[i], shingle))
            return sets[i]

        for at in range(0, len(node), 256):
            first, second = near_bits.candidates(words, table, at, min(at + 256, len(node)))
            wanted = (first < second) & ((lo == hi) | (side[first] != side[second]))
            first, second = first[wanted], second[wanted]
            for i in range(0, len(first), 1 << 14):
                x, y = first[i : i + (1 << 14)], second[i : i + (1 << 14)]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                near = near_bits.close(words, table, x, y)
                for j, k in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    if label[j] == label[k]:
                        continue
                    a, b = shingles(j), shingles(k)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= SHARE * (len(a) + len(b) - both):
                        label[label == max(label[j], label[k])] = min(label[j], label[k])
                        yield node[j], node[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            found = list(of_unit([r[0] for r in rows], key[2], key[1], *map(list, list(zip(*rows))[1:]))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("comp", "lo", "hi", "own", "node", "bits", "text")]
            for comp, lo, hi, *row in zip(*columns, strict=True):
                if (comp, lo, hi) != key:
                    if rows:
                        yield links()
                    key, rows = (comp, lo, hi), []
                rows.append(row)
        if rows:
            yield links()

    return run


def links_by_share(docs: DataFrame, classes: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of classes (node, bits, first) whose texts share SHARE of their shingles, among those that candidates (a, b) connect.
    Only these are joined to their texts, once each whatever the number of tables that they met in."""
    roots = components(candidates)
    ends = roots.select("root").distinct().select(F.col("root").alias("node"), F.col("root").alias("comp"))
    met = written(classes.join(roots.withColumnRenamed("root", "comp").unionByName(ends), "node").select("comp", "node", "bits", F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie")), "near-classes")
    asked = likely_among(_texts(docs), met, ["doc_id", "tie"], max(1, met.count())).where("likely").drop("likely")
    asked = asked.groupBy("doc_id", "tie").agg(F.min("text").alias("text")).withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    texts = met.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("comp", "node", "bits", "text")
    texts = written(texts, "near-texts")
    tiles = F.ceil(F.greatest(F.sum(F.octet_length("text")) / SHARED_BYTES, F.count("*") / SHARED_TILE))
    sized = texts.groupBy("comp").agg(F.count("*").alias("n"), tiles.alias("tiles"))
    dealt = attach_by_key(texts, sized, ["comp"], "n", texts.count()).withColumn("own", F.pmod(F.xxhash64("node"), "tiles"))
    dealt = dealt.select("comp", "own", "node", "bits", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "bits", "text")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = dealt.repartition(n_parts, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "node")
    return units.mapInArrow(shared_links(shingle), "a long, b long")


def _rooted(classes: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """(node, n_docs, first) of classes (node, first, n_docs): the first row of all classes that links lead to."""
    roots = components(links).withColumnRenamed("node", "linked")
    rooted = classes.join(roots, F.col("node") == F.col("linked"), "left").select("node", "first", "n_docs", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "fingerprint-roots")
    firsts = written(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n_nodes")), "fingerprint-firsts")
    named = attach_by_key(rooted.select("node", "n_docs", "root"), firsts, ["root"], "n_nodes", n)
    return written(named.select("node", "n_docs", "first"), "fingerprint-components")


#: The first row of a class has the smallest doc_id, then hash of text; a null doc_id comes last.
_ROW = ("no_id", "doc_id", "tie")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id that
    links lead to, its own included)."""
    marked = written(fingerprints(docs, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    classes = written(marked.groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("n_docs")), "fingerprint-classes")
    n = classes.count()
    named = _rooted(classes, links_by_bits(classes.select("node"), distance, n), n)
    n_docs = named.agg(F.sum("n_docs")).first()[0] or 0
    out = attach_by_key(marked, named, ["node"], "n_docs", n_docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def similar_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(node, n_docs, first) of classes of equal bits: first is the first row (no_id, doc_id, tie) of all that are
    linked. Two texts are linked if they share SHARE of their distinct shingles."""
    bits, tables = cell_bits_for(max(docs.count(), 1))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "cells")
    classes = signatures(docs, bits, tables, shingle).groupBy("bits").agg(F.min(row).alias("first"), F.count("*").alias("n_docs"))
    # numbered as they are written, so that different bits never share a node
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "bits", "first.cells", F.struct(*[f"first.{c}" for c in _ROW]).alias("first"), "n_docs"), "signature-classes")
    n = classes.count()
    candidates = links_by_similarity(classes.select("node", "bits", "cells"), n, tables)
    links = links_by_share(docs, classes.select("node", "bits", "first"), candidates, shingle)
    return _rooted(classes.select("node", "first", "n_docs"), links, n)


def keep_one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of `docs`, with all its columns, that are the first of their class; of repeated rows one."""
    firsts = similar_classes(docs, shingle).select(F.col("first.doc_id").alias("id"), F.col("first.tie").alias("tie")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    kept = keyed.join(firsts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("tie")))
    same = Window.partitionBy("id", "tie").orderBy("tie")
    return kept.withColumn("n", F.row_number().over(same)).where("n = 1").select("row.*")

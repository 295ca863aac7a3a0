"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words; a document of a source is then to be taken target / source size times on
average: a whole number of times, and once more with a probability below one. The flight phase of the cube method
moves these probabilities along the null space of two constraints, the totals of words and of documents, three
documents at a time, until each is 0 or 1. It streams through blocks of each source, so neither memory nor a task
grows with a source; of each block two documents and a few that are kept back stay undecided. These are blocked and
moved again, until one block per source is left. The landing phase decides what is undecided there, so that the
totals come out as near as a choice among them can make them.

Documents that hold a large part of their source, of which a source has LARGE at most, would leave more open at the end than others can make up for.
They are decided first, each after the first so that words stay near what is expected, and the others' probabilities are moved by what that leaves.

Defined results: a null text has size 0; the null source comes last in order of code points; repeated rows are
units of their own; a source without words has target 0 and its documents are taken 0 times; other columns are
ignored or carried along. All randomness comes from the seed, the source's rank and the block: reruns agree.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, bounded_batches, text_or_empty, word_count, written

#: Documents of a source that one block's flight goes through, and those of them that are kept back for landing: half of them the
#: block's largest, half those in the middle of its sizes, so that what a large one leaves open others can make up for.
#: A block must be at least twice what stays of it, LANDING + 2.
BLOCK, LANDING = 5000, 12
#: Numbers of words that differ by so little of what is landed are as near as one another.
WORDS_OFF = 0.0005
#: A document is large if it holds one in so many of its source's words.
LARGE = 200
#: So many sources are broadcast; where there are more, only those with many documents are.
FEW_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: float = 3.0) -> DataFrame:
    """source, n_docs, source_size, rank, target from (source, size).

    Sources by code point, null last, have the weights in turn. Targets share the sum of sizes by weight, but stop
    at most_repeats times the source's size; what is above is shared again by weight among the others, until none
    is above: targets end as the lesser of that bound and weight times a common level, which is what is computed.
    """
    spark = sized.sparkSession
    order = F.col("source").asc_nulls_last()
    totals = written(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    placed = totals.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("part", F.spark_partition_id())
    placed = written(placed, "sources-in-order")
    before, at = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one number per partition
        before.append((part, at))
        at += n
    starts = spark.createDataFrame(before, "part int, before long")
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "n_docs", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * most_repeats).alias("bound"))
    ranked = written(ranked, "source-weights")

    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, bounded = 0.0, -1
    while True:  # the set of bounded sources only grows; a few rounds do
        above = F.col("bound") < F.col("weight") * level
        row = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("bound"))), F.sum(F.when(~above, F.col("weight")))).first()
        if row[0] == bounded:
            break
        bounded = row[0]
        level = max(level, (total - (row[1] or 0.0)) / row[2]) if row[2] else level
    return ranked.select("source", "n_docs", "source_size", "rank", F.least("bound", F.col("weight") * level).alias("target"))


class _Unit:
    __slots__ = ("size", "p", "at", "slice")

    def __init__(self, size: float, p: float, at: int):
        self.size, self.p, self.at, self.slice = size, p, at, None


def _null_vector(units: list[_Unit]) -> list[float]:
    """A direction that keeps the sums of size * p and of p."""
    a, b, c = (u.size for u in units)
    v = [b - c, c - a, a - b]
    return v if any(v) else [1.0, -1.0, 0.0]


def _step(units: list[_Unit], rng: random.Random) -> None:
    """Move along the null vector, one way or the other, as far as the unit cube goes; at least one p becomes 0 or 1."""
    v = _null_vector(units)
    up = min((1 - u.p) / x if x > 0 else u.p / -x for u, x in zip(units, v, strict=True) if x)
    down = min(u.p / x if x > 0 else (1 - u.p) / -x for u, x in zip(units, v, strict=True) if x)
    move = up if rng.random() * (up + down) < down else -down
    for u, x in zip(units, v, strict=True):
        p = u.p + move * x
        u.p = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _land(units: list[_Unit]) -> None:
    """Decide the last units: of the choices whose number of words is nearest, or about as near, that with the nearest number of
    documents."""
    sizes, p = np.array([u.size for u in units]), np.array([u.p for u in units])
    choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    words_off, docs_off = np.abs(choices @ sizes - sizes @ p), np.abs(choices.sum(1) - p.sum())
    near_best = words_off <= words_off.min() + WORDS_OFF * (sizes @ p)
    best = np.lexsort((words_off, docs_off, ~near_best))[0]
    for u, x in zip(units, choices[best], strict=True):
        u.p = float(x)


def _fly(seed: int, level: int):
    """Over rows sorted by (rank, block): replaces p by 0, 1 or, for the undecided of a block, what it has come to."""

    def flight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, active, reserve, rng, last_block = None, [], deque(), None, False

        def with_p(batch: pa.RecordBatch, p: list[float]) -> pa.RecordBatch:
            return batch.set_column(batch.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

        def close() -> list[_Unit]:
            """The group's units that are still open; decided if the block is the source's only one."""
            ended = [*active, *reserve]
            if last_block and ended:
                _land(ended)
            active.clear()
            reserve.clear()
            return ended

        for batch in batches:
            ranks, blocks, n_blocks = (batch.column(c).to_pylist() for c in ("rank", "block", "blocks"))
            sizes, probabilities = batch.column("size").to_pylist(), batch.column("p").to_pylist()
            late: list[_Unit] = []  # units of earlier batches that are settled now

            def settle(units: list[_Unit]) -> None:
                for u in units:
                    if u.slice is None:
                        probabilities[u.at] = u.p  # noqa: B023
                    else:
                        late.append(u)  # noqa: B023

            for i, key in enumerate(zip(ranks, blocks, strict=True)):
                if key != group:
                    settle(close())
                    group, rng, last_block = key, random.Random(f"{seed}:{level}:{key}"), n_blocks[i] == 1
                if 0 < probabilities[i] < 1:
                    reserve.append(_Unit(float(sizes[i]), probabilities[i], i))
                    if len(reserve) <= LANDING:
                        continue
                    active.append(reserve.popleft())
                    if len(active) == 3:
                        _step(active, rng)
                        settle([u for u in active if not 0 < u.p < 1])
                        active[:] = [u for u in active if 0 < u.p < 1]
            open_now = {u.at for u in (*active, *reserve) if u.slice is None}
            for u in (*active, *reserve):
                if u.slice is None:
                    u.slice = batch.slice(u.at, 1)
            out = with_p(batch, probabilities)
            if open_now:
                out = out.filter(pa.array([i not in open_now for i in range(len(probabilities))]))
            yield out
            for u in late:
                yield with_p(u.slice, [u.p])
        for u in close():
            yield with_p(u.slice, [u.p])

    return flight


def _settle_large(seed: int):
    """Over rows sorted by (rank, size descending): replaces p by 0 or 1, the first by chance, others by what has been taken so far."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, ahead = None, 0.0
        for batch in batches:
            decided = []
            for r, size, p in zip(*(batch.column(c).to_pylist() for c in ("rank", "size", "p")), strict=True):
                owed = p * size + (ahead if r == rank else 0.0)
                take = owed * 2 >= size if r == rank else random.Random(f"{seed}:large:{r}").random() < p
                rank, ahead = r, owed - size * take
                decided.append(float(take))
            yield batch.set_column(batch.schema.get_field_index("p"), "p", pa.array(decided, pa.float64()))

    return settle


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_repeats: int = 3, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, and what
    is named in `carry`. copies is how often the mix takes the document, taken its words times that."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("tie"), *kept)
    slim = written(rows.select("source", "size"), "sizes")
    targets = source_targets(slim, weights, most_repeats)
    n_docs, largest, n_sources = targets.agg(F.sum("n_docs"), F.max("n_docs"), F.count("*")).first()

    times = F.when(F.col("source_size") > 0, F.least(F.lit(float(most_repeats)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    if n_sources <= FEW_SOURCES:
        few = F.broadcast(targets.withColumnRenamed("source", "_source"))
        units = rows.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    else:
        units = attach_by_key(rows, targets, ["source"], "n_docs", n_docs or 0)
    units = units.withColumn("times", times)
    units = units.withColumns({"base": F.floor("times").cast("int"), "p": F.col("times") - F.floor("times"), "blocks": F.ceil(F.col("n_docs") / BLOCK)})
    columns = ["doc_id", "tie", "size", "source_size", "target", "rank", "base", "p", "blocks", "block", *[f"carry_{i}" for i in range(len(carry))]]

    def level_of(rows: DataFrame, level: int) -> DataFrame:
        mixed = [F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("doc_id"), F.col("tie")]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        block = Window.partitionBy("rank", "block")
        # the flight keeps back a block's last ones
        nth = F.row_number().over(block.orderBy(F.desc("size"), *mixed))
        dealt = rows.repartition(n, "rank", "block").withColumns({"nth": nth, "of": F.count("*").over(block)})
        half = LANDING // 2
        last = (F.col("nth") <= half) | F.col("nth").between(F.ceil(F.col("of") / 2) - half // 2 + 1, F.ceil(F.col("of") / 2) + half - half // 2)
        ready = dealt.withColumn("last", last).sortWithinPartitions("rank", "block", "last", *mixed).select(*columns)
        return ready.mapInArrow(_fly(seed, level), ready.schema)

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_large = (F.col("size") * LARGE >= F.col("source_size")) & (F.col("p") > 0) & (F.col("p") < 1)
    large = units.where(is_large).withColumn("block", F.lit(-1).cast("long")).select(*columns)
    large = large.repartition(n_parts, "rank").sortWithinPartitions("rank", F.desc("size"), F.xxhash64("doc_id", "tie", F.lit(seed)), "doc_id", "tie")
    large = written(large.mapInArrow(_settle_large(seed), large.schema), "large-documents")
    left = large.groupBy("rank").agg(F.sum("size").alias("large_size"), F.sum(F.col("size") * F.col("p")).alias("large_taken"))
    if n_sources <= FEW_SOURCES:
        rest = units.where(~is_large).join(F.broadcast(left), "rank", "left")
    else:
        rest = attach_by_key(units.where(~is_large), left.join(targets.select("rank", F.col("n_docs").alias("of_rank")), "rank"), ["rank"], "of_rank", n_docs or 0).drop("of_rank")
    moved = F.col("p") + (F.col("p") * F.col("large_size") - F.col("large_taken")) / (F.col("source_size") - F.col("large_size"))
    moves = F.col("large_size").isNotNull() & (F.col("p") > 0) & (F.col("p") < 1) & (F.col("source_size") > F.col("large_size"))
    units = rest.withColumn("p", F.when(moves, F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("p")))

    # Blocks and the order in them follow from the rows alone, so that reruns agree; rows that can't be told apart
    # come out alike whichever of them is taken.
    flown = level_of(units.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("blocks"))), 0)
    done, level, blocks = [], 0, -(-(largest or 0) // BLOCK)
    while blocks > 1:
        flown = written(flown, f"flight-{level}")
        done.append(flown.where("p = 0 or p = 1"))
        level += 1
        blocks = -(-(LANDING + 2) * blocks // BLOCK)
        again = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * (LANDING + 2) / BLOCK))
        flown = level_of(again.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed + level)), F.col("blocks"))), level)
    for part in (*done, large):
        flown = flown.unionByName(part.select(*columns))
    copies = (F.col("base") + F.col("p")).cast("int")
    return flown.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])

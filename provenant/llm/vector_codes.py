"""Vector codes: product quantisation with integer codebooks, its distances shared along a trie of parts.

Vectors become integers and are cut into equal parts. Parts are looked up in lexicographic order: sorted, they are the leaves of a trie
whose nodes are their common prefixes. From each node down to its children, a vector of distances to all entries of the codebook
is carried and added to, one component at a level, so parts with a common prefix share what it costs. Leaves take the nearest entry, and
add themselves, as often as they occur, to its sum. The trie is walked depth first in runs of neighbouring leaves: what is held is
one run's distances, whatever the number of parts.

Codebooks are fitted in rounds. Distinct parts and their numbers are written once, sorted; each round reads them, with the codebooks, which
are of fixed size, sent along; a task gives a sum for each entry, and these are added up by entry. Codes come from one more pass over the vectors,
a trie for each batch, so no vector is ever joined to its parts.

Defined results: rows whose vector is null, or holds a null, an infinite value or no number, or has no components or another
number of them than the kept row with the smallest id, are dropped. Nulls among ids come last; rows of one id are ordered by their vectors, and
stay all. With fewer kept rows than entries the codebooks have one entry a row. Equal vectors make equal entries, of which the first
wins all ties and the others stay as they are. A null label counts as one label. A number of components that doesn't divide into the
parts is an error; so is a component of 2 ** 18 or more in magnitude, whose squared distances would leave 64 bits. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, bounded_batches, written

#: Leaves of a run: their distances to 256 entries stay in a core's cache.
RUN = 1024


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `parts`, distinct and in lexicographic order, the nearest row of `codebook` (ties: the first) and the
    squared distance."""
    n, width = parts.shape
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    widest = int(max(abs(int(x)) for a in (parts, codebook) for x in (a.min(initial=0), a.max(initial=0))))
    kind = np.int32 if width * (2 * widest) ** 2 < 2**31 else np.int64
    parts, entries = parts.astype(kind), np.ascontiguousarray(codebook.T, dtype=kind)
    for low in range(0, n, RUN):
        run = parts[low : low + RUN]
        # the level at which each leaf leaves the one before it; at level d a node begins where that is d or less
        parted = np.r_[0, (run[1:] != run[:-1]).argmax(axis=1)] if len(run) > 1 else np.zeros(1, np.int64)
        node_of = np.zeros(len(run), np.int64)
        carried = np.zeros((1, len(codebook)), kind)
        for d in range(width):
            begins = parted <= d
            first = np.flatnonzero(begins)
            step = entries[d] - run[first, d][:, None]
            step *= step
            if len(first) == len(carried):
                carried += step
            else:
                step += carried[node_of[first]]
                carried = step
                node_of = np.cumsum(begins) - 1
        best = carried.argmin(axis=1)
        code[low : low + RUN] = best
        error[low : low + RUN] = carried[np.arange(len(run)), best]
    return code, error


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of `parts` in lexicographic order, and for each row which of them it is."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
    which = np.empty(len(parts), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null if any is no finite number. An error for those too large."""
    limit = float(2**18)
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    floors = F.transform(x, lambda v: F.when(F.abs(v) < limit, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("component of 2 ** 18 or more")).cast("int")))
    return F.when(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0), floors)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(position: np.ndarray, parts: np.ndarray, weights: np.ndarray, codebooks: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(position, entry, number, sums) of a batch that is sorted by position and part."""
    for p in np.unique(position):
        at = position == p
        mine, often = parts[at], weights[at]
        code, _ = nearest(mine, codebooks[p])
        order = np.argsort(code, kind="stable")
        entries, starts = np.unique(code[order], return_index=True)
        numbers = np.add.reduceat(often[order], starts)
        sums = np.add.reduceat((mine.astype(np.int64) * often[:, None])[order], starts, axis=0)
        yield from zip([int(p)] * len(entries), entries.tolist(), numbers.tolist(), sums)


def _round(codebooks: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = codebooks[0].shape[1]
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            position, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("position", "n"))
            for p, entry, number, sums in _sums(position, _matrix(batch.column("part"), width), n, codebooks):
                known = total.setdefault((p, entry), [0, np.zeros(width, np.int64)])
                known[0] += number
                known[1] += sums
        rows = [(p, e, n, s.tolist()) for (p, e), (n, s) in total.items()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["position", "entry", "n", "sums"])

    return add_up


def compress(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per kept row of `rows`: vec_id, code (two hex digits a part), error, label_error (errors summed over equal labels),
    codebooks_sha256."""
    spark = rows.sparkSession
    bounded_batches(spark)
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits tells at most 256 entries")
    vectors = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), integers(F.col(vector_column), scale).alias("v")).where("v IS NOT NULL")
    schema = f"vec_id long, code string, error long, label_error long, codebooks_sha256 string"

    # the size of all vectors, and the first codebooks: rows of the smallest ids
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not least:
        return spark.createDataFrame([], schema)
    dimension = len(least[0].v)
    if dimension % parts:
        raise ValueError(f"{dimension} components don't divide into {parts} parts")
    width = dimension // parts
    vectors = vectors.where(F.size("v") == dimension)
    smallest = np.array([r.v for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], np.int64)
    codebooks = [smallest[:, p * width : (p + 1) * width] for p in range(parts)]

    cut = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    counted = vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("n"))
    leaves = written(counted.sortWithinPartitions("position", "part"), "vector-parts")
    for _ in range(rounds):
        sums = leaves.mapInArrow(_round(codebooks), "position int, entry int, n long, sums array<long>")
        totals = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
        codebooks = [c.copy() for c in codebooks]
        for p, entry, n, *s in totals.collect():  # at most one row an entry
            codebooks[p][entry] = [x // n for x in s]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_parts = _matrix(batch.column("v"), dimension)
            error, digits = np.zeros(len(all_parts), np.int64), np.empty((len(all_parts), parts), np.uint8)
            for p, codebook in enumerate(codebooks):
                if len(all_parts):
                    leaves, which = distinct_parts(all_parts[:, p * width : (p + 1) * width])
                    code, far = nearest(leaves, codebook)
                    digits[:, p], error = code[which], error + far[which]
            codes = pa.array([row.tobytes().hex() for row in digits], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error)], ["vec_id", "label", "code", "error"])

    label_type = vectors.schema["label"].dataType.simpleString()
    coded = written(vectors.mapInArrow(encode, f"vec_id long, label {label_type}, code string, error long"), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = coded.count()
    digest = hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()
    return attach_by_key(coded, by_label, ["label"], "n", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

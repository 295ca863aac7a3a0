"""Vector search for a stated set of queries, with several vectors per parent: exact, and by an index of cells.

Exact search compares each query with all vectors, in blocks: scores are matrix products in double precision within
tasks, which keep each query's best k parents of a block; only those are shuffled. A parent among a query's best k is
among the best k of the block that holds its best vector, so nothing is lost. Up to `block` queries are broadcast and
go over the vectors where they lie; more are dealt out in tiles, and each tile of queries meets each tile of vectors
in a group of bounded size, in one job however many there are.

The index puts each vector in the cell of its nearest centre; centres are a bounded set of vectors. A query looks in its
nearest cells only. Large cells are tiles too, and queries that find fewer than k parents are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_per_group

FOUND = "query_id long, parent_id long, slice_index long, score double"
#: Vectors in a tile at most, bytes of a tile's vectors or queries as doubles, and scores that are held at a time.
TILE, TILE_BYTES, SCORES = 50_000, 32 << 20, 1 << 22


def _rows_in_tile(dim: int, most: int) -> int:
    return max(1, min(most, TILE_BYTES // (8 * max(1, dim))))


def check_dimensions(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """The rows, failing at run time if a vector has another length."""
    right = F.assert_true(F.size(column) == dim, F.lit(f"vectors must have {dim} numbers"))
    return vectors.where(right.isNull())


def _best(parent: np.ndarray, piece: np.ndarray, scores: np.ndarray, ids: list, k: int, own: np.ndarray | None, classes: list | None) -> list[tuple]:
    """(query, parent, slice, score) of each query's best k parents; scores (vectors, queries)."""
    found = []
    for q in range(len(ids)):
        s = scores[:, q]
        rows = np.arange(len(s)) if own is None else np.flatnonzero(own == classes[q])
        if not len(rows):
            continue
        if len(rows) > 8 * k:  # whatever ties with the last of the best 8k vectors stays; parents may have many
            rows = _enough(rows, s, parent, k)
        order = rows[np.lexsort((piece[rows], parent[rows], -s[rows]))]
        _, first = np.unique(parent[order], return_index=True)
        best = order[np.sort(first)[:k]]
        found += [(ids[q], int(parent[i]), int(piece[i]), float(s[i])) for i in best]
    return found


def _tiled_search(vectors: DataFrame, queries: DataFrame, by: list[str], k: int, within: str | None, decimals: int) -> DataFrame:
    """Scores of vectors and queries that share the tile columns `by`; a tile's queries meet its vectors in one group."""

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame(columns=["query_id", "parent_id", "slice_index", "score"])
        matrix, found = np.stack(v["vec"]).astype(np.float64), []
        step = max(1, SCORES // len(v))
        for at in range(0, len(q), step):  # a matrix of bounded size at a time
            some = q.iloc[at : at + step]
            scores = np.round(matrix @ np.stack(some["vec"]).astype(np.float64).T, decimals)
            found += _best(v["parent_id"].to_numpy(), v["slice_index"].to_numpy(), scores, some["query_id"].tolist(), k, v[within].to_numpy() if within else None, some[within].tolist() if within else None)
        return pd.DataFrame(found, columns=["query_id", "parent_id", "slice_index", "score"])

    return vectors.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.min_by("slice_index", F.struct(-F.col("score"), "slice_index")).alias("slice_index"))
    return top_per_group(best, ["query_id"], [F.desc("score"), F.asc("parent_id")], k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None, block: int = 1024, tile: int = 16_384, decimals: int = 6) -> DataFrame:
    """(query_id, parent_id, slice_index, score, rank): the k parents whose best vector has the greatest dot product.

    vectors (parent_id, slice_index, vec), queries (query_id, vec); with `within`, a column of both, only vectors
    that share its value with the query. Scores are rounded before they are ranked, so that the order of additions
    doesn't decide; ties go to the smaller parent, then slice.
    """
    spark = vectors.sparkSession
    columns = ["parent_id", "slice_index", "vec", *([within] if within else [])]
    queries = queries.select("query_id", "vec", *([within] if within else []))
    few = queries.limit(block + 1).collect()
    if len(few) > block:
        n, n_queries, dim = vectors.count(), queries.count(), len(few[0]["vec"])
        tiles, query_tiles = max(1, -(-n // _rows_in_tile(dim, TILE))), -(-n_queries // _rows_in_tile(dim, tile))
        v = vectors.select(*columns, F.pmod(F.xxhash64("parent_id", "slice_index"), F.lit(tiles)).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("_q"))
        q = queries.withColumns({"_q": F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)).cast("int"), "_v": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))})
        return _ranked(_tiled_search(v, q, ["_v", "_q"], k, within, decimals), k)
    if not few:
        return spark.createDataFrame([], FOUND + ", rank int")
    shared = spark.sparkContext.broadcast(([r["query_id"] for r in few], np.array([r["vec"] for r in few], np.float64), [r[within] for r in few] if within else None))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, classes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, piece = batch.column("parent_id").to_numpy(zero_copy_only=False), batch.column("slice_index").to_numpy(zero_copy_only=False)
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(flat.reshape(len(parent), -1) @ matrix.T, decimals)
            found = _best(parent, piece, scores, ids, k, batch.column(within).to_numpy(zero_copy_only=False) if within else None, classes)
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "parent_id", "slice_index", "score"])

    return _ranked(vectors.select(*columns).mapInArrow(search, FOUND), k)


def sampled_centres(vectors: DataFrame, most: int = 4096) -> DataFrame:
    """(centre_id, vec): a bounded sample of the vectors, those whose ids have the smallest hashes, numbered in that order."""
    key = F.xxhash64("parent_id", "slice_index")
    sample = vectors.select(key.alias("h"), "parent_id", "slice_index", "vec").orderBy("h", "parent_id", "slice_index").limit(most)
    return sample.selectExpr("row_number() over (order by h, parent_id, slice_index) as centre_id", "vec")  # `most` rows


def nearest_centres(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, n: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """The batches with the column cells, in pieces of at most SCORES scores: centres may be as many as a batch's rows, or more."""
    step = max(1, SCORES // max(1, len(ids)))
    for whole in batches:
        for at in range(0, max(1, whole.num_rows), step):
            batch = whole.slice(at, step)
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(flat.reshape(batch.num_rows, -1) @ matrix.T, decimals) if batch.num_rows else np.zeros((0, len(ids)))
            if n == 1 and len(ids):
                order = scores.argmax(axis=1)[:, None]
            else:
                order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            edges = np.arange(batch.num_rows + 1, dtype=np.int32) * order.shape[1]
            yield batch.append_column("cells", pa.ListArray.from_arrays(pa.array(edges), pa.array(ids[order].ravel())))


class CellIndex:
    """Vectors by the cell of their nearest centre. `centres` (centre_id, vec) are collected, so they are to be few; the
    index itself is a table, (parent_id, slice_index, vec, ..., cell), to be kept where the caller wants it."""

    def __init__(self, centres: DataFrame, decimals: int = 6):
        rows = sorted((r["centre_id"], r["vec"]) for r in centres.select("centre_id", "vec").collect())
        self.ids, self.matrix, self.decimals = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64), decimals

    def cells(self, rows: DataFrame, n: int) -> DataFrame:
        """`rows` with the column cells, the n nearest centres, ties to the smaller id."""
        shared = rows.sparkSession.sparkContext.broadcast((self.ids, self.matrix))
        decimals = self.decimals

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return nearest_centres(batches, *shared.value, n, decimals)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(nearest, kinds + ", cells array<long>")

    def build(self, vectors: DataFrame) -> DataFrame:
        return self.cells(vectors, 1).withColumn("cell", F.element_at("cells", 1)).drop("cells")

    def in_cells(self, index: DataFrame, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """Vectors and queries with (cell, tile, query_tile): each tile of a cell meets each tile of the queries that look there."""
        rows = _rows_in_tile(self.matrix.shape[1], TILE)
        q = self.cells(queries.select("query_id", "vec"), probes).select("query_id", "vec", F.explode("cells").alias("cell"))
        sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("tiles"))  # as many rows as centres
        sizes = sizes.join(q.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("query_tiles")), "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        v = index.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("parent_id", "slice_index"), F.col("tiles")))
        q = q.join(F.broadcast(sizes), "cell").withColumn("query_tile", F.pmod(F.xxhash64("query_id"), F.col("query_tiles")))
        return v.withColumn("query_tile", each("query_tiles")), q.withColumn("tile", each("tiles"))

    def search(self, index: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """As `knn`, from the `probes` nearest cells of each query; exactly for queries that find fewer than k parents there."""
        v, q = self.in_cells(index, queries, probes)
        by = ["cell", "tile", "query_tile"]
        found = _ranked(_tiled_search(v.select(*by, "parent_id", "slice_index", "vec"), q.select(*by, "query_id", "vec"), by, k, None, self.decimals), k)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        rest = knn(index, queries.join(full, "query_id", "left_anti"), k, decimals=self.decimals)
        return found.join(full, "query_id", "left_semi").unionByName(rest)


def trained_centres(vectors: DataFrame, n: int, rounds: int = 5) -> DataFrame:
    """(centre_id, vec): the centres of `n` cells after Lloyd rounds over all vectors, each a job that gives a sum for each cell. They begin
    as a sample of the vectors; cells are by the greatest dot product with centres of unit length; one without vectors keeps its centre."""
    spark = vectors.sparkSession
    rows = sampled_centres(vectors, n).collect()
    matrix = np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), -1)

    for _ in range(rounds if len(rows) else 0):
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast(matrix)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    for at in range(0, len(flat), max(1, SCORES // len(centres))):
                        some = flat[at : at + max(1, SCORES // len(centres))]
                        cell = (some @ centres.T).argmax(1)
                        np.add.at(sums, cell, some)
                        counts += np.bincount(cell, minlength=len(centres))
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.float64()))], ["cell", "n", "sums"])

        parts = vectors.select("vec").mapInArrow(add_up, "cell long, n long, sums array<double>")
        width = matrix.shape[1]
        for cell, n_vectors, *total in parts.groupBy("cell").agg(F.sum("n"), *[F.sum(F.col("sums")[d]) for d in range(width)]).collect():  # a row a cell
            matrix[cell] = np.array(total) / n_vectors
    return spark.createDataFrame([(i, [float(x) for x in m]) for i, m in enumerate(matrix)], "centre_id long, vec array<double>")


class TrainedIndex(CellIndex):
    """Cells around trained centres, and in each a code for each vector: what it is beyond its centre, a signed byte a component. A search
    compares codes first, and only the vectors of each query's best codes themselves."""

    STEPS = 127

    def build(self, vectors: DataFrame) -> DataFrame:
        """(parent_id, slice_index, cell, scale, code): a row for each vector; the vectors stay where they are."""
        shared = vectors.sparkSession.sparkContext.broadcast(dict(zip(self.ids.tolist(), self.matrix)))
        steps = self.STEPS

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                codes, scales = [], []
                for vec, cell in zip(batch.column("vec").to_pylist(), batch.column("cell").to_pylist()):
                    beyond = np.array(vec, np.float64) - centres[cell]
                    scale = float(np.abs(beyond).max(initial=0.0)) / steps or 1.0
                    codes.append(np.round(beyond / scale).astype(np.int8).tobytes())
                    scales.append(scale)
                kept = [batch.column(c) for c in ("parent_id", "slice_index", "cell")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scales, pa.float64()), pa.array(codes, pa.binary())], ["parent_id", "slice_index", "cell", "scale", "code"])

        placed = super().build(vectors.select("parent_id", "slice_index", "vec")).select("parent_id", "slice_index", "cell", "vec")
        return placed.mapInArrow(encode, "parent_id long, slice_index long, cell long, scale double, code binary")

    def candidates(self, index: DataFrame, queries: DataFrame, probes: int, most: int) -> DataFrame:
        """(query_id, parent_id, slice_index): the `most` vectors with the best codes in the cells that a query looks in."""
        centres = index.sparkSession.sparkContext.broadcast(dict(zip(self.ids.tolist(), self.matrix)))

        def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            columns = ["query_id", "parent_id", "slice_index", "score"]
            if not len(v) or not len(q):
                return pd.DataFrame(columns=columns)
            codes = np.frombuffer(b"".join(v["code"]), np.int8).reshape(len(v), -1).astype(np.float32)
            asked = np.stack(q["vec"]).astype(np.float32)
            at_centre = asked @ centres.value[v["cell"].iloc[0]].astype(np.float32)
            parent, piece, scale, found = v["parent_id"].to_numpy(), v["slice_index"].to_numpy(), v["scale"].to_numpy(np.float32), []
            for at in range(0, len(q), step := max(1, SCORES // len(v))):
                scores = (codes @ asked[at : at + step].T) * scale[:, None] + at_centre[at : at + step]
                for j in range(scores.shape[1]):
                    best = np.argpartition(-scores[:, j], most)[:most] if len(v) > most else np.arange(len(v))
                    found.append(pd.DataFrame({"query_id": q["query_id"].iloc[at + j], "parent_id": parent[best], "slice_index": piece[best], "score": scores[best, j].astype(np.float64)}))
            return pd.concat(found) if found else pd.DataFrame(columns=columns)

        v, q = self.in_cells(index, queries, probes)
        by = ["cell", "tile", "query_tile"]
        v, q = v.select(*by, "parent_id", "slice_index", "scale", "code"), q.select(*by, "query_id", "vec")
        scored = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(compare, FOUND)
        return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("parent_id"), F.asc("slice_index")], most, "place").select("query_id", "parent_id", "slice_index")

    def search(self, index: DataFrame, queries: DataFrame, k: int, probes: int, vectors: DataFrame | None = None, most: int = 0) -> DataFrame:
        """As `knn`, with the slice of each best vector: of `vectors` (parent_id, slice_index, vec), those with the `most` best codes (16 k unless
        given) are compared themselves; all are for queries that find fewer than k parents among these."""
        if vectors is None:
            raise ValueError("codes lead to vectors, which have to be given")
        near = self.candidates(index, queries, probes, most or 16 * k)
        met = near.join(vectors.select("parent_id", "slice_index", "vec"), ["parent_id", "slice_index"]).join(queries.select("query_id", F.col("vec").alias("asked")), "query_id")
        dot = F.aggregate(F.zip_with("vec", "asked", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        found = _ranked(met.select("query_id", "parent_id", "slice_index", F.round(dot, self.decimals).alias("score")), k)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        rest = knn(vectors, queries.join(full, "query_id", "left_anti"), k, decimals=self.decimals)
        return found.join(full, "query_id", "left_semi").unionByName(rest.select(*found.columns))


def _enough(rows: np.ndarray, s: np.ndarray, parent: np.ndarray, k: int) -> np.ndarray:
    """A part of the rows that surely holds the best vectors of the best k parents: the best n, for an n at which
    they have k parents, and all that tie with the last."""
    n = 8 * k
    while n < len(rows):
        bar = np.partition(s[rows], len(rows) - n)[len(rows) - n]
        top = rows[s[rows] >= bar]
        if len(np.unique(parent[top])) > k:
            return top
        n *= 4
    return rows


def agreement(exact: DataFrame, other: DataFrame, k: int = 8) -> DataFrame:
    """Share of queries with the same first parent, and mean share of the best k in common."""
    a = exact.where(F.col("rank") <= k).select("query_id", "parent_id", F.col("rank").alias("exact_rank"))
    b = other.where(F.col("rank") <= k).select("query_id", "parent_id", F.col("rank").alias("other_rank"))
    per = a.join(b, ["query_id", "parent_id"], "left").groupBy("query_id").agg(
        F.max(F.when((F.col("exact_rank") == 1) & (F.col("other_rank") == 1), 1).otherwise(0)).alias("same_first"), (F.count("other_rank") / F.count("*")).alias("overlap")
    )
    return per.agg(F.avg("same_first").alias("same_first"), F.avg("overlap").alias("overlap"))

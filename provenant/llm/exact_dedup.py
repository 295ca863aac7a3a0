"""Exact dedup: a persistent index of text digests, bucketed and sorted by digest.

New data is compared with the index by a sort-merge anti-join, which needs no shuffle of the index, and appended. All
of it is DataFrame operations.

A batch has a name. One that is added again, because a job failed after it was appended, gives what it gave before
and appends only what is missing; what later batches have brought doesn't count for it. One batch is added at a time.
Each batch appends files to the buckets, so that the index is no longer sorted as a whole; `compacted` writes it anew.

Defined results: a null text counts as empty; of equal texts within one batch the row with the largest doc_id
stays (a null doc_id counts as smallest); of repeated rows (same text, same doc_id) one stays; a text that an
earlier batch has brought in stays with that batch's document, so all its new rows go. Columns other than the id
and the text are ignored, whatever their names. Empty input gives empty output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, text_or_empty, written


class DigestIndex:
    """A catalog table (digest, keep_id, n_rows, batch, seq): for each text and each batch that holds it the document that
    stays, if no earlier batch has the text, and the number of its rows; seq numbers batches in order."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], "digest binary, keep_id long, n_rows long, batch string, seq long")
            self._append(empty)

    def _append(self, rows: DataFrame) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def compacted(self, table: str) -> DigestIndex:
        """The same index as a new table with one sorted file a bucket and one row a text. Its batches can't be added
        again there; the old table is left to the caller."""
        new = DigestIndex(self.spark, table, self.buckets)
        rows = self.spark.table(self.table).groupBy("digest").agg(F.min_by("keep_id", "seq").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
        new._append(rows.withColumns({"batch": F.lit(None).cast("string"), "seq": F.lit(0).cast("long")}).repartition(self.buckets, "digest"))
        return new

    def add(self, docs: DataFrame, batch: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Append the texts of `docs` under the batch's name and return one row per row of `docs`:
        doc_id, keep_id, group_size (rows of this batch and of those before it), kept, text_sha256."""
        batch = batch or uuid.uuid4().hex
        digests = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_column), 256)).alias("digest"))
        # rows of one text that share a doc_id become one row with a count
        staged = written(digests.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
        # written, or the optimizer would push the anti-join below the aggregation and shuffle all rows of a digest
        groups = written(staged.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("n_rows"), F.count("*").alias("n_staged")), "digest-groups")

        entries = self.spark.table(self.table)
        own, last = entries.agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))), F.max("seq")).first()
        seq = own if own is not None else (last or 0) + 1
        before = entries.where(F.col("seq") < seq)
        fresh = groups.join(before.hint("merge"), "digest", "left_anti").withColumns({"is_new": F.lit(True), "before": F.lit(0).cast("long")})
        known = before.groupBy("digest").agg(F.min_by("keep_id", "seq").alias("kept_id"), F.sum("n_rows").alias("before"))
        known = groups.hint("merge").join(known, "digest").select("digest", F.col("kept_id").alias("keep_id"), "n_rows", "n_staged", F.lit(False).alias("is_new"), "before")
        decided = written(fresh.unionByName(known), "groups")

        missing = decided if own is None else decided.join(entries.where(F.col("batch") == batch).hint("merge"), "digest", "left_anti")
        self._append(missing.select("digest", "keep_id", "n_rows", F.lit(batch).alias("batch"), F.lit(seq).cast("long").alias("seq")))

        total = decided.agg(F.sum("n_staged")).first()[0] or 0
        rows = attach_by_key(staged, decided.withColumn("group_size", F.col("n_rows") + F.col("before")), ["digest"], "n_staged", total)
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        return rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

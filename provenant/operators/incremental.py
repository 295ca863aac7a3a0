"""Incremental work: resuming by content, diffs of chunks, document status, and the silence monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_of, collapsed_sha256, fingerprint16


def to_do(corpus: DataFrame, done: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows whose (id, fingerprint of the text) isn't among those done (id, fingerprint): new and changed ones."""
    keyed = corpus.withColumn("fingerprint", fingerprint16(text_column))
    made = done.select(F.col("id").alias("_id"), F.col("fingerprint").alias("_fp")).distinct()
    return keyed.join(made, (F.col(id_column) == F.col("_id")) & (F.col("fingerprint") == F.col("_fp")), "left_anti")


def last_line_wins(journal: DataFrame, key: str, seq: str) -> DataFrame:
    """Of a journal's lines with one key the last by `seq`."""
    values = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("r")).select(key, "r.*")


def chunk_diff(old: DataFrame, new: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, change): added, removed, modified or same, by the hash of bodies without headers and spacing."""
    o = old.select(*by, collapsed_sha256(body_of(text)).alias("old_hash"))
    n = new.select(*by, collapsed_sha256(body_of(text)).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("same")
    return o.join(n, by, "full").select(*by, change.alias("change"))


def document_status(diff: DataFrame, document: str, failed: DataFrame | None = None) -> DataFrame:
    """(document, status, n_added, n_removed, n_modified): error for documents in `failed` or left without chunks,
    else changed or unchanged."""
    counts = diff.groupBy(document).agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "modified", "same")])
    gone = F.col("n_added") + F.col("n_modified") + F.col("n_same") == 0
    moved = F.col("n_added") + F.col("n_removed") + F.col("n_modified") > 0
    bad = gone
    if failed is not None:
        counts = counts.join(failed.select(document).distinct().withColumn("_failed", F.lit(True)), document, "full")
        bad = F.col("_failed").isNotNull() | gone
    status = F.when(bad, "error").when(moved, "changed").otherwise("unchanged")
    return counts.select(document, status.alias("status"), *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in ("added", "removed", "modified")])


def silence(log: DataFrame, by: list[str], at: str, now: Column, least_days: int = 10) -> DataFrame:
    """Days since the last entry of each group, and whether that is silence."""
    days = F.datediff(now, F.max(at))
    return log.groupBy(*by).agg(days.cast("long").alias("days"), (days >= least_days).alias("is_silent"))

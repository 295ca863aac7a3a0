"""Token counts: encoding in Arrow batches that return lengths only.

Within a batch, texts are regrouped into parts of equal bytes; long texts are cut at white space, which no token of
the tokenizers that `count_tokens` is meant for crosses (see tokens.py). A null text counts as empty and has no
tokens. Repeated rows are counted each. No other columns are read. Nulls in doc_id stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty
from .tokens import PieceMemo, by_bytes, kept_memo, read_tokenizer, words_of


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, part_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of `docs`, by a tokenizer that drops
    white space."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = spark.sparkContext.broadcast({"tokenizer": read_tokenizer(tokenizer_path)})

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept_memo(tokenizer.value, PieceMemo)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            for part in by_bytes(texts, part_bytes):
                words = [(i, words_of(text)) for i, text in part]
                memo.learn(set().union(*(w for _, w in words)))
                for i, w in words:
                    counts[i] += sum(map(memo.__getitem__, w))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Helpers that several operators share: the shared folder, written tables, and joins on keys that may be hot."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator whose contract names one: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot if it holds more than one in so many of all rows; so there are fewer hot keys than this.
HOT_KEYS = 1000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for `name` under the cluster's shared folder, spark.checkpoint.dir.

    Where that setting is absent, a temporary folder takes its place if all runs in this process (master local[...]); on a cluster
    it has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        base = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="provenant-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def attach_by_key(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of `right`, whose rows are unique by `keys`, when some keys hold a large share of `left`.

    `weight` is a column of `right`: how many rows of `left` have the key; `total` is their sum. A key above
    total / HOT_KEYS is hot. There are fewer than HOT_KEYS of those whatever the input, so they are broadcast
    and their rows of `left` never move; all others are joined by shuffle, where no key is large. Nulls in keys match.
    """
    bar = max(total // HOT_KEYS, 1000)
    renamed = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    key_columns = [f"_key{i}" for i in range(len(keys))]
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    hot = F.broadcast(renamed.where(F.col(weight) > bar))
    warm = left.join(hot, on).drop(*key_columns)
    cold = left.join(F.broadcast(hot.select(*key_columns)), on, "left_anti")
    cold = cold.join(renamed.where(F.col(weight) <= bar), on, "left").drop(*key_columns)
    return warm.unionByName(cold)


def likely_among(rows: DataFrame, keys: DataFrame, columns: list[str], n: int) -> DataFrame:
    """`rows` with a column `likely`, false only for rows whose values of `columns` no row of `keys` has.

    The `n` keys' hashes are set in a bitmap of 16 bits a key, but at most 2 ** 26, which is broadcast in parts: 8 MB
    whatever the input. So only rows that are probably asked for have to be shuffled to what is known of them. Beyond some four million keys
    more and more others pass too; nothing asked for is ever lost.
    """
    slots = 1 << min(26, max(15, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64(*columns), F.lit(slots)) + 1  # the functions count from 1
    bits = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    placed = rows.withColumn("_slot", slot).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_part"), "left")
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.withColumn("likely", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_slot", "_part", "_bits")


def bounded_batches(spark: SparkSession) -> None:
    """Batches that Python workers get are held to a size in bytes, the same for all operators, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

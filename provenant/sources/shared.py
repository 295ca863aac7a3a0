"""Tables that steps of a job leave for one another, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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

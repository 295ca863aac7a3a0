"""Readers and sinks. Schemas are given, never inferred; writes replace a whole table or append to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Texts that lie in a single file are dealt out to all cores, as a file may be one row group,
    which is read by one task whatever there is to do with its rows; tables of more files are left where they lie."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if {"text", "html"} & set(rows.columns) and cores > 1 and len(rows.inputFiles()) == 1:
        return rows.repartition(cores)
    return rows


def dealt_out(rows: DataFrame) -> DataFrame:
    """The rows over all cores: for small rows that long work is done on, as few splits of a file may hold very many."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def read_snapshots(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per file: path, id (the digits of its name), html."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return files.withColumn("id", F.regexp_extract("path", "(\\d+)[^/]*$", 1).cast("long"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per line that holds an object; blank lines are dropped; of lines that can't be parsed only `broken`,
    their text, is set."""
    full = f"{schema}, broken string" if isinstance(schema, str) else StructType([*schema.fields, StructField("broken", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "broken"}).alias("r")).select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Comma-separated with quoted fields, doubled quotes and line ends within fields; rows without any value are dropped."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return rows.where(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, line ends turned to spaces."""
    plain = df.select(*[F.regexp_replace(F.col(c).cast("string"), "[\\r\\n]+", " ").alias(c) for c in df.columns])
    plain.write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """A report's rows as lines of a pipe table: (n, line), heading first. Reports are small; lines sort in one place."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.orderBy(*order).select(line.alias("line"))
    head = [("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)]
    numbered = rows.select((F.monotonically_increasing_id() + 2).alias("n"), "line")
    return df.sparkSession.createDataFrame([(i, h[0]) for i, h in enumerate(head)], "n long, line string").unionByName(numbered)


def write_tsv(df: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    df.orderBy(*order).select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def swap(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table anew; with partition_by only the partitions that `df` has."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def retrievable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What every retriever starts from: chunks in force of eligible documents in force.
    chunks (document_id, status, ...), documents (id, status, rag_eligible)."""
    good = documents.where("rag_eligible and status = 'in_force'").select(F.col("id").alias("document_id"))
    return chunks.where("status = 'in_force'").join(good, "document_id", "left_semi")


def failed_expectations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n): how many rows break each rule, given as SQL conditions; null counts as broken. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias(name) for name, sql in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")

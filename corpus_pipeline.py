"""The corpus pipeline: stages in order, each on what the one before kept.

Documents go in; token-ID files and a row for each document in them come out. Each stage's result is written and
read again, so that a lost executor costs one stage at most. Stage 4 takes documents up to three times, so what it
returns may hold a document more than once.

Defined results, for every stage: other columns than those of documents are dropped, whatever their names; null ids, languages and sources stay as they are; no rows give
no rows. A null text counts as empty. The classifier keeps what it has no labels to judge by; of empty texts near-dedup keeps one, as of any that
are alike, and of repeated rows one; no item stands in an empty text; mixing takes no document without words, and treats the null source as one; token files hold repeated rows
each, null ids first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import quality
from provenant.llm.common import written
from provenant.llm.decontamination import find_contamination
from provenant.llm.mixing import mix
from provenant.llm.simhash import keep_one_of_each
from provenant.llm.token_files import encode_and_read_back

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = quality.score(docs.select(*COLUMNS), model, carry=COLUMNS[1:])
    return rated.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; near copies have a cosine of about 0.8 or
    more of their five-word shingles."""
    return keep_one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    found = find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:])
    return found.where("kept").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix(docs.select(*COLUMNS), carry=COLUMNS[1:])
    taken = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_and_read_back(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: SQL expresses neither the classifier nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs

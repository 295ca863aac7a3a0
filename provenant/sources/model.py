"""The data model: schemas that readers are given, the rules that tables must keep, and versions of the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import failed_expectations

#: The model's tables and columns, and what types, statuses and languages there are.
TABLES = {
    "documents": "id long, source_id long, doc_type string, number string, suffix string, title string, status string, language string, adopted_at date, amended_at date, source_url string, content_hash string, last_checked timestamp, rag_eligible boolean",
    "articles": "id long, document_id long, ref string, article_number string, part_number string, title string, path array<string>, text string, status string, ord int, char_count int",
    "article_refs": "from_id long, to_id long",
    "embeddings": "article_id long, model string, slice_index int, vec array<float>",
    "document_aliases": "alias_id long, document_id long, reason string",
    "sessions": "id string, created_at timestamp, fact_summary string",
    "messages": "id long, session_id string, role string, content string, created_at timestamp",
    "session_chunks": "session_id string, article_id long, score float, turn_added int",
    "eval_questions": "id long, question string, language string, expected array<long>",
    "crawl_log": "id long, run_at timestamp, checked int, changed int, errors array<struct<source_id:long,message:string>>",
    "schema_migrations": "name string, applied_at timestamp",
}
DOC_TYPES = ("law", "code", "decision", "order")
STATUSES = ("in_force", "repealed", "not_yet")
LANGUAGES = ("hy", "ru", "en")

RULES = {
    "documents": {
        "type_known": f"doc_type in {DOC_TYPES}",
        "status_known": f"status in {STATUSES}",
        "language_known": f"language in {LANGUAGES}",
        "suffix_is_a_letter": "suffix is null or length(suffix) = 1",
        "individual_acts_are_not_eligible": "not (rag_eligible and suffix = 'Ա')",
    },
    "articles": {"has_ref": "ref <> ''", "counts_its_text": "char_count = length(text)", "status_known": f"status in {STATUSES}"},
    "messages": {"role_known": "role in ('user', 'assistant', 'system')"},
    "article_refs": {"no_self_reference": "from_id <> to_id"},
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def broken_rules(df: DataFrame, table: str) -> DataFrame:
    """(rule, n) of the table's rules; all n must be 0."""
    return failed_expectations(df, RULES[table])


def schema_differences(df: DataFrame, table: str) -> list[str]:
    """Columns that are missing, surplus or of another type; none may be."""
    want = dict(df.sparkSession.createDataFrame([], TABLES[table]).dtypes)
    have = dict(df.dtypes)
    return sorted([f"missing {c}" for c in want.keys() - have.keys()] + [f"surplus {c}" for c in have.keys() - want.keys()] + [f"{c}: {have[c]}, not {want[c]}" for c in want.keys() & have.keys() if want[c] != have[c]])


def pending(available: DataFrame, applied: DataFrame) -> DataFrame:
    """Names of migrations that are still to be applied, in order."""
    return available.join(applied.select("name"), "name", "left_anti").orderBy("name")


def orphan_counts(articles: DataFrame, documents: DataFrame) -> DataFrame:
    """What a cascade would have to remove: articles without a document, one row."""
    gone = articles.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return gone.agg(F.count("*").alias("n_orphans"))

"""The operators applied to whole tables, under the names and with the digest columns that their contracts give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import pii, quality, secrets, sql
from .decontamination import find_contamination
from .exact_dedup import DigestIndex
from .licenses import scan_licenses
from .mixing import mix
from .simhash import near_duplicates
from .spelling import variants
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .token_files import encode_and_read_back
from .vector_codes import compress


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read_back(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return index.add(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii.find_personal_data(docs, pii.train(docs))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4, distance=4)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35, with_text=False)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir)).drop("spans")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_documents(spark, sf_dir))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_personal_data": op8_personal_data,
    "op9_simhash": op9_simhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}


def _op1_sql() -> str:
    """Spans by splitting: what lies between matches and the matches themselves add up to their places."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
            SELECT row_id, {i} AS k, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda n: {{
                'start': list_sum(list_transform(between[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0),
                'len': length(m[n]), 'counted': length(g[n]) }})) AS s
            FROM (SELECT row_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g,
                         regexp_split_to_array(t, '{pattern}') AS between FROM d)""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES))
    base = [i for i, r in enumerate(secrets.RULES) if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{secrets.RULES[i].kind}" for i in base)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({" UNION ALL ".join(parts)}),
        kept AS (SELECT row_id, k, s.start AS a, kind || ':' || s.start::BIGINT || ':' || (s.start + s.len)::BIGINT AS span FROM found WHERE s.counted >= CASE k {least} END)
        SELECT any_value(doc_id) AS doc_id, {counts},
               sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k <= {max(base)}), '')) AS base_sha256,
               coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
        FROM d LEFT JOIN kept USING (row_id) GROUP BY row_id
    """


ORACLE_SQL = {
    "op11_license_scan": sql.license_scan(),
    "op12_vector_codes": sql.vector_codes(),
    "op13_spelling_variants": sql.spelling_variants(),
    "op1_secret_scan": _op1_sql(),
    "op10_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        places AS (SELECT r, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
        keyed AS (SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS k FROM places JOIN d USING (r)),
        again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM keyed) WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i, true AS is_gone FROM again),
        word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d)
        SELECT any_value(doc_id) AS doc_id, count(x) AS n_words, count(is_gone) AS n_removed,
               sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE is_gone IS NULL), '')) AS kept_sha256
        FROM d LEFT JOIN word USING (r) LEFT JOIN gone USING (r, i) GROUP BY r
    """,
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}

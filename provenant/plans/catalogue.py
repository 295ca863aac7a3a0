"""Queries over the given tables, which stand in for the document model: documents for documents and their lines for
blocks, embeddings for slices (four to a parent), events for session chunks, conversations for messages, lineitem for
citations, pages for snapshots. Each has its SQL beside it in `SQL` where SQL can express it.

Searches take as queries every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, counters, evaluate, graph, html, incremental, postings, rank, relational, seam, segment, textindex, vector, verify
from ..sources.shared import shared_dir, written
from ..sources.tables import dealt_out, failed_expectations, table
from ..streaming import events, sessions
from ..streaming.gate import CLOSING, gate_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- vectors -----------------------------------------------------------------------------------------------------

_SLICES = "SELECT vec_id // 4 AS parent_id, vec_id % 4 AS slice_index, embedding::DOUBLE[] AS vec, label FROM embeddings"
_KNN = f"""
    s AS ({_SLICES}),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
    scored AS (SELECT query_id, parent_id, slice_index, round(list_dot_product(qv, vec), 6) AS score FROM q JOIN s ON {{on}}),
    best AS (SELECT query_id, parent_id, max(score) AS score, first(slice_index ORDER BY score DESC, slice_index) AS slice_index FROM scored GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM best)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    slices = e.select(F.floor(F.col("vec_id") / 4).alias("parent_id"), (F.col("vec_id") % 4).alias("slice_index"), F.col("embedding").alias("vec"), "label")
    return slices, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {_KNN.format(on='true')} SELECT query_id, parent_id, slice_index, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 8")
def knn_maxpool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vectors(spark, sf_dir), k=8)


@query(f"WITH {_KNN.format(on='ql = label')} SELECT query_id, parent_id, slice_index, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 8")
def knn_filtered_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.knn(*_vectors(spark, sf_dir), k=8, within="label")


_PROBED = f"""{_KNN.format(on='true')},
    centres AS (SELECT vec_id AS centre_id, embedding::DOUBLE[] AS cv FROM embeddings WHERE vec_id % 41 = 0),
    celled AS (SELECT s.*, arg_min(centre_id, (-round(list_dot_product(vec, cv), 6), centre_id)) AS cell FROM s, centres GROUP BY ALL),
    probed AS (SELECT query_id, qv, centre_id AS cell FROM (SELECT query_id, qv, centre_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv, cv), 6) DESC, centre_id) AS n FROM q, centres) WHERE n <= (SELECT ceil(0.75 * count(*)) FROM centres)),
    near AS (SELECT query_id, parent_id, max(round(list_dot_product(qv, vec), 6)) AS score FROM probed JOIN celled USING (cell) GROUP BY ALL),
    near_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM near),
    indexed AS (SELECT query_id, parent_id, score, rank FROM near_ranked WHERE n >= 8 AND rank <= 8 UNION ALL SELECT query_id, parent_id, score, rank FROM ranked WHERE rank <= 8 AND query_id NOT IN (SELECT query_id FROM near_ranked WHERE n >= 8))"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by cells around every forty-first vector, three in four of them a query: the given vectors are hardly
    clustered, and fewer find less than 0.9 of what the exact search does."""
    slices, queries = _vectors(spark, sf_dir)
    centres = table(spark, sf_dir, "embeddings").where("vec_id % 41 = 0").select(F.col("vec_id").alias("centre_id"), F.col("embedding").alias("vec"))
    cells = vector.CellIndex(centres)
    return cells.search(cells.build(slices.select("parent_id", "slice_index", "vec")), queries, 8, math.ceil(0.75 * len(cells.ids)))


@query(f"WITH {_PROBED} SELECT query_id, parent_id, score, rank::INTEGER AS rank FROM indexed")
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("query_id", "parent_id", "score", "rank")


@query(f"""WITH {_PROBED}, pairs AS (SELECT e.query_id, e.rank AS exact_rank, i.rank AS index_rank FROM ranked e LEFT JOIN indexed i USING (query_id, parent_id) WHERE e.rank <= 8),
    per AS (SELECT query_id, max((exact_rank = 1 AND coalesce(index_rank, 0) = 1)::INTEGER) AS same_first, count(index_rank) / count(*) AS overlap FROM pairs GROUP BY 1)
    SELECT count(*) AS n_queries, round(avg(same_first), 9) AS same_first, round(avg(overlap), 9) AS overlap FROM per""")
def index_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the search by cells gives what the exact one does."""
    exact = vector.knn(*_vectors(spark, sf_dir), 8)
    out = vector.agreement(exact, _indexed(spark, sf_dir)).crossJoin(exact.agg(F.count_distinct("query_id").alias("n_queries")))  # a row each
    return out.select("n_queries", F.round("same_first", 9).alias("same_first"), F.round("overlap", 9).alias("overlap"))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[vector.TrainedIndex, DataFrame, DataFrame, DataFrame]:
    """An index of some square root of the vectors in cells, written; the vectors, and the queries."""
    slices, queries = _vectors(spark, sf_dir)
    rows = slices.select("parent_id", "slice_index", "vec")
    cells = vector.TrainedIndex(vector.trained_centres(rows, max(8, math.isqrt(rows.count()))))
    return cells, written(cells.build(rows), "trained-index"), rows, queries


@query()
def knn_trained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by trained cells: nine in ten of them by codes, as the given vectors are hardly clustered, and the vectors of the best 64 codes; how near
    that is to the exact search is in trained_index_agreement."""
    cells, index, rows, queries = _trained(spark, sf_dir)
    return cells.search(index, queries, 8, math.ceil(0.9 * len(cells.ids)), rows, 64).select("query_id", "parent_id", "slice_index", "score", "rank")


@query()
def trained_index_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far search by trained cells gives what the exact one does, and what share of vectors it compares."""
    cells, index, rows, queries = _trained(spark, sf_dir)
    exact = vector.knn(rows, queries, 8)
    out = vector.agreement(exact, cells.search(index, queries, 8, math.ceil(0.9 * len(cells.ids)), rows, 64))
    n = rows.agg(F.least(F.count("*"), F.lit(64)).alias("compared"), F.count("*").alias("n"))
    return out.crossJoin(n).select(F.round("same_first", 9).alias("same_first"), F.round("overlap", 9).alias("overlap"), F.round(F.col("compared") / F.col("n"), 9).alias("compared_share"))  # a row each


# --- lexical search ----------------------------------------------------------------------------------------------


def _terms_sql(source: str, key: str) -> str:
    return f"""(SELECT id, pos, term FROM (SELECT id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM (
        SELECT {key} AS id, list_filter(list_transform(regexp_split_to_array(lower(text), '[^\\pL\\pN._-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) >= 2) AS terms FROM {source})))"""


_POSTED = f"posted AS {_terms_sql('documents', 'doc_id')}"
_LENGTHS = "lengths AS (SELECT id, count(*) AS length FROM posted GROUP BY id)"


def _query_terms_sql(k: int) -> str:
    return f"""asked AS (SELECT id AS query_id, term, n, count(*) OVER (PARTITION BY id) AS n_terms FROM (
        SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS n FROM (SELECT DISTINCT id, term FROM {_terms_sql('benchmark', 'item_id')})) WHERE n <= {k})"""


_ASKED = f"""asked AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT id AS query_id, term FROM {_terms_sql('benchmark', 'item_id')}))"""
# Covers of all terms: from each place to the last of all terms' first places from there on, of those that end together the latest.
_RANKED_TERMS = """met AS (SELECT query_id, id, n_terms, term, pos FROM posted JOIN asked USING (term)),
    hits AS (SELECT query_id, id, n_terms, count(DISTINCT term) AS matched, count(*) AS tf FROM met GROUP BY ALL),
    events AS (SELECT query_id, id, term, pos, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS n FROM met WHERE (query_id, id) IN (SELECT query_id, id FROM hits WHERE matched = n_terms)),
    firsts AS (SELECT b.query_id, b.id, b.pos AS a, b.n AS i, e.term, min(e.pos) AS p, min(e.n) AS j FROM events b JOIN events e ON e.query_id = b.query_id AND e.id = b.id AND e.pos >= b.pos GROUP BY ALL),
    ends AS (SELECT query_id, id, a, i, max(p) AS z, max(j) AS j, count(*) AS n FROM firsts GROUP BY ALL),
    covers AS (SELECT query_id, id, max(a) AS a, max(i) AS i, z, j FROM ends JOIN hits USING (query_id, id) WHERE n = n_terms GROUP BY query_id, id, z, j),
    ranks AS (SELECT query_id, id, sum(0.1::DOUBLE / (1 + (z - a) - (j - i))) AS raw FROM covers GROUP BY ALL
        UNION ALL SELECT query_id, id, 0.1::DOUBLE * tf FROM hits WHERE query_id NOT IN (SELECT query_id FROM hits WHERE matched = n_terms)),
    lexical AS (SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT query_id, id, matched, round(raw / length, 9) AS score FROM ranks JOIN hits USING (query_id, id) JOIN lengths USING (id)))"""
_LEXICAL = f"{_POSTED}, {_LENGTHS}, {_ASKED}, {_RANKED_TERMS}"


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


_indexes: dict[tuple[str, ...], textindex.TextIndex] = {}


def _text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The index of all documents: built when first asked for, and again if the table's files have changed."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time") % 2**40)).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, str(state))
    if key not in _indexes or not spark.catalog.tableExists(f"{_indexes[key].name}_commits"):
        index = textindex.TextIndex(spark, f"text_index_{uuid.uuid4().hex}")
        index.add(table(spark, sf_dir, "documents"), "doc_id", "text")
        _indexes[key] = index
    return _indexes[key]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return textindex.search(_text_index(spark, sf_dir), _asked(spark, sf_dir), k)


@query(f"WITH {_POSTED} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM posted GROUP BY term")
def fts_postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.document_frequencies(_posted(spark, sf_dir))


@query(f"WITH {_LEXICAL} SELECT query_id, id, matched, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 8")
def fts_and_then_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 8)


@query(f"""WITH {_POSTED}, {_LENGTHS}, {_ASKED}, {_RANKED_TERMS}
    SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + (z - a) - (j - i))) / any_value(length), 9) AS score, count(*) AS n_covers, min(z - a) AS shortest FROM covers JOIN lengths USING (id) GROUP BY ALL""")
def fts_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold all terms of an item, by the covers of these."""
    return textindex.all_covers(_text_index(spark, sf_dir), _asked(spark, sf_dir))


_AMENDED = f"""amended AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || b.t ELSE text END AS text FROM documents, (SELECT text AS t FROM benchmark ORDER BY item_id LIMIT 1) b WHERE doc_id % 10 <> 7),
    posted AS {_terms_sql('amended', 'doc_id')}, {_LENGTHS}, {_ASKED}, {_RANKED_TERMS}"""


@query(f"WITH {_AMENDED} SELECT query_id, id, matched, score, rank::INTEGER AS rank FROM lexical WHERE rank <= 8")
def fts_index_amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search after a tenth of the documents has been replaced in the stored index, by themselves and an item's text, and a tenth removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = textindex.TextIndex(spark, f"text_index_{uuid.uuid4().hex}")
    index.add(docs, "doc_id", "text")
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.col("text").alias("t"))
    index.add(docs.where("doc_id % 10 = 3").crossJoin(F.broadcast(item)).select("doc_id", F.concat_ws(" ", "text", "t").alias("text")), "doc_id", "text")
    index.remove(docs.where("doc_id % 10 = 7").select(F.col("doc_id").alias("id")))
    return textindex.search(index, _asked(spark, sf_dir), 8)


# A query's two concepts: the beginnings of its longest two terms together, and of the third alone; roots have 3 to 6 letters.
_CONCEPTS = f"""{_POSTED}, {_LENGTHS}, {_query_terms_sql(3)},
    concepts AS (SELECT query_id, CASE WHEN n < 3 THEN 1 ELSE 2 END AS concept, substring(term, 1, (3 + length(term) % 4)::INTEGER) AS root, CASE WHEN n < 3 THEN n ELSE 1 END AS n, CASE WHEN n < 3 THEN least(n_terms, 2) ELSE 1 END AS n_roots, n < 3 AS is_primary FROM asked WHERE length(term) > 2),
    full_concepts AS (SELECT *, query_id || '.' || concept AS c FROM concepts WHERE (query_id, concept) IN (SELECT query_id, concept FROM concepts GROUP BY ALL HAVING count(*) = max(n_roots) AND count(DISTINCT root) = max(n_roots))),
    latest AS (SELECT c, id, pos, n_roots, max(CASE WHEN n = 1 THEN pos END) OVER w AS p1, CASE WHEN n_roots = 1 THEN pos ELSE max(CASE WHEN n = 2 THEN pos END) OVER w END AS p2
               FROM posted JOIN full_concepts ON starts_with(term, root) WINDOW w AS (PARTITION BY c, id ORDER BY pos RANGE UNBOUNDED PRECEDING)),
    covers AS (SELECT c, id, n_roots, least(p1, p2) AS a, min(pos) AS b FROM latest WHERE p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY ALL),
    density AS (SELECT c, id, sum(0.1::DOUBLE / (1 + greatest(b - a - n_roots + 1, 0))) / any_value(length) AS score FROM covers JOIN lengths USING (id) GROUP BY ALL),
    titles AS (SELECT id, term FROM {_terms_sql("(SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 80) AS text FROM documents)", "doc_id")}),
    titled AS (SELECT c, id FROM titles JOIN full_concepts ON starts_with(term, root) GROUP BY ALL HAVING count(DISTINCT root) = max(n_roots)),
    met AS (SELECT query_id, d.id AS id, count(*) AS n_concepts, count(*) FILTER (WHERE is_primary) AS n_primary, round(sum(score * CASE WHEN t.c IS NULL THEN 1 ELSE 12 END * CASE WHEN is_primary THEN 2 ELSE 1 END), 9) AS score
            FROM density d JOIN (SELECT DISTINCT c, query_id, is_primary FROM full_concepts) USING (c) LEFT JOIN titled t ON t.c = d.c AND t.id = d.id GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_concepts DESC, score DESC, id) AS rank FROM met)"""


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = postings.longest_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", 3).where(F.length("term") > 2)
    first = F.col("n") < 3
    root = F.substring("term", F.lit(1), 3 + F.length("term") % 4)
    concepts = asked.select("query_id", F.when(first, 1).otherwise(2).alias("concept"), root.alias("root"), F.when(first, F.col("n")).otherwise(1).alias("n"), F.when(first, F.least("n_terms", F.lit(2))).otherwise(1).alias("n_roots"), first.alias("is_primary"))
    same = Window.partitionBy("query_id", "concept")
    concepts = concepts.withColumns({"m": F.count("*").over(same), "d": F.size(F.collect_set("root").over(same)), "of": F.max("n_roots").over(same)})
    concepts = concepts.where("m = of and d = of").drop("m", "d", "of")
    title = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 80)
    met = postings.prefix_concepts(table(spark, sf_dir, "documents"), "doc_id", title, "text", concepts, best=3)
    return concepts, relational.top_per_group(met, ["query_id"], [F.desc("n_concepts"), F.desc("score"), F.asc("id")], 3)


@query(f"""WITH {_CONCEPTS}, top AS (SELECT * FROM placed WHERE rank <= 3)
    SELECT query_id, id, n_concepts, n_primary, score, rank::INTEGER AS rank,
           CASE WHEN rank = 1 AND n_primary > 0 AND n_concepts > 1 AND (score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0)) / score > 0.25 THEN 'high'
                WHEN n_primary > 0 THEN 'med' ELSE 'low' END AS confidence FROM top""")
def fts_prefix_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.confidence(_concepts(spark, sf_dir)[1])


@query(f"""WITH {_CONCEPTS}, top AS (SELECT query_id, id FROM placed WHERE rank <= 3),
    places AS (SELECT query_id, id, min(CASE WHEN instr(lower(text), root) > 0 THEN instr(lower(text), root) END) AS place, any_value(text) AS text
               FROM top JOIN full_concepts USING (query_id) JOIN documents ON doc_id = id WHERE length(root) >= 4 GROUP BY ALL)
    SELECT query_id, id, substring(text, greatest(coalesce(place, 1) - 60, 1), 200) AS snippet FROM places""")
def snippet_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, top = _concepts(spark, sf_dir)
    roots = concepts.groupBy("query_id").agg(F.collect_list("root").alias("roots"))  # at most three
    wanted = written(top.select("query_id", "id").join(roots, "query_id"), "wanted")  # of known size, so that texts needn't move
    rows = wanted.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.where(F.exists("roots", lambda r: F.length(r) >= 4)).select("query_id", "id", postings.snippet(F.col("text"), F.col("roots")).alias("snippet"))


# --- fusing, expanding, reranking --------------------------------------------------------------------------------


@query(f"""WITH {_LEXICAL}, {_KNN.format(on='true')},
    legs AS (SELECT query_id, id, 0 AS leg, rank FROM lexical WHERE rank <= 32 UNION ALL SELECT query_id // 100, parent_id, 1, rank FROM ranked WHERE rank <= 32),
    fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(leg * 1000 + rank) AS first FROM legs GROUP BY ALL)
    SELECT query_id, id, rank::INTEGER AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM fused) WHERE rank <= 8""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector.knn(*_vectors(spark, sf_dir), k=32).select(F.floor(F.col("query_id") / 100).alias("query_id"), F.col("parent_id").alias("id"), "rank")
    return rank.reciprocal_rank_fusion([_lexical(spark, sf_dir, 32), near], k=8)


_EDGES = "edges AS (SELECT DISTINCT l_partkey AS from_id, l_suppkey AS to_id FROM lineitem)"


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).distinct()


@query(f"""WITH {_EDGES}, seeds AS (SELECT p_brand AS query_id, p_partkey AS id, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
    first8 AS (SELECT * FROM seeds WHERE rank <= 8),
    cited AS (SELECT query_id, to_id AS id, min(rank) AS seed_rank FROM first8 JOIN edges ON from_id = id JOIN supplier ON s_suppkey = to_id AND s_acctbal > 0 GROUP BY ALL),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, id) AS place FROM cited WHERE (query_id, id) NOT IN (SELECT query_id, id FROM first8))
    SELECT query_id, id, rank::INTEGER AS rank, score FROM first8
    UNION ALL SELECT query_id, id, (n + place)::INTEGER, 0.0 FROM fresh JOIN (SELECT query_id, max(rank) AS n FROM first8 GROUP BY ALL) USING (query_id) WHERE place <= 40""")
def one_hop_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    first = relational.top_per_group(part, ["query_id"], [F.desc("score"), F.asc("id")], 8)
    eligible = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return rank.expand_one_hop(first, _part_edges(spark, sf_dir), eligible)


@query(f"WITH {_EDGES} SELECT to_id, count(*) AS in_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def in_degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_part_edges(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey AS from_id, o_custkey % 50 AS target_act, o_custkey::VARCHAR AS number FROM orders),
    t AS (SELECT c_custkey % 50 AS act, c_custkey::VARCHAR AS number, c_custkey AS to_id FROM customer WHERE c_acctbal > 0 AND c_custkey % 50 <> 7),
    x AS (SELECT r.*, to_id, act IS NOT NULL AS known FROM r LEFT JOIN t ON t.act = target_act AND t.number = r.number LEFT JOIN (SELECT DISTINCT act AS a FROM t) ON a = target_act),
    y AS (SELECT x.*, a IS NOT NULL AS act_known FROM x LEFT JOIN (SELECT DISTINCT act AS a FROM t) ON a = target_act)
    SELECT count(*) AS n_citations, count(*) FILTER (WHERE to_id IS NULL AND NOT act_known) AS n_act_absent, count(*) FILTER (WHERE to_id IS NULL AND act_known) AS n_target_absent,
           count(*) FILTER (WHERE to_id = from_id) AS n_self, count(DISTINCT (from_id, to_id)) FILTER (WHERE to_id <> from_id) AS n_edges FROM y""")
def reference_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from_id"), (F.col("o_custkey") % 50).alias("act"), F.col("o_custkey").cast("string").alias("number"), F.lit(False).alias("in_code"))
    customer = table(spark, sf_dir, "customer").where("c_acctbal > 0 and c_custkey % 50 <> 7")
    targets = customer.select((F.col("c_custkey") % 50).alias("act"), F.col("c_custkey").cast("string").alias("number"), F.col("c_custkey").alias("to_id"))
    return graph.diagnostics(graph.resolve(refs, targets, 0), targets)


@query("""WITH r AS (SELECT o_orderkey AS from_id, o_custkey % 50 AS act, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '.' || o_orderkey % 4 ELSE o_custkey::VARCHAR END AS number FROM orders),
    t AS (SELECT c_custkey % 50 AS act, CASE WHEN c_nationkey % 3 = 0 THEN c_custkey || '.' || c_nationkey % 4 ELSE c_custkey::VARCHAR END AS number FROM customer WHERE c_acctbal > 0 AND c_custkey % 50 <> 7),
    lost AS (SELECT DISTINCT act, number, from_id FROM r WHERE (act, number) NOT IN (SELECT act, number FROM t) AND act IN (SELECT act FROM t)),
    rows AS (SELECT act, number, true AS held FROM t UNION SELECT DISTINCT act, number, false FROM lost),
    placed AS (SELECT *, split_part(number, '.', 1)::INTEGER AS w, CASE WHEN contains(number, '.') THEN split_part(number, '.', 2)::INTEGER ELSE -1 END AS d FROM rows),
    near AS (SELECT *, last_value(CASE WHEN held THEN number END IGNORE NULLS) OVER (PARTITION BY act ORDER BY w, d ROWS UNBOUNDED PRECEDING) AS after,
                    first_value(CASE WHEN held THEN number END IGNORE NULLS) OVER (PARTITION BY act ORDER BY w, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS before FROM placed)
    SELECT near.act, after, before, arg_min(near.number, (w, d)) AS first, arg_max(near.number, (w, d)) AS last, count(DISTINCT near.number) AS n_missing, count(DISTINCT from_id) AS n_citing, min(from_id) AS first_citing
    FROM near JOIN lost ON lost.act = near.act AND lost.number = near.number WHERE NOT held GROUP BY near.act, after, before""")
def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citations of customers, which are articles of fifty acts."""
    number = lambda key, n: F.when(n % 3 == 0, F.concat(key.cast("string"), F.lit("."), (n % 4).cast("string"))).otherwise(key.cast("string"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from_id"), (F.col("o_custkey") % 50).alias("act"), number(F.col("o_custkey"), F.col("o_orderkey")).alias("number"), F.lit(False).alias("in_code"))
    customer = table(spark, sf_dir, "customer").where("c_acctbal > 0 and c_custkey % 50 <> 7")
    targets = customer.select((F.col("c_custkey") % 50).alias("act"), number(F.col("c_custkey"), F.col("c_nationkey")).alias("number"), F.col("c_custkey").alias("to_id"))
    return graph.gaps(graph.resolve(refs, targets, 0), targets)


@query("""WITH r AS (SELECT l_linenumber AS a, l_linenumber + floor(l_quantity)::INTEGER - 3 AS b FROM lineitem),
    x AS (SELECT unnest(CASE WHEN b >= a AND b - a <= 30 THEN range(a, b + 1) ELSE [a, b]::BIGINT[] END) AS number FROM r)
    SELECT number::INTEGER AS number, count(*) AS n FROM x GROUP BY 1""")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber"), (F.col("l_linenumber") + F.floor("l_quantity") - 3)
    return table(spark, sf_dir, "lineitem").select(F.explode(graph.expand_range(a, b)).alias("number")).groupBy("number").agg(F.count("*").alias("n"))


@query("""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets, max(href) AS last_href
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.page_links(table(spark, sf_dir, "pages"), "page_id", "html")
    return links.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_targets"), F.max("href").alias("last_href"))


def _list_terms_sql(column: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({column}), '[^\\pL\\pN._-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) >= 2)"


@query(f"""WITH {_LEXICAL}, c AS (SELECT query_id, id, rank AS came FROM lexical WHERE rank <= 50),
    x AS (SELECT query_id, c.id, came, {_list_terms_sql('b.text')} AS qt, {_list_terms_sql('substring(d.text, 1, 1800)')} AS dt FROM c JOIN documents d ON doc_id = c.id JOIN benchmark b ON item_id = query_id),
    y AS (SELECT query_id, id, came, round(len(list_intersect(list_distinct(qt), list_distinct(dt))) / greatest(len(list_distinct(qt)), 1), 9) AS relevance FROM x)
    SELECT query_id, id, came::INTEGER AS came, relevance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, came) AS rank FROM y) WHERE rank <= 8""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rank.rerank_document(F.col("text"), F.lit(None).cast("string"), "prefix").alias("document"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = written(_lexical(spark, sf_dir, 50).select("query_id", "id", "rank"), "pool").join(docs, "id").join(asked, "query_id")
    out = rank.rerank(rows, rank.term_overlap(T.search_terms("question"), T.search_terms("document")), 8)
    return out.select("query_id", "id", "came", "relevance", "rank")


def _stub_reranker(requests: list[dict]) -> list[dict]:
    """A model that is down for questions of an odd length, alone or together with others."""
    if any(len(r["question"]) % 2 for r in requests):
        raise ConnectionError("no answer")
    return [{"relevance": [float(len(d) % 97) for d in r["documents"]]} for r in requests]


@query(f"""WITH {_LEXICAL}, c AS (SELECT query_id, id, rank AS came FROM lexical WHERE rank <= 20),
    x AS (SELECT query_id, c.id, came, CASE WHEN length(b.text) % 2 = 0 THEN (length(substring(d.text, 1, 1800)) % 97)::DOUBLE END AS relevance FROM c JOIN documents d ON doc_id = c.id JOIN benchmark b ON item_id = query_id)
    SELECT query_id, id, came::INTEGER AS came, relevance, rank::INTEGER AS rank, CASE WHEN relevance IS NULL THEN 'failed after 2: ConnectionError: no answer' ELSE 'ok' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, came) AS rank FROM x) WHERE rank <= 8""")
def rerank_by_failing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 20, by a model that answers for some questions; the others keep their order and say why."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 1800).alias("document"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = written(_lexical(spark, sf_dir, 20).select("query_id", "id", "rank"), "pool").join(docs, "id").join(asked, "query_id")
    return seam.rerank_by_model(rows, 8, _stub_reranker, batch=1, attempts=2, first_wait=0.0).select("query_id", "id", "came", "relevance", "rank", "status")


def _stub_rewriter(requests: list[dict]) -> list[dict]:
    """Three kinds of answers by the message's length: none, an empty one, a whole one."""
    out = []
    for r in requests:
        n = len(r["message"])
        if n % 3 == 0:
            raise ValueError("unparseable")
        full = {"standalone_query": f" about {r['message']} ", "search_terms": "a b", "needs_retrieval": n % 2 == 0, "is_topic_shift": r["history"] == "", "fact_summary": f"{r['known']}; {len(r['history'])}"}
        out.append(full if n % 3 == 1 else {"standalone_query": " ", "fact_summary": None})
    return out


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    u AS (SELECT conv_id, arg_max(text, turn) AS message, max(turn) AS last FROM r WHERE back <= 8 AND role = 'user' GROUP BY 1),
    h AS (SELECT u.conv_id, message, coalesce(string_agg(role || ': ' || coalesce(r.text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE turn < last), '') AS history FROM u JOIN r USING (conv_id) WHERE back <= 8 AND message IS NOT NULL GROUP BY ALL),
    x AS (SELECT conv_id, message, history, length(message) % 3 AS kind, CASE WHEN conv_id % 2 = 0 THEN 'known ' || conv_id ELSE '' END AS known FROM h)
    SELECT conv_id, trim(CASE WHEN kind = 1 THEN trim('about ' || message, ' ') ELSE message END || CASE WHEN kind = 1 THEN ' a b' ELSE '' END, ' ') AS query, CASE WHEN kind = 1 THEN 'a b' ELSE '' END AS search_terms,
           kind <> 1 OR length(message) % 2 = 0 AS needs_retrieval, kind = 1 AND history = '' AS is_topic_shift, CASE WHEN kind = 1 THEN known || '; ' || length(history) ELSE known END AS facts,
           CASE WHEN kind = 0 THEN 'failed after 1: ValueError: unparseable' ELSE 'ok' END AS status FROM x""")
def contextualise_by_failing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    facts = said.where("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("known "), F.col("conv_id").cast("string")).alias("facts")).distinct()
    out = seam.contextualised_by_model(said, "conv_id", "turn", "role", "text", _stub_rewriter, facts, batch=1, attempts=1)
    return out.drop("standalone_query")


_EVENTS = """s AS (SELECT conv_id * 1000 + turn AS session, text, turn % 5 = 0 AS failed, turn % 10 <> 0 AS found FROM conversations WHERE role = 'assistant'),
    d AS (SELECT session, unnest(range(len(x))) AS seq, unnest(x) AS text FROM (SELECT session, regexp_extract_all(text, '(?s).{1,40}') AS x FROM s WHERE NOT failed)),
    e AS (SELECT session, unnest([0, 1]) AS pl, 0 AS seq, 'stage' AS type, unnest(['{"stage":"understanding"}', '{"stage":"searching"}']) AS payload FROM s
        UNION ALL SELECT session, unnest([2, 3, 4]), 0, unnest(['chunks', 'stage', 'stage']), unnest(['{"n":' || length(text) || '}', '{"stage":"reading"}', '{"stage":"writing"}']) FROM s WHERE found
        UNION ALL SELECT session, 5, seq, 'delta', '{"text":' || to_json(text) || '}' FROM d
        UNION ALL SELECT session, 6, 0, CASE WHEN failed THEN 'error' ELSE 'done' END, CASE WHEN failed THEN '{"error":"chat failed"}' ELSE '{"n":' || length(text) || '}' END FROM s)"""


def _answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("session", F.col("conv_id") * 1000 + F.col("turn"))
    failed, size = F.col("turn") % 5 == 0, F.format_string('{"n":%d}', F.length("text"))
    answers = said.select("session", F.when(F.col("turn") % 10 != 0, size).alias("chunks"), size.alias("result"), F.when(failed, "chat failed").alias("error"))
    deltas = said.where(~failed).select("session", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("seq", "text"))
    return events.protocol(answers, deltas.withColumn("seq", F.col("seq").cast("long")))


@query(f"""WITH {_EVENTS} SELECT session, row_number() OVER (PARTITION BY session ORDER BY pl, seq) - 1 AS n, type, payload FROM e""")
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns as answers: their events put in frames, these cut into pieces of 13 bytes, and read back."""
    rows = _answer_events(spark, sf_dir)
    wire = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("n", events.frame_of(F.col("type"), F.col("payload")).alias("frame")))).alias("all"))
    sent = wire.select("session", F.hex(F.encode(F.array_join(F.transform("all", lambda x: x["frame"]), ""), "UTF-8")).alias("h"))
    pieces = sent.select("session", F.posexplode(F.regexp_extract_all("h", F.lit(".{1,26}"), F.lit(0))).alias("seq", "h")).select("session", "seq", F.unhex("h").alias("piece"))
    return events.read_frames(pieces)


@query("""WITH m AS (SELECT user_id AS session, event_type AS stage, epoch_us(ts) // 1000 AS ms FROM events),
    f AS (SELECT session, min(ms) FILTER (WHERE stage = 'view') AS a, min(ms) FILTER (WHERE stage = 'click') AS b, min(ms) FILTER (WHERE stage = 'purchase') AS c, min(ms) AS s, max(ms) AS z FROM m GROUP BY 1)
    SELECT session, coalesce(list_min(list_filter([a, b, c, z], lambda t: t > a)), a) - a AS view, coalesce(list_min(list_filter([a, b, c, z], lambda t: t > b)), b) - b AS click,
           coalesce(list_min(list_filter([a, b, c, z], lambda t: t > c)), c) - c AS purchase, c - s AS first, z - s AS total FROM f""")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as the marks of stages."""
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("stage"), F.col("ts").alias("at"))
    return events.stage_timings(marks, ["view", "click", "purchase"], "purchase")


@query("""WITH x AS (SELECT doc_id, '[Source] ' || source || chr(10) || '---' || chr(10) || text AS t, source, string_split(text, chr(10)) AS l FROM documents),
    y AS (SELECT doc_id, substring(t, 1, 1800) AS head, CASE WHEN len(l) > 1 THEN l[doc_id % len(l) + 1] END AS piece, '[Source] ' || source || chr(10) || '---' || chr(10) AS h FROM x)
    SELECT doc_id, sha256(head) AS prefix_sha256, sha256(coalesce(substring(h || piece, 1, 3600), head)) AS slice_sha256, sha256(coalesce(substring(head || chr(10) || '…' || chr(10) || piece, 1, 3600), head)) AS both_sha256 FROM y""")
def rerank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker would read of each document in each mode, a line of it being the matched slice."""
    head = F.concat(F.lit("[Source] "), "source", F.lit("\n---\n"))
    rows = table(spark, sf_dir, "documents").withColumns({"lines": F.split("text", "\n"), "full": F.concat(head, "text")})
    piece = F.when(F.size("lines") > 1, F.concat(head, F.get("lines", (F.col("doc_id") % F.size("lines")).cast("int"))))
    return rows.select("doc_id", *[F.sha2(rank.rerank_document(F.col("full"), piece, mode), 256).alias(f"{mode}_sha256") for mode in ("prefix", "slice", "both")])


# --- sessions and tables -----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS depth FROM events)
    SELECT user_id, event_type, event_id, value, depth::INTEGER AS depth, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY depth, event_type) AS rank FROM d) WHERE rank <= 5""")
def carry_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.round_robin(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), "user_id", "event_type", "event_id", "value")


@query("""WITH n AS (SELECT c_custkey % 200 AS conv_id, min(c_name) AS u, min(c_address) AS a FROM customer GROUP BY 1),
    m AS (SELECT n.*, coalesce(max(turn) + 1, 0) AS next FROM n LEFT JOIN conversations USING (conv_id) GROUP BY ALL)
    SELECT conv_id, next AS turn, 'user' AS role, u AS text FROM m UNION ALL SELECT conv_id, next + 1, 'assistant', a FROM m""".replace("c_address", "c_mktsegment"))
def append_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn more for two hundred sessions, some of them new."""
    new = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 200).alias("conv_id")).agg(F.min("c_name").alias("user"), F.min("c_mktsegment").alias("assistant"))
    return relational.append_turns(table(spark, sf_dir, "conversations"), new, "conv_id", "turn")


_CRAWL = """k AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE md5(html) END AS hash, CASE WHEN page_id % 4 > 0 THEN page_id % 7 END AS checked FROM pages WHERE page_id % 3 > 0),
    w AS (SELECT page_id FROM k WHERE checked IS NULL OR checked < 4 UNION ALL SELECT page_id FROM pages WHERE page_id % 3 = 0),
    f AS (SELECT page_id, CASE WHEN page_id % 11 > 0 THEN md5(html) END AS hash, 9 AS checked, CASE WHEN page_id % 11 = 0 THEN 'timed out' END AS error FROM pages WHERE page_id IN (SELECT page_id FROM w)),
    m AS (SELECT page_id, k.hash AS h0, k.checked AS c0, f.hash AS h1, f.checked AS c1, error FROM k FULL JOIN f USING (page_id))"""


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two in three pages known, some with another hash; those not checked lately and the new ones are fetched, of which some fail."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("hash"))
    known = pages.where("page_id % 3 > 0").select("page_id", F.when(F.col("page_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 7).alias("checked"))
    wanted = relational.worklist(known, "page_id", "checked", F.lit(4)).unionByName(pages.where("page_id % 3 = 0").select("page_id"))
    fails = F.col("page_id") % 11 == 0
    fetched = pages.join(wanted, "page_id", "left_semi").select("page_id", F.when(~fails, F.col("hash")).alias("hash"), F.lit(9).cast("long").alias("checked"), F.when(fails, "timed out").alias("error"))
    return relational.crawl_round(known, fetched, "page_id")


@query(f"WITH {_CRAWL} SELECT page_id, CASE WHEN c1 IS NOT NULL AND error IS NULL THEN h1 ELSE h0 END AS hash, coalesce(c1, c0) AS checked FROM m")
def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir)[0]


@query(f"""WITH {_CRAWL} SELECT * FROM (SELECT page_id, c1 AS checked, CASE WHEN error IS NOT NULL THEN 'failed' WHEN h0 IS NULL THEN 'added' WHEN h0 <> h1 THEN 'changed' END AS kind, error FROM m WHERE c1 IS NOT NULL) WHERE kind IS NOT NULL""")
def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir)[1]


@query("""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_message, max(turn) AS last_turn
    FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0 ORDER BY n_user DESC, conv_id LIMIT 40""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.session_list(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return said.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"), "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3)


@query("SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS n_good, (SELECT max(n_chars) FROM documents) AS longest")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id").agg(F.count("*").alias("n_good"))
    return docs.agg(F.count("*").alias("n_documents"), F.max("n_chars").alias("longest")).crossJoin(good)  # a row each


_OLD_NEW = "o AS (SELECT user_id, event_type, max(value) AS score, max(event_id) AS turn FROM events WHERE value < 50 GROUP BY ALL), n AS (SELECT user_id, event_type, min(value) AS score, max(event_id) AS turn FROM events WHERE value >= 20 GROUP BY ALL)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    old = e.where("value < 50").groupBy("user_id", "event_type").agg(F.max("value").alias("score"), F.max("event_id").alias("turn"))
    return old, e.where("value >= 20").groupBy("user_id", "event_type").agg(F.min("value").alias("score"), F.max("event_id").alias("turn"))


@query(f"WITH {_OLD_NEW} SELECT user_id, event_type, coalesce(greatest(o.score, n.score), o.score, n.score) AS score, coalesce(n.turn, o.turn) AS turn FROM o FULL JOIN n USING (user_id, event_type)")
def upsert_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.upsert_greatest(*_old_new(spark, sf_dir), ["user_id", "event_type"], "score", "turn")


@query(f"WITH {_OLD_NEW} SELECT user_id, event_type, CASE WHEN n.turn IS NULL OR o.turn > n.turn THEN o.score ELSE n.score END AS score, coalesce(greatest(o.turn, n.turn), o.turn, n.turn) AS turn FROM o FULL JOIN n USING (user_id, event_type)")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.upsert_last_wins(*_old_new(spark, sf_dir), ["user_id", "event_type"], "turn")


@query(f"WITH {_OLD_NEW} SELECT user_id, event_type, coalesce(o.score, n.score) AS score, CASE WHEN o.turn IS NULL THEN n.turn ELSE o.turn END AS turn FROM o FULL JOIN n USING (user_id, event_type)")
def insert_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.insert_do_nothing(*_old_new(spark, sf_dir), ["user_id", "event_type"])


@query(f"WITH {_OLD_NEW} SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n WHERE event_type = 'click') UNION ALL SELECT * FROM n WHERE event_type = 'click'")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return relational.replace_by_key(old, new.where("event_type = 'click'"), ["user_id"])


@query("""SELECT doc_id, substring(sha256(text), 1, 16) AS fingerprint FROM documents
    WHERE (doc_id, substring(sha256(text), 1, 16)) NOT IN (SELECT doc_id, substring(sha256(CASE WHEN quality = 0 THEN lower(text) ELSE text END), 1, 16) FROM documents JOIN labels USING (doc_id))""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    earlier = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), T.fingerprint16(F.when(F.col("quality") == 0, F.lower("text")).otherwise(F.col("text"))).alias("fingerprint"))
    return incremental.to_do(docs, earlier, "doc_id", "text").select("doc_id", "fingerprint")


_DIFF = """l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    o AS (SELECT doc_id, pos, sha256(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS h FROM l),
    n AS (SELECT doc_id, pos, sha256(trim(regexp_replace(CASE WHEN toxic = 1 THEN upper(line) ELSE line END, '\\s+', ' ', 'g'))) AS h FROM l LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1),
    diff AS (SELECT doc_id, pos, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' ELSE 'same' END AS change FROM o FULL JOIN n USING (doc_id, pos))"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = segment.lines(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
    now = old.join(table(spark, sf_dir, "labels"), "doc_id", "left").where("coalesce(quality, 1) = 1")
    now = now.select("doc_id", "pos", F.when(F.col("toxic") == 1, F.upper("line")).otherwise(F.col("line")).alias("line"))
    return incremental.chunk_diff(old, now, ["doc_id", "pos"], "line")


@query(f"WITH {_DIFF} SELECT change, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM diff GROUP BY 1")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"))


@query(f"""WITH {_DIFF} SELECT doc_id, CASE WHEN count(*) FILTER (WHERE change <> 'removed') = 0 THEN 'error' WHEN count(*) FILTER (WHERE change <> 'same') > 0 THEN 'changed' ELSE 'unchanged' END AS status,
    count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) FILTER (WHERE change = 'modified') AS n_modified FROM diff GROUP BY 1""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.document_status(_diff(spark, sf_dir), "doc_id")


@query("SELECT user_id, event_type, datediff('day', max(ts), (SELECT max(ts) FROM events)) AS days, datediff('day', max(ts), (SELECT max(ts) FROM events)) >= 10 AS is_silent FROM events GROUP BY ALL")
def silence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return incremental.silence(e.crossJoin(now), ["user_id", "event_type"], "ts", F.max("now"))


_ALIASES = "a AS (SELECT s_suppkey + 7 AS alias_id, s_suppkey AS document_id FROM supplier WHERE s_acctbal < 0)"


def _aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    return s, s.where("s_acctbal < 0").select((F.col("s_suppkey") + 7).alias("alias_id"), F.col("s_suppkey").alias("document_id"))


@query(f"WITH {_ALIASES} SELECT s_suppkey AS lookup_id, s_suppkey AS id, false AS is_alias FROM supplier UNION ALL SELECT alias_id, document_id, true FROM a")
def alias_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.alias_view(*_aliases(spark, sf_dir), "s_suppkey", "alias_id", "document_id")


@query(f"WITH {_ALIASES} SELECT alias_id, document_id FROM a WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = alias_id AND s_suppkey <> document_id)")
def alias_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.alias_collisions(*_aliases(spark, sf_dir), "s_suppkey", "alias_id", "document_id")


@query(f"""WITH {_EDGES} SELECT from_id, to_id, s_name, n_name, place::INTEGER AS place FROM (
    SELECT from_id, to_id, s_name, n_name, row_number() OVER (PARTITION BY from_id ORDER BY s_name, to_id) AS place FROM edges JOIN supplier ON s_suppkey = to_id JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) WHERE place <= 3""")
def related_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's lines cite, in force, with where it belongs, the first three by name."""
    targets = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return graph.related(_part_edges(spark, sf_dir), targets.select(F.col("s_suppkey").alias("to_id"), "s_name", "n_name"), "s_name", 3)


@query("""WITH s AS (SELECT DISTINCT conv_id, 'fact ' || conv_id AS fact_summary, 0 AS started FROM conversations WHERE turn = 0 AND conv_id % 3 > 0),
    n AS (SELECT conv_id, nullif(left(arg_max(text, turn), 30 * (conv_id % 2)::INTEGER), '') AS fact_summary FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT conv_id, CASE WHEN n.conv_id IS NULL THEN s.fact_summary ELSE n.fact_summary END AS fact_summary, coalesce(started, -1) AS started FROM s FULL JOIN n USING (conv_id)""")
def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of sessions updated from the last thing their users said, null where that gives none; new sessions are created."""
    said = table(spark, sf_dir, "conversations")
    old = said.where("turn = 0 and conv_id % 3 > 0").select("conv_id", F.concat(F.lit("fact "), F.col("conv_id").cast("string")).alias("fact_summary"), F.lit(0).alias("started")).distinct()
    last = said.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    new = last.select("conv_id", F.nullif(F.left("text", (30 * (F.col("conv_id") % 2)).cast("int")), F.lit("")).alias("fact_summary"))
    return relational.update_by_key(old, new, ["conv_id"], ["fact_summary"]).fillna(-1, ["started"])


@query("""WITH c AS (SELECT user_id, event_id, value, event_type AS turn, p_partkey, s_name FROM events JOIN part ON p_partkey = event_id % 199 + 1 JOIN supplier ON s_suppkey = p_partkey % 9 + 1 WHERE event_id % 5 > 0),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, turn DESC, event_id) AS cut FROM c) WHERE cut <= 20),
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id, turn ORDER BY value DESC, event_id) AS depth FROM m)
    SELECT user_id, turn, event_id, value, p_partkey, s_name, depth::INTEGER AS depth, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY depth, turn) AS rank FROM d) WHERE rank <= 5""")
def carried_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session chunks with their articles and documents, the best twenty of a session, then five of them in turn."""
    part, supplier = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = table(spark, sf_dir, "events").where("event_id % 5 > 0").withColumn("p_partkey", F.col("event_id") % 199 + 1).join(part, "p_partkey")
    rows = rows.withColumn("s_suppkey", F.col("p_partkey") % 9 + 1).join(supplier, "s_suppkey").select("user_id", F.col("event_type").alias("turn"), "event_id", "value", "p_partkey", "s_name")
    return relational.round_robin(rows, "user_id", "turn", "event_id", "value", most=20)


@query("""WITH k AS (SELECT lang, source, min(doc_id) AS article_id FROM documents WHERE doc_id % 4 > 0 GROUP BY ALL),
    v AS (SELECT vec_id, ['en', 'fr', 'de', 'xx'][(label % 4 + 1)::INTEGER] AS lang, (SELECT min(source) FROM documents) AS source FROM embeddings)
    SELECT vec_id, lang, coalesce(article_id, -1) AS article_id FROM v LEFT JOIN k USING (lang, source)""")
def embedding_key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under natural keys get the ids of what has the keys; orphans get none."""
    docs = table(spark, sf_dir, "documents")
    source = docs.agg(F.min("source").alias("source"))  # one row
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "xx"))), (F.col("label") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", lang.alias("lang")).crossJoin(source)
    targets = docs.where("doc_id % 4 > 0").withColumnRenamed("doc_id", "article_id")
    return relational.key_map(rows, targets, ["lang", "source"], "article_id").select("vec_id", "lang", F.coalesce("article_id", F.lit(-1)).alias("article_id"))


@query("""WITH e AS (SELECT vec_id // 4 AS parent, label FROM embeddings WHERE label IS DISTINCT FROM 2)
    SELECT label, count(*) AS n, count(DISTINCT parent) AS n_parents, (SELECT count(DISTINCT doc_id) FROM documents) AS n_all, round(100 * count(DISTINCT parent) / (SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE, 6) AS percent
    FROM e WHERE parent IN (SELECT doc_id FROM documents) GROUP BY 1""")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's vectors deleted, then what the others cover; labels stand for models."""
    rows = relational.without(table(spark, sf_dir, "embeddings"), "label", 2).select(F.floor(F.col("vec_id") / 4).alias("parent"), "label")
    return relational.coverage(rows, table(spark, sf_dir, "documents"), "label", "parent", "doc_id")


@query("""SELECT lang, count(*) AS n_eligible, count(*) FILTER (WHERE doc_id NOT IN (SELECT vec_id // 4 FROM embeddings)) AS n_missing
    FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND coalesce(text, '') <> '' GROUP BY 1""")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "documents").where("coalesce(text, '') <> ''").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    done = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("parent"))
    return relational.eligible_and_missing(good, done, "doc_id", "parent", "lang")


@query("""SELECT doc_id, source, quality, sha256(text) AS text_sha256 FROM documents JOIN labels USING (doc_id)
    WHERE (source, quality) IN (SELECT source, min(quality) FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def judge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by keys that a journal names: of each source the documents of its worst verdict."""
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "text")
    keys = judged.groupBy("source").agg(F.min("quality").alias("quality"))
    return judged.join(keys, ["source", "quality"], "left_semi").select("doc_id", "source", "quality", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))) AS title, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.lower(T.normalise_space(F.element_at(F.split("text", "\n"), 1)))
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(title.alias("title")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH c AS (SELECT query_id, id, score, rank FROM (SELECT q.doc_id AS query_id, t.first_id AS id, t.n AS score, row_number() OVER (PARTITION BY q.doc_id ORDER BY t.n DESC, t.first_id) AS rank
        FROM (SELECT doc_id, lower(text) AS x FROM documents WHERE doc_id % 100 = 0) q JOIN (SELECT lower(trim(split_part(text, chr(10), 1), ' ')) AS title, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) t ON length(title) > 3 AND title = split_part(x, chr(10), 1)) WHERE rank <= 2)
    SELECT doc_id AS query_id, coalesce(id, -1) AS id, coalesce(score, 0) AS score, coalesce(rank, 0)::INTEGER AS rank FROM documents LEFT JOIN c ON query_id = doc_id WHERE doc_id % 100 = 0""")
def title_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the title index proposes for each query; queries without a proposal keep a row."""
    docs = table(spark, sf_dir, "documents")
    title = F.lower(F.trim(F.element_at(F.split("text", "\n"), 1)))
    index = docs.groupBy(title.alias("title")).agg(F.count("*").alias("score"), F.min("doc_id").alias("id")).where(F.length("title") > 3)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.element_at(F.split(F.lower("text"), "\n"), 1).alias("title"))
    best = relational.top_per_group(asked.join(index, "title"), ["query_id"], [F.desc("score"), F.asc("id")], 2)
    return asked.select("query_id").join(best.select("query_id", "id", "score", "rank"), "query_id", "left").fillna({"rank": 0, "score": 0, "id": -1})


@query("""SELECT o_custkey AS by_id, o_orderkey AS id, o_orderpriority AS language, strftime(o_orderdate, '%Y-%m-%d') AS amended FROM (
    SELECT *, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate END) OVER (PARTITION BY o_custkey) AS original FROM orders) WHERE o_orderpriority NOT LIKE '1%' AND o_orderdate < original""")
def stale_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of a customer's act, the first priority as its original: translations amended before it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("by_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("language"), F.col("o_orderdate").alias("amended"), F.substring("o_orderpriority", 1, 1).alias("rank"))
    return context.stale_translations(rows, "by_id", "rank", "amended", "1").select("by_id", "id", "language", F.date_format("amended", "yyyy-MM-dd").alias("amended"))


@query("""SELECT unnest(['has_text', 'known_language', 'is_short', 'counts_its_text']) AS rule, unnest([count(*) FILTER (WHERE NOT coalesce(text <> '', false)), count(*) FILTER (WHERE NOT coalesce(lang IN ('en', 'fr', 'de'), false)),
    count(*) FILTER (WHERE NOT coalesce(length(text) <= 6000, false)), count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false))]) AS n FROM documents""")
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents break each rule."""
    rules = {"has_text": "text <> ''", "known_language": "lang in ('en', 'fr', 'de')", "is_short": "length(text) <= 6000", "counts_its_text": "n_chars = length(text)"}
    return failed_expectations(table(spark, sf_dir, "documents"), rules)


# --- segments, slices, headers -----------------------------------------------------------------------------------

_LINES = "l AS (SELECT doc_id AS id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
_ISLANDS = f"{_LINES}, s AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS segment FROM l)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_ISLANDS} SELECT id, segment, min(pos)::INTEGER AS first_pos, count(*) AS n_blocks, trim(string_agg(line, chr(10) ORDER BY pos), ' ') AS text FROM s WHERE segment > 0 GROUP BY ALL")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines open segments; what comes before the first is left out."""
    cut = segment.islands(_lines(spark, sf_dir), F.length("line") < 60).where("segment > 0")
    return segment.joined(cut, ["id", "segment"])


@query(f"""WITH {_LINES} SELECT heading, count(*) AS n, count(DISTINCT id) AS n_documents FROM (
    SELECT id, last_value(CASE WHEN length(line) < 25 THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM l) GROUP BY 1""")
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.carry_forward(_lines(spark, sf_dir), F.when(F.length("line") < 25, F.col("line")), "heading")
    return rows.groupBy("heading").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_documents"))


@query("""WITH r AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, floor(l_quantity)::INTEGER AS number FROM lineitem),
    o AS (SELECT *, number > coalesce(max(number) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM r),
    g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS grp FROM o)
    SELECT id, grp::BIGINT AS "group", count(*) AS n, max(number) AS number FROM g GROUP BY ALL""")
def monotone_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(order).alias("pos"), F.floor("l_quantity").cast("int").alias("number"))
    return segment.monotone_groups(rows, F.col("number")).groupBy("id", "group").agg(F.count("*").alias("n"), F.max("number").alias("number"))


@query("""SELECT p_partkey, p_brand, CASE WHEN n > 1 THEN p_type || ' (' || n || ')' ELSE p_type END AS ref FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)""")
def dup_ref_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_type").alias("ref"))
    return segment.unique_refs(rows, ["p_brand"], "ref", "p_partkey")


@query("""WITH a AS (SELECT source, list_sort(list(n_chars)) AS v FROM documents GROUP BY 1)
    SELECT source, len(v)::BIGINT AS n, v[1] AS min_size, v[floor((len(v) - 1) * 0.5)::INTEGER + 1] AS p50, v[floor((len(v) - 1) * 0.9)::INTEGER + 1] AS p90, v[-1] AS max_size, list_sum(v)::BIGINT AS total_size FROM a""")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.size_report(table(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("""WITH h AS (SELECT doc_id, '[Document] ' || doc_id || chr(10) || '[Type] ' || lang || CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN ' | [Status] in_force' ELSE ' | [Status] repealed' END
        || chr(10) || '[Location] ' || source || ' › ' || doc_id || chr(10) || '---' || chr(10) || text AS full_text, text, source, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, length(full_text)::INTEGER AS n_chars, source || ' › ' || doc_id AS location, CASE quality WHEN 1 THEN 'in_force' WHEN 0 THEN 'repealed' END AS status, sha256(text) AS body_sha256 FROM h""")
def header_build_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    nothing, key = F.lit(None).cast("string"), F.col("doc_id").cast("string")
    status = F.when(F.col("quality") == 1, "in_force").when(F.col("quality") == 0, "repealed")
    full = segment.with_header(key, F.col("lang"), status, F.array("source"), key, nothing, nothing, nothing, nothing, F.col("text"))
    rows = docs.select("doc_id", full.alias("full"))
    head = T.header_of("full")
    return rows.select(
        "doc_id",
        F.length("full").alias("n_chars"),
        T.header_field(head, "Location").alias("location"),
        F.nullif(F.regexp_extract(head, "\\[Status\\] (\\S+)", 1), F.lit("")).alias("status"),
        F.sha2(T.body_of("full"), 256).alias("body_sha256"),
    )


@query("""WITH b AS (SELECT doc_id AS id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 6 WHEN 1 THEN i || '. ' WHEN 2 THEN '12.5 ' WHEN 3 THEN i || ') ' WHEN 4 THEN i || ')' WHEN 5 THEN 'ա) ' ELSE '' END || x), 'string_agg', chr(10)) AS body FROM documents),
    l AS (SELECT id, body, unnest(string_split(body, chr(10))) AS line FROM b)
    SELECT id, length(any_value(body))::INTEGER AS n_chars, count(*) FILTER (WHERE regexp_matches(line, '^\\s*\\d+(\\.\\d+)*\\.\\s') OR regexp_matches(line, '^\\s*(\\d+\\)|[ա-ֆ][.)])\\s') OR regexp_matches(line, '^\\|\\s*\\d+\\)')) >= 4 AND length(any_value(body)) >= 2500 AS is_enumeration FROM l GROUP BY id""")
def enumeration_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are marked: three in six as parts or points, two with numbers that mark none."""
    n = lambda i: (i + 1).cast("string")
    mark = lambda i: F.when(i % 6 == 0, F.concat(n(i), F.lit(". "))).when(i % 6 == 1, "12.5 ").when(i % 6 == 2, F.concat(n(i), F.lit(") "))).when(i % 6 == 3, F.concat(n(i), F.lit(")"))).when(i % 6 == 4, "ա) ").otherwise("")
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i), x))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(marked, "\n").alias("body"))
    return rows.select("id", F.length("body").alias("n_chars"), segment.is_enumeration(F.col("body")).alias("is_enumeration"))


# Documents as chunks with a table's header before them and every third line made a row of it.
_TABLED = """b AS (SELECT doc_id AS id, '[Source] ' || source || chr(10) || '---' AS head, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN '| ' || x ELSE x END), 'string_agg', chr(10)) AS body FROM documents)"""


def _tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("| "), x)).otherwise(x))
    body = F.concat(F.lit("| a | b |\n| --- | --- |\n"), F.array_join(marked, "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[Source] "), F.col("source"), F.lit("\n---")).alias("head"), body.alias("body"))


@query(f"""WITH {_TABLED}, l AS (SELECT id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT id, string_split(body, chr(10)) AS x FROM b)),
    k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 0 WHEN starts_with(line, '|') THEN 2 ELSE 1 END AS kind FROM l),
    o AS (SELECT *, CASE WHEN kind = 2 OR (kind = 1 AND coalesce(lag(kind) OVER (PARTITION BY id ORDER BY pos), 0) <> 1) THEN 1 ELSE 0 END AS opens FROM k),
    u AS (SELECT id, unit, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS unit FROM o) WHERE kind > 0 GROUP BY ALL),
    r AS (SELECT id, greatest(256, 512 - ceil((strlen(head) + 1) / 4) - 6 - 16)::BIGINT AS room FROM b),
    s AS (SELECT id, unit, room, list_filter(string_split(regexp_replace(text, '([։.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS x FROM u JOIN r USING (id) WHERE ceil(strlen(text) / 4) >= room),
    f AS (SELECT id, unit, list_reduce(list_prepend({{'out': []::VARCHAR[], 'held': ''}}, list_transform(x, lambda t: {{'out': []::VARCHAR[], 'held': t}})), lambda a, t:
        CASE WHEN ceil(strlen(t.held) / 4) >= room THEN {{'out': list_concat(list_append(a.out, a.held), regexp_extract_all(t.held, '(?s).{{1,' || room || '}}')), 'held': ''}}
             WHEN a.held <> '' AND ceil(strlen(a.held || ' ' || t.held) / 4) >= room THEN {{'out': list_append(a.out, a.held), 'held': t.held}}
             WHEN a.held = '' THEN {{'out': a.out, 'held': t.held}} ELSE {{'out': a.out, 'held': a.held || ' ' || t.held}} END) AS z FROM s),
    p AS (SELECT id, unit, 0 AS n, text FROM u JOIN r USING (id) WHERE ceil(strlen(text) / 4) < room
        UNION ALL SELECT id, unit, unnest(range(len(z.out) + 1)), regexp_replace(unnest(list_append(z.out, z.held)), '^\\s+|\\s+$', '', 'g') FROM f),
    a AS (SELECT id, list(text ORDER BY unit, n) AS texts, list(ceil(strlen(text) / 4)::INTEGER ORDER BY unit, n) AS sizes FROM p WHERE text <> '' GROUP BY 1),
    g AS (SELECT b.id, head, body, texts, list_reduce(list_transform(sizes, lambda t: {{'i': 1, 'used': t, 'begins': [0]}}), lambda x, y: {{'i': x.i + 1, 'used': CASE WHEN x.used + y.used > room THEN y.used ELSE x.used + y.used END,
        'begins': CASE WHEN x.used + y.used > room THEN list_append(x.begins, x.i) ELSE x.begins END}}).begins AS begins FROM b JOIN r USING (id) JOIN a USING (id)),
    c AS (SELECT id, head, ceil(strlen(head || chr(10) || body) / 4) <= 512 AS whole, CASE WHEN whole THEN [[body]] ELSE list_transform(begins, lambda x, i: texts[x + 1:coalesce(begins[i + 1], len(texts))]) END AS groups FROM g),
    e AS (SELECT id, head, whole, len(groups) AS n_slices, unnest(range(len(groups))) AS i, unnest(groups) AS units FROM c)
    SELECT id AS parent_id, id || CASE WHEN whole THEN '' ELSE '::' || i END AS slice_id, i::INTEGER AS slice_index, n_slices::INTEGER AS n_slices,
           sha256(head || chr(10) || CASE WHEN i > 0 AND len(list_filter(units, lambda x: starts_with(x, '|'))) > 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) ELSE '' END || list_aggregate(units, 'string_agg', chr(10))) AS text_sha256 FROM e""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of documents at 512 estimated tokens."""
    return segment.slices(_tabled(spark, sf_dir), "doc_id", "head", "body", most=512, cap=1024).select("parent_id", "slice_id", "slice_index", "n_slices", F.sha2("text", 256).alias("text_sha256"))


@query()
def slices_exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of documents at 512 tokens, none over 600, by a byte-level vocabulary."""
    import public_tokenizers

    counter = counters.vocabulary_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    cut = segment.slices(_tabled(spark, sf_dir), "doc_id", "head", "body", most=512, cap=600, counter=counter)
    return cut.select("parent_id", "slice_id", "slice_index", "n_slices", "tokens", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH p AS (SELECT p_partkey AS id, '[Document] ' || p_brand || chr(10) || '---' AS head, trim(repeat(p_name || ' ', 100)) AS a, trim(repeat(p_type || ' ', 80)) AS b, p_brand AS brand FROM part),
    i AS (SELECT id, head, unnest([0, 1, 2, 3, 4]) AS n, unnest(['1. ' || a, '1) ' || b || chr(10) || 'goes on ' || brand, '2) ' || b, '2. ' || b || a, '3) ' || a]) AS text,
                 unnest([NULL, left('1. ' || a, 220), left('1. ' || a, 220), NULL, left('2. ' || b || a, 220)]) AS lead FROM p WHERE id % 2 = 0),
    x AS (SELECT id AS parent_id, id || '::e' || n AS slice_id, n::INTEGER AS slice_index, 5 AS n_slices, head || chr(10) || coalesce(lead || chr(10), '') || text AS text FROM i
        UNION ALL SELECT id, id::VARCHAR, 0, 1, head || chr(10) || '1. ' || a || chr(10) || '2. ' || brand FROM p WHERE id % 2 = 1)
    SELECT *, ceil(strlen(text) / 4)::INTEGER AS tokens FROM x""")
def policy_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks: every second one an enumeration of parts and points, which has a slice an item, the others packed."""
    a, b = F.trim(F.repeat(F.concat("p_name", F.lit(" ")), 100)), F.trim(F.repeat(F.concat("p_type", F.lit(" ")), 80))
    listed = F.concat(F.lit("1. "), a, F.lit("\n1) "), b, F.lit("\ngoes on "), "p_brand", F.lit("\n2) "), b, F.lit("\n2. "), b, a, F.lit("\n3) "), a)
    body = F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(F.concat(F.lit("1. "), a, F.lit("\n2. "), "p_brand"))
    chunk = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("[Document] "), "p_brand", F.lit("\n---")).alias("head"), body.alias("body"))
    return segment.slices_by("enumerated", chunk, "p_partkey", "head", "body")


@query("""WITH b AS (SELECT doc_id AS id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 1 THEN i || '. ' || x WHEN i % 7 = 0 THEN '| ' || x ELSE x END), 'string_agg', chr(10)) AS body FROM documents),
    l AS (SELECT id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT id, string_split(body, chr(10)) AS x FROM b)),
    s AS (SELECT *, regexp_matches(line, '^\\d{1,3}\\.\\s+\\S') AND NOT starts_with(line, '|') AND NOT coalesce(starts_with(lag(line) OVER (PARTITION BY id ORDER BY pos), '|'), false) AS starts FROM l),
    p AS (SELECT id, piece, sum(length(line)) + count(*) - 1 AS size FROM (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY id ORDER BY pos) AS piece FROM s) GROUP BY ALL),
    t AS (SELECT id, count(*) AS n, sum(size) + count(*) - 1 AS total, max(size) AS largest FROM p GROUP BY 1), e AS (SELECT *, unnest([1000, 2000, 4000]) AS threshold FROM t)
    SELECT threshold, count(*) AS n_texts, count(*) FILTER (WHERE total > threshold) AS n_cut, sum(CASE WHEN total > threshold THEN n ELSE 1 END)::BIGINT AS n_units, count(*) FILTER (WHERE total > threshold AND largest > threshold) AS n_still_over FROM e GROUP BY 1""")
def part_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbered lines and rows of tables: what cutting at parts would give at some thresholds."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat((i + 1).cast("string"), F.lit(". "), x)).when(i % 7 == 6, F.concat(F.lit("| "), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("body"))
    return segment.split_sizes(segment.part_pieces(docs, "doc_id", "body"), (1000, 2000, 4000))


# --- scripts, pages, numbers -------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, CASE lang WHEN 'de' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') WHEN 'fr' THEN translate(text, 'aeimnorstu', 'աեիմնորստու') ELSE text END AS text FROM documents),
    c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS n_latin, len(regexp_extract_all(text, '[\\x{0400}-\\x{052F}]')) AS n_cyrillic, len(regexp_extract_all(text, '[\\x{0531}-\\x{0556}\\x{0561}-\\x{0587}]')) AS n_armenian FROM t)
    SELECT *, CASE WHEN greatest(n_latin, n_cyrillic, n_armenian) <= 200 THEN NULL WHEN n_armenian >= greatest(n_latin, n_cyrillic) THEN 'hy' WHEN n_cyrillic >= n_latin THEN 'ru' ELSE 'en' END AS script,
           CASE WHEN n_cyrillic > n_armenian THEN 'ru' ELSE 'hy' END AS answer_language FROM c""")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three scripts: German ones in Cyrillic letters, French ones partly in Armenian."""
    text = F.when(F.col("lang") == "de", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")).when(F.col("lang") == "fr", F.translate("text", "aeimnorstu", "աեիմնորստու")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    counts = [T.script_count("text", s).alias(f"n_{n}") for s, n in (("en", "latin"), ("ru", "cyrillic"), ("hy", "armenian"))]
    return rows.select("doc_id", *counts, T.dominant_script("text").alias("script"), T.answer_language("text").alias("answer_language"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.classified(html.raw_blocks(table(spark, sf_dir, "pages"), "page_id", "html"))


@query("""SELECT id, title, body_sha256, n_comments FROM (SELECT page_id AS id, trim(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title,
    sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_sha256,
    len(regexp_extract_all(html, '(?i)class="[^"]*comment'))::BIGINT AS n_comments FROM pages)""")
def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.posts(table(spark, sf_dir, "pages"), "page_id", "html").select("id", "title", F.sha2("body", 256).alias("body_sha256"), "n_comments")


# Parts as acts: by turns with articles, with points and an annex, and with tables only. What their pages hold is known
# from what they are made of.
_P = "p_partkey AS id, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size"
_TABLE = "brand || chr(10) || type || ' ' || size || chr(10) || id", "'| ' || brand || ' | ' || brand || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || type || ' | ' || size || ' |' || chr(10) || '| ' || type || ' | ' || id || ' |'"


def _block_sql(act: int, pos: int, kind: str, text: str, label: str = "NULL", title: str = "NULL", markdown: str = "NULL") -> str:
    return f"SELECT id, {pos}::BIGINT AS pos, '{kind}' AS kind, {label} AS label, {title} AS title, {text} AS text, {markdown} AS markdown FROM p WHERE id % 3 = {act}"


_ACT_BLOCKS = " UNION ALL ".join([
    _block_sql(0, 0, "chapter", "'Գ Լ Ո Ւ Խ ' || size", "'Գ Լ Ո Ւ Խ ' || size"),
    _block_sql(0, 1, "article", "'Հոդված ' || size || '.1 ' || name", "size || '.1'", "name"),
    _block_sql(0, 2, "text", "type || ' & ' || brand"),
    _block_sql(0, 3, "table", _TABLE[0], markdown=_TABLE[1]),
    _block_sql(0, 4, "article", "'Հոդված ' || (size + 1)", "(size + 1)::VARCHAR", "''"),
    _block_sql(0, 5, "text", "'second of ' || name"),
    _block_sql(1, 0, "text", "size || '. first of ' || name"),
    _block_sql(1, 1, "text", "'goes on ' || type"),
    _block_sql(1, 2, "text", "(size + 1) || '.1. second'"),
    _block_sql(1, 3, "annex", "'ՀԱՎԵԼՎԱԾ N ' || size", "'ՀԱՎԵԼՎԱԾ N ' || size"),
    _block_sql(1, 4, "text", "'annex of ' || brand"),
    _block_sql(1, 5, "table", _TABLE[0], markdown=_TABLE[1]),
    _block_sql(2, 0, "text", "'preamble ' || name"),
    _block_sql(2, 1, "table", _TABLE[0], markdown=_TABLE[1]),
    _block_sql(2, 2, "text", "'after ' || type"),
])
_ACTS = f"p AS (SELECT {_P} FROM part), blocks AS ({_ACT_BLOCKS})"


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def page(pieces: str) -> Column:
        """Pieces with the columns' names in braces."""
        parts = re.split("[{}]", pieces)
        return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    data = "<table class=x><tr><th colspan='2'>{brand}</th></tr><tr><td rowspan=2>{type}</td><td> {size}</td></tr><tr><td>{id}</td></tr></table>"
    articles = "<html><head><title>{id}</title><style>p {}</style></head><body><p>Գ Լ Ո Ւ Խ {size}</p><table><tr><td>Հոդված {size}․1.</td><td>{name}</td></tr></table><p>{type} &amp;\n <b>{brand}</b></p><p> </p>"
    articles = articles.replace("p {}", "p") + data + "<table><tr><td>Հոդված {next}.</td></tr></table><script>var x = '<p>no</p>';</script><p>second of {name}</p></body></html>"
    points = "<div><p>{size}. first of {name}</p><p>goes<br>on {type}<p>{next}.1. second</p><table><tr><td>ՀԱՎԵԼՎԱԾ</td><td>N {size}</td></tr></table><p>annex of {brand}</p>" + data + "</div>"
    tables = "<p>preamble {name}</p>" + data + "<p>after {type}</p>"
    act = F.col("id") % 3
    rows = dealt_out(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), (F.col("p_size") + 1).alias("next")))
    return rows.select("id", F.when(act == 0, page(articles)).when(act == 1, page(points)).otherwise(page(tables)).alias("html"))


def _act_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.classified(html.raw_blocks(_acts(spark, sf_dir), "id", "html"))


@query(f"WITH {_ACTS} SELECT * FROM blocks")
def act_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, tables with spans, annexes, text in order from pages of acts."""
    return _act_blocks(spark, sf_dir)


@query(f"""WITH {_ACTS} SELECT id, sum(length(text))::BIGINT AS n_chars, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("article", "table", "part", "section", "chapter", "annex"))},
    CASE WHEN id % 3 = 1 THEN 2::BIGINT ELSE 0::BIGINT END AS n_points, ['articles', 'points', 'tabular'][(id % 3 + 1)::INTEGER] AS structure FROM blocks GROUP BY id""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_metadata(_act_blocks(spark, sf_dir))


@query(f"""WITH {_ACTS}, t AS (SELECT *, {_TABLE[1]} AS data FROM p)
    SELECT id, size || '.1' AS ref, 2::BIGINT AS first_pos, type || ' & ' || brand || chr(10) || chr(10) || data AS text FROM t WHERE id % 3 = 0 UNION ALL SELECT id, (size + 1)::VARCHAR, 5, 'second of ' || name FROM t WHERE id % 3 = 0
    UNION ALL SELECT id, size::VARCHAR, 0, size || '. first of ' || name || chr(10) || chr(10) || 'goes on ' || type FROM t WHERE id % 3 = 1 UNION ALL SELECT id, (size + 1) || '.1', 2, (size + 1) || '.1. second' FROM t WHERE id % 3 = 1
    UNION ALL SELECT id, 'annex 1 part 1', 4, 'annex of ' || brand FROM t WHERE id % 3 = 1 UNION ALL SELECT id, 'annex 1 table 1', 5, data FROM t WHERE id % 3 = 1
    UNION ALL SELECT id, 'preamble 1', 0, 'preamble ' || name FROM t WHERE id % 3 = 2 UNION ALL SELECT id, 'table 1', 1, data FROM t WHERE id % 3 = 2 UNION ALL SELECT id, 'preamble 2', 2, 'after ' || type FROM t WHERE id % 3 = 2""")
def act_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts cut by what structure they have."""
    return segment.chunks(_act_blocks(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 5 AS n, p_partkey % 90 + 1 AS d FROM part),
    x AS (SELECT id, unnest([a::VARCHAR] || list_transform(range(a + 2, a + 3 + n), lambda i: i::VARCHAR)) AS number, false AS in_code, unnest(range(1, n + 3)) AS place FROM p)
    SELECT id, number, in_code, place::INTEGER AS place FROM x UNION ALL SELECT id, d::VARCHAR, true, (n + 3)::INTEGER FROM p""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that a text cites: a number and a range of them in its own act, and one of the code."""
    a, n = F.col("p_size"), F.col("p_partkey") % 5
    text = F.concat(F.lit("[Location] › 9-րդ հոդված\n---\n5 հոդվածներ կան, և սույն հոդվածի 3-րդ մասը. Ըստ "), a.cast("string"), F.lit("-րդ եւ "), (a + 2).cast("string"), F.lit("-"), (a + 2 + n).cast("string"), F.lit("-րդ հոդվածների կարգով սահմանված պայմանների դեպքում կիրառվում է նաև հարկային օրենսգրքի "), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit("-ին  հոդվածը։"))
    found = graph.citations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id", "text")
    return graph.references(found)


@query("""SELECT p_partkey AS id, 'law:' || p_partkey || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'Ն' ELSE 'Ա' END || ' decision:' || p_size || ':Լ law:' || (p_size + 7) || ':' AS numbers,
    CASE WHEN p_partkey % 4 = 0 THEN 'decision:' || p_size ELSE 'law:' || (p_size + 7) END AS own, p_partkey % 2 = 0 AS normative FROM part""")
def act_number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All act numbers of a text in order, and a page's own by place: a decision's in the head, or the last law's in the tail."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    all_of = F.concat(F.lit("ըստ ՀՕ-"), key, F.when(F.col("p_partkey") % 2 == 0, "-Ն").otherwise("-Ա"), F.lit(" և N "), size.cast("string"), F.lit("-Լ, HO "), (size + 7).cast("string"), F.lit("."))
    page = F.concat(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("ՈՐՈՇՈՒՄ № "), size.cast("string"), F.lit(" - Ն"))).otherwise(F.lit("ՕՐԵՆՔ")), F.repeat(F.lit(" բառ"), 300), F.lit(" ՀՕ-3-Ն, ՀՕ-"), (size + 7).cast("string"), F.lit("-Ն"))
    numbers = F.array_join(F.transform(T.act_numbers(all_of), lambda x: F.concat_ws(":", x["series"], x["number"].cast("string"), F.coalesce(x["suffix"], F.lit("")))), " ")
    own = T.own_act_number(page)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.alias("numbers"), F.concat_ws(":", own["series"], own["number"].cast("string")).alias("own"), T.is_normative(T.act_number(all_of)).alias("normative"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found, strftime(o_orderdate, '%Y-%m-%d') AS dotted FROM orders""")
def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written with inflected month names, in two orders, and with dots."""
    d = F.col("o_orderdate")
    name = F.element_at(F.array(*map(F.lit, T.MONTHS)), F.month(d))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ընդունված "), F.dayofmonth(d).cast("string"), F.lit(" "), name, F.lit("ի "), F.year(d).cast("string"), F.lit(" թ."))).otherwise(F.concat(F.year(d).cast("string"), F.lit(" թ. "), name, F.lit("ի "), F.dayofmonth(d).cast("string"), F.lit("-ին")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.long_date(text).cast("string").alias("found"), T.dotted_date(F.concat(F.lit("ամսաթիվ "), F.date_format(d, "dd.MM.yyyy"))).cast("string").alias("dotted"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(regexp_replace(text, '\\$[^ ]*', '', 'g'), '[0-9]+'), x))) AS n_lost FROM documents""")
def numeric_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("made", F.regexp_replace("text", "\\$[^ ]*", ""))
    return rows.select("doc_id", F.size(html.lost_numbers("text", "made")).cast("long").alias("n_lost"))


# --- quotes and coverage -----------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents), q AS (SELECT item_id AS quote_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark)
    SELECT quote_id, id FROM q JOIN n ON contains(s, q)""")
def quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return verify.contained_quotes(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_QUOTED = f"""m AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS t FROM conversations),
    l AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM m),
    q AS (SELECT conv_id, turn, trim('Հոդված ' || substring(b, 1, 40)) AS q1, trim('Հոդված ' || substring(t, 1, 40)) AS q2, b FROM l WHERE role = 'assistant'),
    src AS (SELECT conv_id, string_agg('Հոդված ' || t, chr(10)) AS texts FROM m WHERE role = 'user' GROUP BY 1),
    kept AS (SELECT q.*, length(q1) >= 25 AS c1, length(q2) >= 25 AS c2, {{hold}} FROM q LEFT JOIN src USING (conv_id)),
    said AS (SELECT *, CASE WHEN c1 AND NOT h1 THEN '{verify.NOTICES["hy"]}' ELSE '«' || q1 || '»' END || ' և ' || CASE WHEN c2 AND NOT h2 THEN '{verify.NOTICES["hy"]}' ELSE '"' || q2 || '"' END || ' և ' || q2 AS clean FROM kept)"""


def _quoted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The letters of messages as provisions: each assistant's turn quotes the turn before it and, as if it stood there too,
    itself, in two kinds of marks, and repeats the second without any. Sources are the user's turns."""
    letters = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", letters.alias("t"))
    said = said.withColumn("b", F.coalesce(F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    one, two = (F.trim(F.concat(F.lit("Հոդված "), F.substring(c, 1, 40))) for c in ("b", "t"))
    answers = said.where("role = 'assistant'").select("conv_id", "turn", "b", F.concat(F.lit("«"), one, F.lit("» և \""), two, F.lit("\" և "), two).alias("text"))
    return answers, said.where("role = 'user'").select("conv_id", F.concat(F.lit("Հոդված "), "t").alias("source"))


@query(f"""WITH {_QUOTED.format(hold="contains('Հոդված ' || b, q1) AS h1, contains('Հոդված ' || b, q2) AS h2")}
    SELECT conv_id * 1000 + turn AS id, sha256(clean) AS clean_sha256, c1::BIGINT + c2::BIGINT AS n_quotes, (c1 AND NOT h1)::BIGINT + (c2 AND NOT h2)::BIGINT AS n_rejected FROM said""")
def quote_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant's turn as an answer whose source is the turn before it."""
    answers, _ = _quoted(spark, sf_dir)
    rows = answers.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.array(F.concat(F.lit("Հոդված "), "b")).alias("texts"))
    return verify.sanitised(rows.select("id", "text"), rows.select("id", "texts")).select("id", F.sha2("clean", 256).alias("clean_sha256"), "n_quotes", "n_rejected")


@query("""SELECT role, coverage, count(*) AS n, sum(length(body))::BIGINT AS n_chars FROM (SELECT role, CASE WHEN h THEN (CASE turn % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END) END AS coverage,
    CASE WHEN h THEN ltrim(text, ' ' || chr(10)) ELSE text END AS body FROM (SELECT *, turn % 2 = 0 AS h FROM conversations)) GROUP BY ALL""")
def coverage_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("turn") % 3 == 0, "full").when(F.col("turn") % 3 == 1, "Partial").otherwise("NONE")
    said = table(spark, sf_dir, "conversations").select("role", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Coverage: "), level, F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"))
    out = said.select("role", verify.coverage(F.col("text")).alias("c")).select("role", "c.coverage", F.regexp_replace("c.body", "^[ \\n]+", "").alias("trimmed"), "c.body")
    return out.groupBy("role", "coverage").agg(F.count("*").alias("n"), F.sum(F.length(F.when(F.col("coverage").isNotNull(), F.col("trimmed")).otherwise(F.col("body")))).alias("n_chars"))


_GATED = f"""WITH {_QUOTED.format(hold="coalesce(contains(texts, q1), false) AS h1, coalesce(contains(texts, q2), false) AS h2")},
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS is_last, sum((c1 AND NOT h1)::BIGINT + (c2 AND NOT h2)::BIGINT) OVER (PARTITION BY conv_id) AS bad, sum((c1 AND h1)::BIGINT + (c2 AND h2)::BIGINT) OVER (PARTITION BY conv_id) AS good FROM said)
    SELECT conv_id, turn, sha256(clean || CASE WHEN is_last AND bad >= 2 THEN '{CLOSING["hy"]}' ELSE '' END) AS shown_sha256,
           CASE WHEN is_last THEN '{{"coverage": "partial", "accepted": ' || good || ', "rejected": ' || bad || '}}' END AS done FROM n"""


def _deltas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as streams (session, seq, delta): a header, then the assistant's turns, in deltas of eleven characters; and what the user said."""
    answers, sources = _quoted(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    answers = answers.withColumn("text", F.when(first, F.concat(F.lit("Coverage: Partial\n\n"), "text")).otherwise(F.col("text")))
    deltas = answers.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,11}"), F.lit(0))).alias("n", "delta"))
    deltas = deltas.select(F.col("conv_id").alias("session"), (F.col("turn") * 10000 + F.col("n")).alias("seq"), "delta")
    sources = sources.groupBy(F.col("conv_id").alias("session")).agg(F.collect_list("source").alias("texts")).join(deltas.select("session").distinct(), "session", "left_semi")
    return deltas, sources


def _by_turn(found: DataFrame) -> DataFrame:
    shown = found.groupBy(F.col("session").alias("conv_id"), F.floor(F.col("seq") / 10000).alias("turn")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "n", "payload")))).alias("shown"), F.max(F.when(F.col("type") == "done", F.col("payload"))).alias("done")
    )
    return shown.select("conv_id", "turn", F.sha2(F.array_join(F.transform("shown", lambda x: x["payload"]), ""), 256).alias("shown_sha256"), "done")


@query(_GATED)
def stream_quote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas verified against what the user said; the streams below give the same."""
    deltas, sources = _deltas(spark, sf_dir)
    return _by_turn(gate_batch(deltas, sources, language="hy"))


@query(_GATED)
def stream_gate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deltas as a stream over files, in which no session is in order: they are dealt out by a hash, and come file by file."""
    deltas, sources = _deltas(spark, sf_dir)
    in_session = Window.partitionBy("session").orderBy("seq")
    numbered = deltas.withColumns({"at": F.timestamp_seconds(F.floor(F.col("seq") / 10000)), "place": F.row_number().over(in_session) - 1, "next": F.lead("seq").over(in_session)})
    numbered = written(numbered.join(sources, "session", "left"), "numbered-deltas")
    texts = F.when(F.col("place") == 0, F.coalesce("texts", F.expr("cast(array() as array<string>)")))
    rows = numbered.select("session", F.col("place").cast("long").alias("seq"), "delta", F.col("next").isNull().alias("is_last"), texts.alias("texts"), "at")
    # the first deltas, with the texts, are in the first of eight parts
    part = F.when(F.col("seq") < 2, 0).otherwise(F.pmod(F.xxhash64("session", "seq"), F.lit(8)))
    schema = "session long, seq long, delta string, is_last boolean, texts array<string>, at timestamp"
    folder = shared_dir(spark, "deltas")
    rows.repartition(8, part).write.parquet(folder)
    found = sessions.run_gate_over_files(spark, folder, schema, files_at_once=2, delay="365 days", language="hy")
    places = numbered.select("session", F.col("place").cast("long").alias("place"), F.col("seq").alias("own"))
    back = found.withColumnRenamed("seq", "place").join(places, ["session", "place"]).select("session", F.col("own").alias("seq"), "n", "type", "payload")
    return _by_turn(back)


@query("""WITH d AS (SELECT doc_id AS id, text, substring(text, 11, 40) AS q FROM documents WHERE text IS NOT NULL),
    p AS (SELECT id, q, unnest(range(len(x))) AS i, unnest(x) AS part, len(x) AS n FROM (SELECT id, q, CASE WHEN length(q) > 20 THEN string_split(text, q) ELSE [text] END AS x FROM d)),
    u AS (SELECT id, i * 2 AS o, part, false AS marked FROM p WHERE part <> '' UNION ALL SELECT id, i * 2 + 1, q, true FROM p WHERE i < n - 1)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, sha256(part) AS part_sha256, marked FROM u""")
def quote_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where forty characters of a text stand in it."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = verify.highlight_segments(docs.select(F.col("doc_id").alias("id"), "text", F.array(F.substring("text", 11, 40)).alias("quotes")))
    return parts.select("id", "pos", F.sha2("part", 256).alias("part_sha256"), "marked")


# --- evaluation and audits ---------------------------------------------------------------------------------------

_GOLD = "gold AS (SELECT DISTINCT q.vec_id AS query_id, p.vec_id // 4 AS id FROM embeddings q JOIN embeddings p ON p.label = q.label WHERE q.vec_id % 100 = 0)"
_RANKED = f"WITH {_KNN.format(on='true')}, {_GOLD}, top AS (SELECT query_id, parent_id AS id, score, rank FROM ranked WHERE rank <= 20)"


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists of twenty, and what is right in them: parents of which a vector has the query's label."""
    slices, queries = _vectors(spark, sf_dir)
    ranked = written(vector.knn(slices, queries, 20).select("query_id", F.col("parent_id").alias("id"), "score", "rank"), "ranked-lists")
    return ranked, _labelled(ranked, slices, queries)[0]


def _labelled(ranked: DataFrame, slices: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evaluate.gold_by_class(ranked, queries.select("query_id", "label"), slices.select(F.col("parent_id").alias("id"), "label"), "label")


@query(f"""{_RANKED}, h AS (SELECT query_id, min(rank) AS first, count(*) FILTER (WHERE rank <= 5) AS f5, count(*) FILTER (WHERE rank <= 8) AS f8 FROM top JOIN gold USING (query_id, id) GROUP BY 1),
    m AS (SELECT query_id, n_gold, coalesce(f5, 0) AS f5, coalesce(f8, 0) AS f8, coalesce(1.0::DOUBLE / first, 0) AS rr FROM (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) LEFT JOIN h USING (query_id))
    SELECT count(*) AS n_questions, round(avg((f5 > 0)::INT), 9) AS hit_5, round(avg(f5 / n_gold), 9) AS recall_5, round(avg((f8 > 0)::INT), 9) AS hit_8, round(avg(f8 / n_gold), 9) AS recall_8, round(avg(rr), 9) AS reciprocal_rank FROM m""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices, queries = _vectors(spark, sf_dir)
    ranked, gold = _evaluated(spark, sf_dir)
    return evaluate.macro_average(evaluate.question_metrics(ranked, gold, n_gold=_labelled(ranked, slices, queries)[1]))


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def fair_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fair_universe(table(spark, sf_dir, "events"), "event_type", "user_id")


@query(f"""{_RANKED}, u AS (SELECT vec_id // 4 AS id FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 4) = 4 AND max(vec_id) % 3 > 0),
    t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM top WHERE id IN (SELECT id FROM u)),
    g AS (SELECT * FROM gold WHERE id IN (SELECT id FROM u)),
    h AS (SELECT query_id, min(rank) AS first, count(*) FILTER (WHERE rank <= 5) AS f5, count(*) FILTER (WHERE rank <= 8) AS f8 FROM t JOIN g USING (query_id, id) GROUP BY 1),
    m AS (SELECT query_id, n_gold, coalesce(f5, 0) AS f5, coalesce(f8, 0) AS f8, coalesce(1.0::DOUBLE / first, 0) AS rr FROM (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1) LEFT JOIN h USING (query_id))
    SELECT count(*) AS n_questions, round(avg((f5 > 0)::INT), 9) AS hit_5, round(avg(f5 / n_gold), 9) AS recall_5, round(avg((f8 > 0)::INT), 9) AS hit_8, round(avg(f8 / n_gold), 9) AS recall_8, round(avg(rr), 9) AS reciprocal_rank FROM m""")
def fair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over parents that all four places of slices have and that a second condition admits, for lists and gold alike."""
    slices, queries = _vectors(spark, sf_dir)
    whole = evaluate.fair_universe(slices, "slice_index", "parent_id").select(F.col("parent_id").alias("id"))
    last = slices.groupBy(F.col("parent_id").alias("id")).agg(F.max(F.col("parent_id") * 4 + F.col("slice_index")).alias("last")).where("last % 3 > 0")
    universe = whole.join(last, "id", "left_semi")
    ranked, gold = evaluate.restricted(*_evaluated(spark, sf_dir), universe)
    admitted = slices.join(universe.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    return evaluate.macro_average(evaluate.question_metrics(ranked, gold, n_gold=_labelled(ranked, admitted, queries)[1]))


_CALIBRATED = """rows AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top1, round(avg(CASE WHEN rank <= 3 THEN score END), 9) AS top3,
    count(*) FILTER (WHERE rank <= 5 AND g.id IS NOT NULL) > 0 AS covered FROM top LEFT JOIN gold g USING (query_id, id) GROUP BY 1)"""


@query(f"{_RANKED}, {_CALIBRATED} SELECT query_id, top1, top3, covered FROM rows")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration_rows(*_evaluated(spark, sf_dir))


@query(f"""{_RANKED}, {_CALIBRATED}, g AS (SELECT unnest(range(41)) AS step)
    SELECT step / 40 AS t, count(*) AS n, count(*) FILTER (WHERE covered = (least(greatest(floor(round(top3 * 40, 6)), -1), 40) >= step)) AS n_correct,
           count(*) FILTER (WHERE NOT covered AND least(greatest(floor(round(top3 * 40, 6)), -1), 40) >= step) AS false_confident,
           count(*) FILTER (WHERE covered AND least(greatest(floor(round(top3 * 40, 6)), -1), 40) < step) AS false_cautious FROM rows CROSS JOIN g GROUP BY step""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(evaluate.calibration_rows(*_evaluated(spark, sf_dir)), "top3", "covered")


@query(f"""{_RANKED}, {_CALIBRATED}, g AS (SELECT unnest(range(20, 181)) AS step),
    sweep AS (SELECT step / 200 AS t, count(*) AS n, count(*) FILTER (WHERE covered = (least(greatest(floor(round(top1 * 200, 6)), 19), 180) >= step)) AS n_correct,
           count(*) FILTER (WHERE NOT covered AND least(greatest(floor(round(top1 * 200, 6)), 19), 180) >= step) AS false_confident,
           count(*) FILTER (WHERE covered AND least(greatest(floor(round(top1 * 200, 6)), 19), 180) < step) AS false_cautious FROM rows CROSS JOIN g GROUP BY step)
    SELECT * FROM sweep ORDER BY n_correct DESC, t LIMIT 1""")
def confidence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the thresholds from 0.1 to 0.9 in steps of 0.005 for the first score, the one that is most often right."""
    rows = evaluate.calibration_rows(*_evaluated(spark, sf_dir))
    return evaluate.best_threshold(evaluate.threshold_sweep(rows, "top1", "covered", 20, 180, 200))


_CUTOFF = """k AS (SELECT step, query_id, count(*) FILTER (WHERE floor(round(score * 40, 6)) >= step) AS n, count(*) FILTER (WHERE floor(round(score * 40, 6)) >= step AND g.id IS NOT NULL) AS f
    FROM top LEFT JOIN gold g USING (query_id, id) CROSS JOIN (SELECT unnest(range(41)) AS step) WHERE rank <= 4 GROUP BY ALL),
    c AS (SELECT step / 40 AS t, count(*) FILTER (WHERE f > 0) AS hits, sum(f)::BIGINT AS found, sum(n)::BIGINT AS kept, count(*) FILTER (WHERE n = 0) AS empty FROM k GROUP BY step)"""


@query(f"{_RANKED}, {_CUTOFF} SELECT * FROM c")
def cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cutoff_sweep(*_evaluated(spark, sf_dir))


@query(f"{_RANKED}, {_CUTOFF} SELECT max(t) AS knee, max(found) AS found FROM c WHERE found = (SELECT max(found) FROM c)")
def cutoff_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.knee(cutoff_sweep(spark, sf_dir))


_JOURNAL = "j AS (SELECT source AS query_id, CASE WHEN quality = 0 THEN 'no' WHEN toxic = 1 THEN 'partial' ELSE 'yes' END AS verdict, doc_id FROM documents JOIN labels USING (doc_id))"


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("quality") == 0, "no").when(F.col("toxic") == 1, "partial").otherwise("yes")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("query_id"), verdict.alias("verdict"), "doc_id")


@query(f"WITH {_JOURNAL} SELECT query_id, count(*) AS n_judged, count(*) FILTER (WHERE verdict <> 'no') AS n_accepted, count(*) FILTER (WHERE verdict <> 'no') > 0 AS is_resolved FROM j GROUP BY 1")
def judged_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged_gold(_journal(spark, sf_dir))


@query(f"WITH {_JOURNAL} SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM j), 9) AS share FROM j GROUP BY 1")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.shares(_journal(spark, sf_dir), "verdict")


@query(f"""WITH {_JOURNAL}, b AS (SELECT verdict AS before, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE verdict END AS after FROM j)
    SELECT before, after, CASE WHEN p(after) > p(before) THEN 'up' WHEN p(after) < p(before) THEN 'down' ELSE 'same' END AS direction, count(*) AS n FROM b GROUP BY ALL""".replace("p(after)", "list_position(['no', 'partial', 'yes'], after)").replace("p(before)", "list_position(['no', 'partial', 'yes'], before)"))
def triage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _journal(spark, sf_dir)
    after = j.withColumn("verdict", F.when(F.col("doc_id") % 3 == 0, "yes").otherwise(F.col("verdict")))
    return evaluate.movement(j, after, "doc_id", "verdict", ["no", "partial", "yes"])


@query("SELECT lang, count(*) AS n, round(avg((len(regexp_extract_all(text, '[éèêçàäöüßñíó]')) > 0)::INT), 9) AS share_marked FROM documents GROUP BY 1")
def audit_language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.regexp_like("text", F.lit("[éèêçàäöüßñíó]")).cast("int")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(marked), 9).alias("share_marked"))


@query("""SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_partkey) ELSE first(p_partkey ORDER BY p_size DESC, p_retailprice DESC, p_partkey) END AS canonical, count(DISTINCT p_type) = 1 AS is_identical, count(*) AS n_items FROM part GROUP BY 1""")
def canonical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.canonical(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type", ["p_size", "p_retailprice"])


@query("SELECT regexp_extract(c_name, '(\\d)$', 1) AS suffix, count(*) AS n, min(c_name) AS first_name FROM customer GROUP BY 1")
def suffix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.regexp_extract("c_name", "(\\d)$", 1).alias("suffix")).agg(F.count("*").alias("n"), F.min("c_name").alias("first_name"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), r AS (SELECT * FROM m WHERE back <= 8)
    SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS query, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0""")
def contextualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.contextualised(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").drop("facts")


@query("""WITH s AS (SELECT count(*) AS n_texts, sum(ceil(strlen(text) / 4)::BIGINT)::BIGINT AS n_tokens, sum(length(text)) AS c, count(*) FILTER (WHERE ceil(strlen(text) / 4) > 2048) AS n_over, max(ceil(strlen(text) / 4))::INTEGER AS largest FROM documents)
    SELECT name, n_texts, n_tokens, round(c / n_tokens, 6) AS chars_per_token, n_over, largest, round(n_tokens * per_million / 1e6, 9) AS price FROM s CROSS JOIN (VALUES ('large-3072', 0.13::DOUBLE), ('small-1024', 0.02::DOUBLE)) p(name, per_million)""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("large-3072", 0.13), ("small-1024", 0.02)], "name string, per_million double")
    out = context.cost_estimate(table(spark, sf_dir, "documents"), segment.estimated_tokens(F.col("text")), prices, F.length("text"), 2048)
    return out.drop("per_million")


@query("""SELECT role, count(*) AS n, round(avg(turn), 6) AS avg_seconds, round(avg(length(text)), 6) AS avg_chars, sum((length(text) - length(replace(text, '"', ''))))::BIGINT AS bad_quotes, count(*) FILTER (WHERE regexp_matches(text, '[éèêçàäöüßñíó]')) AS n_wrong_language FROM conversations GROUP BY 1""")
def generator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    return context.compare_generators(table(spark, sf_dir, "conversations"), "role", F.col("turn"), F.col("text"), marks, F.regexp_like("text", F.lit("[éèêçàäöüßñíó]")))


@query(f"""WITH {_LEXICAL}, w AS (SELECT query_id, id, rank, score FROM lexical WHERE rank <= 50),
    src AS (SELECT source AS s, min(doc_id) AS to_id FROM documents GROUP BY 1), e AS (SELECT doc_id AS from_id, to_id FROM documents JOIN src ON s = source WHERE to_id <> doc_id),
    c AS (SELECT query_id, to_id AS id, min(rank) AS seed_rank FROM w JOIN e ON from_id = id WHERE rank <= 8 GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, id) AS place FROM c WHERE (query_id, id) NOT IN (SELECT query_id, id FROM w)),
    a AS (SELECT query_id, id, rank FROM w UNION ALL SELECT query_id, id, n + place FROM f JOIN (SELECT query_id, max(rank) AS n FROM w GROUP BY 1) USING (query_id) WHERE place <= 40),
    x AS (SELECT a.query_id, a.id, a.rank AS came, {_list_terms_sql('b.text')} AS qt, {_list_terms_sql('substring(d.text, 1, 1800)')} AS dt FROM a JOIN documents d ON doc_id = a.id JOIN benchmark b ON item_id = a.query_id),
    y AS (SELECT query_id, id, came, round(len(list_intersect(list_distinct(qt), list_distinct(dt))) / greatest(len(list_distinct(qt)), 1), 9) AS relevance FROM x)
    SELECT query_id, id, came::INTEGER AS came, relevance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, came) AS rank FROM y) WHERE rank <= 8""")
def retrieve_expand_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: a pool of 50, what its first eight cite, reranked to eight. Texts join after ranks are known."""
    docs = table(spark, sf_dir, "documents")
    pool = written(_lexical(spark, sf_dir, 50).select("query_id", "id", "rank", "score"), "pool")  # read four times
    first = docs.groupBy("source").agg(F.min("doc_id").alias("to_id"))
    cited = docs.join(first, "source").where("to_id <> doc_id").select(F.col("doc_id").alias("from_id"), "to_id")
    found = written(rank.expand_one_hop(pool, cited, docs.select(F.col("doc_id").alias("id"))), "found")  # of known size, so that texts needn't move
    texts = docs.select(F.col("doc_id").alias("id"), rank.rerank_document(F.col("text"), F.lit(None).cast("string"), "prefix").alias("document"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = found.join(texts, "id").join(asked, "query_id")
    return rank.rerank(rows, rank.term_overlap(T.search_terms("question"), T.search_terms("document")), 8).select("query_id", "id", "came", "relevance", "rank")


@query("""SELECT o_orderkey AS id, o_custkey AS pos, CASE WHEN o_orderkey % 3 > 0 THEN 'Փոփոխություն ' || o_orderpriority END AS label, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey || ',' || o_orderkey AS acts FROM orders""")
def amendment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of tables of amendments."""
    o = table(spark, sf_dir, "orders")
    left = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" Փոփոխություն  "), "o_orderpriority")).otherwise(F.lit("— --"))
    right = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" https://host/hy/acts/"), F.col("o_custkey").cast("string"), F.lit("/latest, /acts/"), F.col("o_orderkey").cast("string"))
    out = html.amendments(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pos"), left.alias("left"), right.alias("right")))
    return out.select("id", "pos", "label", F.col("date").cast("string").alias("date"), F.array_join(F.col("acts").cast("array<string>"), ",").alias("acts"))


@query(f"""WITH {_ACTS}, b AS (SELECT id, count(*) AS n FROM blocks GROUP BY 1),
    x AS (SELECT p.id, id % 10 = 0 AS is_control, b.n IS NULL OR id % 7 = 0 AS is_missing, id % 7 > 0 AND id % 3 < 2 AS number_ok, id % 7 > 0 AS script_ok FROM p LEFT JOIN b USING (id))
    SELECT *, CASE WHEN is_missing THEN 'failed' WHEN number_ok AND script_ok THEN 'ok' ELSE 'partial' END AS verdict FROM x""")
def audit_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts' pages against what is expected of them: every seventh page is missing, every third has another number."""
    meta = html.page_metadata(_act_blocks(spark, sf_dir)).where("id % 7 > 0")
    pages = meta.withColumns({"number": F.when(F.col("id") % 3 < 2, F.col("id")), "body_script": F.lit("hy")})
    expected = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("number"), F.lit("hy").alias("script"), (F.col("p_partkey") % 10 == 0).alias("is_control"))
    return context.audit_rows(pages, expected)


@query(f"""WITH {_ACTS}, b AS (SELECT id, pos, kind, CASE WHEN kind = 'article' AND id % 2 = 0 THEN '1' ELSE label END AS label FROM blocks WHERE id % 7 > 0 AND NOT (id % 5 = 0 AND kind = 'chapter')),
    m AS (SELECT id, count(*) FILTER (WHERE kind = 'article') AS n, count(DISTINCT label) FILTER (WHERE kind = 'article') AS d, min(pos) FILTER (WHERE kind = 'chapter') AS c, max(pos) FILTER (WHERE kind = 'article') AS a,
                 count(*) FILTER (WHERE kind = 'table') AS n_table, count(*) FILTER (WHERE kind = 'annex') AS n_annex FROM b GROUP BY 1),
    x AS (SELECT p.id, m.id IS NOT NULL AS body, CASE WHEN m.id IS NULL THEN 'unknown' ELSE ['articles', 'points', 'tabular'][(p.id % 3 + 1)::INTEGER] END AS structure, coalesce(n, 0) AS n_article, coalesce(n_table, 0) AS n_table, coalesce(n_annex, 0) AS n_annex,
                 CASE WHEN m.id IS NOT NULL AND p.id % 3 = 1 THEN 2 ELSE 0 END AS n_point, p.id % 4 = 0 AS latest_differs, p.id % 6 > 0 AS is_eligible,
                 list_filter([CASE WHEN m.id IS NULL THEN 'no body' END, CASE WHEN m.id IS NULL THEN 'no structure' END, CASE WHEN n > 1 AND NOT coalesce(c < a, false) THEN 'no chapters' END, CASE WHEN n <> d THEN 'repeated article numbers' END,
                    CASE WHEN p.id % 9 = 0 THEN 'no act number' END, CASE WHEN p.id % 9 > 0 AND p.id % 8 = 1 THEN 'another act number' END, CASE WHEN p.id % 10 = 3 THEN 'no translation' END], lambda t: t IS NOT NULL) AS problems FROM p LEFT JOIN m USING (id))
    SELECT id, structure, n_article, n_table, n_annex, n_point::BIGINT AS n_point, latest_differs, is_eligible, array_to_string(problems, '; ') AS problems, CASE WHEN NOT body THEN 'failed' WHEN len(problems) > 0 THEN 'partial' ELSE 'ok' END AS verdict FROM x""")
def audit_whole_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts' pages at two addresses, some without a body, without chapters, with repeated numbers, or not as expected."""
    acts = _acts(spark, sf_dir)
    blocks = _act_blocks(spark, sf_dir).where("id % 7 > 0 and not (id % 5 = 0 and kind = 'chapter')")
    blocks = blocks.withColumn("label", F.when((F.col("kind") == "article") & (F.col("id") % 2 == 0), "1").otherwise(F.col("label")))
    bare = acts.select("id", F.when(F.col("id") % 4 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("html"))
    key = F.col("p_partkey").alias("id")
    part = table(spark, sf_dir, "part")
    found = part.select(key, F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).alias("number"), (F.col("p_partkey") % 6 > 0).alias("eligible"), (F.col("p_partkey") % 10 != 3).alias("translated"))
    expected = part.select(key, (F.col("p_partkey") + (F.col("p_partkey") % 8 == 1).cast("int")).alias("number"))
    out = context.act_audit(blocks, acts.select("id", "html"), bare, found, expected, many=1)
    return out.drop("latest_bytes", "bare_bytes").withColumn("problems", F.array_join("problems", "; "))


@query(f"""WITH {_PROBED}, {_GOLD}, runs AS (SELECT 'exact' AS retriever, query_id, parent_id AS id, rank FROM ranked WHERE rank <= 8 UNION ALL SELECT 'indexed', query_id, parent_id, rank FROM indexed),
    f AS (SELECT retriever, query_id, min(rank) AS first FROM runs JOIN gold USING (query_id, id) GROUP BY ALL)
    SELECT retriever, query_id, coalesce('rank ' || first, 'MISS') AS outcome FROM (SELECT DISTINCT query_id FROM gold) CROSS JOIN (SELECT DISTINCT retriever FROM runs) LEFT JOIN f USING (retriever, query_id)""")
def compare_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first right item stands in the lists of two retrievers."""
    slices, queries = _vectors(spark, sf_dir)
    exact = vector.knn(slices, queries, 8).select(F.lit("exact").alias("retriever"), "query_id", F.col("parent_id").alias("id"), "rank")
    indexed = _indexed(spark, sf_dir).select(F.lit("indexed").alias("retriever"), "query_id", F.col("parent_id").alias("id"), "rank")
    runs = written(exact.unionByName(indexed), "runs")
    gold, sizes = _labelled(runs, slices, queries)
    return evaluate.compare_lists(runs, gold, sizes)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def journal_last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key's lines in a journal the last."""
    journal = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return incremental.last_line_wins(journal, "user_id", "event_id")


@query("""SELECT conv_id, sha256('Answer in: ' || CASE WHEN conv_id % 2 = 0 THEN 'hy' ELSE 'ru' END || CASE WHEN conv_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Known: fact ' || conv_id END || chr(10) || chr(10)
    || string_agg('<' || CASE WHEN turn < 2 THEN 'carried' ELSE 'fresh' END || ' ref="' || role || '">' || chr(10) || coalesce(text, '') || chr(10) || '</fragment>', chr(10) || chr(10) ORDER BY turn)) AS prompt_sha256 FROM conversations GROUP BY conv_id""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as fragments of prompts."""
    said = table(spark, sf_dir, "conversations")
    fragments = said.select("conv_id", F.col("turn").alias("place"), (F.col("turn") < 2).alias("is_carried"), F.col("role").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))
    language = F.when(F.col("conv_id") % 2 == 0, "hy").otherwise("ru")
    facts = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("fact "), F.col("conv_id").cast("string")))
    return context.prompts(fragments, ["conv_id"], language, facts).select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS named, regexp_extract_all(substring(text, 1, 400), '[0-9]+') AS got FROM documents)
    SELECT doc_id, coalesce(list_aggregate(list_sort(list_filter(named, lambda x: NOT list_contains(got, x))), 'string_agg', ','), '') AS absent FROM n""")
def named_not_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text names and its first 400 characters, as what was retrieved, lack."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    absent = verify.named_but_absent(numbers(F.col("text")), numbers(F.substring("text", 1, 400)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(absent), ",").alias("absent"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Հոդված ' || p_size ELSE 'annex 1 part ' || p_size END AS key, count(*) AS n FROM part GROUP BY 1""")
def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs of articles without their parts; other refs as they are."""
    size = F.col("p_size").cast("string")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Հոդված "), size, F.when(F.col("p_partkey") % 2 == 0, F.lit(", մաս 3")).otherwise(""))).otherwise(F.concat(F.lit("annex 1 part "), size))
    return table(spark, sf_dir, "part").groupBy(evaluate.article_key(ref).alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, -1::BIGINT AS orphan FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT l_orderkey, l_linenumber, 0, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)""")
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a unique key and a foreign key would have refused."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    twice = relational.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]).withColumn("orphan", F.lit(-1).cast("long"))
    gone = relational.orphans(lines, table(spark, sf_dir, "part").where("p_size > 1"), "l_partkey", "p_partkey")
    return twice.unionByName(gone.select("l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("n"), F.col("l_partkey").alias("orphan")))

"""Where models are called: rows go out in batches, calls that fail are tried again, answers are journalled, and what stays without one
passes through with a status.

A request is what a row's inputs say, so equal rows are asked once, and a journal, a folder of answers by the hash of model and inputs, is asked before
the model is. Each run appends its answers as a whole; one that stops half way loses only what it had not yet written, and the next asks for
no more than what is missing. Failures aren't journalled. How many calls run at a time is the number of partitions, whatever the number of rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.shared import shared_dir, written
from .context import last_turns
from .relational import top_per_group

#: Takes requests, each a dict of inputs, and gives as many answers, each a dict of outputs; raises if it can't.
Model = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]


class Refused(Exception):
    """A model's answer that trying again won't change."""


def answers(model: Model, requests: list[dict[str, Any]], attempts: int, first_wait: float, longest_wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict[str, Any]] | None, str]:
    """A batch's answers, or none and the reason; waits double from try to try."""
    reason = ""
    for n in range(max(1, attempts)):
        if n:
            sleep(min(longest_wait, first_wait * 2 ** (n - 1)))
        try:
            found = model(requests)
            if len(found) == len(requests):
                return found, "ok"
            reason = f"{len(found)} answers to {len(requests)} requests"
        except Refused as why:
            return None, f"refused: {why}"
        except Exception as why:  # whatever a service brings about; the row says so
            reason = f"{type(why).__name__}: {why}"
    return None, f"failed after {max(1, attempts)}: {reason}"


def _read(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def call_model(rows: DataFrame, inputs: Sequence[str], outputs: str, model: Model, name: str, journal: str | None = None, batch: int = 8, workers: int = 4, attempts: int = 7, first_wait: float = 2.0, longest_wait: float = 60.0) -> DataFrame:
    """`rows` with the columns of `outputs`, a schema, null where the model gave no answer, and `status`: ok, or why not."""
    spark = rows.sparkSession
    spark_outputs = spark.createDataFrame([], outputs).schema
    base = journal or shared_dir(spark, "journal")
    keyed = written(rows.withColumn("_request", F.sha2(F.concat_ws("\x1f", F.lit(name), F.to_json(F.struct(*inputs))), 256)), "requests")  # read twice
    schema = StructType([StructField("_request", StringType()), *spark_outputs.fields, StructField("status", StringType())])
    (spark.createDataFrame([], schema)).write.mode("append").parquet(f"{base}/run={uuid.uuid4().hex}")  # so that there is one
    known = _read(spark, schema, base).where("status = 'ok'").dropDuplicates(["_request"])
    asked = keyed.select("_request", *inputs).dropDuplicates(["_request"]).join(known.select("_request"), "_request", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found, status = answers(model, part[list(inputs)].to_dict("records"), attempts, first_wait, longest_wait)
                given = [dict.fromkeys(spark_outputs.names) | (x or {}) for x in found or [{}] * len(part)]
                out = pd.DataFrame({c: [x[c] for x in given] for c in spark_outputs.names}, dtype=object)
                yield out.assign(_request=part["_request"].tolist(), status=status)[[f.name for f in schema.fields]]

    asked.repartition(workers).mapInPandas(ask, schema).write.parquet(run := f"{base}/run={uuid.uuid4().hex}")
    failed = _read(spark, schema, run).where("status <> 'ok'")
    now = _read(spark, schema, base).where("status = 'ok'").dropDuplicates(["_request"]).unionByName(failed)
    return keyed.join(now, "_request", "left").drop("_request")


def failures(called: DataFrame) -> DataFrame:
    """(status, n): each reason once, with the rows that have it."""
    return called.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


def rerank_by_model(candidates: DataFrame, k: int, model: Model, **calls: Any) -> DataFrame:
    """The best k of each query's candidates (query_id, question, id, rank, document) by a model of (question, documents) to relevance, a number a document;
    ties in the order they came in. Without an answer that order, cut to k, and the status says why. A query has a pool of candidates, not more."""
    pool = candidates.groupBy("query_id").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(F.struct("rank", "id", "document"))).alias("all"))
    called = call_model(pool.withColumn("documents", F.col("all.document")), ["question", "documents"], "relevance array<double>", model, **({"name": "rerank"} | calls))
    each = called.select("query_id", "status", "relevance", F.posexplode("all").alias("at", "x"))
    scored = each.select("query_id", F.col("x.id").alias("id"), F.col("x.rank").alias("came"), F.get("relevance", F.col("at")).alias("relevance"), "status")
    return top_per_group(scored, ["query_id"], [F.desc_nulls_last("relevance"), F.asc("came")], k)


CONTEXT = "standalone_query string, search_terms string, needs_retrieval boolean, is_topic_shift boolean, fact_summary string"


def contextualised_by_model(messages: DataFrame, session: str, seq: str, role: str, content: str, model: Model, facts: DataFrame | None = None, turns: int = 8, **calls: Any) -> DataFrame:
    """(session, query, standalone_query, search_terms, needs_retrieval, is_topic_shift, facts, status): what the model makes of each session's last user message, the
    turns before it and the facts (session, facts) so far. An empty rewrite leaves the message, an empty summary the old facts; without
    an answer the message is searched for as it is and the facts stay. The query is the rewrite with the terms."""
    recent = last_turns(messages, session, seq, turns)
    user = F.col(role) == "user"
    turn = F.struct(F.col(seq).alias("seq"), F.col(role).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    last = F.max(F.when(user, F.col(seq))).alias("last")
    rows = recent.groupBy(session).agg(last, F.max_by(F.when(user, F.col(content)), F.when(user, F.col(seq))).alias("message"), F.sort_array(F.collect_list(turn)).alias("all")).where("message is not null")
    before = F.filter("all", lambda t: t["seq"] < F.col("last"))
    history = F.array_join(F.transform(before, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n\n")
    rows = rows.select(session, "message", history.alias("history"))
    rows = rows.join(facts.select(session, F.col("facts").alias("known")), session, "left") if facts is not None else rows.withColumn("known", F.lit(None).cast("string"))
    called = call_model(rows.withColumn("known", F.coalesce("known", F.lit(""))), ["message", "history", "known"], CONTEXT, model, **({"name": "contextualise"} | calls))
    filled = lambda c, otherwise: F.coalesce(F.nullif(F.trim(c), F.lit("")), otherwise)
    rewritten, terms = filled("standalone_query", F.col("message")), F.coalesce(F.trim("search_terms"), F.lit(""))
    return called.select(
        session,
        F.trim(F.concat_ws(" ", rewritten, terms)).alias("query"),
        rewritten.alias("standalone_query"),
        terms.alias("search_terms"),
        F.coalesce("needs_retrieval", F.lit(True)).alias("needs_retrieval"),
        F.coalesce("is_topic_shift", F.lit(False)).alias("is_topic_shift"),
        filled("fact_summary", F.col("known")).alias("facts"),
        "status",
    )


def legs_status(legs: dict[str, Column]) -> Column:
    """What is said of a result some of whose legs were lost: their names, in order; null if none was."""
    return F.nullif(F.array_join(F.filter(F.array(*[F.when(lost, F.lit(name)) for name, lost in legs.items()]), lambda x: x.isNotNull()), ","), F.lit(""))

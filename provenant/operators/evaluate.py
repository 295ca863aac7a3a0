"""Evaluation of ranked lists, thresholds and labels, and audits of a corpus.

Everything is one plan over a table of questions: ranked (query_id, id, rank, score), gold (query_id, id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def article_key(ref: Column, part_word: str = "մաս", article_word: str = "Հոդված") -> Column:
    """A ref without its part, for refs of articles only."""
    return F.when(ref.startswith(article_word), F.regexp_replace(ref, f"[\\s,]+{part_word}\\s*\\d+$", "")).otherwise(ref)


def first_occurrences(ranked: DataFrame, key: str = "id") -> DataFrame:
    """A list over keys: the first place of each, ranked anew without gaps."""
    first = ranked.groupBy("query_id", key).agg(F.min("rank").alias("_at"), F.max("score").alias("score"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at"))).drop("_at")


def gold_by_class(ranked: DataFrame, queries: DataFrame, items: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Gold where an item is right that shares a query's class `by`: (query_id, id) of those in the lists, and (query_id, n_gold) of all, for
    queries that have any. Pairs of all queries and right items grow with the square of both, and are not made.
    queries (query_id, by), one row each; items (id, by), where an item may have several classes."""
    classes = items.select("id", by).distinct()
    listed = ranked.select("query_id", "id").distinct().join(queries.select("query_id", by), "query_id")
    sizes = queries.select("query_id", by).join(classes.groupBy(by).agg(F.count("*").alias("n_gold")), by)
    return listed.join(classes, ["id", by]).select("query_id", "id"), sizes.select("query_id", "n_gold")


def question_metrics(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 8), depth: int = 20, n_gold: DataFrame | None = None) -> DataFrame:
    """Per question with gold: n_gold, hit_k and recall_k, and reciprocal rank of the first gold item within depth. With n_gold (query_id,
    n_gold), gold need only hold items of the lists."""
    g = gold.select("query_id", "id").distinct()
    n = n_gold if n_gold is not None else g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= depth).join(g, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in ks])
    rows = n.join(hits, "query_id", "left")
    at = [c for k in ks for c in ((F.coalesce(f"found_{k}", F.lit(0)) > 0).cast("int").alias(f"hit_{k}"), (F.coalesce(f"found_{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}"))]
    return rows.select("query_id", "n_gold", *at, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def macro_average(per_question: DataFrame) -> DataFrame:
    values = [c for c in per_question.columns if c not in ("query_id", "n_gold", "retriever")]
    by = ["retriever"] if "retriever" in per_question.columns else []
    return per_question.groupBy(*by).agg(F.count("*").alias("n_questions"), *[F.round(F.avg(c), 9).alias(c) for c in values])


def fair_universe(indexed: DataFrame, model: str, item: str) -> DataFrame:
    """Items that every model has."""
    n = indexed.agg(F.count_distinct(model).alias("n_models"))
    return indexed.groupBy(item).agg(F.count_distinct(model).alias("n")).join(n, F.col("n") == F.col("n_models")).select(item)


def restricted(ranked: DataFrame, gold: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and gold within a shared universe (id): lists close their gaps, and questions without gold there drop out."""
    ids = universe.select("id").distinct()
    kept = ranked.join(ids, "id", "left_semi")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return kept, gold.join(ids, "id", "left_semi")


def calibration_rows(ranked: DataFrame, gold: DataFrame, within: int = 5) -> DataFrame:
    """(query_id, top1, top3, covered): the first score, the mean of the first three, and whether gold is within."""
    g = gold.select("query_id", "id", F.lit(True).alias("is_gold")).distinct()
    rows = ranked.join(g, ["query_id", "id"], "left")
    return rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.round(F.avg(F.when(F.col("rank") <= 3, F.col("score"))), 9).alias("top3"), (F.count_if((F.col("rank") <= within) & F.col("is_gold")) > 0).alias("covered")
    )


def threshold_sweep(rows: DataFrame, score: str, covered: str, first: int = 0, last: int = 40, per_unit: int = 40) -> DataFrame:
    """(t, n, n_correct, false_confident, false_cautious) over a grid of thresholds: confident means score >= t.
    Rows are counted by grid cell first, so the grid meets sums only."""
    cell = F.least(F.greatest(F.floor(F.round(F.col(score) * per_unit, 6)), F.lit(first - 1)), F.lit(last)).cast("int")
    cells = rows.groupBy(cell.alias("cell")).agg(F.count_if(F.col(covered)).alias("yes"), F.count_if(~F.col(covered)).alias("no"))
    grid = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("step"))
    sums = grid.crossJoin(cells)  # a grid of fixed size and as many sums
    confident = F.col("cell") >= F.col("step")
    out = sums.groupBy("step").agg(
        F.sum(F.col("yes") + F.col("no")).alias("n"),
        F.sum(F.when(confident, F.col("no")).otherwise(0)).alias("false_confident"),
        F.sum(F.when(~confident, F.col("yes")).otherwise(0)).alias("false_cautious"),
    )
    return out.select((F.col("step") / per_unit).alias("t"), "n", (F.col("n") - F.col("false_confident") - F.col("false_cautious")).alias("n_correct"), "false_confident", "false_cautious")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the most correct."""
    return sweep.orderBy(F.desc("n_correct"), "t").limit(1)


def cutoff_sweep(ranked: DataFrame, gold: DataFrame, first: int = 0, last: int = 40, per_unit: int = 40, depth: int = 8, keep: int = 4) -> DataFrame:
    """(t, hits, found, kept, empty) when of the first `depth` those with score >= t are kept, `keep` at most. Scores
    fall with rank, so what is kept at t is a head of the list."""
    g = gold.select("query_id", "id", F.lit(True).alias("is_gold")).distinct()
    top = ranked.where(F.col("rank") <= min(depth, keep)).join(g, ["query_id", "id"], "left")
    cell = F.floor(F.round(F.col("score") * per_unit, 6)).cast("int").alias("cell")
    rows = top.select("query_id", cell, F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    steps = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step")
    per = rows.groupBy("query_id").agg(F.collect_list(F.struct("cell", "is_gold")).alias("r")).select("query_id", "r", steps)  # at most `keep` rows each
    kept = F.filter("r", lambda x: x["cell"] >= F.col("step"))
    counted = per.select("step", F.size(kept).alias("n"), F.size(F.filter(kept, lambda x: x["is_gold"])).alias("g"))
    out = counted.groupBy("step").agg(F.count_if(F.col("g") > 0).alias("hits"), F.sum("g").alias("found"), F.sum("n").alias("kept"), F.count_if(F.col("n") == 0).alias("empty"))
    return out.select((F.col("step") / per_unit).alias("t"), "hits", "found", "kept", "empty")


def knee(sweep: DataFrame) -> DataFrame:
    """The highest threshold that loses none of what the lowest finds."""
    all_found = sweep.agg(F.max("found").alias("all_found"))
    return sweep.crossJoin(all_found).where("found = all_found").agg(F.max("t").alias("knee"), F.max("found").alias("found"))


def compare_lists(runs: DataFrame, gold: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(retriever, query_id, outcome): the rank of the first gold item, or MISS. runs (retriever, query_id, id, rank). With questions
    (query_id), those that have gold, gold need only hold items of the runs."""
    g = gold.select("query_id", "id").distinct()
    asked = (questions if questions is not None else g).select("query_id").distinct().crossJoin(runs.select("retriever").distinct())
    first = runs.join(g, ["query_id", "id"], "left_semi").groupBy("retriever", "query_id").agg(F.min("rank").alias("first"))
    return asked.join(first, ["retriever", "query_id"], "left").withColumn("outcome", F.coalesce(F.concat(F.lit("rank "), F.col("first").cast("string")), F.lit("MISS"))).drop("first")


def judged_gold(journal: DataFrame) -> DataFrame:
    """Per question: judged and accepted items, verdict other than no, and whether any was accepted."""
    return journal.groupBy("query_id").agg(F.count("*").alias("n_judged"), F.count_if(F.col("verdict") != "no").alias("n_accepted"), (F.count_if(F.col("verdict") != "no") > 0).alias("is_resolved"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) over all rows."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(rows.agg(F.count("*").alias("total"))).select(by, "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def movement(before: DataFrame, after: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(before, after, direction, n) of keys in both: up or down by place in `order`, what isn't there lowest."""

    def place(c: str) -> Column:
        p = F.lit(-1)
        for i, v in enumerate(order):
            p = F.when(F.col(c) == v, i).otherwise(p)
        return p

    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    moved = place("after") - place("before")
    direction = F.when(moved > 0, "up").when(moved < 0, "down").otherwise("same")
    return both.groupBy("before", "after", direction.alias("direction")).agg(F.count("*").alias("n"))


def canonical(rows: DataFrame, group: str, item: str, content: str, preference: Sequence[str]) -> DataFrame:
    """(group, canonical, is_identical): of items with one content the lowest, else the one that has most of each
    preferred measure in turn, then the lowest."""
    best = F.min_by(item, F.struct(*[-F.col(p) for p in preference], item))
    same = F.count_distinct(content) == 1
    return rows.groupBy(group).agg(F.when(same, F.min(item)).otherwise(best).alias("canonical"), same.alias("is_identical"), F.count("*").alias("n_items"))

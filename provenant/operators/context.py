"""What surrounds retrieval in a conversation, and reports over models and corpora.

Models that can't run here are seams: functions from rows to a column, with stand-ins that need no network and a
stated result when they fail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .html import page_metadata
from .relational import last_turns

#: Embedding models with their providers, dimensions, input limits in tokens, and whether vectors are unit length.
MODELS = (("large-3072", "remote", 3072, 8191, True), ("small-1024", "local", 1024, 512, True))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "name string, provider string, dimensions int, input_limit int, is_normalised boolean")


def smallest_input_limit(registry: DataFrame) -> DataFrame:
    """What a slice may hold if all models are to take it."""
    return registry.agg(F.min("input_limit").alias("input_limit"))


def contextualised(messages: DataFrame, session: str, seq: str, role: str, content: str, facts: DataFrame | None = None, rewrite: Callable[[Column, Column], Column] | None = None, turns: int = 8) -> DataFrame:
    """(session, query, history, facts): the last user message and the turns before it, the latest `turns` in all.

    `rewrite` makes the query of the message and the history; without one, or where it gives null, the message stands
    as it is, and the facts stay as they were."""
    recent = last_turns(messages, session, seq, turns)
    user = F.col(role) == "user"
    rows = recent.groupBy(session).agg(
        F.max_by(F.when(user, F.col(content)), F.when(user, F.col(seq))).alias("message"),
        F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("_all"),  # at most `turns`
    )
    history = F.array_join(F.transform("_all", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    rows = rows.withColumn("history", history).where("message is not null")
    query = F.col("message") if rewrite is None else F.coalesce(rewrite(F.col("message"), F.col("history")), F.col("message"))
    rows = rows.select(session, query.alias("query"), "history")
    return rows.join(facts.select(session, "facts"), session, "left") if facts is not None else rows.withColumn("facts", F.lit(None).cast("string"))


def prompts(fragments: DataFrame, by: Sequence[str], language: Column, facts: Column) -> DataFrame:
    """Fragments (by, place, is_carried, ref, text) in order, tagged as fresh or carried, under a language line and
    the facts known so far."""
    tag = F.concat(F.lit("<"), F.when(F.col("is_carried"), "carried").otherwise("fresh"), F.lit(' ref="'), F.col("ref"), F.lit('">\n'), F.col("text"), F.lit("\n</fragment>"))
    rows = fragments.withColumns({"_tagged": tag, "_language": language, "_facts": facts})
    out = rows.groupBy(*by).agg(F.max("_language").alias("l"), F.max("_facts").alias("f"), F.sort_array(F.collect_list(F.struct("place", "_tagged"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["_tagged"]), "\n\n")
    return out.select(*by, F.concat_ws("\n\n", F.concat(F.lit("Answer in: "), F.col("l")), F.concat(F.lit("Known: "), F.col("f")), body).alias("prompt"))


def cost_estimate(texts: DataFrame, size: Column, prices: DataFrame, chars: Column, budget: int) -> DataFrame:
    """Per model of prices (name, per_million): texts, tokens, characters a token, how many exceed the budget, the
    largest, and the price of all. Prices meet one row of sums."""
    sums = texts.agg(F.count("*").alias("n_texts"), F.sum(size).alias("n_tokens"), F.round(F.sum(chars) / F.sum(size), 6).alias("chars_per_token"), F.count_if(size > budget).alias("n_over"), F.max(size).alias("largest"))
    return prices.crossJoin(sums).withColumn("price", F.round(F.col("n_tokens") * F.col("per_million") / 1e6, 9))


def compare_generators(answers: DataFrame, by: str, seconds: Column, text: Column, bad_quotes: Column, wrong_language: Column) -> DataFrame:
    return answers.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("avg_seconds"), F.round(F.avg(F.length(text)), 6).alias("avg_chars"), F.sum(bad_quotes).alias("bad_quotes"), F.count_if(wrong_language).alias("n_wrong_language")
    )


def audit_rows(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """pages (id, n_article, n_table, n_annex, n_chars, structure, number, body_script) against expected (id, number,
    script, is_control): what each page's verdict is. failed without any structure or text; partial if its number or
    script isn't as expected; else ok. Control pages are judged like others and marked."""
    rows = expected.select("id", F.col("number").alias("want_number"), F.col("script").alias("want_script"), "is_control").join(pages, "id", "left")
    is_missing = F.col("n_chars").isNull() | (F.col("n_chars") == 0)
    number_ok = F.col("number").eqNullSafe(F.col("want_number"))
    script_ok = F.col("body_script").eqNullSafe(F.col("want_script"))
    verdict = F.when(is_missing | (F.col("structure") == "unknown"), "failed").when(number_ok & script_ok, "ok").otherwise("partial")
    return rows.select("id", "is_control", is_missing.alias("is_missing"), number_ok.alias("number_ok"), script_ok.alias("script_ok"), verdict.alias("verdict"))


#: What may be wrong with an act's page, in the order in which it is said.
PROBLEMS = ("no body", "no structure", "no chapters", "repeated article numbers", "no act number", "another act number", "no translation")


def act_audit(blocks: DataFrame, latest: DataFrame, bare: DataFrame, found: DataFrame, expected: DataFrame, many: int = 5) -> DataFrame:
    """One row for each act of `expected` (id, number, null if unknown): structure, n_article, n_table, n_annex, n_point, latest_bytes, bare_bytes, latest_differs (the two pages'
    bytes; not if the bare one is empty), is_eligible, problems (of PROBLEMS), verdict. From classified blocks, pages (id, html) of both addresses, and
    `found` (id, number, eligible, translated) on them. Chapters are missed where there are more than `many` articles and none comes after one. failed without a body or a
    structure, partial with a problem, else ok."""
    article = F.col("kind") == "article"
    more = blocks.groupBy("id").agg(F.count_distinct(F.when(article, F.col("label"))).alias("_labels"), F.min(F.when(F.col("kind") == "chapter", F.col("pos"))).alias("_chapter"), F.max(F.when(article, F.col("pos"))).alias("_article"))
    sizes = latest.select("id", F.md5("html").alias("_latest"), F.octet_length("html").alias("latest_bytes")).join(bare.select("id", F.md5("html").alias("_bare"), F.octet_length("html").alias("bare_bytes")), "id", "full")
    rows = expected.select("id", F.col("number").alias("_expected")).join(page_metadata(blocks), "id", "left").join(more, "id", "left").join(sizes, "id", "left").join(found, "id", "left")
    squeezed = lambda c: F.regexp_replace(F.col(c).cast("string"), "\\s", "")
    body, n = F.coalesce(F.col("n_chars"), F.lit(0)) > 0, F.coalesce(F.col("n_article"), F.lit(0))
    structure = F.coalesce("structure", F.lit("unknown"))
    is_wrong = (
        ~body,
        structure == "unknown",
        (structure == "articles") & (n > many) & ~F.coalesce(F.col("_chapter") < F.col("_article"), F.lit(False)),
        n != F.coalesce("_labels", F.lit(0)),
        F.col("number").isNull(),
        F.coalesce(squeezed("number") != squeezed("_expected"), F.lit(False)),
        ~F.coalesce("translated", F.lit(False)),
    )
    problems = F.filter(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in zip(PROBLEMS, is_wrong, strict=True)]), lambda x: x.isNotNull())
    verdict = F.when(~body | (structure == "unknown"), "failed").when(F.size(problems) > 0, "partial").otherwise("ok")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "id",
        structure.alias("structure"),
        count("n_article"),
        count("n_table"),
        count("n_annex"),
        F.coalesce("n_points", F.lit(0)).alias("n_point"),
        "latest_bytes",
        "bare_bytes",
        ((F.coalesce("bare_bytes", F.lit(0)) > 0) & ~F.col("_latest").eqNullSafe(F.col("_bare"))).alias("latest_differs"),
        F.coalesce("eligible", F.lit(False)).alias("is_eligible"),
        problems.alias("problems"),
        verdict.alias("verdict"),
    )


def stale_translations(pages: DataFrame, by: str, language: str, amended: str, original: str) -> DataFrame:
    """Translations whose amendment date is before the original's, of each document."""
    of_original = F.max(F.when(F.col(language) == original, F.col(amended))).over(Window.partitionBy(by))
    return pages.withColumn("original_amended", of_original).where((F.col(language) != original) & (F.col(amended) < F.col("original_amended")))

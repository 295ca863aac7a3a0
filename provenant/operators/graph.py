"""Citation graph: references in texts, ranges, resolution to chunks, edges and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_of
from .relational import top_per_group

#: An article's number, the ordinal endings of a cited number or range, what parts them in a list, the inflected
#: noun after it, and the stem that names the code.
_NUMBER = r"\d{1,4}(?:\.\d{1,3})?"
_CITED = rf"{_NUMBER}(?:\s*-\s*{_NUMBER})?-(?:րդ|ին)"
CITATION = rf"((?:{_CITED}(?:\s*,\s*|\s+(?:և|եւ)\s+))*{_CITED})\s+հոդված\p{{L}}*"
CODE_STEM = "օրենսգրք"


def citations(chunks: DataFrame, id_column: str, text_column: str, pattern: str = CITATION, scope_stem: str = CODE_STEM, look_back: int = 60) -> DataFrame:
    """(id, position, group, in_code): each list of cited numbers in the bodies of chunks, each number or range with its ordinal ending, and
    whether the stem that names another act stands within look_back characters before it. White space is collapsed first; positions are those
    of what is left, and follow from the lengths of matches and of what lies between them."""
    body = F.regexp_replace(body_of(text_column), "[\\s\u00a0]+", " ")
    rows = chunks.select(F.col(id_column).alias("id"), body.alias("text"))
    found = rows.withColumns({"whole": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "groups": F.regexp_extract_all("text", F.lit(pattern), F.lit(1))}).where(F.size("whole") > 0)
    between = found.withColumn("between", F.split("text", pattern, -1))
    steps = F.transform("whole", lambda m, i: F.struct((F.length(F.get("between", i)) + F.when(i > 0, F.length(F.get("whole", i - 1))).otherwise(0)).alias("step"), F.get("groups", i).alias("group")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<position: int, group: string>>)").alias("out"))

    def add(s: Column, x: Column) -> Column:
        at = s["at"] + x["step"]
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("position"), x["group"].alias("group")))).alias("out"))

    placed = between.select("id", "text", F.inline(F.aggregate(steps, start, add, lambda s: s["out"])))
    before = F.substring("text", F.greatest(F.col("position") - look_back, F.lit(0)) + 1, F.least(F.col("position"), F.lit(look_back)))
    return placed.select("id", F.col("position").cast("long").alias("position"), "group", F.regexp_like(before, F.lit(f"(?iu){scope_stem}")).alias("in_code"))


def number_tokens(group: Column) -> Column:
    """Numbers and ranges within a cited list."""
    return F.regexp_extract_all(group, F.lit(f"({_NUMBER}(?:\\s*-\\s*{_NUMBER})?)-(?:րդ|ին)"), F.lit(1))


def expand_range(first: Column, last: Column, widest: int = 30) -> Column:
    """The whole numbers from first to last if there are at most widest steps, else the two ends."""
    a, b = first.cast("int"), last.cast("int")
    return F.when((b >= a) & (b - a <= widest), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))


def cited_numbers(token: Column) -> Column:
    """A token's numbers as strings: whole-number ranges are expanded, others keep their ends."""
    ends = F.regexp_extract_all(token, F.lit("(\\d+(?:\\.\\d+)?)"), F.lit(1))
    first, last = F.element_at(ends, 1), F.element_at(ends, -1)
    whole = (F.size(ends) == 2) & ~F.contains(first, F.lit(".")) & ~F.contains(last, F.lit("."))
    return F.when(whole, F.transform(expand_range(first, last), lambda x: x.cast("string"))).otherwise(F.array_distinct(ends))


def references(found: DataFrame) -> DataFrame:
    """(id, in_code, number, place), each once, from `citations`; place numbers them as they first occur in the text."""
    numbers = found.select("id", "position", "in_code", F.posexplode(number_tokens(F.col("group"))).alias("m", "token"))
    cited = numbers.select("id", "position", "in_code", "m", F.posexplode(cited_numbers(F.col("token"))).alias("n", "number"))
    first = cited.groupBy("id", "in_code", "number").agg(F.min(F.struct("position", "m", "n")).alias("at"))
    return first.select("id", "in_code", "number", F.row_number().over(Window.partitionBy("id").orderBy("at", "in_code", "number")).alias("place"))


def resolve(refs: DataFrame, targets: DataFrame, code_act: int) -> DataFrame:
    """refs (from_id, act, number, in_code) with to_id, of the target (act, number, to_id) in the cited act: the
    code's if in_code, else the citing document's own."""
    cited = refs.withColumn("target_act", F.when(F.col("in_code"), F.lit(code_act)).otherwise(F.col("act")))
    t = targets.select(F.col("act").alias("target_act"), "number", "to_id")
    return cited.join(t, ["target_act", "number"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges without those from a chunk to itself."""
    return resolved.where("to_id is not null and to_id <> from_id").select("from_id", "to_id").distinct()


def diagnostics(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of counts: citations, unresolved because the act has no targets at all or lacks the number, to the
    citing chunk itself, and unique edges."""
    acts = targets.select(F.col("act").alias("target_act")).distinct().withColumn("known", F.lit(True))
    rows = resolved.join(acts, "target_act", "left")
    lost = F.col("to_id").isNull()
    return rows.agg(
        F.count("*").alias("n_citations"),
        F.count_if(lost & F.col("known").isNull()).alias("n_act_absent"),
        F.count_if(lost & F.col("known")).alias("n_target_absent"),
        F.count_if(F.col("to_id") == F.col("from_id")).alias("n_self"),
        F.count_distinct(F.when(F.col("to_id") != F.col("from_id"), F.struct("from_id", "to_id"))).alias("n_edges"),
    )


def dangling(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """(act, number, from_id): citations of articles that an act should hold, as it holds others, but doesn't."""
    acts = targets.select(F.col("act").alias("target_act")).distinct()
    lost = resolved.where("to_id is null").join(acts, "target_act", "left_semi")
    return lost.select(F.col("target_act").alias("act"), "number", "from_id").distinct()


def gaps(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each run of cited but missing articles of an act between two that it holds: act, after and before (the held ones, null at the
    ends), first and last (missing), n_missing, n_citing (chunks that cite any), first_citing. Numbers are ordered by their whole part, then by
    what follows the dot. Citing chunks themselves are in `dangling`."""

    def place(number: Column | str) -> Column:
        parts = F.split(number, "\\.")
        return F.struct(F.get(parts, F.lit(0)).cast("int").alias("whole"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(-1)).alias("part"), F.col("number").alias("text"))

    lost = dangling(resolved, targets)
    cited = lost.groupBy("act", "number").agg(F.count("*").alias("n"), F.min("from_id").alias("first_citing"))
    held = targets.select("act", "number").distinct().withColumns({"n": F.lit(0).cast("long"), "first_citing": F.lit(None).cast(cited.schema["first_citing"].dataType)})
    rows = held.unionByName(cited).withColumns({"place": place("number"), "held": F.col("n") == 0})
    in_act = Window.partitionBy("act").orderBy("place")
    # both frames grow row by row, the second from the end: one that shrinks is gone through anew for each row
    up_to, from_here = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (in_act, Window.partitionBy("act").orderBy(F.desc("place"))))
    nearest = F.last(F.when(F.col("held"), F.col("number")), True)
    rows = rows.withColumns({"after": nearest.over(up_to), "before": nearest.over(from_here)})
    runs = rows.where("not held").groupBy("act", "after", "before").agg(F.min("place").alias("a"), F.max("place").alias("z"), F.count("*").alias("n_missing"), F.min("first_citing").alias("first_citing"))
    # a chunk that cites several articles of a run counts once
    citing = rows.where("not held").select("act", "number", "after", "before").join(lost, ["act", "number"]).groupBy("act", "after", "before").agg(F.count_distinct("from_id").alias("n_citing"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("act", "after", "before")]
    return runs.alias("r").join(citing.alias("c"), same).select("r.act", "r.after", "r.before", F.col("a.text").alias("first"), F.col("z.text").alias("last"), "n_missing", "n_citing", "first_citing")


def related(edge: DataFrame, targets: DataFrame, order: str, k: int = 12) -> DataFrame:
    """(from_id, to_id, place, ...): what each node cites, of targets (to_id, `order`, ...) that are in force, the
    first k in their order."""
    cited = edge.select("from_id", "to_id").distinct().join(targets, "to_id")
    return top_per_group(cited, ["from_id"], [F.asc(order), F.asc("to_id")], k, "place")


def in_degree(edge: DataFrame, k: int = 10) -> DataFrame:
    return edge.groupBy("to_id").agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "to_id").limit(k)

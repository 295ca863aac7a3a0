"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: any text that matches holds all trigrams of
at least one clause. Postings (trigram, document) of the trigrams that the rules name are written as the index;
clauses are intersected by aggregating postings by document, never by gathering a trigram's documents; candidates
are verified by the expression itself on the whole text. Rules without mandatory trigrams scan every text.

The index is of lower-cased text, so queries hold whatever the case. It ignores nothing: a candidate that isn't one
costs time, and a match that isn't a candidate can't occur.

Defined results: a null text is empty and has no spans; documents are told apart by id and text's hash, and repeated
rows are reported each; null ids stay null; other columns are ignored; empty tables give empty results. Spans are in
code points, end exclusive; matches of a kind are leftmost and don't overlap; a match whose group is too short is
dropped and not tried again.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, likely_among, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, the group whose length counts, and its least length. `base` rules are the
    contract's; the others are added by this operator."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base patterns of the contract. A lower bound within a pattern stands for dropping shorter
# matches where the two are the same, as no shorter match could hide a longer one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: More alternatives than these are not followed; their texts' trigrams are then not demanded.
MOST_CHOICES = 64

#: Matches whose places are summed together.
FOLD = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of which a matching text, lower-cased, holds at least one's trigrams; None if a text may match that
    holds none."""
    ends = _follow(_parser.parse(pattern), {(frozenset(), "")})
    clauses = {had | _trigrams(run) for had, run in ends}
    if not all(clauses):
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _cut(states: set) -> set:
    """What follows isn't known: runs of literals end here."""
    return {(had | _trigrams(run), "") for had, run in states}


def _follow(items, states: set) -> set:
    """states: (trigrams met, literals since the last unknown character), one for each way to get here."""
    for kind, value in items:
        if kind is op.LITERAL:
            states = {(had, run + chr(value).lower()) for had, run in states}
        elif kind is op.IN and len(value) <= 8 and all(k is op.LITERAL for k, _ in value):
            states = {(had, run + chr(c).lower()) for had, run in states for _, c in value}
        elif kind is op.SUBPATTERN:
            states = _follow(value[3], states)
        elif kind is op.BRANCH:
            states = set().union(*(_follow(way, states) for way in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            once = _follow(body, states)
            if (least, most) == (0, 1):
                states = states | once
            elif least == 0:
                states = _cut(states)
            else:
                states = once if most == 1 else _cut(once)
        elif kind is not op.AT:
            states = _cut(states)
        if len(states) > MOST_CHOICES:
            states = {(frozenset.intersection(*(had for had, _ in _cut(states))), "")}
    return states


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, tie) of `rows` (doc_id, tie, text), written to the shared folder."""
    low = rows.select("doc_id", "tie", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return written(low.select("doc_id", "tie", F.explode(held).alias("trigram")).sortWithinPartitions("trigram"), "trigram-postings")


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, tie, rules, weight): the numbers of the rules of which the document meets a clause; weight is at least
    the number of rows that share the document's id and text."""
    clauses = [(rule, n, t, 1 << i, (1 << len(clause)) - 1) for rule, query in queries.items() for n, clause in enumerate(query) for i, t in enumerate(sorted(clause))]
    table = postings.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, bit long, full long")
    met = postings.join(F.broadcast(table), "trigram").groupBy("doc_id", "tie", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("hits"))
    return met.where("bits = full").groupBy("doc_id", "tie").agg(F.collect_set("rule").alias("rules"), F.max("hits").alias("weight"))


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches in a text: places are sums of the lengths of what lies
    between matches and of the matches. The sums run over blocks of FOLD matches and, within each, over its matches, so that no
    long array is copied for each match."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    pieces = F.transform(
        F.slice(F.arrays_zip(between.alias("gap"), matches.alias("match"), counted.alias("counted")), F.lit(1), F.size(matches)),
        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["match"]).cast("long").alias("match"), (F.length(p["counted"]) >= rule.least).alias("holds")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int")), lambda b: F.slice(pieces, b * FOLD + 1, FOLD))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda at, p: at + p["gap"] + p["match"]))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))

    def add(state: Column, p: Column) -> Column:
        a = state["at"] + p["gap"]
        b = a + p["match"]
        found = F.array(F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(p["holds"], F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), nothing.alias("out")), add, lambda s: s["out"])

    folded = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), spans))
    return F.when(F.size(matches) > 0, folded).otherwise(nothing)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_<kind> for each base rule, base_sha256, spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    marked = written(candidates(build_index(rows, trigrams), queries), "secret-candidates")
    n, weight = marked.agg(F.count("*"), F.sum("weight")).first()
    # only texts that are probably candidates are shuffled to what is known of them
    seen = likely_among(rows, marked, ["doc_id", "tie"], n)
    asked = attach_by_key(seen.where("likely"), marked, ["doc_id", "tie"], "weight", weight or 0).select("doc_id", "text", "rules")
    joined = asked.unionByName(seen.where("not likely").select("doc_id", "text", F.lit(None).cast("array<int>").alias("rules")))
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    found = [F.when(F.array_contains("rules", i), rule_spans(F.col("text"), i, r)).otherwise(nothing) if i in queries else rule_spans(F.col("text"), i, r) for i, r in enumerate(rules)]
    spans = joined.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))

    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(i) for i, r in enumerate(rules) if r.base])

    def listed(chosen: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    def of_kind(number: int) -> Column:
        return F.filter("found", lambda s: s["kind"] == number)

    return spans.select(
        "doc_id",
        *[F.size(of_kind(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base],
        F.sha2(listed(F.filter("found", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )

"""From ordered blocks to units of retrieval, and from those to units of indexing.

Order is a column, never implied. Segments are islands: a running sum of starts numbers them, and ordered joins of
their lines put them together. Where a step depends on all steps before it, a fold over one document's array does it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .counters import Counter, Estimate

#: The lines at which oversized chunks are cut; and the markers of an enumeration's parts (1. or 2.1.), of its points (1) or a letter),
#: each with white space after it, and of table rows that begin with a numbered cell.
PART_LINE = "^\\d{1,3}\\.\\s+\\S"
ENUM_PART = "^\\s*\\d+(?:\\.\\d+)*\\.\\s"
ENUM_POINT = "^\\s*(?:\\d+\\)|[ա-ֆ][.)])\\s"
ENUM_ROW = "^\\|\\s*\\d+\\)"


def lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, line), one row per line, from 0."""
    return docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text_column, "\n")).alias("pos", "line"))


def running(by: Sequence[str], order: str = "pos") -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def islands(blocks: DataFrame, starts: Column, by: Sequence[str] = ("id",), order: str = "pos", name: str = "segment") -> DataFrame:
    """Numbers segments from 1 at each start; 0 is what comes before the first."""
    return blocks.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(running(by, order)).cast("long"))


def carry_forward(blocks: DataFrame, value: Column, name: str, by: Sequence[str] = ("id",), order: str = "pos") -> DataFrame:
    """The last value that isn't null, up to and including this row."""
    return blocks.withColumn(name, F.last(value, ignorenulls=True).over(running(by, order)))


def joined(blocks: DataFrame, by: Sequence[str], text: str = "line", order: str = "pos", separator: str = "\n") -> DataFrame:
    """Segments' texts in order, trimmed, with their first places and numbers of blocks."""
    rows = blocks.groupBy(*by).agg(F.min(order).alias("first_pos"), F.count("*").alias("n_blocks"), F.sort_array(F.collect_list(F.struct(order, text))).alias("_rows"))
    return rows.withColumn("text", F.trim(F.array_join(F.transform("_rows", lambda r: r[text]), separator))).drop("_rows")


def article_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks (id, segment, ref, title, path, text) from blocks (id, pos, kind, label, title, text, markdown): one at
    each article; parts, sections and chapters give its path, and each resets those below it; what comes before the
    first article is left out."""
    numbered = islands(blocks, F.col("kind") == "article")
    by = running(["id"])
    levels = ("part", "section", "chapter")
    for i, level in enumerate(levels):
        resets = F.col("kind").isin(list(levels[: i + 1]))
        at = F.last(F.when(resets, F.struct("kind", "label")), ignorenulls=True).over(by)
        numbered = numbered.withColumn(f"_{level}", F.when(at["kind"] == level, at["label"]))
    path = F.array_compact(F.array(*[f"_{x}" for x in levels]))
    head = F.first(F.when(F.col("kind") == "article", F.struct(F.col("label").alias("ref"), "title", path.alias("path"))), ignorenulls=True)
    body = F.when(F.col("kind").isin("text", "table"), F.struct("pos", F.coalesce("markdown", "text").alias("line")))
    # an article and its body are one group; an article may be without one
    rows = numbered.where("segment > 0").groupBy("id", "segment").agg(head.alias("_head"), F.sort_array(F.collect_list(body)).alias("_rows"))
    text = F.trim(F.array_join(F.transform("_rows", lambda r: r["line"]), "\n\n"))
    return rows.select("id", "segment", "_head.*", F.get("_rows", F.lit(0))["pos"].alias("first_pos"), F.nullif(F.size("_rows").cast("long"), F.lit(0).cast("long")).alias("n_blocks"), text.alias("text"))


def point_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks at each numbered point before the first annex; what comes before the first point is left out."""
    main = islands(blocks, F.col("kind") == "annex", name="annex").where("annex = 0")
    starts = (F.col("kind") == "text") & F.col("text").rlike("^\\d{1,3}(\\.\\d{1,2})?\\s*\\.\\s+")
    cut = islands(main, starts).where("segment > 0").withColumn("line", F.coalesce("markdown", "text"))
    out = joined(cut, ["id", "segment"], separator="\n\n").where("text <> ''")
    return out.withColumn("ref", F.regexp_extract("text", "^(\\d{1,3}(?:\\.\\d{1,2})?)", 1))


def annex_chunks(blocks: DataFrame) -> DataFrame:
    """Within annexes: each table is a chunk; prose between them is cut at points, or is one part where it has none."""
    inside = islands(blocks, F.col("kind") == "annex", name="annex").where("annex > 0 and kind in ('text', 'table')")
    table = F.col("kind") == "table"
    point = (F.col("kind") == "text") & F.col("text").rlike("^\\d{1,3}(\\.\\d{1,2})?\\s*\\.\\s+")
    before = F.lag("kind").over(Window.partitionBy("id", "annex").orderBy("pos"))
    cut = islands(inside, table | point | (before == "table") | before.isNull(), ["id", "annex"]).withColumn("line", F.coalesce("markdown", "text"))
    out = joined(cut, ["id", "annex", "segment"], separator="\n\n")
    kind = F.when(F.col("text").startswith("|"), "table").when(F.col("text").rlike("^\\d{1,3}(\\.\\d{1,2})?\\s*\\.\\s+"), "point").otherwise("part")
    n = F.row_number().over(Window.partitionBy("id", "annex", "kind").orderBy("first_pos"))
    out = out.where("text <> ''").withColumn("kind", kind).withColumn("n", n)
    number = F.when(F.col("kind") == "point", F.regexp_extract("text", "^(\\d{1,3}(?:\\.\\d{1,2})?)", 1)).otherwise(F.col("n").cast("string"))
    return out.withColumn("ref", F.concat_ws(" ", F.lit("annex"), "annex", "kind", number))


def tabular_chunks(blocks: DataFrame) -> DataFrame:
    """Runs of prose and single tables in turn, numbered each."""
    table = F.col("kind") == "table"
    before = F.lag("kind").over(Window.partitionBy("id").orderBy("pos"))
    cut = islands(blocks.where("kind in ('text', 'table')"), table | (before == "table") | before.isNull()).withColumn("line", F.coalesce("markdown", "text"))
    out = joined(cut, ["id", "segment"], separator="\n\n").where("text <> ''")
    out = out.withColumn("kind", F.when(F.col("text").startswith("|"), "table").otherwise("preamble"))
    return out.withColumn("ref", F.concat_ws(" ", "kind", F.row_number().over(Window.partitionBy("id", "kind").orderBy("first_pos"))))


def structure(n_articles: Column, n_points: Column, n_tables: Column) -> Column:
    return F.when(n_articles > 0, "articles").when(n_points > 0, "points").when(n_tables > 0, "tabular").otherwise("unknown")


def chunks(blocks: DataFrame) -> DataFrame:
    """(id, ref, first_pos, text) by each document's structure."""
    point = (F.col("kind") == "text") & F.col("text").rlike("^\\d{1,3}(\\.\\d{1,2})?\\s*\\.\\s+")
    n_articles, n_points, n_tables = (F.count_if(c).over(Window.partitionBy("id")) for c in (F.col("kind") == "article", point, F.col("kind") == "table"))
    # pages are parsed once, and no document's structure goes through the driver
    known = written(blocks.withColumn("structure", structure(n_articles, n_points, n_tables)), "structured-blocks")
    wanted = ["id", "ref", "first_pos", "text"]
    points = known.where("structure = 'points'")
    parts = [article_chunks(known.where("structure = 'articles'")), point_chunks(points), annex_chunks(points), tabular_chunks(known.where("structure = 'tabular'"))]
    out = parts[0].select(*wanted)
    for part in parts[1:]:
        out = out.unionByName(part.select(*wanted))
    return unique_refs(out, ["id"], "ref", "first_pos")


def monotone_groups(rows: DataFrame, number: Column, by: Sequence[str] = ("id",), order: str = "pos") -> DataFrame:
    """A number opens a group only if it is greater than all before it."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    opens = number.isNotNull() & (number > F.coalesce(F.max(number).over(before), F.lit(-1)))
    return islands(rows.withColumn("opens", opens), F.col("opens"), by, order, "group")


def unique_refs(rows: DataFrame, by: Sequence[str], ref: str, order: str) -> DataFrame:
    """The nth row with the same ref, from the second on, becomes "ref (n)"."""
    n = F.row_number().over(Window.partitionBy(*by, ref).orderBy(order))
    return rows.withColumn("_n", n).withColumn(ref, F.when(F.col("_n") > 1, F.concat(F.col(ref), F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col(ref))).drop("_n")


def with_header(document: Column, kind: Column, status: Column, path: Column, ref: Column, title: Column, adopted: Column, amended: Column, source: Column, body: Column) -> Column:
    """A chunk's text: its header's lines, those without a value left out, then three dashes and the body."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"[{name}] "), value))

    dates = F.nullif(F.concat_ws(" | ", F.concat(F.lit("adopted "), adopted), F.concat(F.lit("amended "), amended)), F.lit(""))
    place = F.concat_ws(" › ", path, ref)
    typed = F.concat_ws(" | ", field("Type", kind), field("Status", status))
    return F.concat_ws("\n", field("Document", document), typed, field("Location", place), field("Title", title), field("Dates", dates), field("Source", source), F.lit("---"), body)


def percentile_floor(values: Column, p: float) -> Column:
    """Of an array, the value at floor((n - 1) p) of the sorted ones."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * p) + 1).cast("int"))


def percentile_cut(values: Column, p: float) -> Column:
    """The other definition in use: at min(n - 1, floor(n p))."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * p)) + 1).cast("int"))


def size_report(rows: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """n, min, p50, p90, max and total of sizes by group. The two percentiles come from counts of equal sizes, so no
    group is gathered: a running count finds the row at the place."""
    counts = rows.groupBy(*by, size).agg(F.count("*").alias("c"))
    all_of = Window.partitionBy(*by)
    up_to = Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"n": F.sum("c").over(all_of), "upto": F.sum("c").over(up_to)})

    def at(p: float) -> Column:
        place = F.floor((F.col("n") - 1) * p)
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(size)))

    return placed.groupBy(*by).agg(F.max("n").alias("n"), F.min(size).alias("min_size"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max(size).alias("max_size"), F.sum(F.col(size) * F.col("c")).alias("total_size"))


def part_pieces(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, piece, size): texts cut before numbered part lines, but not within tables; what comes before the first is piece 0."""
    rows = lines(docs, id_column, text_column)
    before = F.lag("line").over(Window.partitionBy("id").orderBy("pos"))
    in_table = F.col("line").startswith("|") | F.coalesce(before.startswith("|"), F.lit(False))
    cut = islands(rows.withColumn("starts", F.col("line").rlike(PART_LINE) & ~in_table), F.col("starts"), name="piece")
    return cut.groupBy("id", "piece").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("size"))


def split_sizes(pieces: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, n_texts, n_cut, n_units, n_still_over): what cutting only texts above each threshold would give."""
    texts = pieces.groupBy("id").agg(F.count("*").alias("n"), (F.sum("size") + F.count("*") - 1).alias("total"), F.max("size").alias("largest"))
    each = texts.select("n", "total", "largest", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    over = F.col("total") > F.col("threshold")
    return each.groupBy("threshold").agg(F.count("*").alias("n_texts"), F.count_if(over).alias("n_cut"), F.sum(F.when(over, F.col("n")).otherwise(1)).alias("n_units"), F.count_if(over & (F.col("largest") > F.col("threshold"))).alias("n_still_over"))


def is_enumeration(body: Column, least_length: int = 2500, least_lines: int = 4) -> Column:
    marked = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(ENUM_PART) | x.rlike(ENUM_POINT) | x.rlike(ENUM_ROW)))
    return (F.length(body) >= least_length) & (marked >= least_lines)


def estimated_tokens(c: Column) -> Column:
    """What counters.Estimate counts, as a column."""
    return F.ceil(F.octet_length(c) / 4).cast("int")


def atomic_units(body: Column) -> Column:
    """array<string>: paragraphs, and each table row by itself; blank lines only separate. Where a unit begins and ends
    shows from a line and its neighbours, so nothing is folded."""
    text = F.split(body, "\n")
    kinds = F.transform(text, lambda x: F.when(F.trim(x) == "", 0).when(x.startswith("|"), 2).otherwise(1))  # blank, of a paragraph, row
    numbered = F.transform(kinds, lambda k, i: F.struct(i.alias("i"), k.alias("k"), F.coalesce(F.get(kinds, i - 1), F.lit(0)).alias("before"), F.coalesce(F.get(kinds, i + 1), F.lit(0)).alias("after")))
    starts = F.filter(numbered, lambda x: (x["k"] == 2) | ((x["k"] == 1) & (x["before"] != 1)))
    ends = F.filter(numbered, lambda x: (x["k"] == 2) | ((x["k"] == 1) & (x["after"] != 1)))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(text, a["i"] + 1, b["i"] - a["i"] + 1), "\n"))


def table_header(body: Column) -> Column:
    """The row before the first separator row and that row; null if there is none."""
    return F.nullif(F.regexp_extract(body, "(?m)^(\\|[^\\n]*\\n\\|\\s*-{3}[^\\n]*)$", 1), F.lit(""))


def greedy_pack(units: Column, budget: Column | int, sizes: Column) -> Column:
    """array<array<string>>: units in order, each group as long as its `sizes` stay within the budget. The fold goes over
    sizes and keeps where groups begin; texts are only cut up after it."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("begins"))

    def add(s: Column, t: Column) -> Column:
        opens = (s["i"] == 0) | (s["used"] + t > limit)
        return F.struct((s["i"] + 1).alias("i"), F.when(opens, t).otherwise(s["used"] + t).alias("used"), F.when(opens, F.concat(s["begins"], F.array(s["i"]))).otherwise(s["begins"]).alias("begins"))

    begins = F.aggregate(sizes, start, add, lambda s: s["begins"])
    ends = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(units)))
    return F.filter(F.zip_with(begins, ends, lambda a, b: F.slice(units, a + 1, b - a)), lambda g: g.isNotNull())


def sentence_pieces(unit: str, budget: int, counter: Counter) -> list[str]:
    """A unit of the budget or more: its sentences, as many together as stay below the budget; a sentence that doesn't is cut
    between tokens. Sentences with blanks between them have at most a token more for each than by themselves, so they are only counted
    together where that reaches the budget."""
    sentences = [x for x in re.split(r"(?<=[։.;])\s+", unit) if x]
    groups: list[list[str]] = [[]]
    bound = 0
    for sentence, n in zip(sentences, counter.count(sentences)):
        if n >= budget:
            groups += [[part] for part in counter.cut(sentence, budget)] + [[]]
            bound = 0
            continue
        bound += n + 1
        if groups[-1] and bound >= budget and counter.count([" ".join([*groups[-1], sentence])])[0] >= budget:
            groups.append([])
            bound = n
        groups[-1].append(sentence)
    return [piece for g in groups if (piece := " ".join(g).strip())]


def _sized(make: Callable[[], Counter], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            out: list[tuple] = []
            for head, body, columns, atoms in zip(*(batch.column(c).to_pylist() for c in ("head", "body", "columns", "atoms"))):
                total, head_size, columns_size = counter.count(["\n".join(filter(None, [head, body])), head and head + "\n", columns or ""])
                room = max(256, most - head_size - columns_size - 16)
                pieces: list[str] = []
                if total > most:
                    for unit, n in zip(atoms, counter.count(atoms)):
                        pieces += [unit] if n < room else sentence_pieces(unit, room, counter)
                out.append((total <= most, room, pieces, counter.count(pieces)))
            kinds = (pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            new = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)]
            kept = ["parent_id", "head", "body", "columns"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, "whole", "room", "pieces", "sizes"])

    return size


def within_cap(text: str, head: str, cap: int, counter: Counter, depth: int = 0) -> list[tuple[str, int]]:
    """A slice and its size, or its parts, each under the head, or without it if that leaves no room."""
    (n,) = counter.count([text])
    if n <= cap or depth == 8:
        return [(text, n)]
    room = cap - counter.count([head])[0] - 8
    if head and text.startswith(head) and room >= 64:
        parts = [head + p for p in counter.cut(text[len(head) :], room)]
    else:
        parts, head = counter.cut(text, max(1, cap - 8)), ""
    return [x for p in parts for x in within_cap(p, head, cap - 8 * depth if len(parts) == 1 else cap, counter, depth + 1)]


def capped(rows: DataFrame, cap: int, make: Callable[[], Counter]) -> DataFrame:
    """(parent_id, slice_id, slice_index, n_slices, text, tokens) for rows (parent_id, head, ids, texts) of a parent's slices in order: none is over `cap`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            out: list[list[dict]] = []
            for head, ids, texts in zip(*(batch.column(c).to_pylist() for c in ("head", "ids", "texts"))):
                found = []
                for id_, text in zip(ids, texts):
                    parts = within_cap(text, head and head + "\n", cap, counter)
                    found += [{"slice_id": id_ if len(parts) == 1 else f"{id_}~{i}", "text": t, "tokens": n} for i, (t, n) in enumerate(parts)]
                out.append(found)
            kind = pa.list_(pa.struct([("slice_id", pa.string()), ("text", pa.string()), ("tokens", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("parent_id"), pa.array(out, kind)], ["parent_id", "slices"])

    id_type = rows.schema["parent_id"].dataType.simpleString()
    done = rows.select("parent_id", "head", "ids", "texts").mapInArrow(cut, f"parent_id {id_type}, slices array<struct<slice_id string, text string, tokens int>>")
    each = done.select("parent_id", F.size("slices").alias("n_slices"), F.posexplode("slices").alias("slice_index", "x"))
    return each.select("parent_id", "x.slice_id", "slice_index", "n_slices", "x.text", "x.tokens")


def slices(chunk: DataFrame, id_column: str, header: str, body: str, most: int = 7000, cap: int = 8000, counter: Callable[[], Counter] = Estimate) -> DataFrame:
    """(parent_id, slice_id, slice_index, n_slices, text, tokens): the chunk itself if it is within `most` tokens, else packed units, each group
    under the header, and the table's header again on slices after the first that hold a row. Nulls count as empty. Units are
    paragraphs and table rows; what the budget can't hold is cut as `sentence_pieces` says, and no slice is over `cap`."""
    text, head = F.coalesce(F.col(body), F.lit("")), F.coalesce(F.col(header), F.lit(""))
    rows = chunk.select(F.col(id_column).alias("parent_id"), head.alias("head"), text.alias("body"), table_header(text).alias("columns"), atomic_units(text).alias("atoms"))
    id_type = rows.schema["parent_id"].dataType.simpleString()
    sized = rows.mapInArrow(_sized(counter, most), f"parent_id {id_type}, head string, body string, columns string, whole boolean, room int, pieces array<string>, sizes array<int>")
    packed = sized.withColumn("groups", F.when(F.col("whole"), F.array(F.array("body"))).otherwise(greedy_pack(F.col("pieces"), F.col("room"), F.col("sizes"))))

    def composed(units: Column, i: Column) -> Column:
        again = (i > 0) & F.exists(units, lambda u: u.startswith("|")) & F.col("columns").isNotNull()
        return F.concat_ws("\n", F.nullif(F.col("head"), F.lit("")), F.when(again, F.col("columns")), F.array_join(units, "\n"))

    key = F.col("parent_id").cast("string")
    ids = F.when(F.col("whole"), F.array(key)).otherwise(F.transform("groups", lambda _, i: F.concat_ws("::", key, i.cast("string"))))
    return capped(packed.select("parent_id", "head", ids.alias("ids"), F.transform("groups", composed).alias("texts")), cap, counter)


def enumerated_items(chunk: DataFrame, id_column: str, body: str, lead_length: int = 220) -> DataFrame:
    """(parent_id, item, lead, text, is_row): items of an enumeration. A part line opens an item and gives the lead of
    those that follow; a point line opens one under that lead; a table row is one by itself; other lines go on."""
    rows = lines(chunk, id_column, body).where(F.trim("line") != "")
    row = F.col("line").startswith("|")
    part = F.col("line").rlike(ENUM_PART) & ~row
    point = F.col("line").rlike(ENUM_POINT) & ~part & ~row
    before_row = F.lag(row, 1, False).over(Window.partitionBy("id").orderBy("pos"))
    cut = islands(rows.withColumns({"part": part, "row": row, "point": point}), part | point | row | before_row, name="item")
    cut = carry_forward(cut, F.when(F.col("part"), F.substring(F.trim("line"), 1, lead_length)), "lead")
    head = cut.groupBy("id", "item").agg(F.min_by("lead", "pos").alias("lead"), F.max("row").alias("is_row"), F.min_by("part", "pos").alias("is_part"))
    out = joined(cut, ["id", "item"]).join(head, ["id", "item"])
    return out.select(F.col("id").alias("parent_id"), "item", F.when(~F.col("is_part"), F.col("lead")).alias("lead"), "text", "is_row")


def merge_tiny(items: DataFrame, least: int = 120) -> DataFrame:
    """Items shorter than `least` that aren't rows go to the head of the next item, which takes their lead if it has
    none; what is left over at the end goes to the last."""
    ordered = items.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("item", "text", "lead", "is_row"))).alias("all"))
    item = "struct<text:string,lead:string,is_row:boolean>"
    start = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("out"), F.lit("").alias("held"), F.lit(None).cast("string").alias("lead"))

    def add(s: Column, x: Column) -> Column:
        text = F.concat_ws("\n", F.nullif(s["held"], F.lit("")), x["text"])
        tiny = (F.length(text) < least) & ~x["is_row"]
        lead = F.coalesce(x["lead"], s["lead"])
        hold = F.struct(s["out"].alias("out"), text.alias("held"), lead.alias("lead"))
        put = F.struct(F.concat(s["out"], F.array(F.struct(text.alias("text"), lead.alias("lead"), x["is_row"].alias("is_row")))).alias("out"), F.lit("").alias("held"), F.lit(None).cast("string").alias("lead"))
        return F.when(tiny, hold).otherwise(put)

    def end(s: Column) -> Column:
        last = F.element_at(s["out"], F.size(s["out"]))
        grown = F.struct(F.concat_ws("\n", last["text"], s["held"]).alias("text"), last["lead"].alias("lead"), last["is_row"].alias("is_row"))
        alone = F.array(F.struct(s["held"].alias("text"), s["lead"].alias("lead"), F.lit(False).alias("is_row")))
        return F.when(s["held"] == "", s["out"]).when(F.size(s["out"]) == 0, alone).otherwise(F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(grown)))

    merged = ordered.select("parent_id", F.posexplode(F.aggregate("all", start, add, end)).alias("item", "x"))
    return merged.select("parent_id", "item", "x.text", "x.lead", "x.is_row")


def enumerated_slices(chunk: DataFrame, id_column: str, header: str, body: str, keep_header_rows: bool = False, cap: int = 8000, counter: Callable[[], Counter] = Estimate) -> DataFrame:
    """(parent_id, slice_id, slice_index, n_slices, text, tokens): header, the table's header for data rows, lead and text of each item; none over `cap`.
    Rows that are the table's header or separator make no slice, unless keep_header_rows."""
    items = merge_tiny(enumerated_items(chunk, id_column, body))
    heads = chunk.select(F.col(id_column).alias("parent_id"), F.coalesce(F.col(header), F.lit("")).alias("head"), table_header(F.col(body)).alias("columns"))
    rows = items.join(heads, "parent_id")
    is_head = F.array_contains(F.split("columns", "\n"), F.col("text")) | F.col("text").rlike("^\\|[\\s|:-]*$")
    if not keep_header_rows:
        rows = rows.where(~(F.col("is_row") & F.coalesce(is_head, F.lit(False))))
    text = F.concat_ws("\n", F.nullif(F.col("head"), F.lit("")), F.when(F.col("is_row"), F.col("columns")), "lead", "text")
    whole = rows.groupBy("parent_id").agg(F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("item", text.alias("text")))).alias("all"))
    ids = F.transform("all", lambda _, i: F.concat(F.col("parent_id").cast("string"), F.lit("::e"), i.cast("string")))
    return capped(whole.select("parent_id", "head", ids.alias("ids"), F.col("all.text").alias("texts")), cap, counter)


def slices_by(policy: str, chunk: DataFrame, id_column: str, header: str, body: str, most: int = 7000, cap: int = 8000, counter: Callable[[], Counter] = Estimate) -> DataFrame:
    """Slices by one of two policies: "token" packs all chunks to a size, "enumerated" gives enumerations a slice an item and
    packs the others."""
    if policy == "token":
        return slices(chunk, id_column, header, body, most, cap, counter)
    if policy != "enumerated":
        raise ValueError(f"no policy {policy!r}")
    listed = is_enumeration(F.coalesce(F.col(body), F.lit("")))
    packed = slices(chunk.where(~listed), id_column, header, body, most, cap, counter)
    return enumerated_slices(chunk.where(listed), id_column, header, body, cap=cap, counter=counter).unionByName(packed)

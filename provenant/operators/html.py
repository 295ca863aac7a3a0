"""HTML pages to ordered blocks. Parsing is a small Python step per page; classifying blocks is SQL again."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DOT_LIKE, dotted_date, fold_dots, normalise_space, squash

#: The words that open articles, parts, sections, chapters and annexes.
ARTICLE, PART, SECTION, CHAPTER, ANNEX = "Հոդված", "ՄԱՍ", "ԲԱԺԻՆ", "ԳԼՈՒԽ", "ՀԱՎԵԼՎԱԾ"
_VOID = {"br", "img", "hr", "meta", "link", "input", "col", "area", "base", "embed", "source", "track", "wbr"}
#: The widest and highest that a cell may be, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}


def _span(value: str | None, most: int) -> int:
    """What a cell spans: 1 unless the attribute is a number of ASCII digits, and never more than `most`."""
    digits = (value or "").strip(" \t\n\f\r")
    return max(1, min(int(digits[:9]), most)) if digits.isascii() and digits.isdigit() else 1


class _Page(HTMLParser):
    """Collects paragraphs and outermost tables in order, links, and the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, object]] = []
        self.links: list[tuple[str, str]] = []
        self.title = ""
        self.depth = 0  # of tables
        self.muted = 0  # within script or style
        self.text: list[str] | None = None
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.in_title = False
        self.link: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.muted += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], []]
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "table":
            if self.depth == 0:
                self.end_text()
                self.rows = []
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.end_cell()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
            self.cell, self.span = [], (_span(a.get("colspan"), MOST_COLUMNS), _span(a.get("rowspan"), MOST_ROWS))
        elif self.depth == 0 and tag in _BLOCKS:
            self.end_text()
            self.text = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                self.end_cell()
                self.blocks.append(("table", [r for r in self.rows if r]))
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.end_cell()
        elif self.depth == 0 and tag in _BLOCKS:
            self.end_text()

    def handle_data(self, data):
        if self.muted:
            return
        if self.in_title:
            self.title += data
        if self.link:
            self.link[1].append(data)
        if self.cell is not None:
            self.cell.append(data)
        elif self.text is not None and self.depth == 0:
            self.text.append(data)

    def end_text(self):
        if self.text is not None:
            if text := " ".join("".join(self.text).split()):
                self.blocks.append(("p", text))
            self.text = None

    def end_cell(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None


def parsed(html: str) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.end_text()
    if page.depth:
        page.end_cell()
        page.blocks.append(("table", [r for r in page.rows if r]))
    return page


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells at the next free column of their row; a cell's text fills its columns and goes down its rows."""
    taken: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, wide, high in row:
            while (y, x) in taken:
                x += 1
            for dy in range(min(high, len(rows) - y)):
                for dx in range(wide):
                    taken.setdefault((y + dy, x + dx), text)
            x += wide
    width = max((x for _, x in taken), default=-1) + 1
    return [[taken.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def markdown(rows: list[list[tuple[str, int, int]]]) -> str:
    cells = grid(rows)
    table = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in cells]
    if table:
        table.insert(1, "|" + " --- |" * len(cells[0]))
    return "\n".join(table)


def article_heading(rows: list[list[tuple[str, int, int]]]) -> tuple[str, str] | None:
    """(number, title) of a table of one row and at most two cells whose first is the article word and a number."""
    import re

    if len(rows) != 1 or not 1 <= len(rows[0]) <= 2:
        return None
    first = rows[0][0][0].translate(str.maketrans(dict.fromkeys(DOT_LIKE, ".")))
    found = re.fullmatch(rf"[^\w]*{ARTICLE}\s+(\d+(?:\.\d+)*)\.?", first)
    return (found[1], rows[0][1][0] if len(rows[0]) > 1 else "") if found else None


def raw_blocks(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, pos, kind, label, title, text, markdown): article, table or text in order; empty ones are left out."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "pos", "kind", "label", "title", "text", "markdown"]
        for batch in batches:
            out = []
            for key, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                pos = 0
                for tag, content in parsed(html).blocks:
                    if tag == "p":
                        out.append((key, pos, "text", None, None, content, None))
                    elif heading := article_heading(content):
                        out.append((key, pos, "article", heading[0], heading[1], f"{ARTICLE} {heading[0]} {heading[1]}".strip(), None))
                    elif len(content) > 1:
                        out.append((key, pos, "table", None, None, "\n".join(" ".join(c[0] for c in r) for r in content), markdown(content)))
                    elif text := " ".join(c[0] for r in content for c in r).strip():
                        out.append((key, pos, "text", None, None, text, None))
                    else:
                        continue
                    pos += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.string()) for i in range(7)], names)

    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).alias("html"))
    return rows.mapInArrow(blocks, "id long, pos long, kind string, label string, title string, text string, markdown string")


def classified(blocks: DataFrame) -> DataFrame:
    """Text blocks that are parts, sections, chapters or annexes become such, with their labels."""
    tight = F.upper(squash(fold_dots("text")))

    def numbered(word: str):
        return F.regexp_extract(tight, f"^{word}([0-9]+(?:\\.[0-9]+)?)", 1)

    annex = F.regexp_like(normalise_space("text"), F.lit(f"(?iu)^{ANNEX}(?:\\s|$|N|№)")) & (F.length("text") <= 300)
    text = F.col("kind") == "text"
    kind = F.when(text & (numbered(PART) != ""), "part").when(text & (numbered(SECTION) != ""), "section").when(text & (numbered(CHAPTER) != ""), "chapter").when(text & annex, "annex").otherwise(F.col("kind"))
    label = F.when(text & (kind != "text"), F.substring(normalise_space("text"), 1, 80)).otherwise(F.col("label"))
    return blocks.select("id", "pos", kind.alias("kind"), label.alias("label"), "title", "text", "markdown")


def page_links(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, n, href, text) of each link."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, n, href, text) for key, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist(), strict=True) for n, (href, text) in enumerate(parsed(html).links)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.string()) for i in range(4)], ["id", "n", "href", "text"])

    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).alias("html"))
    return rows.mapInArrow(links, "id long, n long, href string, text string")


def posts(pages: DataFrame, id_column: str, html_column: str, least_body: int = 40) -> DataFrame:
    """(id, title, date, body, n_comments) of pages that are posts: the first heading, or else the page's title; the
    first dd/mm/yyyy; the text without scripts, styles and tags. Bodies shorter than least_body are left out."""
    raw = F.col(html_column)
    bare = F.regexp_replace(F.regexp_replace(raw, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1>", " "), "(?s)<[^>]*>", " ")
    heading = F.trim(F.regexp_replace(F.regexp_extract(raw, "(?is)<h1\\b[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    title = F.trim(F.regexp_extract(raw, "(?is)<title\\b[^>]*>(.*?)</title>", 1))
    out = pages.select(
        F.col(id_column).alias("id"),
        F.when(heading != "", heading).otherwise(title).alias("title"),
        F.nullif(F.regexp_extract(raw, "(\\d{2}/\\d{2}/\\d{4})", 1), F.lit("")).alias("date"),
        normalise_space(bare).alias("body"),
        F.regexp_count(raw, F.lit("(?i)class=\"[^\"]*comment")).cast("long").alias("n_comments"),
    )
    return out.where(F.length("body") >= least_body)


def page_metadata(blocks: DataFrame) -> DataFrame:
    """One row per page: length of its text, counts of its structures, and what structure it has."""
    point = (F.col("kind") == "text") & F.col("text").rlike("^\\d{1,3}(\\.\\d{1,2})?\\s*\\.\\s+")
    counts = blocks.groupBy("id").agg(
        F.sum(F.length("text")).alias("n_chars"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("article", "table", "part", "section", "chapter", "annex")],
        F.count_if(point).alias("n_points"),
    )
    kind = F.when(F.col("n_article") > 0, "articles").when(F.col("n_points") > 0, "points").when(F.col("n_table") > 0, "tabular").otherwise("unknown")
    return counts.withColumn("structure", kind)


def tables_with_articles(blocks: DataFrame) -> DataFrame:
    """Data tables, each with the last article before it."""
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("kind") == "article", F.col("label")), ignorenulls=True).over(before)
    return blocks.withColumn("article", at).where("kind = 'table'")


def amendments(pairs: DataFrame) -> DataFrame:
    """pairs (id, pos, left, right) of a page's table of amendments as (id, pos, label, date, acts): the label unless it is
    nothing but dashes, the first dotted date of either cell, and the ids of all acts that they link to."""
    both = F.concat_ws(" ", "left", "right")
    label = normalise_space("left")
    acts = F.transform(F.regexp_extract_all(both, F.lit("/acts/(\\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return pairs.select("id", "pos", F.when(~label.rlike("^[-‐-― ]*$"), label).alias("label"), dotted_date(both).alias("date"), acts.alias("acts"))


def lost_numbers(source: str, made: str):
    """Digit runs of the source that the made text lacks; none may be."""
    return F.array_except(F.regexp_extract_all(source, F.lit("([0-9]+)"), F.lit(1)), F.regexp_extract_all(made, F.lit("([0-9]+)"), F.lit(1)))

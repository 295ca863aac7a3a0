"""Verbatim quotations: extraction, matching with elisions, sanitising and highlighting; coverage headers.

`match` and `segments` are small pure functions that the batch and the streaming code share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import meaning_normalise

#: Pairs of quotation marks, in the order in which they are looked for; elisions; the header's values.
PAIRS = (("«", "»"), ('"', '"'), ("“", "”"))
ELISION = r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…)\s*"
COVERAGE = r"^\s*COVERAGE\s*:\s*(full|partial|none)\s*$"
NOTICES = {"hy": "[չհաստատված մեջբերում]", "ru": "[цитата не подтверждена]"}
LEAST_QUOTE, LEAST_SEGMENT = 25, 15
#: Characters of parts, with what each takes besides, that are held at a time.
PARTS_BYTES = 4 << 20
_ENUMERATOR = re.compile(r"^\s*(?:\d{1,3}(?:\.\d{1,2})?\s*[.)]|[^\W\d_]\s*\))\s*")
LETTERS, _CYRILLIC = re.compile("[Ա-Ֆա-և]"), re.compile("[Ѐ-ԯ]")


def normalised(text: str) -> str:
    """As functions.text.meaning_normalise."""
    text = re.sub("[‐-―]", "-", text).translate(str.maketrans("‘’ʼ`։", "'''':"))
    return re.sub(r"\s+", " ", text.replace(" ", " ")).strip()


def segments(quote: str) -> list[str]:
    """A quote's parts between elisions, without closing punctuation and leading enumerators; parts that are nothing
    but an enumerator are left out."""
    out = []
    for part in re.split(ELISION, normalised(quote)):
        part = _ENUMERATOR.sub("", part.strip()).rstrip(" .:;,")
        if part and re.search(r"[^\W\d_]", part):
            out.append(part)
    return out


def match(quote: str, source: str) -> bool:
    """Whether the source, normalised, holds the quote word for word, its segments in order and apart."""
    hay = source
    if normalised(quote) in hay:
        return True
    parts = segments(quote)
    if not parts or any(len(p) < LEAST_SEGMENT for p in parts):
        return False
    at = 0
    for p in parts:
        found = hay.find(p, at)
        if found < 0:
            return False
        at = found + len(p)
    return True


def _blocks(rows: DataFrame, text_column: str, block_bytes: int) -> Iterator[DataFrame]:
    """`rows` as small tables of bounded bytes."""
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append(row)
        size += 100 + len(row[text_column].encode())
        if size >= block_bytes:
            yield rows.sparkSession.createDataFrame(block, rows.schema)
            block, size = [], 0
    if block:
        yield rows.sparkSession.createDataFrame(block, rows.schema)


def contained_quotes(quotes: DataFrame, sources: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(quote_id, id) of sources that hold the quote, both normalised. A quote's longest inner word is the join key, so
    only sources with that word are searched. Quotes of fewer than three words, as all are in scripts without spaces, have none: they
are a stated query set, broadcast in blocks of bounded bytes, and all sources are searched for each block in one pass.
    quotes (quote_id, text), sources (id, text)."""
    q = quotes.select("quote_id", meaning_normalise("text").alias("q")).where("q <> ''")
    # the first and last words of a quote may be parts of longer words in a source; only inner words are whole
    inner = F.slice(F.split("q", " "), F.lit(2), F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, b: F.when((F.length(b) > F.length(a)) | ((F.length(b) == F.length(a)) & (b < a)), b).otherwise(a))
    q = q.withColumn("word", longest)
    s = sources.select("id", meaning_normalise("text").alias("s"))
    words = s.select("id", F.explode(F.array_distinct(F.split("s", " "))).alias("word"))
    candidates = words.join(q.where("word <> ''"), "word").select("quote_id", "id", "q")
    found = candidates.join(s, "id").where(F.contains("s", F.col("q"))).select("quote_id", "id")
    for block in _blocks(q.where("word = ''").select("quote_id", "q"), "q", block_bytes):
        found = found.unionByName(s.join(F.broadcast(block), F.contains("s", F.col("q"))).select("quote_id", "id"))
    return found.distinct()


def sanitised(answers: DataFrame, sources: DataFrame, letters: re.Pattern | None = LETTERS, language: str | None = None) -> DataFrame:
    """answers (id, text) with sources (id, texts): text with quotes that no source holds replaced by a notice,
    n_quotes, n_rejected, and the places of the sources that hold the others. Only quotes with `letters` are
    checked, Armenian ones by default; None checks all. The notice is in the language given, or in the answer's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, texts in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "texts")), strict=True):
                out.append((key, *sanitise(text or "", texts or [], letters, language)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["id", "clean", "n_quotes", "n_rejected", "found_in"])

    rows = answers.select(F.col("id").cast("long").alias("id"), "text").join(sources.select(F.col("id").cast("long").alias("id"), "texts"), "id", "left")
    return rows.mapInArrow(run, "id long, clean string, n_quotes long, n_rejected long, found_in array<long>")


def checkable(quote: str, letters: re.Pattern | None = LETTERS, least: int = LEAST_QUOTE) -> bool:
    """Whether a quote must stand in a source: it has letters of the script, and at least `least` characters. What
    isn't is the writer's own words or a term. Batches and streams ask this alike."""
    return (letters is None or letters.search(quote) is not None) and len(normalised(quote)) >= least


def quote_places(text: str, letters: re.Pattern | None = LETTERS) -> list[tuple[int, int]]:
    """(start, end) of the quotes to be checked, with their marks; pair by pair, not nested."""
    found = []
    for opening, closing in PAIRS:
        at = 0
        while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a + 1)) >= 0:
            if checkable(text[a + 1 : b], letters):
                found.append((a, b + 1))
            at = b + 1
    return found


def script_counts(text: str) -> tuple[int, int]:
    """Armenian and Cyrillic letters."""
    return len(LETTERS.findall(text)), len(_CYRILLIC.findall(text))


def notice_in(hy: int, ru: int) -> str:
    """The notice in the script that prevails; Cyrillic where neither does."""
    return NOTICES["hy" if hy > ru else "ru"]


def sanitise(text: str, sources: list[str], letters: re.Pattern | None = LETTERS, language: str | None = None) -> tuple[str, int, int, list[int]]:
    """The text with each quote that no source holds, marks included, replaced by a notice: just there, not where its
    words stand without marks. Of quotes that overlap, the one found first is replaced."""
    hays = [normalised(s or "") for s in sources]
    places = quote_places(text, letters)
    found, rejected = [], []
    for a, b in places:
        at = next((i for i, h in enumerate(hays) if match(text[a + 1 : b - 1], h)), None)
        if at is None:
            rejected.append((a, b))
        else:
            found.append(at)
    gone: list[tuple[int, int]] = []
    for a, b in rejected:
        if all(b <= x or a >= y for x, y in gone):
            gone.append((a, b))
    notice = NOTICES[language] if language else notice_in(*script_counts(text))
    clean, end = [], 0
    for a, b in sorted(gone):
        clean += [text[end:a], notice]
        end = b
    return "".join(clean) + text[end:], len(places), len(rejected), found


def highlight(text: str, quotes: list[str], least: int = 20) -> list[tuple[str, bool]]:
    """The text in parts, marked where a quote longer than `least` stands, always the earliest first."""
    wanted = [q for q in quotes if len(q) > least]
    out, at = [], 0
    while at < len(text):
        hits = [(p, -len(q), q) for q in wanted if (p := text.find(q, at)) >= 0]
        if not hits:
            out.append((text[at:], False))
            break
        p, _, q = min(hits)
        if p > at:
            out.append((text[at:p], False))
        out.append((q, True))
        at = p + len(q)
    return out


def highlighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text, quotes) as (id, pos, part, marked), text by text: put out whenever PARTS_BYTES are reached."""

    def put(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["id", "pos", "part", "marked"])

    for batch in batches:
        out, size = [], 0
        for key, text, quotes in zip(*(batch.column(c) for c in ("id", "text", "quotes")), strict=True):
            parts = highlight(text.as_py() or "", quotes.as_py() or [])
            out += [(key.as_py(), n, part, marked) for n, (part, marked) in enumerate(parts)]
            size += 100 * len(parts) + sum(len(part) for part, _ in parts)
            if size >= PARTS_BYTES:
                yield put(out)
                out, size = [], 0
        yield put(out)


def highlight_segments(rows: DataFrame) -> DataFrame:
    """rows (id, text, quotes) as (id, pos, part, marked)."""
    return rows.select(F.col("id").cast("long").alias("id"), "text", "quotes").mapInArrow(highlighted, "id long, pos long, part string, marked boolean")


def coverage(text: Column) -> Column:
    """struct<coverage, body>: the value of a header in the first line, lower case, and what follows it; without a
    header null and the whole text."""
    first = F.element_at(F.split(text, "\n", 2), 1)
    value = F.lower(F.regexp_extract(first, f"(?i){COVERAGE}", 1))
    rest = F.ltrim(F.substring(text, F.length(first) + 2, F.length(text)))
    return F.struct(F.nullif(value, F.lit("")).alias("coverage"), F.when(value != "", rest).otherwise(text).alias("body"))


def named_but_absent(named: Column, retrieved: Column) -> Column:
    return F.array_except(named, retrieved)

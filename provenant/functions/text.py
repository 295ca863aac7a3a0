"""Column functions over text: normalising, scripts, terms, dates, act numbers, headers and hashes.

All are built-in expressions, so they stay in generated code and can be pushed around by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
#: Signs that stand for a full stop in numbers of headings.
DOT_LIKE = "․·‧։"
#: Month names as written in long dates, in order.
MONTHS = ("հունվար", "փետրվար", "մարտ", "ապրիլ", "մայիս", "հունիս", "հուլիս", "օգոստոս", "սեպտեմբեր", "հոկտեմբեր", "նոյեմբեր", "դեկտեմբեր")
#: Classes of letters per script.
SCRIPTS = {"hy": "[\\u0531-\\u0556\\u0561-\\u0587]", "ru": "[\\u0400-\\u052F]", "en": "[A-Za-z]"}
#: Runs of white space, the no-break space included, which Java's class leaves out.
SPACES = "[\\s ]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), SPACES, " "))


def squash(c: Column | str) -> Column:
    """Without any white space, for headings whose letters are spaced."""
    return F.regexp_replace(_c(c), SPACES, "")


def fold_dots(c: Column | str) -> Column:
    return F.translate(_c(c), DOT_LIKE, "." * len(DOT_LIKE))


def script_count(c: Column | str, script: str) -> Column:
    return F.regexp_count(_c(c), F.lit(SCRIPTS[script])).cast("long")


def dominant_script(c: Column | str, least: int = 200) -> Column:
    """The script with the most letters if those are more than `least`; ties go to hy, then ru."""
    counts = {s: script_count(c, s) for s in SCRIPTS}
    top = F.greatest(*counts.values())
    return F.when(top <= least, F.lit(None)).when(counts["hy"] == top, "hy").when(counts["ru"] == top, "ru").otherwise("en")


def answer_language(c: Column | str) -> Column:
    """ru if Cyrillic letters outnumber Armenian ones, else hy, also where there are none."""
    return F.when(script_count(c, "ru") > script_count(c, "hy"), "ru").otherwise("hy")


def notice_language(c: Column | str) -> Column:
    """hy only if Armenian letters outnumber Cyrillic ones: the other rule for ties."""
    return F.when(script_count(c, "hy") > script_count(c, "ru"), "hy").otherwise("ru")


def search_terms(c: Column | str) -> Column:
    """Terms of a text, in order: lower case, letters, digits and . _ - within, at least two characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[\\p{L}\\p{N}](?:[\\p{L}\\p{N}._-]*[\\p{L}\\p{N}])"), F.lit(0))


def meaning_normalise(c: Column | str) -> Column:
    """What quotes are compared by: one dash, one apostrophe, one colon, single spaces."""
    x = F.regexp_replace(_c(c), "[‐-―]", "-")
    x = F.translate(x, "‘’ʼ`։", "'''':")
    return normalise_space(x)


def collapsed_sha256(c: Column | str) -> Column:
    return F.sha2(normalise_space(c), 256)


def fingerprint16(c: Column | str) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def header_of(c: Column | str) -> Column:
    """What stands before the first line of three dashes; empty if there is none."""
    at = F.locate("\n---\n", _c(c))
    return F.when(at > 0, F.substring(_c(c), F.lit(1), at - 1)).otherwise("")


def body_of(c: Column | str) -> Column:
    at = F.locate("\n---\n", _c(c))
    return F.when(at > 0, F.substring(_c(c), at + 5, F.length(_c(c)))).otherwise(_c(c))


def header_field(header: Column | str, name: str) -> Column:
    """The value of a line "[name] value"; null if there is none."""
    return F.nullif(F.regexp_extract(_c(header), f"(?m)^\\[{name}\\] (.*)$", 1), F.lit(""))


def dotted_date(c: Column | str) -> Column:
    """dd.mm.yyyy as a date."""
    return F.try_to_timestamp(F.regexp_extract(_c(c), "(\\d{2}\\.\\d{2}\\.\\d{4})", 1), F.lit("dd.MM.yyyy")).cast("date")


def long_date(c: Column | str) -> Column:
    """The first long-form date, day month year or year month day; month names may be inflected."""
    names = "|".join(MONTHS)
    dmy, ymd = f"(?iu)(\\d{{1,2}})\\s+({names})\\p{{L}}*\\s+(\\d{{4}})", f"(?iu)(\\d{{4}})\\s*\\p{{L}}*\\.?\\s+({names})\\p{{L}}*\\s+(\\d{{1,2}})"
    month = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])

    def made(pattern: str, year: int, day: int) -> Column:
        found = F.regexp_extract(_c(c), pattern, 2)
        parts = [F.regexp_extract(_c(c), pattern, g).try_cast("int") for g in (year, day)]
        return F.when(found != "", F.make_date(parts[0], F.element_at(month, F.lower(found)), parts[1]))

    def place(pattern: str) -> Column:
        at = F.regexp_instr(_c(c), F.lit(pattern))
        return F.when(at > 0, at)

    first, second = place(dmy), place(ymd)
    return F.when(second.isNull() | (first <= second), made(dmy, 3, 1)).otherwise(made(ymd, 1, 3))


#: How laws (ՀՕ) and decisions (Ն, Ա, Լ) are numbered.
LAW_NUMBER = "(?:ՀՕ|HO)\\s*[-‐-―]?\\s*(\\d+)(?:\\s*[-‐-―]\\s*([ՆԱԼN]))?"
DECISION_NUMBER = "[Nn№]\\s*(\\d+)\\s*[-‐-―]\\s*([ՆԱԼ])"


def act_number(c: Column | str) -> Column:
    """struct<series, number, suffix> of the first act number, a law's before a decision's; null if there is none."""
    law, decision = F.regexp_extract(_c(c), LAW_NUMBER, 1), F.regexp_extract(_c(c), DECISION_NUMBER, 1)

    def made(series: str, number: Column, pattern: str) -> Column:
        return F.struct(F.lit(series).alias("series"), number.cast("int").alias("number"), F.nullif(F.regexp_extract(_c(c), pattern, 2), F.lit("")).alias("suffix"))

    return F.when(law != "", made("law", law, LAW_NUMBER)).when(decision != "", made("decision", decision, DECISION_NUMBER))


def act_numbers(c: Column | str) -> Column:
    """array of such structs: all act numbers of a text, of either series, in the order in which they stand."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(f"(?:{LAW_NUMBER})|(?:{DECISION_NUMBER})"), F.lit(0)), act_number)


def own_act_number(c: Column | str, head: int = 600, tail: int = 400) -> Column:
    """A page's own number by its place: a decision's in the head, else the last law's in the tail, else the head's first."""
    text = _c(c)
    first = F.substring(text, 1, head)
    last = F.element_at(F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(LAW_NUMBER), F.lit(0)), -1)
    in_head = F.regexp_extract(first, DECISION_NUMBER, 0)
    return F.when(in_head != "", act_number(in_head)).otherwise(F.coalesce(act_number(last), act_number(first)))


def is_normative(number: Column) -> Column:
    """Whether an act may be retrieved: all but individual ones, whose suffix is Ա."""
    return F.coalesce(number["suffix"] != "Ա", F.lit(True))


def int_or(c: Column | str, default: int) -> Column:
    """Settings read from text: a default where the text isn't a number."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(float(default)))


def link_id(href: Column | str) -> Column:
    """The act id in a link's path; null if there is none."""
    return F.nullif(F.regexp_extract(_c(href), "/acts/(\\d+)", 1), F.lit("")).cast("long")

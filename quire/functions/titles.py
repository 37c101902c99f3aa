"""Predicates and scores of heading lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelled-out numbers, one to twenty.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty"
).split()
IDENTIFIER = r"[0-9]{1,3}|[IVXLCDMivxlcdm]{1,12}|(?i:" + "|".join(NUMBER_WORDS) + ")"
#: First words of running prose, not of a title.
PROSE_STARTS = (
    "we this that is was has will presented presents describes discusses contains continues"
).split()
#: Beginnings of captions and of matter around the chapters.
NOT_TITLES = (
    "answers to ", "chapter preview", "contents", "example ", "exercise ", "figure ", "october ", "source:", "table ",
)
MARKUP = r"\\[A-Za-z]+|\\[\\{}$&#_%]|[${}]|\^\{|_\{"
SPACES = r"(?U)\s+"

CHAPTER = rf"^\s*((?i:chapter|chap\.?))\s+({IDENTIFIER})\b(?:\s*[:.\-–—]\s*|\s+)?(.*?)\s*$"
DIVISION = rf"^\s*((?i:book|part))\s+({IDENTIFIER})\b(?:\s*[:.\-–—]\s*|\s+)?(.*?)\s*$"
NUMBERED = r"^\s*([0-9]{1,3})(?:[.)]|[ \t]{1,4})([A-Za-z][A-Za-z0-9 ,:'\"&/()\-–—]{2,110})\s*$"


def folded(text: Column) -> Column:
    """Lower case with the sharp s spelled out, as caseless matching wants it."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_key(label: Column) -> Column:
    return F.trim(F.regexp_replace(folded(label), "[^a-z0-9]+", " "))


def acceptable_line(line: Column) -> Column:
    stripped = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return (stripped != "") & (F.length(stripped) <= 150) & ~line.contains("...")


def words_in(text: Column) -> Column:
    return F.when(squeezed(text) == "", 0).otherwise(F.size(F.split(squeezed(text), " ")))


def heading_like_tail(tail: Column) -> Column:
    t = squeezed(tail)
    first = F.substring(t, 1, 1)
    opening = F.regexp_replace(F.substring_index(folded(t), " ", 1), "[^a-z]", "")
    fits = (
        (words_in(t) <= 14)
        & first.rlike(r"^[\p{L}\p{N}]")
        & ~first.rlike(r"^[\p{L}&&[^\p{Lu}]]")
        & ~opening.isin(*PROSE_STARTS)
    )
    return (t == "") | fits


def plausible_title(title: Column) -> Column:
    """The shape of a title, not of prose or data."""
    t = squeezed(title)
    letters = F.regexp_replace(t, r"\P{L}+", "")
    low = folded(t)
    out = (
        F.length(t).between(1, 150)
        & (words_in(t) <= 18)
        & (F.length(letters) >= 4)
        & letters.rlike(r"^\p{Lu}")
        & ~t.rlike(r"[.,;:]$")
        & ~t.contains("...")
        & ~t.rlike(MARKUP)
        & ~t.rlike(r"^[0-9]+(?:\.[0-9]+)+\b")
    )
    for start in NOT_TITLES:
        out = out & ~low.startswith(start)
    return out


def identifier_number(identifier: Column) -> Column:
    """Value of a number word, a decimal or a Roman numeral; else null."""
    low = F.regexp_replace(F.lower(identifier), r"\.+$", "")
    spelled = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), low).cast("int")
    value = F.create_map(*[F.lit(x) for p in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in p])
    digits = F.transform(F.filter(F.split(F.reverse(low), ""), lambda c: c != ""), lambda c: value[c])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))

    def add(s, v):
        # a numeral before a greater one is taken off
        return F.when(v < s["top"], F.struct((s["sum"] - v).alias("sum"), s["top"].alias("top"))).otherwise(
            F.struct((s["sum"] + v).alias("sum"), v.alias("top"))
        )

    roman = F.when(low.rlike("^[ivxlcdm]+$"), F.aggregate(digits, start, add, lambda s: s["sum"]))
    decimal = F.when(low.rlike("^[0-9]+$"), low.try_cast("int"))
    return F.when(spelled > 0, spelled).otherwise(F.coalesce(decimal, F.nullif(roman, F.lit(0))))


def heading_quality(label: Column, kind: Column) -> Column:
    """How much a heading looks like the real one among its repeats."""
    title = F.regexp_replace(F.regexp_replace(label, r"^\s*[0-9]{1,3}\s+", ""), r"^\s+|\s+$", "")
    digits = F.length(F.regexp_replace(title, "[^0-9]", ""))
    letters = F.regexp_replace(label, r"\P{L}+", "")
    bare = F.lit(False)
    for pattern in (CHAPTER, DIVISION):
        bare = bare | (label.rlike(pattern) & (F.regexp_extract(label, pattern, 3) == ""))
    return (
        F.when(digits == 0, 4).otherwise(-F.least(digits, F.lit(6)))
        + F.when(words_in(title).between(1, 12), 2).otherwise(0)
        - F.when(title.rlike("[=<>→]"), 4).otherwise(0)
        + F.when((kind != "chapter block") & letters.rlike(r"^\p{Lu}+$"), 5).otherwise(0)
        + F.when(bare, 3).otherwise(0)
        + F.when(label.rlike("^(Chapter|Book|Part)"), 1).otherwise(0)
    ).cast("int")

"""Portable file names of books and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTITLED = "Untitled Section"
BOOK_BYTES, CUT_BOOK_BYTES, HEADING_BYTES, NAME_BYTES = 160, 145, 65, 236


def safe_filename(label: Column, limit: int = 100) -> Column:
    clean = F.regexp_replace(label, r'[\\/:*?"<>|\x00-\x1F]', " ")
    clean = F.btrim(F.regexp_replace(clean, r"(?U)\s+", " "), F.lit(" ."))
    cut = F.rtrim(F.substring(clean, 1, limit), F.lit(" ."))
    return F.when(cut == "", UNTITLED).otherwise(cut)


def truncate_utf8(value: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cutting between characters."""
    # the longest prefix whose bytes fit: a character has four at most, so only the
    # last three characters before the byte limit can be in question
    cut = F.substring(F.encode(value, "utf-8"), 1, limit)
    valid = F.rtrim(F.make_valid_utf8(cut.cast("string")), F.lit("\ufffd"))
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.rtrim(valid, F.lit(" .")))


def flat_section_filename(book: Column, number: Column, heading: Column, suffix: str = ".txt") -> Column:
    """book_NNN - heading, below 240 bytes; a shortened book name carries a digest."""
    label = truncate_utf8(safe_filename(book, 180), BOOK_BYTES)
    marked = F.concat(truncate_utf8(label, CUT_BOOK_BYTES), F.lit("_"), F.substring(F.sha2(book, 256), 1, 12))
    stem = F.when(label == book, label).otherwise(marked)
    title = truncate_utf8(safe_filename(heading, 100), HEADING_BYTES)
    name = F.concat(stem, F.lit("_"), F.format_string("%03d", number.cast("int")), F.lit(" - "), title)
    return F.concat(truncate_utf8(name, NAME_BYTES), F.lit(suffix))

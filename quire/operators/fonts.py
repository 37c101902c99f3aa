"""Fonts of a page: what their codes, glyph names and outlines say a character is.

Font objects are rows (doc_key, page_idx, font, object, encoding, to_unicode): the texts of a
font's dictionary, of its encoding and of its character map, as a decoder reads them. Everything is
parsed by expressions and joined with glyphs by page, font and character.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import symbols
from quire.functions.formulas import MATH_FONTS
from quire.operators import layout

KEY = ("doc_key", "page_idx", "font")


def differences(fonts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """by, code, glyph: the codes that an encoding names. A number sets the code, every name
    takes it and moves on; of two names for a code the later counts."""
    body = F.regexp_extract("encoding", r"(?s)/Differences\s*\[(.*?)\]", 1)
    tokens = F.regexp_extract_all(body, F.lit(r"(?<!\S)(?:[0-9]+|/\S+)(?!\S)"), F.lit(0))
    rows = fonts.select(*by, F.posexplode(tokens).alias("at", "token"))
    order = Window.partitionBy(*by).orderBy("at")
    number = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token").cast("int"))
    rows = rows.withColumn("number", number).withColumn("base", F.last("number", True).over(order)).withColumn(
        "since", F.col("at") - F.coalesce(F.last(F.when(F.col("number").isNotNull(), F.col("at")), True).over(order), F.lit(-1)) - 1
    )
    named = rows.where("number IS NULL")
    code = F.coalesce("base", F.lit(0)) + F.col("since")
    return named.groupBy(*by, code.cast("int").alias("code")).agg(F.max_by(F.expr("substring(token, 2)"), "at").alias("glyph"))


def utf16(digits: Column) -> Column:
    """Text from hexadecimal UTF-16, or Latin-1 where that is not valid."""
    even = F.upper(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits))
    valid = even.rlike("^(?:(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*$")
    return F.when(valid, F.decode(F.unhex(even), "UTF-16BE")).otherwise(F.decode(F.unhex(even), "ISO-8859-1"))


def code_point(value: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")


def cmap_pairs(fonts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """by, code, character: the pairs and ranges of a font's character map; of several for a
    code the last counts, ranges after pairs."""
    text = F.coalesce("to_unicode", F.lit(""))
    digits = r"<([0-9A-Fa-f]+)>"
    pairs = F.regexp_extract_all(text, F.lit("(?s)beginbfchar(.*?)endbfchar"), F.lit(1))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    listed = fonts.select(*by, F.posexplode(pairs).alias("block", "part")).select(
        *by, "block", F.regexp_extract_all("part", F.lit(digits), F.lit(1)).alias("d")
    ).select(*by, "block", "d", F.explode(F.sequence(F.lit(0), F.floor(F.size("d") / 2).cast("int"))).alias("k")).where(
        "2 * k + 1 < size(d)"
    ).select(
        *by, F.struct(F.lit(0), F.col("block"), F.col("k")).alias("at"),
        number(F.get("d", F.col("k") * 2)).alias("code"), utf16(F.get("d", F.col("k") * 2 + 1)).alias("character"),
    )
    ranges = F.regexp_extract_all(text, F.lit("(?s)beginbfrange(.*?)endbfrange"), F.lit(1))
    triple = rf"{digits}\s*{digits}\s*{digits}"
    parts = F.arrays_zip(*[F.regexp_extract_all("part", F.lit(triple), F.lit(g)).alias(n) for g, n in ((1, "lo"), (2, "hi"), (3, "to"))])
    spread = fonts.select(*by, F.posexplode(ranges).alias("block", "part")).select(
        *by, "block", F.posexplode(parts).alias("k", "r")
    ).where(F.conv("r.lo", 16, 10).cast("int") <= F.conv("r.hi", 16, 10).cast("int")).select(
        *by, F.struct(F.lit(1), F.col("block"), F.col("k")).alias("at"), number(F.col("r.to")).alias("to"), number(F.col("r.lo")).alias("lo"),
        F.explode(F.sequence(number(F.col("r.lo")), number(F.col("r.hi")))).alias("code"),
    ).select(*by, "at", "code", code_point(F.col("to") + F.col("code") - F.col("lo")).alias("character"))
    return listed.unionByName(spread).groupBy(*by, "code").agg(F.max_by("character", "at").alias("character"))


def glyph_map(fonts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """by, text, name, code: what a character that a decoder emits stands for. Codes with a
    name come first, by their mapped character or their own; of several the greatest code."""
    both = differences(fonts, by).join(cmap_pairs(fonts, by), [*by, "code"], "full")
    text = F.coalesce("character", code_point(F.col("code")))
    return both.groupBy(*by, text.alias("text")).agg(
        F.max_by(F.struct(F.col("glyph").alias("name"), "code"), F.struct(F.col("glyph").isNotNull(), F.when(F.col("glyph").isNotNull(), F.col("code")).otherwise(-F.col("code")))).alias("m")
    ).select(*by, "text", "m.name", "m.code")


def widths(fonts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """by, code, width: the widths that a font gives its codes; none if one is no number."""
    numbers = F.split(F.btrim(F.regexp_extract("object", r"(?s)/Widths\s*\[(.*?)\]", 1)), r"\s+")
    values = F.transform(numbers, lambda x: x.try_cast("double"))
    first = F.coalesce(F.regexp_extract("object", r"/FirstChar\s+([0-9]+)", 1).try_cast("int"), F.lit(0))
    return fonts.where(~F.exists(values, lambda x: x.isNull())).select(
        *by, first.alias("first"), F.posexplode(values).alias("k", "width")
    ).select(*by, (F.col("first") + F.col("k")).alias("code"), "width")


def replace_characters(glyphs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Glyphs with the characters that were recovered for their place. ``replacements``:
    doc_key, page_idx, font, code, ox, oy (rounded to hundredths), character."""
    keyed = replacements.select(
        "doc_key", "page_idx", "font", F.col("code").alias("_code"), F.col("ox").alias("_ox"), F.col("oy").alias("_oy"), "character"
    )
    near = glyphs.withColumns(
        {"_code": F.when(F.length("text") == 1, F.ascii("text")), "_ox": F.round("ox", 2), "_oy": F.round("oy", 2)}
    )
    return near.join(keyed, ["doc_key", "page_idx", "font", "_code", "_ox", "_oy"], "left").select(
        *[F.coalesce("character", "text").alias("text") if c == "text" else F.col(c) for c in glyphs.columns]
    )


def name_glyphs(glyphs: DataFrame, maps: DataFrame, width: DataFrame) -> DataFrame:
    """Glyphs with the names that their fonts give them. A blank whose advance is not the
    width of its code was made up by the decoder, and stays a blank."""
    named = glyphs.drop("name").join(
        maps.select(*KEY, "text", "name", "code"), [*KEY, "text"], "left"
    ).join(width, [*KEY, "code"], "left")
    want, got = F.col("width") * F.col("size") / 1000, F.col("x1") - F.col("x0")
    made_up = (F.col("text") == " ") & (F.col("size") > 0) & (want > 0.1) & (F.abs(got - want) > F.greatest(F.lit(0.35), want * 0.1))
    columns = [c for c in glyphs.columns if c != "name"]
    return named.select(*columns, F.when(~F.coalesce(made_up, F.lit(False)), F.col("name")).alias("name"))


def _table(spark, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def resolve_tokens(glyphs: DataFrame) -> DataFrame:
    """Glyphs with latex, their token whatever their place: by name, else by font and
    character, else by character; pieces of delimiters and unknown codes are empty."""
    spark = glyphs.sparkSession
    by_name = _table(spark, list(symbols.NAMED.items()), "name string, _named string")
    own = {("NewOptr2k", c): t for c, t in symbols.NEWOPTR.items()}
    by_font = _table(
        spark, [(*k, t) for k, t in (symbols.FONT_CHARACTERS | own).items()], "font string, text string, _font string"
    )
    by_text = _table(spark, list(symbols.UNICODE.items()), "text string, _text string")
    text = F.col("text")
    empty = F.col("name").isin(*symbols.EXTENSIONS) | ((F.length(text) == 1) & (F.ascii(text) < 32))
    token = F.coalesce(
        "_named", "_font", "_text",
        F.when(F.coalesce(empty, F.lit(False)), "").when(text == "$", r"\$").otherwise(text),
    )
    joined = glyphs.join(by_name, "name", "left").join(by_font, ["font", "text"], "left").join(by_text, "text", "left")
    return joined.select(*glyphs.columns, token.alias("latex"))


def true_extents(glyphs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Glyphs with y0 and y1 from their outlines where ``boxes`` (font, glyph, bottom, top; in
    thousandths of the size) has them, for tall symbols reach beyond their line."""
    key = F.coalesce("name", "text")
    found = glyphs.withColumn("glyph", key).join(boxes, ["font", "glyph"], "left")
    scale = F.col("size") / 1000
    y0 = F.coalesce(F.col("oy") - F.col("top") * scale, "y0").alias("y0")
    y1 = F.coalesce(F.col("oy") - F.col("bottom") * scale, "y1").alias("y1")
    return found.select(*[y0 if c == "y0" else y1 if c == "y1" else F.col(c) for c in glyphs.columns])


def outline_boxes(outlines: DataFrame) -> DataFrame:
    """font, glyph, bottom, top: of all subsets of a font, the one with the most glyphs.
    ``outlines``: font, subset, glyph, bottom, top."""
    size = outlines.groupBy("font", "subset").agg(F.count("*").alias("n"))
    most = size.groupBy("font").agg(F.max_by("subset", F.struct("n", "subset")).alias("subset"))
    return outlines.join(most, ["font", "subset"]).groupBy("font", "glyph").agg(
        F.round(F.min("bottom")).cast("int").alias("bottom"), F.round(F.max("top")).cast("int").alias("top")
    )


def first_occurrences(glyphs: DataFrame) -> DataFrame:
    """font, text, doc_key, page_idx, pos: where each character of each mathematical font is
    first seen, for looking at it."""
    math = layout.is_math_font(F.col("font"), sorted(MATH_FONTS))
    place = F.struct("doc_key", "page_idx", "pos")
    return glyphs.where(math).groupBy(layout.base_font(F.col("font")).alias("font"), "text").agg(
        F.min(place).alias("p"), F.count("*").alias("n")
    ).select("font", "text", "p.doc_key", "p.page_idx", "p.pos", "n")

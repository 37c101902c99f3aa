"""Paged documents: offsets, outline headings, sections, catalog, density gates.

Pages are rows (doc_key, page_idx, text); outlines are rows (doc_key, pos, level, title,
page), pages counted from 1. One shuffle by document serves each operator's windows; a
document's pages are read by one task, as its text is one value in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import latex, naming, titles

BREAK = latex.PAGE_BREAK
SAMPLE_PAGES, MIN_DENSITY, MIN_BODY, ERROR_SHARE = 12, 40.0, 200, 0.05


def page_offsets(pages: DataFrame) -> DataFrame:
    """Where each page starts in the joined text, in characters."""
    before = Window.partitionBy("doc_key").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(
        "doc_key", "page_idx",
        F.coalesce(F.sum(F.length("text") + len(BREAK)).over(before), F.lit(0)).cast("long").alias("start"),
        F.length("text").cast("long").alias("characters"),
    )


def joined_text(pages: DataFrame) -> DataFrame:
    """doc_key, text: the pages of each document, joined by the page break."""
    ordered = F.sort_array(F.collect_list(F.struct("page_idx", "text")))
    return pages.groupBy("doc_key").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), BREAK).alias("text"),
        F.count("*").alias("pages"),
    )


def bookmark_headings(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Headings from the outline: doc_key, start, label, key, kind.

    Entries with a title and an existing page count. If titles that name a chapter lie on
    two or more pages, their least level is taken; else the least level with more than
    one entry. The first title of that level on a page stands for it; a document with
    fewer than two such pages has no headings."""
    offsets = page_offsets(pages)
    n_pages = pages.groupBy("doc_key").agg(F.count("*").alias("n_pages"))
    title = F.btrim(F.col("title"))
    valid = (
        toc.join(n_pages, "doc_key")
        .where((title != "") & F.col("page").between(1, F.col("n_pages")))
        .select("doc_key", "pos", "level", title.alias("title"), "page", title.rlike(titles.CHAPTER).alias("named"))
    )
    by_level = valid.groupBy("doc_key", "level").agg(
        F.count("*").alias("entries"), F.collect_set(F.when(F.col("named"), F.col("page"))).alias("named_pages")
    )
    level = by_level.groupBy("doc_key").agg(
        F.min(F.when(F.size("named_pages") > 0, F.col("level"))).alias("named_level"),
        F.size(F.array_distinct(F.flatten(F.collect_list("named_pages")))).alias("named_pages"),
        F.min(F.when(F.col("entries") > 1, F.col("level"))).alias("full_level"),
    ).select(
        "doc_key",
        F.when(F.col("named_pages") >= 2, F.col("named_level")).otherwise(F.col("full_level")).alias("level"),
    )
    chosen = (
        valid.join(level, ["doc_key", "level"])
        .groupBy("doc_key", "page")
        .agg(F.min_by("title", "pos").alias("label"))
        .withColumn("n", F.count("*").over(Window.partitionBy("doc_key")))
        .where("n >= 2")
    )
    return chosen.join(offsets, (chosen["doc_key"] == offsets["doc_key"]) & (F.col("page") == F.col("page_idx") + 1)).select(
        chosen["doc_key"], "start", "label", titles.normalize_key(F.col("label")).alias("key"),
        F.lit("bookmarks").alias("kind"),
    )


def build_sections(texts: DataFrame, headings: DataFrame) -> DataFrame:
    """Cut texts at headings, losing nothing: doc_key, number, heading, body.

    What precedes the first heading is front matter; a text without headings is one
    section. ``texts``: doc_key, text; ``headings``: doc_key, start, label."""
    marks = headings.select("doc_key", F.col("start").cast("long").alias("start"), F.col("label").alias("heading"))
    first = marks.groupBy("doc_key").agg(F.min("start").alias("least"))
    opening = texts.select("doc_key").join(first, "doc_key", "left").where("least IS NULL OR least > 0").select(
        "doc_key", F.lit(0).cast("long").alias("start"),
        F.when(F.col("least").isNull(), "Complete Text").otherwise("Front Matter").alias("heading"),
    )
    order = Window.partitionBy("doc_key").orderBy("start")
    cuts = marks.unionByName(opening).select(
        "doc_key", "start", "heading",
        F.lead("start").over(order).alias("stop"),
        (F.row_number().over(order) - 1).alias("number"),
    )
    body = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.coalesce("stop", F.length("text")) - F.col("start")).cast("int"))
    return cuts.join(texts.select("doc_key", "text"), "doc_key").select("doc_key", "number", "heading", body.alias("body"))


def plan_sections(
    sections: DataFrame, source: Column, stem: Column, render=latex.latex_document, suffix: str = ".tex"
) -> DataFrame:
    """Output records: doc_key, number, heading, file, characters, sha256, content."""
    return sections.select(
        "doc_key", "number", "heading",
        naming.flat_section_filename(stem, F.col("number"), F.col("heading"), suffix).alias("file"),
        render(F.col("body"), source, F.col("heading")).alias("content"),
    ).select(
        "doc_key", "number", "heading", "file", F.length("content").cast("long").alias("characters"),
        F.sha2("content", 256).alias("sha256"), "content",
    )


def catalog(outputs: DataFrame) -> DataFrame:
    """The published sections: source_file, section_file, detection_method, heading,
    characters, converter. ``outputs`` also has source_file, method and converter."""
    return outputs.select(
        "source_file", F.col("file").alias("section_file"), F.col("method").alias("detection_method"), "heading",
        "characters", "converter",
    )


def lossless(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_key, expected and found characters, and whether the sections make up the pages."""
    whole = joined_text(pages).select("doc_key", F.sha2("text", 256).alias("want"), F.length("text").cast("long").alias("expected"))
    parts = sections.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("number", "body"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    return whole.join(parts.select("doc_key", text.alias("t")), "doc_key", "left").select(
        "doc_key", "expected", F.coalesce(F.length("t"), F.lit(0)).cast("long").alias("found"),
        F.coalesce(F.sha2("t", 256) == F.col("want"), F.lit(False)).alias("complete"),
    )


def text_density(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """Mean letters and digits of up to ``sample`` evenly spaced pages of each document."""
    n = pages.groupBy("doc_key").agg(F.count("*").alias("n_pages"))
    step = F.greatest(F.lit(1), F.expr(f"n_pages div {sample}"))
    signs = F.coalesce(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")), F.lit(0))
    return (
        pages.join(n, "doc_key")
        .where((F.col("page_idx") % step == 0) & (F.expr("page_idx") < step * sample))
        .groupBy("doc_key")
        .agg((F.sum(signs).cast("double") / F.count("*")).alias("density"))
    )


def gates(pages: DataFrame) -> DataFrame:
    """doc_key, density, characters, errors, status: the checks that a text layer must pass.

    ``pages`` also has method; 'error' marks a page that could not be read."""
    body = F.length(F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", ""))
    sums = pages.groupBy("doc_key").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("method") == "error").alias("errors"),
        F.sum(body).cast("long").alias("characters"),
    )
    allowed = F.greatest(F.lit(1), F.floor(F.col("n_pages") * ERROR_SHARE))
    return sums.join(text_density(pages), "doc_key").select(
        "doc_key", "density", "characters", "errors",
        F.when(F.col("density") < MIN_DENSITY, "no text layer")
        .when(F.col("errors") > allowed, "too many failed pages")
        .when(F.col("characters") < MIN_BODY, "too little text")
        .otherwise("accepted").alias("status"),
    )


def outline_chapters(toc: DataFrame) -> DataFrame:
    """doc_key, number, title, page: the numbered entries of an outline's first level."""
    clean = F.btrim(F.replace(F.col("title"), F.lit("\n"), F.lit(" ")))
    pattern = r"^([0-9]+)\s+(.*)$"
    return toc.where("level = 1").select("doc_key", "pos", clean.alias("t"), "page").where(F.col("t").rlike(pattern)).select(
        "doc_key", "pos", F.regexp_extract("t", pattern, 1).cast("int").alias("number"),
        F.btrim(F.regexp_extract("t", pattern, 2)).alias("title"), "page",
    )


def titled_page(toc: DataFrame, title: str) -> DataFrame:
    """doc_key, page: where the first entry with just this title is."""
    clean = F.btrim(F.replace(F.col("title"), F.lit("\n"), F.lit(" ")))
    return toc.where(clean == title).groupBy("doc_key").agg(F.min_by("page", "pos").alias("page"))


def chapter_ranges(toc: DataFrame, counts: DataFrame, stop: str) -> DataFrame:
    """doc_key, number, title, first, last: the pages of each chapter. The last one goes up to the
    entry ``stop``, or to the end. ``counts``: doc_key, n_pages."""
    order = Window.partitionBy("doc_key").orderBy("pos")
    tail = counts.join(titled_page(toc, stop).withColumnRenamed("page", "stop"), "doc_key", "left")
    rows = outline_chapters(toc).withColumn("next", F.lead("page").over(order)).join(tail, "doc_key")
    return rows.select(
        "doc_key", "number", "title", F.col("page").alias("first"),
        F.coalesce(F.col("next") - 1, F.col("stop") - 1, F.col("n_pages")).alias("last"),
    )

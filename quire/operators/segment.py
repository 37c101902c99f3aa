"""Pages from glyphs and rules: groups in reading order, and LaTeX.

Glyphs are gathered into one row per page, bounded by what a page holds, and each page is worked
on by itself in an Arrow function; see ``pagecut`` and ``inline``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import inline, pagecut
from quire.operators.layout import PAGE

GLYPH = ("pos", "text", "name", "font", "size", "x0", "y0", "x1", "y1", "ox", "oy", "flags")
RULE = ("pos", "x0", "y0", "x1", "y1")
GROUP = (
    "reading int, region int, kind string, text string, latex string, x0 double, x1 double, base double, "
    "region_left double, margin boolean, glyphs array<long>"
)


def page_rows(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_key, page_idx, glyphs, rules: a row per page, with its items in order."""
    gathered = glyphs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*GLYPH))).alias("glyphs"))
    lines = rules.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*RULE))).alias("rules"))
    return gathered.join(lines, list(PAGE), "left")


def _per_page(pages: DataFrame, function, schema: str, names: list[str]) -> DataFrame:
    """``function`` (glyphs, rules) -> rows of every page. Keys travel as text."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            out = []
            for key, page, glyphs, rules in zip(*(batch[c] for c in (*PAGE, "glyphs", "rules")), strict=True):
                own = [dict(r) for r in rules] if rules is not None else []
                out += [(key, page, *row) for row in function([dict(g) for g in glyphs], own)]
            yield pd.DataFrame(out, columns=[*PAGE, *names])

    rows = pages.select(*[F.col(c).cast("string") for c in PAGE], "glyphs", "rules")
    found = rows.mapInPandas(run, f"doc_key string, page_idx string, {schema}")
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in PAGE})


def groups(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_key, page_idx and ``GROUP``: lines, displays and margin notes in reading order;
    glyphs: positions of a group's glyphs, left to right."""

    def of_page(glyphs, rules):
        for k, g in enumerate(pagecut.analyse(glyphs, rules)[1]):
            kind = inline.classify(g)
            latex = "" if kind == "blank" else inline.group_latex(g, kind)
            yield k, g.region, kind, g.text(), latex, g.x0, g.x1, float(g.base), g.left, g.margin, [x.pos for x in g.glyphs]

    names = [x.split()[0] for x in GROUP.split(", ")]
    return _per_page(page_rows(glyphs, rules), of_page, GROUP, names)


def page_latex(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_key, page_idx, text, method: every page as LaTeX by itself; a page that cannot be
    read has method 'error' and no text."""

    def of_page(glyphs, rules):
        try:
            yield inline.page_latex(glyphs, rules), "traditional"
        except Exception:  # noqa: BLE001  one bad page must not end the document
            yield "", "error"

    return _per_page(page_rows(glyphs, rules), of_page, "text string, method string", ["text", "method"])


def xy_gap_cut(glyphs: DataFrame) -> DataFrame:
    """doc_key, page_idx, region, glyphs: the regions that white space cuts a page into."""

    def of_page(glyphs, rules):
        solid = [g for g in pagecut.parse(glyphs, [])[0] if not g.blank]
        for k, part in enumerate(pagecut.regions(solid, pagecut.body_size(solid))):
            yield k, len(part)

    empty = glyphs.limit(0).select(*PAGE, *RULE)
    return _per_page(page_rows(glyphs, empty), of_page, "region int, glyphs int", ["region", "glyphs"])

"""Blocks of a page from its classified groups, and the page's LaTeX.

Groups come in reading order as rows (doc_key, page_idx, reading, kind, x0, region_left,
latex). A block is a run: lines of a paragraph, centred lines, or a group on its own. All
is windows over a page and one aggregation per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import latex
from quire.operators.layout import PAGE

INDENT = 6.0
#: Kinds whose neighbours are never joined to them.
ALONE = ("section", "subsection", "boxtitle", "display", "margin")


def attach_labels(groups: DataFrame) -> DataFrame:
    """Without label and blank groups: a label goes, in bold, before the next line of text;
    labels after the last line of a page are dropped."""
    order = Window.partitionBy(*PAGE).orderBy("reading")
    following = order.rowsBetween(1, Window.unboundedFollowing)
    target = F.first(F.when(F.col("kind") == "text", F.col("reading")), ignorenulls=True).over(following)
    rows = groups.where("kind != 'blank'").withColumn("target", F.when(F.col("kind") == "label", target))
    labels = rows.where("target IS NOT NULL").groupBy(*PAGE, F.col("target").alias("reading")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("target", "latex"))), lambda x: F.concat(F.lit("\\textbf{"), x["latex"], F.lit("} "))), ""
        ).alias("label")
    )
    return rows.where("kind != 'label'").join(labels, [*PAGE, "reading"], "left").withColumn(
        "latex", F.concat(F.coalesce("label", F.lit("")), "latex")
    ).drop("label", "target")


def blocks(groups: DataFrame) -> DataFrame:
    """doc_key, page_idx, block, kind, content: runs of groups, rendered."""
    order = Window.partitionBy(*PAGE).orderBy("reading")
    fresh = (
        F.lag("kind").over(order).isNull()
        | (F.lag("kind").over(order) != F.col("kind"))
        | F.col("kind").isin(*ALONE)
        | ((F.col("kind") == "text") & (F.col("x0") > F.col("region_left") + INDENT))
    )
    runs = groups.withColumn("block", F.sum(fresh.cast("int")).over(order))
    ordered = F.sort_array(F.collect_list(F.struct("reading", "latex")))
    lines = runs.groupBy(*PAGE, "block", "kind").agg(F.transform(ordered, lambda x: x["latex"]).alias("lines"))
    text = F.array_join("lines", " ")
    content = (
        F.when(F.col("kind") == "text", latex.join_lines(F.col("lines")))
        .when(
            F.col("kind") == "center",
            F.concat(F.lit("\\begin{center}\n"), F.array_join("lines", " \\\\\n"), F.lit("\n\\end{center}")),
        )
        .when(F.col("kind") == "section", F.concat(F.lit("\\section{"), text, F.lit("}")))
        .when(F.col("kind") == "subsection", F.concat(F.lit("\\subsection{"), text, F.lit("}")))
        .when(F.col("kind") == "boxtitle", F.concat(F.lit("\\subsubsection*{"), text, F.lit("}")))
        .when(F.col("kind") == "display", F.concat(F.lit("\\["), text, F.lit("\\]")))
        .when(F.col("kind") == "margin", F.concat(F.lit("\\marginpar{"), text, F.lit("}")))
        .otherwise(text)
    )
    return lines.select(*PAGE, "block", "kind", content.alias("content"))


def page_text(groups: DataFrame) -> DataFrame:
    """doc_key, page_idx, text: the page's blocks with a blank line between them."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "content")))
    text = F.array_join(F.transform(ordered, lambda b: b["content"]), "\n\n")
    return blocks(attach_labels(groups)).groupBy(*PAGE).agg(F.regexp_replace(text, r"\n{3,}", "\n\n").alias("text"))

"""Chapter headings found in prose or LaTeX, as tables.

Lines come from the text with their offsets; candidates of each kind are filters on
lines and their neighbours; clean-up works in windows over a document's candidates.
Only the choice of the longest numbered sequence, a recurrence over the candidates of
one document, is a grouped Arrow function.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import latex, titles

#: Every character at which a line ends, as text splitting knows them.
ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
LINE = rf"[^{ENDS}]*(?:\r\n|[{ENDS}])|[^{ENDS}]+"
MINIMUM = 3000
METHODS = ("chapter block", "chapter", "division", "numbered section")


def lines(texts: DataFrame) -> DataFrame:
    """doc_key, line_no, start, line (without its end): lines and their offsets."""
    pieces = F.regexp_extract_all("text", F.lit(LINE), F.lit(0))
    split = texts.select("doc_key", F.posexplode(pieces).alias("line_no", "raw"))
    before = Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split.select(
        "doc_key", "line_no",
        F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long").alias("start"),
        F.rtrim(F.col("raw"), F.lit("\r\n")).alias("line"),
    )


def candidates(texts: DataFrame) -> DataFrame:
    """doc_key, start, label, key, kind, number: heading candidates of all kinds."""
    order = Window.partitionBy("doc_key").orderBy("line_no")
    stripped = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = lines(texts).withColumn("s", stripped).select(
        "*",
        *[F.lag("s", k).over(order).alias(f"p{k}") for k in (1,)],
        *[F.lead("s", k).over(order).alias(f"n{k}") for k in range(1, 6)],
    )
    low = titles.folded(F.col("s"))
    ok = titles.acceptable_line(F.col("line"))

    def group(pattern, k):
        return F.regexp_extract("line", pattern, k)

    chapter = ok & F.col("line").rlike(titles.CHAPTER) & titles.heading_like_tail(group(titles.CHAPTER, 3))
    division = (
        ok & ~chapter & F.col("line").rlike(titles.DIVISION) & titles.heading_like_tail(group(titles.DIVISION, 3))
    )
    numbered = (
        ok & ~chapter & ~division & F.col("line").rlike(titles.NUMBERED)
        & ~group(titles.NUMBERED, 2).rlike(r"[.;,]\s*$")
    )
    only = rf"^\s*({titles.IDENTIFIER})[.]?\s*$"
    split = low.isin("chapter", "chap.") & F.coalesce(F.col("n1").rlike(only), F.lit(False))
    roman = r"^\s*([IVXLCDM]{1,10})\.\s+(.{2,120}?)\s*$"
    literary = (
        F.col("line").rlike(roman)
        & (titles.normalize_key(group(roman, 2)) != "title")
        & titles.heading_like_tail(group(roman, 2))
    )
    label = titles.squeezed(F.col("line"))

    def made(kind, name, identifier, text, start="start"):
        number = titles.identifier_number(identifier)
        key = F.concat(F.lit(f"{name} "), F.coalesce(titles.folded(identifier), F.lit("none")))
        if kind == "numbered section":
            key = F.concat(F.lit("section "), F.coalesce(number.cast("string"), F.lit("none")))
        return F.struct(
            F.col(start).alias("start") if isinstance(start, str) else start.alias("start"),
            text.alias("label"), key.alias("key"), F.lit(kind).alias("kind"), number.alias("number"),
        )

    # a number alone, with the title within three blank lines below it
    after = F.array(*[F.col(f"n{k}") for k in range(1, 6)])
    at = (
        F.when(F.coalesce("n1", F.lit("x")) != "", 1)
        .when(F.coalesce("n2", F.lit("x")) != "", 2)
        .when(F.coalesce("n3", F.lit("x")) != "", 3)
        .otherwise(4)
    )
    title, below = F.get(after, at - 1), F.get(after, at)
    value = F.col("s").try_cast("int")
    block = (
        F.col("s").rlike("^[0-9]+$") & value.between(1, 200) & F.col("n1").isNotNull()
        & F.coalesce(F.col("p1") == "", F.lit(True))
        & F.coalesce(titles.plausible_title(title), F.lit(False))
        & F.coalesce(below == "", F.lit(True))
    )
    found = F.array(
        F.when(chapter, made("chapter", "chapter", group(titles.CHAPTER, 2), label)),
        F.when(division, made("division", "division", group(titles.DIVISION, 2), label)),
        F.when(numbered, made("numbered section", "section", group(titles.NUMBERED, 1), label)),
        F.when(
            split,
            made("chapter", "chapter", F.regexp_extract("n1", only, 1), F.concat(F.lit("Chapter "), F.regexp_extract("n1", only, 1))),
        ),
        F.when(literary, made("numbered section", "section", group(roman, 1), label)),
        F.when(
            block,
            made("chapter block", "chapter block", value.cast("string"), F.concat_ws(" ", value.cast("string"), title)),
        ),
    )
    own = rows.select("doc_key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("h")).select("doc_key", "h.*")
    return own.unionByName(opened_chapters(texts))


def opened_chapters(texts: DataFrame) -> DataFrame:
    """Chapters whose title stands, as the last lines of a block, above their section N.1.

    Only documents with such a section have lines with the lines above them."""
    first = r"^\s*([0-9]{1,3})\.1(?:[^0-9]|$)"
    some = texts.where(F.col("text").rlike(rf"(?:^|[{ENDS}])\s*[0-9]{{1,3}}\.1(?:[^0-9]|$)"))
    back = Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(-25, -1)
    stripped = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = lines(some).withColumn("s", stripped).withColumn("n", F.regexp_extract("line", first, 1)).withColumn(
        "back", F.collect_list(F.struct("start", "s")).over(back)
    )
    rows = rows.where("n != ''").withColumn("above", _title_above()).withColumn("number", F.col("n").try_cast("int"))
    bare = F.btrim(F.regexp_replace(F.col("above.title"), F.concat(F.lit("^"), F.col("n"), F.lit(r"\s+")), ""))
    shorter = F.regexp_extract(bare, r"^[0-9]{1,3}\s+(.+)$", 1)
    title = F.when((shorter != "") & titles.plausible_title(shorter), shorter).otherwise(bare)
    name = F.col("number").cast("string")
    return rows.where("above IS NOT NULL AND number BETWEEN 1 AND 200").select(
        "doc_key", F.col("above.start").alias("start"), F.concat_ws(" ", name, title).alias("label"),
        F.concat(F.lit("chapter block "), name).alias("key"), F.lit("chapter block").alias("kind"), "number",
    )


def _title_above():
    """struct(start, title): the nearest plausible title among the up to 25 lines above.

    Going up, a block of lines is tried by its last one, two, three lines."""
    size = F.size("back")
    lines_back = F.reverse("back")

    def tail(i, count):
        return F.slice("back", size - i - count + 1, F.lit(count))

    ends = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda i: (F.get(lines_back, i)["s"] != "") & ((i == 0) | (F.get(lines_back, i - 1)["s"] == "")),
    )

    def tried(i):
        options = []
        for count in (1, 2, 3):
            part = tail(i, count)
            whole = (i + count <= size) & ~F.exists(part, lambda x: x["s"] == "")
            text = F.array_join(F.transform(part, lambda x: x["s"]), " ")
            options.append(
                F.when(whole & titles.plausible_title(text), F.struct(F.get(part, F.lit(0))["start"].alias("start"), text.alias("title")))
            )
        return F.coalesce(*options)

    return F.get(F.filter(F.transform(ends, tried), lambda x: x.isNotNull()), F.lit(0))


def drop_contents(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Without the first dense early run (five or more) whose keys mostly recur later."""
    by = Window.partitionBy("doc_key", "kind")
    order = by.orderBy("start", "label")
    early = F.least(F.floor(F.col("size") * 0.15), F.lit(150_000))
    rows = found.join(texts.select("doc_key", F.length("text").alias("size")), "doc_key").select(
        "*",
        F.row_number().over(order).alias("i"),
        F.count("*").over(by).alias("n"),
        F.when(
            (F.col("start") - F.lag("start").over(order) >= 2000) | (F.col("start") > early), 1
        ).otherwise(0).alias("cut"),
    ).withColumn("run", F.sum("cut").over(order)).withColumn("early", F.col("start") <= early)
    last = F.max("i").over(Window.partitionBy("doc_key", "kind", "key"))
    run = Window.partitionBy("doc_key", "kind", "run")
    rows = rows.withColumn("last_i", last).withColumn("run_end", F.max("i").over(run)).withColumn(
        "run_size", F.count("*").over(run)
    )
    rows = rows.withColumn(
        "share", F.sum((F.col("last_i") > F.col("run_end")).cast("int")).over(run) / F.col("run_size")
    )
    # a run that reaches the end must itself be early; one that ends before is by its break
    fits = (
        (F.col("n") >= 6) & (F.col("run_size") >= 5) & (F.col("share") >= 0.6)
        & ((F.col("run_end") < F.col("n")) | F.col("early"))
    )
    rows = rows.withColumn("drop_run", F.min(F.when(fits, F.col("run"))).over(by))
    return rows.where("drop_run IS NULL OR run != drop_run").select(*found.columns)


def collapse_repeats(found: DataFrame) -> DataFrame:
    """Of adjacent headings with one key, the first of the highest quality."""
    order = Window.partitionBy("doc_key", "kind").orderBy("start", "label")
    fresh = F.coalesce((F.lag("key").over(order) != F.col("key")).cast("int"), F.lit(1))
    rows = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    quality = titles.heading_quality(F.col("label"), F.col("kind"))
    best = F.max_by(F.struct(*found.columns), F.struct(quality, -F.col("start")))
    return rows.groupBy("doc_key", "kind", "island").agg(best.alias("h")).select("h.*")


def strongest_sequence(found: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """The longest chain of headings whose numbers go up by one, at least ``minimum``
    characters apart; of equally long ones, the best by quality and links."""
    rows = found.withColumn("quality", titles.heading_quality(F.col("label"), F.col("kind")))
    names = found.columns

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "label"], ignore_index=True)
        starts, quality = group["start"].tolist(), group["quality"].tolist()
        numbers = [None if x != x or x is None else int(x) for x in group["number"].tolist()]
        best: list[tuple[int, int, int]] = []  # links, score, predecessor
        # by number: starts so far, and the best heading up to each of them
        seen: dict[int, tuple[list[int], list[int]]] = {}
        for i, number in enumerate(numbers):
            state = (1, quality[i], -1)
            places, leaders = seen.get(number - 1, ([], [])) if number is not None else ([], [])
            if k := bisect.bisect_right(places, starts[i] - minimum):
                j = leaders[k - 1]
                state = max((best[j][0] + 1, best[j][1] + quality[i] + 4, j), state, key=lambda s: s[:2])
            best.append(state)
            if number is not None:
                places, leaders = seen.setdefault(number, ([], []))
                places.append(starts[i])
                leaders.append(i if not leaders or state[:2] > best[leaders[-1]][:2] else leaders[-1])
        i = max(range(len(best)), key=lambda k: best[k][:2])
        path = []
        while i >= 0:
            path.append(i)
            i = best[i][2]
        return group.loc[path[::-1], names]

    return rows.groupBy("doc_key", "kind").applyInPandas(pick, found.schema)


def detect_structure(texts: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """doc_key, method, start, label, key, number: the headings of the first method, in
    order, that finds enough; a document without any has no rows."""
    chain = strongest_sequence(collapse_repeats(drop_contents(candidates(texts), texts)), minimum)
    by = Window.partitionBy("doc_key", "kind")
    n, least = F.count("*").over(by), F.min("number").over(by)
    enough = F.when(F.col("kind") == "numbered section", (n >= 3) & (least <= 2)).otherwise(n >= 2)
    rank = F.array_position(F.array(*map(F.lit, METHODS)), F.col("kind"))
    rows = chain.withColumn("enough", enough).where("enough").withColumn("rank", rank)
    return rows.withColumn("best", F.min("rank").over(Window.partitionBy("doc_key"))).where("rank = best").select(
        "doc_key", F.col("kind").alias("method"), "start", "label", "key", "number"
    )


LATEX_HEADING = r"(?d)^[ \t]*\\(chapter|section)\*?\{([^\r\n]+)\}[ \t]*\r?$"


def latex_headings(texts: DataFrame) -> DataFrame:
    """doc_key, start, label, key, kind: chapter marks, or section marks without any."""
    before = Window.partitionBy("doc_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # only line feeds part lines here
    rows = texts.select("doc_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "doc_key", "line", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start")
    )
    argument = F.regexp_extract("line", LATEX_HEADING, 2)
    marks = (
        rows.where(F.col("line").rlike(LATEX_HEADING) & latex.balanced_argument(argument))
        .select(
            "doc_key", "start", titles.squeezed(latex.unescape_text(argument)).alias("label"),
            F.regexp_extract("line", LATEX_HEADING, 1).alias("mark"),
        )
        .where("label != ''")
    )
    outer = F.min("mark").over(Window.partitionBy("doc_key"))
    chosen = marks.withColumn("outer", outer).where("mark = outer").select(
        "doc_key", "start", "label",
        F.coalesce(F.nullif(titles.normalize_key(F.col("label")), F.lit("")), titles.folded(F.col("label"))).alias("key"),
        F.lit("LaTeX headings").alias("kind"),
        F.lit(None).cast("int").alias("number"),
    )
    return collapse_repeats(chosen).drop("number")

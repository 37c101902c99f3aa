"""Quality rules: learned decision lists over text statistics, all in DataFrame code.

Statistics are Spark expressions on the whole text. Sequential covering learns the
list from labelled documents: a rule starts empty and takes up, one at a time, the
threshold condition of greatest information gain on the growing rows (two thirds of
the labelled ones); it is then cut back to the prefix that does best on the pruning
rows; rows that it covers are set aside and the next rule is grown, until none is
precise enough. Every step is one aggregation of the labelled rows to a count per
statistic and bin; the driver sees only those counts, of a fixed size. The list
becomes an ordered conditional expression.

Defined results: null text counts as empty; without labels, or without rejected
ones among them, the list is empty and keeps everything; ties go to the statistic
and threshold that come first; labels of unknown documents are ignored, repeated
ones count as often as they occur; other columns are ignored. Words and lines are
compared inside a row by sorting hashes, so a text costs n log n, and no text's
parts are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_COVERED = 5
MIN_PRECISION = 0.85


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str) -> str:
    """SQL: words inside three-word windows that occur twice or more in the array.

    Windows become 64-bit hashes; hash and position are packed into one integer
    (as many position bits as the text needs) and sorted, which brings equal windows
    together; neighbours are then compared by their whole hashes.
    """
    spread = (
        "aggregate(transform(s, (x, j) -> if(j = size(s) - 1, 3L, least(3L, s[j + 1] - x))), 0L, (a, x) -> a + x)"
    )
    mask = "(shiftleft(1L, length(bin(size(h)))) - 1)"
    same = "get(h, cast(x & {m} as int)) = get(h, cast(get(p, j {d} 1) & {m} as int))"
    repeated = (
        f"filter(p, (x, j) -> coalesce({same.format(m=mask, d='-')}, false)"
        f" or coalesce({same.format(m=mask, d='+')}, false))"
    )
    positions = f"sort_array(transform({repeated}, x -> x & {mask}))"
    packed = "sort_array(transform(h, (x, i) -> shiftleft(x, length(bin(size(h)))) | cast(i as bigint)))"
    counted = let(packed, "p", let(positions, "s", spread))
    hashes = "transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"
    some = let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0L, {counted})")
    return let(words, "w", f"if(size(w) < 4, 0L, {some})")


def gone(text: str, characters: str) -> Column:
    """How many of ``characters`` a text has."""
    return (F.length(text) - F.length(F.translate(F.col(text), characters, ""))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("ws", common.words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        (F.length("t") - gone("t", common.BLANKS)).cast("long").alias("word_chars"),
        gone("t", SYMBOLS).alias("n_symbols"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
        F.expr(repeated_words("ws")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"),
        gone("t", "!?").alias("n_marks"),
        gone("t", "0123456789").alias("n_digits"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )


def ratios() -> dict[str, Column]:
    """What rules may test, of the columns of ``statistics``."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "marks": F.col("n_marks") / words,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "repeats": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct") / words,
        "dup_lines": F.col("n_dup_lines") / words,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.name]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:g}"


def _all(conditions, values) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(values)
    return out


def learn(labelled: DataFrame, names: list[str]) -> list[tuple[Condition, ...]]:
    """Rules that reject, in order. ``labelled``: a double per name, bad (boolean), fold
    (0: pruning rows)."""
    values = {n: F.col(n) for n in names}
    marks = labelled.agg(
        F.count_if("bad").alias("bad"),
        *[
            F.percentile_approx(F.when(rows, F.col(n)), [k / BINS for k in range(step, BINS, step)], 10_000).alias(f"{n}_{k}")
            for n in names
            # finer where a statistic is rarely above 0, and among what is to be rejected
            for k, (rows, step) in enumerate(((F.lit(True), 1), (F.col(n) > 0, 4), (F.col("bad"), 4)))
        ],
    ).first()
    if not marks["bad"]:
        return []
    thresholds = {n: sorted({t for k in range(3) for t in marks[f"{n}_{k}"] or []}) for n in names}
    bins = F.array(*[
        F.struct(
            F.lit(k).alias("name"),
            sum((F.when(values[n] >= t, 1).otherwise(0) for t in thresholds[n]), F.lit(0)).alias("bin"),
        )
        for k, n in enumerate(names)
    ])
    table = common.stage(labelled.select(*names, "bad", "fold", bins.alias("bins")), "rules-labelled")
    rules: list[tuple[Condition, ...]] = []
    free = F.lit(True)
    while len(rules) < MAX_RULES:
        rule = _grow(table.where(free & (F.col("fold") > 0)), names, thresholds, values)
        rule = rule and _prune(table.where(free & (F.col("fold") == 0)), rule, values)
        if not rule:
            return rules
        rules.append(rule)
        free = free & ~_all(rule, values)
    return rules


def _grow(rows: DataFrame, names, thresholds, values) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MAX_CONDITIONS:
        counted = (
            rows.where(_all(rule, values))
            .select("bad", F.explode("bins").alias("b"))
            .groupBy("b.name", "b.bin")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        cells = {(r["name"], r["bin"]): (r["p"], r["n"]) for r in counted}
        all_p = sum(p for (k, _), (p, _n) in cells.items() if k == 0)
        all_n = sum(n for (k, _), (_p, n) in cells.items() if k == 0)
        if not all_p or not all_n:
            break
        before, best = math.log2(all_p / (all_p + all_n)), (0.0, None)
        for k, name in enumerate(names):
            below_p = below_n = 0
            for j, t in enumerate(thresholds[name]):
                p, n = cells.get((k, j), (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for at_least, p, n in (
                    (True, all_p - below_p, all_n - below_n),
                    (False, below_p, below_n),
                ):
                    if p >= MIN_COVERED:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(name, at_least, float(t))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule, values) -> tuple[Condition, ...] | None:
    """The prefix with the best (p - n) / (p + n) on ``rows``, if it is precise enough."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(rule[:k], values)
        sums += [F.count_if(hit & F.col("bad")).alias(f"p{k}"), F.count_if(hit & ~F.col("bad")).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    best = (-2.0, None)
    for k in range(1, len(rule) + 1):
        p, n = row[f"p{k}"], row[f"n{k}"]
        worth = (p - n) / (p + n) if p + n else -1.0
        if p and p / (p + n) >= MIN_PRECISION and worth > best[0] + 1e-9:
            best = worth, rule[:k]
    return best[1]


def verdict(rules, values: dict[str, Column]) -> Column:
    """The list as one conditional expression: false where a rule rejects."""
    out = None
    for rule in rules:
        hit = _all(rule, values)
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every document with base_failed and kept. labels: doc_id, quality (1: good)."""
    counts = common.stage(statistics(docs, id_col, text_col), "rules-counts")
    values = ratios()
    marked = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad")).where(
        "bad IS NOT NULL"
    )
    labelled = counts.join(marked, F.col("doc_id") == F.col("label_id")).select(
        *[v.alias(n) for n, v in values.items()],
        "bad",
        (F.crc32(common.key_text("doc_id").cast("binary")) % 3).alias("fold"),
    )
    rules = learn(labelled, list(values))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules, values))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

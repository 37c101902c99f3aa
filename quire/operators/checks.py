"""Static checks and statistics of generated LaTeX sources."""

from __future__ import annotations

import bisect
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex, mathtext

EXAMPLES = 4
#: Commands that the generated sources may use.
KNOWN = frozenset("""
chapter section subsection paragraph textbf emph text operatorname
frac binom sqrt sum prod int bigcup bigcap cdot cdots ldots vdots ddots
leq geq neq approx equiv infty to in notin subset supset subseteq supseteq
cup cap emptyset partial nabla sim backsim cong times div pm mp
alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda
mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega
Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega
ell Re Im left right big Big bigg Bigg langle rangle mid setminus
sin cos tan arcsin arccos arctan sinh cosh tanh log ln exp max min sup inf
lim det gcd bmod pmod
begin end item label ref cite footnote
quad qquad hspace vspace medskip bigskip smallskip noindent indent
textasciitilde textasciicircum textbackslash textcent copyright square
blacksquare neg forall exists Rightarrow Longleftrightarrow leftrightarrow
leftarrow rightarrow circ bullet star ast dots
figureplaceholder documentclass usepackage newcommand setcounter
frontmatter mainmatter backmatter appendix
title author date maketitle tableofcontents include input
parbox fbox centering itshape linewidth not
""".split())
#: Issues that keep a source from being typeset.
FATAL = (
    "unbalanced brace", "unclosed braces at EOF", "stray \\end", "mismatched environment", "unclosed environment",
    "odd $ count in paragraph", "left/right mismatch",
)
_COMMAND = r"\\([A-Za-z]+)"


def issue_counts(text: Column) -> dict[str, Column]:
    """Issues that expressions can count, by kind."""
    state = latex.brace_state(text)
    left, right = (F.regexp_count(text, F.lit(rf"\\{side}(?![A-Za-z])")) for side in ("left", "right"))
    odd = F.filter(F.split(text, "\n\n"), lambda p: F.regexp_count(p, F.lit(r"(?<!\\)\$")) % 2 == 1)
    return {
        "undecoded control char": F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
        "unbalanced brace": F.greatest(F.lit(0), -state["lowest"]),
        "unclosed braces at EOF": (state["depth"] > F.least(F.lit(0), state["lowest"])).cast("int"),
        "odd $ count in paragraph": F.size(odd),
        "empty maths": F.regexp_count(text, F.lit(r"\$[ \t]*\$")),
        "left/right mismatch": (left != right).cast("int"),
    }


def counted_issues(sources: DataFrame) -> DataFrame:
    """doc_key, kind, n: the issues of ``issue_counts`` that a source has."""
    counts = issue_counts(F.col("text"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in counts.items()])
    return sources.select("doc_key", F.explode(pairs).alias("i")).select("doc_key", "i.*").where("n > 0")


def unknown_commands(sources: DataFrame, known=KNOWN) -> DataFrame:
    """doc_key, kind, n: commands that no source should use, a kind each."""
    names = F.regexp_extract_all("text", F.lit(_COMMAND), F.lit(1))
    return (
        sources.select("doc_key", F.explode(names).alias("name")).where(~F.col("name").isin(*sorted(known)))
        .groupBy("doc_key", F.concat(F.lit("unknown command \\"), "name").alias("kind"))
        .agg(F.count("*").alias("n"))
    )


def nested_issues(text: str) -> list[tuple[str, int]]:
    """Issues of what nests, and where: environments, and scripts that repeat on a base."""
    found, waiting = [], []
    for m in re.finditer(r"\\(begin|end)\{([^}]*)\}", text):
        if m[1] == "begin":
            waiting.append((m[2], m.start()))
        elif not waiting:
            found.append(("stray \\end", m.start()))
        elif waiting.pop()[0] != m[2]:
            found.append(("mismatched environment", m.start()))
    found += [("unclosed environment", at) for _, at in waiting]
    kinds = {"_": "double subscript", "^": "double superscript"}
    return found + [(kinds[mark], at) for mark, at in mathtext.double_scripts(text)]


def nested_counts(sources: DataFrame) -> DataFrame:
    """doc_key, kind, n, lines: issues of what nests, with the lines of the first few."""

    def scan(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_key"].tolist(), batch["text"].tolist(), strict=True):
                text = text or ""
                feeds = [m.start() for m in re.finditer("\n", text)]
                kinds: dict[str, list[int]] = {}
                for kind, at in nested_issues(text):
                    kinds.setdefault(kind, []).append(bisect.bisect_left(feeds, at) + 1)
                out += [(key, kind, len(at), sorted(at)[:EXAMPLES]) for kind, at in kinds.items()]
            yield pd.DataFrame(out, columns=["doc_key", "kind", "n", "lines"])

    # keys travel as text, which pandas leaves as it is, null or not
    kind = dict(sources.dtypes)["doc_key"]
    return (
        sources.select(F.col("doc_key").cast("string"), "text")
        .mapInPandas(scan, "doc_key string, kind string, n long, lines array<int>")
        .withColumn("doc_key", F.col("doc_key").cast(kind))
    )


def issues(sources: DataFrame) -> DataFrame:
    """doc_key, kind, n: a row for every kind of issue that a source has."""
    return (
        counted_issues(sources).unionByName(unknown_commands(sources))
        .unionByName(nested_counts(sources).drop("lines"))
    )


def fatal_issues(found: DataFrame) -> DataFrame:
    """Issues, of ``issues``, that keep a source from being typeset."""
    return found.where(F.col("kind").isin(*FATAL))


def issue_totals(found: DataFrame) -> DataFrame:
    """kind, n, examples: all kinds over all sources, the most frequent first, with a few keys."""
    few = F.collect_list("doc_key")
    first = found.groupBy("kind", "doc_key").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("kind").orderBy("doc_key"))
    sums = first.groupBy("kind").agg(F.sum("n").alias("n"))
    keys = first.withColumn("r", rank).where(f"r <= {EXAMPLES}").groupBy("kind").agg(F.sort_array(few).alias("examples"))
    return sums.join(keys, "kind").orderBy(F.desc("n"), "kind")


def statistics(sources: DataFrame, by: str = "doc_key") -> DataFrame:
    """Bytes, words and garbled words per source, and a total row with a null key."""
    text = F.col("text")
    return (
        sources.select(
            by, F.octet_length(text).cast("long").alias("b"), latex.word_count(text).alias("w"),
            latex.garbled_words(text).alias("g"),
        )
        .rollup(by)
        .agg(F.sum("b").alias("bytes"), F.sum("w").alias("words"), F.sum("g").alias("garbled"))
        .select(by, "bytes", "words", "garbled", F.round(100.0 * F.col("garbled") / F.greatest("words", F.lit(1)), 2).alias("percent"))
    )


#: Symbols whose counts tell whether a text kept its mathematics.
DIAGNOSIS = {"structural": "∑∏∫√", "greek": "λσμθαβγπωδερτφχψΓΔΣΠΩΘΦΛ", "relations": "≤≥≠≈∞∈∪∩⊂"}


def diagnose(sources: DataFrame) -> DataFrame:
    """doc_key, structural, greek, relations, verdict: 'unusable' without any of the first two."""
    counts = {k: F.regexp_count("text", F.lit(f"[{p}]")).cast("long") for k, p in DIAGNOSIS.items()}
    return sources.select("doc_key", *[c.alias(k) for k, c in counts.items()]).withColumn(
        "verdict", F.when((F.col("structural") == 0) & (F.col("greek") == 0), "unusable").otherwise("usable")
    )


def character_blocks(glyphs: DataFrame) -> DataFrame:
    """block, n, distinct: how many characters there are of each block, which is the first word
    of a character's name; each distinct character is looked up once."""

    def name(batches):
        for batch in batches:
            blocks = [unicodedata.name(c, "UNNAMED").split()[0] for c in batch["text"].tolist()]
            yield pd.DataFrame({"n": batch["n"], "block": blocks})

    single = glyphs.where(F.length("text") == 1).groupBy("text").agg(F.count("*").alias("n"))
    return single.mapInPandas(name, "n long, block string").groupBy("block").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct")
    )


#: Parts of the names of fonts that carry mathematics.
MATH_FONT_HINTS = ("MT", "Math", "Cambria", "CM", "wasy", "MSAM", "MSBM", "Symbol", "Optr", "Allphf", "Pearson")


def font_report(glyphs: DataFrame, hints=MATH_FONT_HINTS) -> DataFrame:
    """doc_key, font, n, distinct: glyphs set in fonts of mathematics, and their characters."""
    font = F.substring_index("font", "+", -1)
    hit = F.lit(False)
    for h in hints:
        hit = hit | font.contains(h)
    return (
        glyphs.where(hit & (F.btrim("text") != "")).groupBy("doc_key", font.alias("font"))
        .agg(F.count("*").alias("n"), F.count_distinct("text").alias("distinct"))
    )

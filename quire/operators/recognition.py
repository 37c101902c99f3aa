"""Recognised pages: which pages need it, on which device, and their text from recognised rows.

Recognition itself is an outside model. Its rows (doc_key, page_idx, pos, type, text, line_number)
become pages here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import latex

#: Letters and digits that an embedded text must have to be used.
LEAST_EMBEDDED = 40
#: Kinds of formulas and what stands around them.
FORMULAS = {"embedding": (r"\(", r"\)"), "isolated": ("\\[\n", "\n\\]")}
PROVIDERS = {"coreml": "CoreMLExecutionProvider", "cuda": "CUDAExecutionProvider", "cpu": "CPUExecutionProvider"}
MODES = ("auto", "text", "vision", "math")


def page_method(text: Column, mode: str = "auto") -> Column:
    """How a page is read: 'embedded' if its own text will do, else 'pix2text' in mode 'math', else
    'vision'."""
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    if mode == "math":
        return F.lit("pix2text")
    enough = F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")), F.lit(0)) >= LEAST_EMBEDDED
    return F.when(F.lit(mode == "text") | (F.lit(mode == "auto") & enough), "embedded").otherwise("vision")


def recognised_pages(rows: DataFrame) -> DataFrame:
    """doc_key, page_idx, text: prose escaped, formulas as they are between their delimiters; rows
    of a line with a blank between them, lines in order. Rows of an unknown kind are prose."""
    text = latex.escape_text(F.coalesce("text", F.lit("")))
    for kind, (before, after) in FORMULAS.items():
        text = F.when(F.col("type") == kind, F.concat(F.lit(before), F.coalesce("text", F.lit("")), F.lit(after))).otherwise(text)
    joined = lambda name, by, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, name))), lambda x: x[name]), sep)
    lines = rows.withColumn("part", text).groupBy("doc_key", "page_idx", "line_number").agg(joined("part", "pos", " ").alias("line"))
    return lines.groupBy("doc_key", "page_idx").agg(joined("line", "line_number", "\n").alias("text"))


def resolve_backend(requested: str, providers: Sequence[str], cuda_works: bool) -> str:
    """The backend that a recogniser uses: the requested one, which must be there, or the best."""
    usable = [b for b, p in PROVIDERS.items() if p in providers and (b != "cuda" or cuda_works)]
    if requested == "auto":
        return usable[0] if usable else "cpu"
    wanted = requested if requested != "gpu" else next((b for b in usable if b != "cpu"), "gpu")
    if wanted != "cpu" and wanted not in usable:
        raise RuntimeError(f"no provider for {requested} is installed; choose the device cpu")
    return wanted


def resolve_device(requested: str, cuda_works: bool) -> str:
    """'cuda' or 'cpu'. A device that was asked for by name must work."""
    if requested not in ("auto", "cpu", "cuda", "gpu"):
        raise ValueError(f"unknown device {requested}")
    if requested in ("cuda", "gpu") and not cuda_works:
        raise RuntimeError("CUDA was asked for and does not work here")
    return "cpu" if requested == "cpu" or not cuda_works else "cuda"

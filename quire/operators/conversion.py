"""Conversion runs as tables: entries, page caches, gates, routes, publication.

An entry is a row (doc_key, route, fingerprint, extracted, split, split_settings, method, outputs,
pending, error): what is known of one document on one route. ``outputs`` and ``pending`` are arrays
of (file, sha256, heading, characters). Fingerprints and settings are maps, so that whatever
would change a result is compared as a whole. Every step takes tables and returns the next state;
writing that state, and files, is left to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import checks, headings, pages, state

OUTPUT = "array<struct<file:string,sha256:string,heading:string,characters:bigint>>"
ENTRY = (
    "doc_key {key}, route string, fingerprint map<string,string>, extracted boolean, split boolean, "
    f"split_settings map<string,string>, method string, outputs {OUTPUT}, pending {OUTPUT}, error string"
)
VERSIONS = {"traditional": "3", "pdf2tex": "2"}
SPLITTER_VERSION = "1"


def same_map(a: Column, b: Column) -> Column:
    """Maps with the same entries; null equals null only."""
    entries = lambda c: F.array_sort(F.map_entries(c))
    return entries(a).eqNullSafe(entries(b))


def fingerprint(sha256: Column, route: str, **settings: str) -> Column:
    """What must hold for a document's cached pages to be valid."""
    fixed = {"version": VERSIONS[route], "converter": route} | settings
    return F.create_map(F.lit("sha256"), sha256, *[F.lit(x) for pair in sorted(fixed.items()) for x in pair])


def settings_for(minimum: int, **extra: str) -> Column:
    """What would change the chapters made of the same pages."""
    fixed = {"version": SPLITTER_VERSION, "minimum": str(minimum)} | extra
    return F.create_map(*[F.lit(x) for pair in sorted(fixed.items()) for x in pair])


def fresh_entries(documents: DataFrame, entries: DataFrame, route: str, wanted: Column, force: bool = False) -> DataFrame:
    """The entries with which a run of ``documents`` (doc_key, sha256) begins: those whose
    fingerprint is still ``wanted`` go on, others start anew but keep what they published."""
    own = entries.where(F.col("route") == route)
    joined = documents.select("doc_key", wanted.alias("_wanted")).join(own, "doc_key", "left")
    keep = same_map(F.col("fingerprint"), F.col("_wanted")) & F.lit(not force)
    none = F.array().cast(OUTPUT)
    return joined.select(
        "doc_key", F.lit(route).alias("route"), F.col("_wanted").alias("fingerprint"),
        (keep & F.col("extracted")).alias("extracted"), (keep & F.col("split")).alias("split"),
        F.when(keep, F.col("split_settings")).alias("split_settings"), F.when(keep, F.col("method")).alias("method"),
        F.coalesce("outputs", none).alias("outputs"), F.coalesce("pending", none).alias("pending"),
        F.lit(None).cast("string").alias("error"), (~keep).alias("reset"),
    ).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("extracted", "split")})


def valid_pages(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Cached pages that may be used again: their entry was not reset and their text is what
    was stored. ``cache``: doc_key, route, page_idx, text, sha256, method."""
    kept = entries.where("NOT reset").select("doc_key", "route")
    return cache.join(kept, ["doc_key", "route"]).where(F.sha2("text", 256) == F.col("sha256"))


def missing_pages(counts: DataFrame, valid: DataFrame) -> DataFrame:
    """doc_key, page_idx of pages to convert. ``counts``: doc_key, n_pages."""
    every = counts.where("n_pages > 0").select(
        "doc_key", F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)).alias("page_idx")
    )
    return every.join(valid.select("doc_key", "page_idx"), ["doc_key", "page_idx"], "left_anti")


def stored_pages(converted: DataFrame, route: str) -> DataFrame:
    """Converted pages (doc_key, page_idx, text, method) as rows of the cache."""
    return converted.select(
        "doc_key", F.lit(route).alias("route"), "page_idx", "text", F.sha2("text", 256).alias("sha256"), "method"
    )


def begin_extraction(entries: DataFrame, touched: DataFrame) -> DataFrame:
    """Entries of documents (doc_key) whose pages are about to change are neither extracted
    nor split any more."""
    hit = entries.join(touched.select("doc_key").distinct().withColumn("_hit", F.lit(True)), "doc_key", "left")
    still = F.col("_hit").isNull()
    return hit.withColumns({c: F.col(c) & still for c in ("extracted", "split")}).drop("_hit")


def finish_extraction(entries: DataFrame, done: DataFrame) -> DataFrame:
    hit = entries.join(done.select("doc_key").distinct().withColumn("_hit", F.lit(True)), "doc_key", "left")
    return hit.withColumn("extracted", F.col("extracted") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def begin_publication(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """Entries that know all files that they have written or may write from now on: intent is
    recorded before files change. ``planned``: doc_key, outputs."""
    new = planned.select("doc_key", F.col("outputs").alias("_planned"))
    joined = entries.join(new, "doc_key", "left")
    hit = F.col("_planned").isNotNull()
    return joined.withColumn(
        "pending", F.when(hit, F.concat("outputs", "pending", "_planned")).otherwise(F.col("pending"))
    ).withColumn("split", F.col("split") & ~hit).drop("_planned")


def supersede(entries: DataFrame, route: str) -> DataFrame:
    """Entries of ``route`` also answer for what the other routes have published of the same
    documents, and those give it up: all routes write into one namespace."""
    files = F.concat("outputs", "pending")
    others = entries.where(F.col("route") != route).groupBy("doc_key").agg(
        F.flatten(F.collect_list(files)).alias("_files")
    )
    ours = entries.where(F.col("route") == route).select("doc_key").withColumn("_ours", F.lit(True))
    own = F.col("route") == route
    rows = entries.join(others, "doc_key", "left").join(ours, "doc_key", "left")
    gone = ~own & F.col("_ours").isNotNull()
    none = F.array().cast(OUTPUT)
    taken = F.concat("pending", F.coalesce("_files", none))
    return rows.withColumn("pending", F.when(own, taken).when(gone, none).otherwise(F.col("pending"))).withColumn(
        "outputs", F.when(gone, none).otherwise(F.col("outputs"))
    ).withColumn("split", F.col("split") & ~gone).drop("_files", "_ours")


def leftovers(entries: DataFrame, planned: DataFrame, on_disk: DataFrame) -> DataFrame:
    """file, sha256: files of earlier runs that the plan lacks and that are as they were
    written; edited ones are somebody's own. ``on_disk``: file, sha256."""
    old = entries.join(planned.select("doc_key"), "doc_key").select(F.explode(F.concat("outputs", "pending")).alias("o")).select(
        "o.file", "o.sha256"
    ).distinct()
    now = planned.select(F.explode("outputs").alias("o")).select("o.file").distinct()
    return old.join(now, "file", "left_anti").join(on_disk.select("file", "sha256").distinct(), ["file", "sha256"], "left_semi")


def finish_publication(entries: DataFrame, planned: DataFrame, settings: Column) -> DataFrame:
    """``planned``: doc_key, outputs, method."""
    new = planned.select("doc_key", F.col("outputs").alias("_outputs"), F.col("method").alias("_method"))
    joined = entries.join(new, "doc_key", "left")
    hit = F.col("_outputs").isNotNull()
    none = F.array().cast(OUTPUT)
    return joined.select(
        "doc_key", "route", "fingerprint", "extracted", (F.col("split") | hit).alias("split"),
        F.when(hit, settings).otherwise(F.col("split_settings")).alias("split_settings"),
        F.when(hit, F.col("_method")).otherwise(F.col("method")).alias("method"),
        F.when(hit, F.col("_outputs")).otherwise(F.col("outputs")).alias("outputs"),
        F.when(hit, none).otherwise(F.col("pending")).alias("pending"), "error",
    )


def record_errors(entries: DataFrame, errors: DataFrame) -> DataFrame:
    """Entries with the messages of ``errors`` (doc_key, route, message); those are not split."""
    joined = entries.join(errors.select("doc_key", "route", F.col("message").alias("_m")), ["doc_key", "route"], "left")
    return joined.withColumn("error", F.coalesce("_m", "error")).withColumn(
        "split", F.col("split") & F.col("_m").isNull()
    ).drop("_m")


def intact(outputs: DataFrame, on_disk: DataFrame) -> DataFrame:
    """doc_key, route, valid: whether every output of an entry is on disk unchanged."""
    files = outputs.select("doc_key", "route", F.explode("outputs").alias("o")).select("doc_key", "route", "o.file", "o.sha256")
    disk = on_disk.select("file", F.col("sha256").alias("_found"))
    return files.join(disk, "file", "left").groupBy("doc_key", "route").agg(
        F.bool_and(F.coalesce(F.col("sha256") == F.col("_found"), F.lit(False))).alias("valid")
    )


def completed(documents: DataFrame, entries: DataFrame, on_disk: DataFrame, wanted: dict[str, Column], settings: Column) -> DataFrame:
    """doc_key, route: documents (doc_key, sha256) that a route, the first that has, published
    with these fingerprints and settings, and whose files are intact."""
    match = F.lit(False)
    for route, print_ in wanted.items():
        match = match | ((F.col("route") == route) & same_map(F.col("fingerprint"), print_))
    good = (
        documents.select("doc_key", "sha256").join(entries, "doc_key")
        .where("split AND error IS NULL AND size(pending) = 0 AND size(outputs) > 0")
        .where(match & same_map(F.col("split_settings"), settings))
        .join(intact(entries, on_disk).where("valid"), ["doc_key", "route"], "left_semi")
    )
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("route"))
    return good.groupBy("doc_key").agg(F.min_by("route", rank).alias("route"))


def text_layer_errors(converted: DataFrame) -> DataFrame:
    """doc_key, message: why the text layer of a document cannot be used. ``converted``:
    doc_key, page_idx, text, method; documents without a row here are fit."""
    gates = pages.gates(converted).where("status != 'accepted'").select("doc_key", F.col("status").alias("message"), F.lit(0).alias("rank"))
    body = pages.joined_text(converted)
    counted = checks.fatal_issues(checks.issues(body)).groupBy("doc_key").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))), 1, 4).alias("worst")
    )
    listed = F.array_join(F.transform("worst", lambda w: F.concat(w["kind"], F.lit("="), (-w["n"]).cast("string"))), ", ")
    fatal = counted.select(
        "doc_key", F.concat(F.lit("generated LaTeX would not compile: "), listed).alias("message"), F.lit(1).alias("rank")
    )
    return gates.unionByName(fatal).groupBy("doc_key").agg(F.min_by("message", "rank").alias("message"))


def outcomes(documents: DataFrame, done: DataFrame, errors: dict[str, DataFrame], enabled: Sequence[str] = state.ROUTES) -> DataFrame:
    """doc_key, status, and <route>_error: every document ends as skipped, as the first enabled
    route without an error, or as failed. ``done``: doc_key, route; ``errors``: by route,
    doc_key, message. A route after one that succeeded is not tried, and has no error."""
    rows = documents.select("doc_key").join(done.select("doc_key").withColumn("_done", F.lit(True)), "doc_key", "left")
    for route in enabled:
        rows = rows.join(errors[route].select("doc_key", F.col("message").alias(f"_{route}")), "doc_key", "left")
    status, open_ = F.when(F.col("_done"), "skipped"), F.col("_done").isNull()
    told = {}
    for route in enabled:
        told[route] = F.when(open_, F.col(f"_{route}"))
        status = status.when(F.col(f"_{route}").isNull(), route)
        open_ = open_ & F.col(f"_{route}").isNotNull()
    return rows.select("doc_key", status.otherwise("failed").alias("status"), *[m.alias(f"{r}_error") for r, m in told.items()])


def failure_lines(found: DataFrame, enabled: Sequence[str] = state.ROUTES) -> DataFrame:
    """doc_key, route, line: the last line of each message of documents that failed."""
    pairs = F.array(*[F.struct(F.lit(r).alias("route"), F.col(f"{r}_error").alias("message")) for r in enabled])
    return found.where("status = 'failed'").select("doc_key", F.explode(pairs).alias("p")).where("p.message IS NOT NULL").select(
        "doc_key", "p.route", F.element_at(F.split(F.rtrim("p.message"), r"\r?\n"), -1).alias("line")
    )


def headings_from_text(found: DataFrame, converted: DataFrame, minimum: int = headings.MINIMUM) -> DataFrame:
    """doc_key, method, start, label: an outline's bookmarks (``found``) where a document has
    them, else what its prose shows."""
    return _first(found, headings.detect_structure(pages.joined_text(converted), minimum))


def headings_from_latex(found: DataFrame, converted: DataFrame) -> DataFrame:
    """doc_key, method, start, label: bookmarks, else two or more marks in the LaTeX; a document
    with neither stays whole, whatever its prose looks like."""
    marks = headings.latex_headings(pages.joined_text(converted))
    many = marks.groupBy("doc_key").agg(F.count("*").alias("n")).where("n >= 2").select("doc_key")
    return _first(found, marks.join(many, "doc_key", "left_semi").withColumn("method", F.lit("LaTeX headings")))


def _first(marked: DataFrame, others: DataFrame) -> DataFrame:
    own = marked.select("doc_key", F.lit("PDF bookmarks").alias("method"), "start", "label")
    rest = others.join(marked.select("doc_key").distinct(), "doc_key", "left_anti")
    return own.unionByName(rest.select("doc_key", "method", "start", "label"))

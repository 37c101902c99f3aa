"""A conversion run: document files in, chapters, catalog and restartable state out.

Decoding, segmentation, gates, headings and rendering are tables; chapters are written by the tasks
that render them, to a folder that all tasks reach. The state of a run is a set of tables in the work
folder that a small record points to; the record is replaced only once the tables are whole, and
intent is recorded before the first file changes, so a run that stops anywhere can be repeated.
"""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import dataclass, replace

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import latex
from quire.operators import conversion, pages, segment, state
from quire.sources import files

VERSION = "2"
CATALOG_NAME = "catalog.tsv"
CACHE = "doc_key string, route string, page_idx int, text string, sha256 string, method string"
INFO = "doc_key string, title string, author string, outline array<struct<level:int,title:string,page:int>>"


@dataclass(frozen=True)
class Options:
    source: str
    destination: str
    work: str
    minimum: int = 3000
    force: bool = False
    traditional_only: bool = False
    pdf2tex_only: bool = False

    @property
    def routes(self) -> tuple[str, ...]:
        off = {"pdf2tex"} if self.traditional_only else {"traditional"} if self.pdf2tex_only else set()
        return tuple(r for r in state.ROUTES if r not in off)


class Store:
    """The tables of a run in its work folder. A record of another run's folders, or one that
    cannot be read, counts as none."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.folder = spark, options.work.rstrip("/")
        self.identity = {"version": VERSION, "source": options.source, "destination": options.destination}
        self.tables: dict[str, str] = {}
        try:
            kept = json.loads(_read(f"{self.folder}/run.json"))
            if isinstance(kept, dict) and kept.get("identity") == self.identity:
                self.tables = dict(kept["tables"])
        except (OSError, ValueError, KeyError, TypeError):
            pass

    def get(self, name: str, schema: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.tables[name])

    def save(self, **tables: DataFrame) -> None:
        """Write tables anew, and then the record that points to them."""
        for name, df in tables.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            self.tables[name] = path
        record = {"identity": self.identity, "tables": self.tables}
        files.atomic_write(f"{self.folder}/run.json", json.dumps(record, indent=2, ensure_ascii=False) + "\n")


def _read(path: str) -> str:
    store, base = files.open_store(path)
    with store.open_input_file(base) as f:
        return f.read().decode()


def on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """file, sha256 of what is below a folder; nothing if it does not exist."""
    store, base = files.open_store(folder)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return spark.createDataFrame([], "file string, sha256 string")
    return files.find_documents(spark, folder, (), ".tex").select(F.col("relative").alias("file"), "sha256")


def document_info(documents: DataFrame, reader) -> DataFrame:
    """``INFO`` of documents: what ``reader.info(content)`` says of them, where it can be said."""

    def look(batches):
        for batch in batches:
            out = []
            for key, content in zip(batch["relative"], batch["content"], strict=True):
                try:
                    found = reader.info(content)
                except Exception:  # noqa: BLE001  a document without metadata is still one
                    found = {}
                outline = [dict(zip(("level", "title", "page"), x, strict=True)) for x in found.get("outline", ())]
                out.append((key, found.get("title"), found.get("author"), outline))
            yield pd.DataFrame(out, columns=["doc_key", "title", "author", "outline"])

    return documents.select("relative", "content").mapInPandas(look, INFO)


class InstalledReader:
    """Reads documents by an optional native decoder."""

    @staticmethod
    def pages(content: bytes):
        return files.installed_reader(content)

    @staticmethod
    def info(content: bytes) -> dict:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            own = doc.metadata or {}
            return {"title": own.get("title"), "author": own.get("author"), "outline": doc.get_toc()}


def write_outputs(outputs: DataFrame, folder: str) -> DataFrame:
    """doc_key, file, action of every output, written by the task that holds it; files that are
    right already are kept."""

    def write(batches):
        import hashlib

        store, base = files.open_store(folder)
        for batch in batches:
            done = []
            for key, name, sha256, content in zip(*(batch[c] for c in ("doc_key", "file", "sha256", "content")), strict=True):
                path, action = f"{base.rstrip('/')}/{name}", "write"
                if store.get_file_info(path).type == fs.FileType.File:
                    with store.open_input_file(path) as f:
                        if hashlib.sha256(f.read()).hexdigest() == sha256:
                            action = "keep"
                if action == "write":
                    files.atomic_write(path, content, store)
                done.append((key, name, action))
            yield pd.DataFrame(done, columns=["doc_key", "file", "action"])

    return outputs.select("doc_key", "file", "sha256", "content").mapInPandas(write, "doc_key string, file string, action string")


class Run:
    """One run over a folder of documents. ``reader``: .pages(content) and .info(content), see
    ``files.decode_pages``; ``recogniser``: as ``reader``, for documents without a usable text
    layer, its pages' texts being prose; None if there is none."""

    def __init__(self, spark: SparkSession, options: Options, reader=InstalledReader, recogniser=None):
        self.spark, self.options, self.reader, self.recogniser = spark, options, reader, recogniser
        self.settings = conversion.settings_for(options.minimum, format="latex")

    def stage(self, df: DataFrame) -> DataFrame:
        path = f"{self.options.work.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def wanted(self) -> dict[str, Column]:
        return {r: conversion.fingerprint(F.col("sha256"), r) for r in self.options.routes}

    def extract(self, route: str, documents: DataFrame, found: DataFrame, entries: DataFrame, cache: DataFrame):
        """Pages of ``documents`` on a route, cached ones first, and errors of whole files."""
        valid = conversion.valid_pages(cache.where(F.col("route") == route), entries)
        # a document whose extraction was finished and whose pages are all there is not opened
        ready = entries.where("extracted").join(valid.select("doc_key").distinct(), "doc_key", "left_semi").select("doc_key")
        recorded = cache.where(F.col("route") == route).groupBy("doc_key").agg((F.max("page_idx") + 1).alias("n_pages"))
        broken = conversion.missing_pages(recorded, valid).select("doc_key").distinct()
        open_ = documents.select("doc_key").join(ready.join(broken, "doc_key", "left_anti"), "doc_key", "left_anti")
        content = found.join(open_.withColumnRenamed("doc_key", "relative"), "relative", "left_semi")
        reader = self.reader if route == "traditional" else self.recogniser
        decoded = self.stage(files.decode_pages(content, reader.pages))
        errors = decoded.where("page_idx < 0").select(F.col("relative").alias("doc_key"), "message")
        pages_ = decoded.where("page_idx >= 0")
        if route == "traditional":
            made = segment.page_latex(files.page_glyphs(pages_), files.page_rules(pages_))
            bare = pages_.select(F.col("relative").alias("doc_key"), "page_idx", F.lit("").alias("text"), "method")
            # a page without a glyph is empty, not lost
            whole = bare.join(made.select("doc_key", "page_idx", F.col("text").alias("t"), F.col("method").alias("m")), ["doc_key", "page_idx"], "left")
            made = whole.select(
                "doc_key", "page_idx", F.coalesce("t", "text").alias("text"),
                F.when(F.col("method") == "error", "error").otherwise(F.coalesce("m", F.lit("traditional"))).alias("method"),
            )
        else:
            made = pages_.select(F.col("relative").alias("doc_key"), "page_idx", F.coalesce("text", F.lit("")).alias("text"), "method")
        fresh = conversion.stored_pages(made, route)
        kept = valid.join(open_, "doc_key", "left_anti").select(*fresh.columns)
        return self.stage(kept.unionByName(fresh)), self.stage(errors)

    def split(self, route: str, converted: DataFrame, info: DataFrame) -> DataFrame:
        """doc_key, file, heading, characters, sha256, content, method: the chapters."""
        outline = info.select("doc_key", F.posexplode("outline").alias("pos", "o")).select("doc_key", "pos", "o.level", "o.title", "o.page")
        marks = pages.bookmark_headings(outline, converted)
        cascade = conversion.headings_from_latex(marks, converted) if route == "traditional" else conversion.headings_from_text(marks, converted, self.options.minimum)
        cascade = self.stage(cascade)
        sections = pages.build_sections(pages.joined_text(converted), cascade)
        title = files.document_title(F.col("title"), F.col("doc_key"))
        rows = sections.join(info.select("doc_key", title.alias("title"), F.coalesce("author", F.lit("")).alias("author")), "doc_key")
        source, stem = F.col("doc_key"), files.document_title(F.lit(None), F.col("doc_key"))
        folder = F.regexp_extract("doc_key", r"^(.*/)[^/]*$", 1)
        render = (
            (lambda body, source, heading: latex.book_document(heading, body, source, F.col("title"), F.col("author")))
            if route == "traditional" else latex.latex_document
        )
        planned = pages.plan_sections(rows, source, stem, render)
        method = cascade.groupBy("doc_key").agg(F.min("method").alias("method"))
        return planned.join(method, "doc_key", "left").select(
            "doc_key", F.concat(folder, "file").alias("file"), "heading", "characters", "sha256", "content",
            F.coalesce("method", F.lit("complete text")).alias("method"), "number",
        )

    def publish(self, route: str, entries: DataFrame, outputs: DataFrame, store: Store) -> DataFrame:
        """Write chapters and clean up after earlier runs; the entries afterwards."""
        records = F.transform(
            F.array_sort(F.collect_list(F.struct("number", "file", "sha256", "heading", "characters"))),
            lambda o: F.struct(o["file"], o["sha256"], o["heading"], o["characters"]),
        )
        planned = self.stage(outputs.groupBy("doc_key").agg(records.cast(conversion.OUTPUT).alias("outputs"), F.min("method").alias("method")))
        ours = entries.join(planned.select("doc_key").withColumn("route", F.lit(route)), ["doc_key", "route"], "left_semi")
        others = entries.join(planned.select("doc_key"), "doc_key", "left_semi").where(F.col("route") != route)
        begun = conversion.begin_publication(conversion.supersede(ours.unionByName(others), route).where(F.col("route") == route), planned)
        rest = entries.join(begun.select("doc_key", "route"), ["doc_key", "route"], "left_anti")
        begun = self.stage(begun)
        store.save(entries=rest.unionByName(begun))  # intent, before any file changes
        write_outputs(outputs, self.options.destination).write.format("noop").mode("overwrite").save()
        gone = conversion.leftovers(begun, planned, on_disk(self.spark, self.options.destination))
        remover, base = files.open_store(self.options.destination)
        for row in gone.toLocalIterator():
            remover.delete_file(f"{base.rstrip('/')}/{row['file']}")
        done = conversion.finish_publication(begun, planned, self.settings)
        none = F.array().cast(conversion.OUTPUT)
        superseded = rest.join(planned.select("doc_key").withColumn("_gone", F.lit(True)), "doc_key", "left")
        other = F.col("_gone").isNotNull() & (F.col("route") != route)
        superseded = superseded.withColumns({
            "split": F.col("split") & ~other, "outputs": F.when(other, none).otherwise(F.col("outputs")),
            "pending": F.when(other, none).otherwise(F.col("pending")),
        }).drop("_gone")
        return self.stage(superseded.unionByName(done))

    def __call__(self) -> DataFrame:
        """doc_key, status, errors by route, chapters: what became of every document."""
        o = self.options
        found = files.find_documents(self.spark, o.source, ())
        documents = self.stage(found.select(F.col("relative").alias("doc_key"), "sha256"))
        stems = documents.select(
            F.regexp_extract("doc_key", r"^(.*?)/?[^/]*$", 1).alias("folder"), files.document_title(F.lit(None), F.col("doc_key")).alias("stem")
        )
        if clash := state.name_collisions(stems).head(1):
            raise RuntimeError(f"output names collide; rename one of the files of {clash[0]['prefix']}")
        store = Store(self.spark, o)
        entries = store.get("entries", conversion.ENTRY.format(key="string"))
        cache = store.get("pages", CACHE)
        none = self.spark.createDataFrame([], "doc_key string, route string")
        done = none if o.force else self.stage(
            conversion.completed(documents, entries, on_disk(self.spark, o.destination), self.wanted(), self.settings)
        )
        left, errors = self.stage(documents.join(done, "doc_key", "left_anti")), {}
        for route in o.routes:
            no_reader = route == "pdf2tex" and self.recogniser is None
            if left.isEmpty() or no_reader:
                message = F.lit("no recogniser is installed")
                errors[route] = left.select("doc_key", message.alias("message"))
                continue
            own = self.stage(conversion.fresh_entries(left, entries, route, self.wanted()[route], o.force))
            converted, failed = self.extract(route, left, found, own, cache)
            cache = cache.join(own.select("doc_key", "route"), ["doc_key", "route"], "left_anti").unionByName(converted.select(*cache.columns))
            bad = conversion.text_layer_errors(converted) if route == "traditional" else failed.limit(0)
            bad = self.stage(failed.unionByName(bad.join(failed, "doc_key", "left_anti")).dropDuplicates(["doc_key"]))
            info = self.stage(document_info(
                found.join(left.select(F.col("doc_key").alias("relative")), "relative", "left_semi"),
                self.reader if route == "traditional" else self.recogniser,
            ))
            own = conversion.finish_extraction(own, converted).drop("reset")
            own = conversion.record_errors(own, bad.withColumn("route", F.lit(route)))
            entries = entries.join(own.select("doc_key", "route"), ["doc_key", "route"], "left_anti").unionByName(own)
            entries = self.stage(entries)
            cache = self.stage(cache)
            store.save(entries=entries, pages=cache)
            fit = converted.join(bad, "doc_key", "left_anti")
            outputs = self.stage(self.split(route, fit.select("doc_key", "page_idx", "text", "method"), info))
            entries = self.publish(route, entries, outputs, store)
            store.save(entries=entries)
            errors[route] = bad
            left = self.stage(left.join(bad, "doc_key", "left_semi"))
        self.catalog(entries)
        rows = conversion.outcomes(documents, done, errors, o.routes)
        count = entries.where("split").select("doc_key", F.size("outputs").alias("chapters"))
        return rows.join(count.groupBy("doc_key").agg(F.sum("chapters").alias("chapters")), "doc_key", "left").fillna(0, ["chapters"])

    def catalog(self, entries: DataFrame) -> None:
        rows = entries.where("split").select("doc_key", "route", "method", F.explode("outputs").alias("o")).select(
            F.col("doc_key").alias("source_file"), F.col("o.file").alias("section_file"), F.col("method").alias("detection_method"),
            F.col("o.heading").alias("heading"), F.col("o.characters").alias("characters"), F.col("route").alias("converter"),
        )
        files.write_catalog(rows, f"{self.options.destination.rstrip('/')}/{CATALOG_NAME}")


def report(outcomes: DataFrame, routes=state.ROUTES) -> str:
    """The summary of a run as lines of text."""
    counts = {r["status"]: (r["n"], r["c"]) for r in outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("chapters").alias("c")).collect()}
    lines = [f"documents: {sum(n for n, _ in counts.values())}", f"chapters: {sum(c for _, c in counts.values())}"]
    lines += [f"{s}: {counts.get(s, (0, 0))[0]}" for s in ("skipped", *routes, "failed")]
    for row in conversion.failure_lines(outcomes, routes).orderBy("doc_key", "route").toLocalIterator():
        lines.append(f"{row['doc_key']} ({row['route']}): {row['line']}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Convert a folder of documents to LaTeX chapters.")
    for name in ("source", "destination", "work"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--minimum", type=int, default=Options.minimum, help="least characters between chapters")
    for name in ("force", "traditional-only", "pdf2tex-only"):
        parser.add_argument(f"--{name}", action="store_true")
    options = Options(**vars(parser.parse_args(argv)))
    if options.traditional_only and options.pdf2tex_only:
        parser.error("only one route can be the only one")
    spark = SparkSession.builder.getOrCreate()
    uris = {k: v if "://" in v else f"file://{fs.LocalFileSystem().normalize_path(v)}" for k, v in (("source", options.source), ("destination", options.destination), ("work", options.work))}
    outcomes = Run(spark, replace(options, **uris))()
    print(report(outcomes, options.routes))
    return int(not outcomes.where("status = 'failed'").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())

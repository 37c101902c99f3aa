"""Restartable runs: what is done, what is stale, what to publish; jobs and names.

State is tables: outputs (doc_key, file, sha256, ...), runs (doc_key, route, sha256, ...).
Decisions are joins and windows over them; only writing files is imperative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import naming, titles

ROUTES = ("traditional", "pdf2tex")


def completed_route(documents: DataFrame, runs: DataFrame, routes=ROUTES) -> DataFrame:
    """doc_key, route: the first enabled route whose run of the same content is done.

    ``runs``: doc_key, route, sha256, done, error, valid (all its outputs are intact)."""
    rank = F.array_position(F.array(*map(F.lit, routes)), F.col("route"))
    good = runs.where("done AND error IS NULL AND valid").withColumn("rank", rank).where("rank > 0")
    return (
        documents.select("doc_key", "sha256").join(good, ["doc_key", "sha256"])
        .groupBy("doc_key").agg(F.min_by("route", "rank").alias("route"))
    )


def pending(documents: DataFrame, runs: DataFrame, routes=ROUTES) -> DataFrame:
    return documents.join(completed_route(documents, runs, routes), "doc_key", "left_anti")


def stale_outputs(previous: DataFrame, current: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Files of the previous run that the current one lacks and nobody has edited since."""
    return (
        previous.join(current, "file", "left_anti")
        .join(on_disk.select("file", F.col("sha256").alias("found")), "file")
        .where("sha256 = found")
        .select("file", "sha256")
    )


def publish_plan(current: DataFrame, previous: DataFrame, on_disk: DataFrame) -> DataFrame:
    """file, action: write, keep, delete or leave (edited by hand), for a two-phase publish."""
    disk = on_disk.select("file", F.col("sha256").alias("found"))
    now = current.select("file", "sha256").join(disk, "file", "left").select(
        "file", F.when(F.col("sha256") == F.col("found"), "keep").otherwise("write").alias("action")
    )
    gone = previous.join(current, "file", "left_anti").join(disk, "file").select(
        "file", F.when(F.col("sha256") == F.col("found"), "delete").otherwise("leave").alias("action")
    )
    return now.unionByName(gone)


def publication_matches(outputs: DataFrame, on_disk: DataFrame, recorded: DataFrame, settings: Column) -> DataFrame:
    """doc_key, matches: whether a document was split with these settings, and every output of
    it is on disk unchanged. ``recorded``: doc_key, split, split_settings (text or map)."""
    found = outputs.join(on_disk.select("file", F.col("sha256").alias("found")), "file", "left").groupBy("doc_key").agg(
        F.bool_and(F.coalesce(F.col("sha256") == F.col("found"), F.lit(False))).alias("intact")
    )
    kind = dict(recorded.dtypes)["split_settings"]
    plain = (lambda c: F.array_sort(F.map_entries(c))) if kind.startswith("map") else (lambda c: c)
    same = F.coalesce(F.col("split"), F.lit(False)) & plain(F.col("split_settings")).eqNullSafe(plain(settings))
    return recorded.join(found, "doc_key", "left").select(
        "doc_key", (same & F.coalesce("intact", F.lit(False))).alias("matches")
    )


def name_collisions(documents: DataFrame) -> DataFrame:
    """prefix, n: output names that several source files would share, case aside.

    ``documents``: folder, stem."""
    prefix = titles.folded(
        F.concat_ws("/", "folder", naming.flat_section_filename(F.col("stem"), F.lit(0), F.lit("")))
    )
    return documents.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")


def upload_names(files: DataFrame) -> DataFrame:
    """job, seq, name: a name that the job has already gets the first of _2, _3, ... before
    its extension that is free. Folders in front of a name go."""
    parts = r"^(.+?)(\.[^.]+)?$"
    base = F.element_at(F.split("name", "/"), -1)
    uploads = files.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("seq", base.alias("name")))).alias("uploads"))
    none = F.array().cast("array<string>")

    def add(taken, upload):
        stem, ext = (F.regexp_extract(upload["name"], parts, k) for k in (1, 2))
        free = F.filter(
            F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(stem, F.lit("_"), n.cast("string"), ext)),
            lambda name: ~F.array_contains(taken, name),
        )
        first = F.when(F.array_contains(taken, upload["name"]), F.get(free, F.lit(0))).otherwise(upload["name"])
        return F.array_append(taken, first)

    named = uploads.select("job", "uploads", F.aggregate("uploads", none, add).alias("names"))
    return named.select("job", F.explode(F.arrays_zip("uploads", "names")).alias("u")).select(
        "job", "u.uploads.seq", F.col("u.names").alias("name")
    )


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: unfinished ones are interrupted, discarded ones go."""
    return jobs.where("status != 'discarding'").withColumn(
        "status", F.when(F.col("status").isin("queued", "converting"), "interrupted").otherwise(F.col("status"))
    )


def newest_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("status != 'discarding'").orderBy(F.desc("created_at"), "job_id")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """status, n, characters: a run's outcomes by status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"), F.sum("characters").alias("characters"))

"""Conversion jobs as a table: loading, transitions, outputs, expiry.

A job is a row of ``JOB``. Every transition takes the table, and the ids it is about as a table
(job_id, ...), and returns the table afterwards; jobs that a transition does not fit are left alone.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTPUT = "struct<filename:string,chapter_title:string,size_bytes:bigint,sha256:string,converter:string>"
JOB = (
    "job_id string, status string, progress double, message string, files_count int, source_files array<string>, "
    f"chapters_count int, logs array<string>, outputs array<{OUTPUT}>, options map<string,string>, created_at string, "
    "completed_at string, error string"
)
ACTIVE = ("queued", "converting")
RESUMABLE = ("interrupted", "failed")
INTERRUPTED = "Conversion was interrupted. Resume to continue from the saved checkpoint."
MAX_AGE = 7200


def log_lines(text: Column) -> Column:
    """The lines of a text that say something, trimmed."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def saved(jobs: DataFrame) -> DataFrame:
    """job_id, text: what is kept of each job, as JSON."""
    return jobs.select("job_id", F.to_json(F.struct(F.lit(1).alias("version"), *jobs.columns), {"ignoreNullFields": "false"}).alias("text"))


def loaded(manifests: DataFrame) -> DataFrame:
    """Jobs from ``manifests`` (folder, text) after a restart: those that cannot be read, lack an
    id, options or a date, or lie in a folder of another name are left out, as are jobs that were
    being discarded; unfinished ones are interrupted, and say so."""
    rows = manifests.select("folder", F.from_json("text", JOB).alias("j")).where(
        "j.job_id = folder AND j.options IS NOT NULL AND j.created_at IS NOT NULL"
    ).select("j.*")
    status = F.coalesce("status", F.lit("interrupted"))
    cut = status.isin(*ACTIVE)
    none = F.array().cast("array<string>")
    outputs = F.coalesce("outputs", F.array().cast(f"array<{OUTPUT}>"))
    logs = F.coalesce("logs", none)
    return rows.where(status != "discarding").withColumns({
        "status": F.when(cut, "interrupted").otherwise(status),
        "message": F.when(cut, INTERRUPTED).otherwise(F.coalesce("message", F.lit("Recovered job"))),
        "logs": F.when(cut, F.array_append(logs, "Backend restarted before this conversion finished.")).otherwise(logs),
        "outputs": outputs, "source_files": F.coalesce("source_files", none),
        "progress": F.coalesce("progress", F.lit(0.0)), "files_count": F.coalesce("files_count", F.lit(0)),
        "chapters_count": F.coalesce("chapters_count", F.size(outputs)),
    })


def _marked(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id").distinct().withColumn("_hit", F.lit(True)), "job_id", "left")


def _changed(jobs: DataFrame, ids: DataFrame, fits: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & fits
    rows = _marked(jobs, ids).withColumn("_now", hit)
    return rows.withColumns({k: F.when(F.col("_now"), v).otherwise(F.col(k)) for k, v in changes.items()}).drop("_hit", "_now")


def resumed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Interrupted and failed jobs are queued again."""
    none = F.lit(None).cast("string")
    return _changed(jobs, ids, F.col("status").isin(*RESUMABLE), {
        "status": F.lit("queued"), "progress": F.lit(0.0), "message": F.lit("Queued to resume from the saved checkpoint..."),
        "completed_at": none, "error": none, "logs": F.array_append("logs", F.lit("Resume requested.")),
    })


def started(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return _changed(jobs, ids, F.col("status") == "queued", {
        "status": F.lit("converting"), "progress": F.lit(0.1), "message": F.lit("Starting conversion pipeline..."),
    })


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``results``: job_id, outputs, at (time as text), failure (null if it went well). Jobs that are
    being discarded stay so."""
    rows = jobs.join(results.select("job_id", F.col("outputs").alias("_o"), "at", "failure"), "job_id", "left")
    hit = F.col("at").isNotNull() & (F.col("status") == "converting")
    good = hit & F.col("failure").isNull()
    n = F.size("_o")
    said = F.concat(F.lit("Converted successfully: "), n.cast("string"), F.lit(" chapter(s) generated."))
    message = F.when(good, said).when(hit, F.concat(F.lit("Conversion failed: "), "failure")).otherwise(F.col("message"))
    return rows.withColumn("_good", good).withColumn("_hit", hit).withColumn("message", message).withColumns({
        "status": F.when(F.col("_good"), "completed").when(F.col("_hit"), "failed").otherwise(F.col("status")),
        "progress": F.when(F.col("_good"), 1.0).otherwise(F.col("progress")),
        "outputs": F.when(F.col("_good"), F.col("_o")).otherwise(F.col("outputs")),
        "chapters_count": F.when(F.col("_good"), n).otherwise(F.col("chapters_count")),
        "completed_at": F.when(F.col("_hit"), F.col("at")).otherwise(F.col("completed_at")),
        "error": F.when(F.col("_hit"), F.col("failure")).otherwise(F.col("error")),
    }).select(*jobs.columns)


def discarded(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Active jobs are marked, so that their workers stop; all others go at once."""
    marked = _changed(jobs, ids, F.col("status").isin(*ACTIVE), {
        "status": F.lit("discarding"), "message": F.lit("Discarding conversion..."),
    })
    return _marked(marked, ids).where("_hit IS NULL OR status = 'discarding'").drop("_hit")


def expired(jobs: DataFrame, now: Column, max_age: int = MAX_AGE) -> DataFrame:
    """job_id of jobs that are older than ``max_age`` seconds, fractions counted; dates that cannot
    be read never are."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").try_cast("timestamp"))
    return jobs.where(age > max_age * 1_000_000).select("job_id")


def output_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """filename, chapter_title, size_bytes, sha256, converter of chapter files (file, size, sha256),
    in order of names; title and converter from the catalog (file, title, converter) where it has
    them."""
    known = catalog.select(F.btrim("file").alias("file"), F.nullif("title", F.lit("")).alias("title"), "converter")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]+$", "")
    return files.where(F.col("file").endswith(".tex")).join(known, "file", "left").select(
        F.col("file").alias("filename"), F.coalesce("title", stem).alias("chapter_title"), F.col("size").alias("size_bytes"),
        "sha256", F.coalesce("converter", F.lit("traditional")).alias("converter"),
    ).orderBy("filename")


def accepted_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (name, ...) that are documents: a name, with the suffix in any case."""
    base = F.element_at(F.split("name", "/"), -1)
    return uploads.where((base != "") & F.lower(base).endswith(".pdf"))


def output_content(folder: str, name: str) -> str | None:
    """The text of an output file, None if there is none; a name that leads out of the folder is
    refused."""
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if not path.is_relative_to(root):
        raise PermissionError(f"{name} is not in the folder of outputs")
    return path.read_text("utf-8", errors="replace") if path.is_file() else None

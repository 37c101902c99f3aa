"""Sources and sinks: document files, page decoding, sections, catalog, archives.

Scans and catalogs are DataFrames. Writing a set of chapter files is the driver's work, by
design: intent is recorded before files change, every file is written under a temporary
name and renamed, and files of an earlier run go only if nobody edited them.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = ("source_file", "section_file", "detection_method", "heading", "characters", "converter")


def find_documents(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), suffix: str = ".pdf") -> DataFrame:
    """path, relative, length, sha256, content of files with the suffix in any case, below
    ``root``; hidden resource files and excluded folders are left out."""
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{any_case}").load(root)
    )
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(base.split("://")[-1]) + "/", "")
    rows = files.withColumn("relative", relative)
    rows = rows.where(~F.element_at(F.split("relative", "/"), -1).startswith("._"))
    for folder in exclude:
        rows = rows.where(~F.col("relative").startswith(folder.strip("/") + "/"))
    return rows.select("path", "relative", "length", F.sha2("content", 256).alias("sha256"), "content")


def document_names(documents: DataFrame) -> DataFrame:
    """relative, in a stable order whatever the case: without contents, which are not moved."""
    return documents.select("relative").orderBy(F.lower("relative"), "relative")


def document_title(title: Column, relative: Column) -> Column:
    """A document's own title, or the name of its file."""
    name = F.regexp_replace(F.element_at(F.split(relative, "/"), -1), r"(?<=.)\.[^.]+$", "")
    clean = F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(clean, F.lit("")), name)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def installed_reader(content: bytes):
    """The pages of a document, by an optional native decoder: each a function that returns
    its text, glyphs and rules (see ``layout``)."""
    import fitz

    def page(doc, k):
        def read():
            own = doc[k]
            glyphs = [
                (c["c"], None, span["font"].rpartition("+")[2], span["size"], *c["bbox"], *c["origin"], span.get("flags", 0))
                for block in own.get_text("rawdict")["blocks"] for line in block.get("lines", ())
                for span in line["spans"] for c in span["chars"]
            ]
            boxes = [d["rect"] for d in own.get_drawings() if d["type"] in ("s", "f", "fs")]
            rules = [(r.x0, r.y0, r.x1, r.y1) for r in boxes if r.y1 - r.y0 <= 2 or r.x1 - r.x0 <= 2]
            return own.get_text(), glyphs, rules

        return read

    doc = fitz.open(stream=content, filetype="pdf")
    if doc.needs_pass:
        raise ValueError("password protected")
    return [page(doc, k) for k in range(doc.page_count)]


PAGES = (
    "relative string, page_idx int, method string, message string, text string, "
    "glyphs array<struct<text:string,name:string,font:string,size:double,x0:double,y0:double,x1:double,y1:double,"
    "ox:double,oy:double,flags:int>>, rules array<struct<x0:double,y0:double,x1:double,y1:double>>"
)


def decode_pages(files: DataFrame, reader=installed_reader) -> DataFrame:
    """``PAGES``: every page of every file, by ``reader`` (content -> functions, one per page).

    A page that cannot be read has method 'error', a message and no text, and the others
    stay; a file that cannot be opened is one such row with page -1."""
    names = [c.split(" ", 1)[0] for c in PAGES.split(", ")]

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch["relative"], batch["content"], strict=True):
                try:
                    pages = reader(content)
                except ImportError:
                    raise
                except Exception as error:  # noqa: BLE001  one bad file must not end the run
                    yield pd.DataFrame([(name, -1, "error", f"{type(error).__name__}: {error}", None, [], [])], columns=names)
                    continue
                for k, read in enumerate(pages):
                    try:
                        row = (name, k, "text", None, *read())
                    except Exception as error:  # noqa: BLE001  one bad page must not end the document
                        row = (name, k, "error", f"{type(error).__name__}: {error}", None, [], [])
                    yield pd.DataFrame([row], columns=names)

    return files.select("relative", "content").mapInPandas(decode, PAGES)


def page_glyphs(decoded: DataFrame) -> DataFrame:
    """Glyph rows of decoded pages, as the layout operators take them."""
    rows = decoded.select(F.col("relative").alias("doc_key"), "page_idx", F.posexplode("glyphs").alias("pos", "g"))
    return rows.select("doc_key", "page_idx", F.col("pos").cast("long").alias("pos"), "g.*")


def page_rules(decoded: DataFrame) -> DataFrame:
    rows = decoded.select(F.col("relative").alias("doc_key"), "page_idx", F.posexplode("rules").alias("pos", "r"))
    return rows.select("doc_key", "page_idx", F.col("pos").cast("long").alias("pos"), "r.*")


def open_store(place: str):
    """The file system and path of a local path or a URI, which may hold blanks."""
    return fs.FileSystem.from_uri(quote(place, safe="/:@%") if "://" in place else str(Path(place).absolute()))


def atomic_write(path: Path | str, content: str, store=None) -> None:
    """Write UTF-8 as it is, to a local path, a URI or a path of ``store``; readers see the old
    file or the new one."""
    target = str(path)
    if store is None:
        store, target = open_store(target)
    folder = target.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    fresh = f"{folder}/.writing-{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(fresh) as out:
            out.write(content.encode())
        store.move(fresh, target)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(fresh)
        raise


@contextlib.contextmanager
def exclusive_lock(path: Path) -> Iterator[None]:
    """Hold a lock file; another holder is an error, not a wait."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as error:
            raise RuntimeError(f"{path} is in use") from error
        yield


def digest(path: Path) -> str | None:
    try:
        return hashlib.sha256(path.read_bytes()).hexdigest()
    except OSError:
        return None


class Publisher:
    """Chapter files of a folder and the record of what was written there."""

    def __init__(self, folder: Path):
        self.folder, self.state = Path(folder), Path(folder) / ".published.json"

    def recorded(self) -> dict[str, dict]:
        return json.loads(self.state.read_text("utf-8")) if self.state.exists() else {}

    def publish(self, outputs: DataFrame) -> dict[str, str]:
        """Make the folder hold ``outputs`` (doc_key, file, content, sha256); file -> action.

        Documents come one file at a time, so memory holds one chapter. Other documents'
        files are left alone."""
        with exclusive_lock(self.folder / ".lock"):
            known, done, keys = self.recorded(), {}, set()
            rows = outputs.select(F.col("doc_key").cast("string").alias("doc_key"), "file", "sha256", "content")
            now = {r["file"]: {"doc": r["doc_key"], "sha256": r["sha256"]} for r in rows.drop("content").toLocalIterator()}
            keys = {x["doc"] for x in now.values()}
            stale = {f: x for f, x in known.items() if x["doc"] in keys and f not in now}
            # intent first: a run that stops half-way knows all files it may have written
            atomic_write(self.state, json.dumps(known | now, indent=1, ensure_ascii=False))
            for row in rows.toLocalIterator():
                path = self.folder / row["file"]
                if digest(path) == row["sha256"]:
                    done[row["file"]] = "keep"
                else:
                    atomic_write(path, row["content"])
                    done[row["file"]] = "write"
            for name, x in stale.items():
                path = self.folder / name
                if digest(path) == x["sha256"]:
                    path.unlink()
                    done[name] = "delete"
                elif path.exists():
                    done[name] = "leave"
            kept = {f: x for f, x in (known | now).items() if f not in stale}
            atomic_write(self.state, json.dumps(kept, indent=1, ensure_ascii=False))
            return done

    def archive(self, path: Path) -> int:
        """All published files in one compressed archive; how many."""
        names = sorted(self.recorded())
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name in names:
                z.write(self.folder / name, name)
        return len(names)


def write_catalog(rows: DataFrame, path: Path | str, order: tuple[str, ...] = ("source_file", "section_file")) -> None:
    """The catalog as a tab-separated table with a header, in order."""
    lines = ["\t".join(CATALOG)]
    for row in rows.orderBy(*order).toLocalIterator():
        lines.append("\t".join(str(row[c]).replace("\t", " ").replace("\n", " ") for c in CATALOG))
    atomic_write(path, "\n".join(lines) + "\n")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'long' if c == 'characters' else 'string'}" for c in CATALOG)
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)

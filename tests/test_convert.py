"""Whole runs over a folder: routes, restart, clean-up, catalog."""

import json

import pytest

from quire.plans import convert
from quire.sources import files

WORDS = "the running text of a page goes on from line to line and fills it up"


def fakes():
    """A reader of JSON documents and a recogniser; local, so that they travel by value."""

    class Reader:
        @staticmethod
        def pages(content):
            doc = json.loads(bytes(content))
            if doc.get("locked"):
                raise ValueError("password protected")

            def page(lines):
                def read():
                    if lines == "damaged":
                        raise RuntimeError("damaged page")
                    glyphs = []
                    for k, line in enumerate(lines):
                        size, font = (17.0, "GoudySansPro-Bold") if line.startswith("#") else (10.0, "Times")
                        for i, c in enumerate(line.lstrip("#")):
                            x, y = 60.0 + 6 * i, 80.0 + 30 * k
                            glyphs.append((c, None, font, size, x, y - 0.7 * size, x + 5.5, y + 0.2 * size, x, y, 0))
                    return "\n".join(lines), glyphs, []

                return read

            return [page(x) for x in doc["pages"]]

        @staticmethod
        def info(content):
            doc = json.loads(bytes(content))
            return {"title": doc.get("title"), "author": "", "outline": doc.get("outline", [])}

    class Recogniser(Reader):
        @staticmethod
        def pages(content):
            return [lambda k=k: (f"Recognised page {k}. " + "words " * 60, [], []) for k in range(len(json.loads(bytes(content))["pages"]))]

    return Reader, Recogniser


def put(folder, name, **doc):
    path = folder / "in" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc))


def go(spark, folder, recogniser=None, **options):
    reader, own = fakes()
    o = convert.Options(*(f"file://{folder}/{x}" for x in ("in", "out", "work")), minimum=100, **options)
    outcomes = convert.Run(spark, o, reader, own if recogniser else None)()
    return {r.doc_key: r for r in outcomes.collect()}, outcomes


def chapters(folder):
    return sorted(str(p.relative_to(folder / "out")) for p in (folder / "out").rglob("*.tex"))


BOOK = {"title": "A Book", "pages": [["#Sets", *[WORDS] * 8], ["#Maps", *[WORDS] * 8]], "outline": []}


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "book.pdf", **BOOK)
    put(tmp_path, "deep/marked.pdf", pages=[[WORDS] * 9] * 3, outline=[[1, "Chapter 1 One", 1], [1, "Chapter 2 Two", 3]])
    put(tmp_path, "scan.pdf", pages=[[], []])
    put(tmp_path, "locked.pdf", pages=[], locked=True)
    return tmp_path


def test_runs_can_be_repeated(spark, folder):
    first, outcomes = go(spark, folder)
    assert {k: r.status for k, r in first.items()} == {"book.pdf": "traditional", "deep/marked.pdf": "traditional", "scan.pdf": "failed", "locked.pdf": "failed"}
    assert first["scan.pdf"].traditional_error == "no text layer" and "password" in first["locked.pdf"].traditional_error
    assert chapters(folder) == [
        "book_000 - Sets.tex", "book_001 - Maps.tex", "deep/marked_000 - Chapter 1 One.tex", "deep/marked_001 - Chapter 2 Two.tex",
    ]
    text = (folder / "out/book_000 - Sets.tex").read_text()
    assert "\\title{A Book}" in text and "\\chapter{Sets}" in text and text.count(WORDS) == 8
    catalog = files.read_catalog(spark, f"file://{folder}/out/{convert.CATALOG_NAME}").collect()
    assert {(r.source_file, r.detection_method) for r in catalog} == {("book.pdf", "LaTeX headings"), ("deep/marked.pdf", "PDF bookmarks")}
    lines = convert.report(outcomes).split("\n")
    assert lines[:2] == ["documents: 4", "chapters: 4"] and "locked.pdf (pdf2tex): no recogniser is installed" in lines

    second, _ = go(spark, folder)
    assert {r.status for k, r in second.items() if k in ("book.pdf", "deep/marked.pdf")} == {"skipped"}

    # a chapter that was edited is written anew, a changed document is converted again
    (folder / "out/book_000 - Sets.tex").write_text("edited")
    put(folder, "deep/marked.pdf", pages=[[WORDS] * 9] * 2, outline=[])
    third, _ = go(spark, folder)
    assert third["book.pdf"].status == third["deep/marked.pdf"].status == "traditional"
    assert "\\chapter{Sets}" in (folder / "out/book_000 - Sets.tex").read_text()
    assert [c for c in chapters(folder) if c.startswith("deep")] == ["deep/marked_000 - Complete Text.tex"]


def test_fallback_and_change_of_route(spark, folder):
    first, _ = go(spark, folder, recogniser=True)
    assert first["scan.pdf"].status == "pdf2tex" and first["scan.pdf"].traditional_error == "no text layer"
    assert "scan_000 - Complete Text.tex" in chapters(folder)
    only, _ = go(spark, folder, recogniser=True, pdf2tex_only=True)
    assert only["book.pdf"].status == "pdf2tex" and only["scan.pdf"].status == "skipped"
    # what the other route had published is gone
    assert [c for c in chapters(folder) if c.startswith("book")] == ["book_000 - Complete Text.tex"]


def test_clashing_names(spark, tmp_path):
    put(tmp_path, "a.pdf", **BOOK)
    put(tmp_path, "A.PDF", **BOOK)
    with pytest.raises(RuntimeError):
        go(spark, tmp_path)


def test_bad_pages_and_lost_state(spark, tmp_path):
    put(tmp_path, "a.pdf", pages=[[WORDS] * 9] * 30 + ["damaged"])
    o = convert.Options(*(f"file://{tmp_path}/{x}" for x in ("in", "out", "work")))
    store = convert.Store(spark, o)
    store.save(pages=spark.createDataFrame([], convert.CACHE))
    assert convert.Store(spark, o).tables.keys() == {"pages"}
    # state of other folders, or that cannot be read, is none
    assert convert.Store(spark, convert.Options(o.source, o.source, o.work)).tables == {}
    (tmp_path / "work/run.json").write_text("{broken")
    assert convert.Store(spark, o).tables == {}
    got, _ = go(spark, tmp_path, traditional_only=True)
    assert got["a.pdf"].status == "traditional" and got["a.pdf"].chapters == 1

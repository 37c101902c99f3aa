import pytest
from pyspark.sql import functions as F

from quire.functions import latex
from quire.operators import checks, headings, layout, pages, state
from quire.sources import files
from quire.streaming import incremental


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_key long, text string")


def paged(spark, docs):
    return spark.createDataFrame([(k, i, t, "text") for k, ps in docs.items() for i, t in enumerate(ps)], "doc_key long, page_idx int, text string, method string")


def toc(spark, rows):
    return spark.createDataFrame(rows, "doc_key long, pos int, level int, title string, page int")


def test_bookmarks(spark):
    book = paged(spark, {1: ["First", "Second"], 2: ["a", "b", "c"], 3: ["x"]})
    outline = toc(spark, [
        (1, 0, 1, "Book", 1), (1, 1, 2, "Chapter 1", 1), (1, 2, 3, "1.1 Detail", 1), (1, 3, 2, "Chapter 2", 2), (1, 4, 2, "Chapter 3", 2),
        (2, 0, 1, "Whole", 1), (2, 1, 2, "Alpha", 2), (2, 2, 2, "Beta", 3), (2, 3, 2, " ", 3), (2, 4, 2, "Gone", 9),
        (3, 0, 1, "Only", 1),
    ])
    found = pages.bookmark_headings(outline, book).orderBy("doc_key", "start").collect()
    assert [(r.doc_key, r.start, r.label) for r in found] == [(1, 0, "Chapter 1"), (1, 8, "Chapter 2"), (2, 4, "Alpha"), (2, 8, "Beta")]
    sections = pages.build_sections(pages.joined_text(book), pages.bookmark_headings(outline, book))
    got = [(r.doc_key, r.number, r.heading) for r in sections.orderBy("doc_key", "number").collect()]
    assert got == [(1, 0, "Chapter 1"), (1, 1, "Chapter 2"), (2, 0, "Front Matter"), (2, 1, "Alpha"), (2, 2, "Beta"), (3, 0, "Complete Text")]
    assert all(r.complete for r in pages.lossless(book, sections).collect())


def test_latex_headings(spark):
    doc = texts(
        spark,
        "\\section{Research \\& Development}\n\\section*{Sets \\{A\\} and 50\\% gains}",
        "\\section{DNA}\r\nbody\r\n  \\section{e-commerce}",
        "\\section{one}\n\\chapter{Big}\n\\chapter{Bigger}",
        "see \\section{x}\n\\subsection{y}\n% \\section{z}\n\\section{q} \\end{center}",
        "\\section{一}\n\\section{二}",
        "\\section{A \\textbackslash{}textasciitilde\\{\\} B \\$ C \\_ D}",
    )
    found = {}
    for r in headings.latex_headings(doc).orderBy("doc_key", "start").collect():
        found.setdefault(r.doc_key, []).append((r.start, r.label))
    assert [x[1] for x in found[0]] == ["Research & Development", "Sets {A} and 50% gains"]
    assert found[1] == [(0, "DNA"), (21, "e-commerce")]
    assert [x[1] for x in found[2]] == ["Big", "Bigger"]
    assert 3 not in found and len(found[4]) == 2
    assert [x[1] for x in found[5]] == ["A \\textasciitilde{} B $ C _ D"]


def test_prose_structure(spark):
    filler = "Some ordinary words of the body.\n" * 20
    doc = texts(
        spark,
        "".join(f"Chapter {n} Title\n\n{filler}" for n in ("one", "two", "three")),
        "".join(f"Part {n}\n{filler}" for n in ("I", "II")),
        "".join(f"\n{n}\n\nSetting The Scene\n\n{filler}" for n in (1, 2, 3)),
        "".join(f"{n} Some Section\n{filler}" for n in (1, 2, 3)),
        "Unstructured text",
        "".join(f"A Title For Chapter\n\n{n}.1 Opening\n{filler}" for n in (1, 2)),
    )
    found = {}
    for r in headings.detect_structure(doc, 100).orderBy("doc_key", "start").collect():
        found.setdefault(r.doc_key, []).append((r.method, r.label, r.number))
    assert found[0] == [("chapter", f"Chapter {n} Title", k + 1) for k, n in enumerate(("one", "two", "three"))]
    assert [x[0] for x in found[1]] == ["division"] * 2
    assert found[2] == [("chapter block", f"{n} Setting The Scene", n) for n in (1, 2, 3)]
    assert [x[0] for x in found[3]] == ["numbered section"] * 3
    assert 4 not in found
    assert found[5] == [("chapter block", f"{n} A Title For Chapter", n) for n in (1, 2)]


def test_contents_page_is_dropped(spark):
    early = "".join(f"Chapter {n} Name\n" for n in range(1, 7)) + "preface\n" * 300
    body = "".join(f"Chapter {n} Name\n" + "words and words\n" * 300 for n in range(1, 7))
    found = headings.detect_structure(texts(spark, early + body), 1000).orderBy("start").collect()
    assert len(found) == 6 and found[0].start == len(early)


def test_checks(spark):
    doc = texts(spark, "a}", "{x $y$ $z", "\\begin{a}\\end{b}\\end{c}\\begin{d}", "fine $x_{1}$", "x_1_2\n\\odd $ $")
    got = {(r.doc_key, r.kind): r.n for r in checks.issues(doc).collect()}
    assert got == {
        (0, "unbalanced brace"): 1, (1, "unclosed braces at EOF"): 1, (1, "odd $ count in paragraph"): 1, (1, "empty maths"): 1,
        (2, "mismatched environment"): 1, (2, "stray \\end"): 1, (2, "unclosed environment"): 1,
        (4, "double subscript"): 1, (4, "unknown command \\odd"): 1, (4, "empty maths"): 1,
    }
    assert {r.doc_key for r in checks.fatal_issues(checks.issues(doc)).collect()} == {0, 1, 2}
    assert [r.lines for r in checks.nested_counts(doc).where("doc_key = 4").collect()] == [[1]]
    totals = checks.issue_totals(checks.issues(doc)).collect()
    assert totals[0].kind == "empty maths" and totals[0].n == 2 and totals[0].examples == [1, 4]
    glyphs = spark.createDataFrame([(1, "AB+CMMI10", "x"), (1, "CMMI10", "y"), (1, "Times", "z")], "doc_key long, font string, text string")
    assert [tuple(r) for r in checks.font_report(glyphs).collect()] == [(1, "CMMI10", 2, 2)]


def test_books(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("y")).first().y
    out = one(latex.book_document(F.lit("A & B"), F.lit("x\n\f\ny"), F.lit("f_1.pdf"), F.lit("T"), F.lit("")))
    assert "\\title{T}" in out and "\\chapter{A \\& B}\n\n% Source: f\\_1.pdf\n\nx\n\ny\n\n\\end{document}\n" in out
    assert "\\chapter" not in one(latex.book_document(F.lit(""), F.lit("x"), F.lit("f"), F.lit("T"), F.lit("")))
    main = one(latex.scaffold(F.lit("T"), F.lit("A"), F.lit("1st"), F.array(F.lit(1), F.lit(12))))
    assert "\\include{chapter01}\n\\include{chapter12}\n" in main and main.endswith("\\end{document}\n")


def test_bands_and_gutter(spark):
    columns = "doc_key long, page_idx int, pos long, text string, name string, font string, size double, x0 double, y0 double, x1 double, y1 double, ox double, oy double, flags int"
    three = spark.createDataFrame([(1, 0, k, "x", None, "F", 10.0, 0.0, a, 5.0, b, 0.0, b, 0) for k, (a, b) in enumerate(((0.0, 5.0), (1.0, 2.0), (7.0, 8.0)))], columns)
    assert [r.glyphs for r in layout.bands(three).orderBy("band").collect()] == [2, 1]
    two = spark.createDataFrame(
        [(1, 0, k * 100 + i, "x", None, "F", 10.0, float(x), 20.0 * k, x + 9.0, 20.0 * k + 9, float(x), 20.0 * k, 0)
         for k in range(12) for i, x in enumerate([*range(50, 250, 10), *range(300, 500, 10)])], columns)
    gutter = layout.find_gutter(two).collect()
    assert [(g.gutter_x0, g.gutter_x1) for g in gutter] == [(249, 300)]
    lig = three.limit(1).withColumn("text", F.lit("ﬁ")).withColumn("x1", F.lit(6.0))
    assert [(r.text, r.x0, r.x1) for r in layout.expand_ligatures(lig).orderBy("x0").collect()] == [("f", 0.0, 3.0), ("i", 3.0, 6.0)]


LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def glyph_items(spark, rows):
    """Rows of the test's glyphs on one page: order, quantity, price, discount."""
    return spark.createDataFrame([(o, 100, 1, 1, q, p, d, 0.02, "A", "F", None) for o, q, p, d in rows], LINEITEM).coalesce(1)


def test_measures_as_their_sql_where_values_are_missing(spark, tmp_path):
    from quire.plans import registry

    duckdb = pytest.importorskip("duckdb")
    rows = [(k, float(5 * (k // 2)) if k < 8 else None, 1000.0 + 16000 * (k % 2) + 900 * k, 0.05) for k in range(12)] + [(None, 5.0, 4000.0, 0.1)]
    glyph_items(spark, rows).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("row_breaks", "local_measure"):
        found = registry.queries()[name](spark, str(tmp_path))
        expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        order = lambda rows: sorted(map(tuple, rows), key=repr)
        assert order(found.collect()) == order(expected)


def test_rows_do_not_depend_on_the_order_of_glyphs(spark, tmp_path):
    from quire.plans import registry

    # the last two lie at one place, 4 below the first: a new row for the small one, none for the large one
    rows = [(1, 1.0, 90000.0, 0.05), (2, 5.0, 1000.0, 0.1), (2, 5.0, 20000.0, 0.01), (3, 20.0, 50000.0, 0.05)]
    for name, given in (("a", rows), ("b", rows[::-1])):
        glyph_items(spark, given).write.parquet(str(tmp_path / name / "lineitem.parquet"))
    read = lambda query, name: sorted(map(tuple, registry.queries()[query](spark, str(tmp_path / name)).collect()))
    assert [r[-1] for r in read("row_breaks", "a")] == [1, 2, 2, 3]
    for query in ("row_breaks", "local_measure"):
        assert read(query, "a") == read(query, "b")


def test_state(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_key string, sha256 string")
    runs = spark.createDataFrame(
        [("a", "pdf2tex", "1", True, None, True), ("a", "traditional", "1", True, None, True), ("b", "traditional", "old", True, None, True)],
        "doc_key string, route string, sha256 string, done boolean, error string, valid boolean")
    assert [tuple(r) for r in state.completed_route(docs, runs).collect()] == [("a", "traditional")]
    assert [r.doc_key for r in state.pending(docs, runs).collect()] == ["b"]
    names = spark.createDataFrame([("", "book"), ("", "BOOK"), ("", "book  name"), ("", "book name")], "folder string, stem string")
    assert [r.n for r in state.name_collisions(names).collect()] == [2]
    jobs = spark.createDataFrame([("1", "queued", "2024"), ("2", "completed", "2025"), ("3", "discarding", "2026")], "job_id string, status string, created_at string")
    assert [(r.job_id, r.status) for r in state.newest_jobs(state.recover_jobs(jobs)).collect()] == [("2", "completed"), ("1", "interrupted")]


def plan(spark, bodies):
    sections = spark.createDataFrame([(1, k, f"Head {k}", b) for k, b in enumerate(bodies)], "doc_key long, number int, heading string, body string")
    return pages.plan_sections(sections, F.lit("book.pdf"), F.lit("book"))


def test_publish_protects_edits(spark, tmp_path):
    p = files.Publisher(tmp_path)
    done = p.publish(plan(spark, ["one", "two", "three"]))
    assert set(done.values()) == {"write"} and len(done) == 3
    assert set(p.publish(plan(spark, ["one", "two", "three"])).values()) == {"keep"}
    (tmp_path / "book_002 - Head 2.tex").write_text("my own")
    done = p.publish(plan(spark, ["one"]))
    assert sorted(done.values()) == ["delete", "keep", "leave"]
    assert (tmp_path / "book_002 - Head 2.tex").read_text() == "my own"
    assert p.archive(tmp_path / "all.zip") == 1
    with files.exclusive_lock(tmp_path / ".lock"), pytest.raises(RuntimeError):
        p.publish(plan(spark, ["one"]))


def test_scan_and_catalog(spark, tmp_path):
    for name in ("b.pdf", "math/a.PDF", "math/deep/c.Pdf", "notes.txt", "._x.pdf", "out/z.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("%PDF-1.4 stub")
    found = files.document_names(files.find_documents(spark, str(tmp_path), ("out",))).collect()
    assert [r.relative for r in found] == ["b.pdf", "math/a.PDF", "math/deep/c.Pdf"]
    outputs = plan(spark, ["one", "two"]).select("*", F.lit("b.pdf").alias("source_file"), F.lit("m").alias("method"), F.lit("c").alias("converter"))
    files.write_catalog(pages.catalog(outputs), tmp_path / "catalog.tsv")
    back = files.read_catalog(spark, str(tmp_path / "catalog.tsv"))
    assert back.columns == list(files.CATALOG) and back.count() == 2


def test_incremental_runs_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = paged(spark, {1: ["Chapter 1\nfirst", "more"], 2: ["x"]})
    rows.write.parquet(source)
    handle = incremental.section_writer(target, lambda b: pages.build_sections(pages.joined_text(b), headings.latex_headings(pages.joined_text(b))))
    assert incremental.run_incremental(spark, source, str(tmp_path / "cp"), handle) == 1
    assert incremental.run_incremental(spark, source, str(tmp_path / "cp"), handle) == 0
    assert spark.read.parquet(target).count() == 2


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert latex.PAGE_BREAK == "\n\x0c\n"


def test_blocks(spark):
    from quire.operators import blocks

    rows = [
        ("section", 50.0, "Sets"), ("text", 60.0, "First exam-"), ("text", 50.0, "ple line"), ("label", 50.0, "Note"),
        ("display", 80.0, "x=1"), ("text", 60.0, "again"), ("blank", 0.0, ""), ("center", 99.0, "a"), ("center", 99.0, "b"), ("label", 50.0, "lost"),
    ]
    groups = spark.createDataFrame([(1, 0, i, k, x, 50.0, t) for i, (k, x, t) in enumerate(rows)],
                                   "doc_key long, page_idx int, reading int, kind string, x0 double, region_left double, latex string")
    assert blocks.page_text(groups).first().text == (
        "\\section{Sets}\n\nFirst example line\n\n\\[x=1\\]\n\n\\textbf{Note} again\n\n\\begin{center}\na \\\\\nb\n\\end{center}"
    )

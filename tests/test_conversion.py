"""Conversion runs as tables: invalidation, resume, gates, routes, publication."""

from pyspark.sql import functions as F

from quire.operators import conversion as c
from quire.operators import state

PLAN = f"doc_key string, outputs {c.OUTPUT}, method string"


def entry(spark, *rows):
    """(doc_key, route, fingerprint, split, outputs, pending, error)"""
    none = [(k, r, f, s, s, {"minimum": "1", "version": c.SPLITTER_VERSION} if s else None, None, o, p, e) for k, r, f, s, o, p, e in rows]
    return spark.createDataFrame(none, c.ENTRY.format(key="string"))


def out(name, sha="s"):
    return (name, sha, "Head", 3)


PRINT = {"sha256": "1", "version": "3", "converter": "traditional"}


def documents(spark, *keys):
    return spark.createDataFrame([(k, "1") for k in keys], "doc_key string, sha256 string")


def test_entries_are_reset_when_their_fingerprint_changes(spark):
    old = entry(
        spark, ("same", "traditional", PRINT, True, [out("a")], [], "failed once"),
        ("other", "traditional", PRINT | {"version": "2"}, True, [out("b")], [], None),
    )
    wanted = c.fingerprint(F.col("sha256"), "traditional")
    got = {r.doc_key: r for r in c.fresh_entries(documents(spark, "same", "other", "new"), old, "traditional", wanted).collect()}
    assert got["same"].split and got["same"].error is None and not got["same"].reset
    assert got["other"].reset and not got["other"].split and [o.file for o in got["other"].outputs] == ["b"]
    assert got["new"].outputs == [] and not got["new"].extracted
    forced = c.fresh_entries(documents(spark, "same"), old, "traditional", wanted, force=True).first()
    assert forced.reset and not forced.split and [o.file for o in forced.outputs] == ["a"]


def test_only_damaged_or_missing_pages_are_converted_again(spark):
    pages = spark.createDataFrame([("d", 0, "zero", "traditional"), ("d", 1, "one", "error"), ("d", 2, "two", "traditional")], "doc_key string, page_idx int, text string, method string")
    cache = c.stored_pages(pages, "traditional").withColumn("text", F.when(F.col("page_idx") == 2, "edited").otherwise(F.col("text")))
    counts = spark.createDataFrame([("d", 4), ("empty", 0)], "doc_key string, n_pages int")
    kept = spark.createDataFrame([("d", "traditional", False)], "doc_key string, route string, reset boolean")
    valid = c.valid_pages(cache, kept)
    assert sorted((r.page_idx, r.method) for r in valid.collect()) == [(0, "traditional"), (1, "error")]
    assert sorted(r.page_idx for r in c.missing_pages(counts, valid).collect()) == [2, 3]
    assert c.valid_pages(cache, kept.withColumn("reset", F.lit(True))).count() == 0


def test_publication_records_intent_and_cleans_up(spark):
    entries = entry(spark, ("d", "traditional", PRINT, True, [out("a"), out("b")], [], None))
    plan = spark.createDataFrame([("d", [out("a", "t"), out("c")], "LaTeX headings")], PLAN)
    begun = c.begin_publication(entries, plan)
    row = begun.first()
    assert not row.split and [o.file for o in row.pending] == ["a", "b", "a", "c"]
    disk = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "file string, sha256 string")
    assert [r.file for r in c.leftovers(begun, plan, disk).collect()] == ["b"]
    assert c.leftovers(begun, plan, disk.replace("s", "edited", "sha256")).count() == 0
    done = c.finish_publication(begun, plan, c.settings_for(1)).first()
    assert done.split and done.pending == [] and [o.file for o in done.outputs] == ["a", "c"] and done.method == "LaTeX headings"


def test_routes_share_one_namespace(spark):
    entries = entry(
        spark, ("d", "traditional", PRINT, False, [], [], None), ("d", "pdf2tex", PRINT, True, [out("x")], [out("y")], None),
        ("other", "pdf2tex", PRINT, True, [out("z")], [], None),
    )
    got = {(r.doc_key, r.route): r for r in c.supersede(entries, "traditional").collect()}
    assert [o.file for o in got["d", "traditional"].pending] == ["x", "y"]
    assert got["d", "pdf2tex"].outputs == [] and not got["d", "pdf2tex"].split
    assert [o.file for o in got["other", "pdf2tex"].outputs] == ["z"]


def test_completed_needs_print_settings_and_files(spark):
    rows = [
        ("good", PRINT, [out("a")], [], None), ("edited", PRINT, [out("b")], [], None), ("failed", PRINT, [out("a")], [], "x"),
        ("pending", PRINT, [out("a")], [out("q")], None), ("old", PRINT | {"version": "1"}, [out("a")], [], None), ("none", PRINT, [], [], None),
    ]
    entries = entry(spark, *[(k, "traditional", f, True, o, p, e) for k, f, o, p, e in rows])
    disk = spark.createDataFrame([("a", "s"), ("b", "edited")], "file string, sha256 string")
    wanted = {"traditional": c.fingerprint(F.col("sha256"), "traditional")}
    docs = documents(spark, *[r[0] for r in rows])
    assert [tuple(r) for r in c.completed(docs, entries, disk, wanted, c.settings_for(1)).collect()] == [("good", "traditional")]
    assert c.completed(docs, entries, disk, wanted, c.settings_for(2)).count() == 0


def test_extraction_and_errors(spark):
    entries = entry(spark, ("d", "traditional", PRINT, True, [], [], None), ("e", "traditional", PRINT, True, [], [], None))
    touched = documents(spark, "d")
    begun = {r.doc_key: (r.extracted, r.split) for r in c.begin_extraction(entries, touched).collect()}
    assert begun == {"d": (False, False), "e": (True, True)}
    assert {r.extracted for r in c.finish_extraction(c.begin_extraction(entries, touched), touched).collect()} == {True}
    bad = spark.createDataFrame([("d", "traditional", "boom")], "doc_key string, route string, message string")
    assert {r.doc_key: (r.error, r.split) for r in c.record_errors(entries, bad).collect()} == {"d": ("boom", False), "e": (None, True)}


def pages_of(spark, texts):
    rows = [(k, i, t, "text" if t else "error") for k, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc_key string, page_idx int, text string, method string")


def test_text_layers_that_cannot_be_used(spark):
    words = "plain words of a page that goes on. " * 10
    found = {r.doc_key: r.message for r in c.text_layer_errors(pages_of(spark, {
        "fit": [words, words], "scan": ["", ""], "broken": [words + "\\begin{a}", words + "$"], "unknown": [words + "\\odd"],
    })).collect()}
    assert found.keys() == {"scan", "broken"}
    assert found["broken"] == "generated LaTeX would not compile: odd $ count in paragraph=1, unclosed environment=1"


def test_outcomes_fall_back_and_fail(spark):
    docs = documents(spark, "done", "text", "ocr", "none")
    message = lambda *ks: spark.createDataFrame([(k, f"Traceback\nbad {k}") for k in ks], "doc_key string, message string")
    errors = {"traditional": message("ocr", "none", "done"), "pdf2tex": message("none")}
    found = c.outcomes(docs, docs.where("doc_key = 'done'").withColumn("route", F.lit("traditional")), errors)
    got = {r.doc_key: (r.status, r.traditional_error, r.pdf2tex_error) for r in found.collect()}
    assert got["done"] == ("skipped", None, None) and got["text"] == ("traditional", None, None)
    assert got["ocr"][0] == "pdf2tex" and got["ocr"][1] and got["none"][0] == "failed"
    assert [(r.route, r.line) for r in c.failure_lines(found).orderBy("route").collect()] == [("pdf2tex", "bad none"), ("traditional", "bad none")]
    only = c.outcomes(docs, docs.limit(0).withColumn("route", F.lit("")), errors, ("traditional",))
    assert {r.doc_key: r.status for r in only.collect()}["ocr"] == "failed"


def test_detection_cascade(spark):
    filler = "words and words\n" * 300
    book = pages_of(spark, {"marks": ["\\section{One}\n" + filler, "\\section{Two}\n" + filler], "prose": [f"Chapter {k} Name\n" + filler for k in (1, 2)], "both": [f"Chapter {k} Name\n" + filler for k in (1, 2)]})
    marks = spark.createDataFrame([("both", 0, "A"), ("both", 7, "B")], "doc_key string, start long, label string")
    by = lambda rows: {(r.doc_key, r.method): r.n for r in rows.groupBy("doc_key", "method").agg(F.count("*").alias("n")).collect()}
    assert by(c.headings_from_text(marks, book, 1000)) == {("both", "PDF bookmarks"): 2, ("prose", "chapter"): 2}
    assert by(c.headings_from_latex(marks, book)) == {("both", "PDF bookmarks"): 2, ("marks", "LaTeX headings"): 2}


def test_names_and_matching(spark):
    rows = spark.createDataFrame([("j", k, n) for k, n in enumerate(["a.pdf", "a.pdf", "a_2.pdf", "x/a.pdf", ".b", ".b"])], "job string, seq int, name string")
    assert [r.name for r in state.upload_names(rows).orderBy("seq").collect()] == ["a.pdf", "a_2.pdf", "a_2_2.pdf", "a_3.pdf", ".b", ".b_2"]
    outputs = spark.createDataFrame([("d", "f", "s"), ("e", "g", "s")], "doc_key string, file string, sha256 string")
    recorded = spark.createDataFrame([("d", True, "one"), ("e", True, "two"), ("n", True, "one")], "doc_key string, split boolean, split_settings string")
    got = state.publication_matches(outputs, outputs, recorded, F.lit("one")).collect()
    assert {r.doc_key: r.matches for r in got} == {"d": True, "e": False, "n": False}


def test_jobs(spark, tmp_path):
    from quire.operators import jobs

    blank = {"progress": 0.0, "message": "m", "files_count": 1, "source_files": [], "chapters_count": 0, "logs": [], "outputs": [],
             "options": {}, "completed_at": None, "error": None}
    row = lambda k, status, at="2024-01-01T00:00:00": {"job_id": k, "status": status, "created_at": at} | blank
    table = spark.createDataFrame([row("q", "queued"), row("c", "converting"), row("f", "failed"), row("d", "completed", "never")], jobs.JOB)
    ids = lambda *ks: spark.createDataFrame([(k,) for k in ks], "job_id string")
    status = lambda df: {r.job_id: r.status for r in df.collect()}
    again = jobs.loaded(jobs.saved(table).withColumnRenamed("job_id", "folder"))
    assert status(again) == {"q": "interrupted", "c": "interrupted", "f": "failed", "d": "completed"}
    assert status(jobs.resumed(table, ids("f", "d", "none"))) == status(table) | {"f": "queued"}
    assert status(jobs.started(table, ids("q", "f"))) == status(table) | {"q": "converting"}
    assert status(jobs.discarded(table, ids("c", "f"))) == {"q": "queued", "c": "discarding", "d": "completed"}
    assert {r.job_id for r in jobs.expired(table, F.lit("2024-01-01 03:00:00").cast("timestamp")).collect()} == {"q", "c", "f"}
    out_ = [("a.tex", "A", 1, "s", "traditional")]
    results = spark.createDataFrame([("c", out_, "t", None), ("q", out_, "t", None)], f"job_id string, outputs array<{jobs.OUTPUT}>, at string, failure string")
    done = {r.job_id: r for r in jobs.finished(table, results).collect()}
    assert done["c"].status == "completed" and done["c"].chapters_count == 1 and done["c"].message.startswith("Converted successfully: 1")
    assert done["q"].status == "queued"
    failed = jobs.finished(table, results.withColumn("failure", F.lit("boom"))).where("job_id = 'c'").first()
    assert (failed.status, failed.error, failed.message) == ("failed", "boom", "Conversion failed: boom")
    lines = spark.range(1).select(jobs.log_lines(F.lit(" a \n\n b\r\nc")).alias("l")).first().l
    assert lines == ["a", "b", "c"]
    assert jobs.accepted_uploads(spark.createDataFrame([("x/a.PDF",), ("b.txt",), ("",)], "name string")).count() == 1
    (tmp_path / "a.tex").write_text("text")
    assert jobs.output_content(str(tmp_path), "a.tex") == "text" and jobs.output_content(str(tmp_path), "b.tex") is None
    try:
        jobs.output_content(str(tmp_path), "../x")
        raise AssertionError("a path outside was read")
    except PermissionError:
        pass


def test_jobs_expire_by_fractions_of_a_second(spark):
    from quire.operators import jobs

    table = spark.createDataFrame([("old", "2024-01-01T00:00:00"), ("even", "2024-01-01T00:00:00.25"), ("new", "2024-01-01T00:00:00.5")], "job_id string, created_at string")
    now = F.lit("2024-01-01 00:01:00.25").cast("timestamp")
    assert {r.job_id for r in jobs.expired(table, now, 60).collect()} == {"old"}


def test_jobs_expired_as_its_sql(spark, tmp_path):
    from quire.plans import registry

    # 2: in the second of the limit; 7: a minute older, with an hour in between that New York's clocks skip
    rows = [(2, "2024-03-09 23:30:00.9", "click"), (3, "2024-03-09 23:30:01", "click"), (4, "2024-03-10 23:30:00.2", "click"),
            (5, "2024-03-09 01:00:00", None), (6, "2024-03-09 01:00:00", "view"), (7, "2024-03-09 23:29:00", "error"),
            (10, "2024-03-09 01:00:00", "error"), (11, "2024-03-09 01:00:00", "error"), (-5, "2024-03-09 01:00:00", "error"), (8, None, "error")]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in (zone, "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert {r.job_id for r in registry.jobs_expired(spark, str(tmp_path)).collect()} == {"2", "7"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    events.limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert registry.jobs_expired(spark, str(tmp_path / "none")).count() == 0

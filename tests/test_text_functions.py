from pyspark.sql import functions as F

from quire.functions import latex, naming, titles


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_escape_is_one_pass(spark):
    assert one(spark, "\\{}%&$_#~^", latex.escape_text) == "".join(latex.ESCAPES.values())
    for text in ("Ünï 漢字 α\t\n\f", "a\\\\b{c}", "\\textbackslash{} \\$", "", "~^^~\\&"):
        escaped = one(spark, text, latex.escape_text)
        assert escaped == "".join(latex.ESCAPES.get(c, c) for c in text)
        assert one(spark, escaped, latex.unescape_text) == text


def test_document(spark):
    out = one(
        spark, "a\n\f\nb\x00\x01\x0b\x7f\x85\n\t$x$",
        lambda c: latex.latex_document(c, F.lit("nested/file_1 & 2%.pdf"), F.lit("Chapter {1}: \\input{other} $cash#")),
    )
    assert "a\n\\clearpage\nb\n\t$x$" in out
    assert "Source: nested/file\\_1 \\& 2\\%.pdf" in out
    assert "\\section*{Chapter \\{1\\}: \\textbackslash{}input\\{other\\} \\$cash\\#}" in out


def test_braces(spark):
    assert one(spark, "a}b{c", latex.balance) == "ab{c}"
    assert one(spark, "\\}a{", latex.balance) == "\\}a{}"
    checks = {"a{b}c": True, "a}b{": False, "{": False, "\\{": True, "x\\": False, "": True}
    for text, want in checks.items():
        assert one(spark, text, latex.balanced_argument) is want, text


def test_join_lines(spark):
    rows = spark.createDataFrame([(["exam-", "ple text"],), (["a--", "b"],), (["a-", "B"],), ([],), (["x ", "", "y"],), (["$a$", "$b$"],)], "l array<string>")
    assert [r.y for r in rows.select(latex.join_lines(F.col("l")).alias("y")).collect()] == ["example text", "a-- b", "a- B", "", "x y", "$a\\ b$"]


def test_file_names(spark):
    assert one(spark, "a/b\\c:d*e?\x01f", naming.safe_filename) == "a b c d e f"
    assert one(spark, " . ", naming.safe_filename) == "Untitled Section"
    assert one(spark, "書書", lambda c: naming.truncate_utf8(c, 4)) == "書"
    long = [one(spark, "書" * 100 + end, lambda c: naming.flat_section_filename(c, F.lit(0), F.lit("章" * 100))) for end in ("one", "two")]
    assert long[0] != long[1] and all(len(x.encode()) <= 240 and x.endswith(".txt") for x in long)
    assert one(spark, "book", lambda c: naming.flat_section_filename(c, F.lit(7), F.lit("A: b"), ".tex")) == "book_007 - A b.tex"


def test_numbers(spark):
    for text, want in {"IV": 4, "twelve": 12, "7": 7, "abc": None, "xix.": 19, "MCM": 1900, "0": 0, "": None}.items():
        assert one(spark, text, titles.identifier_number) == want, text


def test_titles(spark):
    good = ["Random Variables", "1 The Law of Large Numbers", "Éléments d'analyse"]
    bad = ["the lower case", "Abc", "Ends with a stop.", "Figure 1 shows", "A $x$ title", "1.2 Numbers Here", "Dots ... Here", "", "word " * 19 + "Word"]
    for text in good:
        assert one(spark, text, titles.plausible_title) is True, text
    for text in bad:
        assert one(spark, text, titles.plausible_title) is False, text
    for text, want in {"": True, "Introduction": True, "lower": False, "This is": False, "(x)": False, "2 sets": True}.items():
        assert one(spark, text, titles.heading_like_tail) is want, text
    assert one(spark, "Straße & Co.", titles.normalize_key) == "strasse co"
    assert one(spark, "  x" + "y" * 150, titles.acceptable_line) is False

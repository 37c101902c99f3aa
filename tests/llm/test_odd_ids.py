"""Ids that numpy would change or refuse, names that clash by case, classes that workers lack."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quire.llm import bilinear, chat_tree, common, decontaminate, jaccard_join, language_id, personal_data, revisits, training_order

LARGE = 9007199254740993  # not a double
TEXTS = [(LARGE, "one two three four five six seven a@b.co"), (None, "the second text stands here, with more words"), (None, None), (7, "")]


@pytest.fixture
def large(make):
    return make([(i, t, "en", "s") for i, t in TEXTS])


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


WANT = sorted((i is None, i or 0) for i, _ in TEXTS)


def test_scoring(large):
    docs = large.select("doc_id", "text", F.lit(False).alias("held_out"))
    assert ids(bilinear.score(docs, *bilinear.learn(docs))) == WANT


def test_languages(large):
    assert ids(language_id.score(large, language_id.train(large), ["doc_id"])) == WANT


def test_personal_data(large):
    model = personal_data.Classifier(personal_data.pattern_counts(large))
    assert ids(personal_data.find_spans(large, model)) == WANT


def test_join(large):
    assert ids(jaccard_join.ngram_components(large)) == WANT


def test_leaks(spark, large):
    bench = spark.createDataFrame([(LARGE, TEXTS[0][1]), (1, TEXTS[1][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(large, bench).collect()}
    assert got == {(LARGE, LARGE), (None, 1)}


def test_token_records(spark, large, tmp_path):
    index = training_order.materialise(large, f"file://{tmp_path}", length=4, per_shard=4)
    found = {r.doc_id for r in index.collect()}
    assert found == {LARGE, None}
    records = training_order.read_slots(f"file://{tmp_path}", 0, index.count(), 4, 4)
    assert {doc for _, doc, _, _ in records} == {LARGE, None}
    named = spark.createDataFrame([("a", "some words"), (None, "others"), ("b", "x y z")], "doc_id string, text string")
    kept = training_order.materialise(named, length=4, per_shard=4).collect()
    assert {r.doc_id for r in kept} == {"a", "b", None}
    date = named.select(F.to_date(F.lit("2020-01-02")).alias("doc_id"), "text")
    assert {str(r.doc_id) for r in training_order.materialise(date, length=4).collect()} == {"2020-01-02"}


def test_conversations(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(LARGE, 0, "user", "hi"), (LARGE, 1, "assistant", "yes"), (None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, None, None)]
    back = chat_tree.read_back(chat_tree.build_blocks(spark.createDataFrame(rows, schema))).collect()
    # rows without an id are conversations of their own
    assert sorted((r.conv_id is None, r.conv_id or 0, len(r.turns)) for r in back) == [(False, LARGE, 2), (True, 0, 1), (True, 0, 1), (True, 0, 1)]


def test_headers_that_differ_in_case(spark):
    schema = "record_id long, kind string, url string, ts long, status int, digest string, headers map<string,string>"
    rows = [
        (1, "response", "http://a/", 1, 200, "d", {"ETag": "old", "etag": "new", "Via": "x"}),
        (2, "revisit", "http://a/", 2, 304, None, {"ETAG": "new"}), (3, "revisit", None, 2, 304, None, None),
    ]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got[2].outcome == "resolved" and got[2].headers == {"etag": "new", "via": "x"} and got[3].outcome == "no_response"


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError):
        common.shared_path(Session, "x")


def test_staged_tables_are_deleted(spark):
    scope = common.Scope()
    table = scope.stage(spark.range(3).toDF("x"), "scoped")
    folder = os.path.dirname(table.inputFiles()[0]).removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(folder)
    scope.drop(spark.range(2))
    scope.drop(table)
    assert not os.path.exists(folder)


WORKERS = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from quire.llm import bilinear, personal_data
docs = spark.createDataFrame([(1, "tel +1 (555) 010-7788 190.137.223.204 end"), (2, "more words")], "doc_id long, text string")
model = personal_data.Classifier(personal_data.pattern_counts(docs))
assert personal_data.find_spans(docs, model).count() == 2
rows = docs.withColumn("held_out", F.lit(False))
assert bilinear.score(rows, *bilinear.learn(rows)).count() == 2
print("workers need no package")
"""


def test_workers_need_no_package(tmp_path):
    """The driver finds the package by its own path only, which workers do not have."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = WORKERS.format(repo=repo, shared=f"file://{tmp_path}")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "workers need no package" in done.stdout, done.stderr[-2000:]


def test_very_long_texts(spark, make):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(120_000))
    near = long.replace("w77 ", "changed ")
    docs = make([(1, long, "en", "s"), (2, near, "en", "s"), (3, "short text of its own here", "en", "s")])
    assert {(r.doc_id, r.component_id) for r in jaccard_join.ngram_components(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    mail = make([(1, "x " * 300_000 + "a@b.co " + "9" * 200_000, None, None)])
    spans = personal_data.find_spans(mail, personal_data.Classifier(personal_data.pattern_counts(mail))).first().spans
    assert [(s.kind, s.start, s.stop) for s in spans] == [("email", 600_000, 600_006)]
    said = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn int, role string, text string")
    back = chat_tree.read_back(chat_tree.build_blocks(said)).first()
    assert back.loss_text == long and len(back.turns) == 2
    assert chat_tree.op9_chat_tree is not None and chat_tree.build_blocks(said.limit(0)).count() == 0

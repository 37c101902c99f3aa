import corpus_pipeline as cp
from quire.llm import common, decontaminate, jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = common.documents(spark, SF)
    columns, last = docs.columns, None
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "near_duplicates", "decontaminate", "mix", "token_ids"]
    for name, stage in cp.STAGES[:-1]:
        last, docs = docs, common.stage(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert len(ids) > 150
        if name == "near_duplicates":
            groups = jaccard_join.ngram_components(last, cp.WIDTH, cp.PERCENT).collect()
            assert ids == {r.component_id for r in groups}
        if name == "decontaminate":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.find_leaks(docs, bench).count() == 0
    index = cp.STAGES[-1][1](spark, docs, SF).toPandas()
    assert sorted(index.slot) == list(range(len(index))) and set(index.doc_id) <= ids


def test_near_duplicates_are_rows_not_ids(make, spark):
    base = [f"w{k}" for k in range(100)]
    near = lambda word: " ".join([*base[:50], word, *base[51:]])
    rows = [(1, near("a")), (7, near("b")), (7, "a text that is no copy of any other one here")]
    rows += [(9, " ".join(f"v{k}" for k in range(80))), (9, " ".join(f"v{k}" for k in range(81)))] * 2
    kept = cp.drop_near_duplicates(spark, make([(i, t, "en", "a") for i, t in rows]), SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 7, 9]
    assert {(r.doc_id, r.text) for r in kept} >= {rows[0], rows[2]}


def test_odd_rows_pass(make, odd, spark):
    rows = odd + [(None, "the of and to in " * 20, "en", "a"), (10, "the of and to in that it is was " * 10, "en", "a")] * 2
    docs = make(rows)
    for _, stage in cp.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, SF), "odd")
    assert docs.count() > 0 and docs.columns == make([]).columns
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, jaccard_join, language_id


@pytest.fixture
def worker(spark):
    """Gives the MB that a Python worker holds which runs this test's tasks and no others."""

    def held(batches):
        for _ in batches:
            pass
        found = re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())
        yield pa.RecordBatch.from_arrays([pa.array([int(found[0]) // 1024])], names=["mb"])

    environment = spark.sparkContext.environment
    environment["QUIRE_TEST"] = "alone"  # workers are kept apart by their environment
    yield lambda: spark.range(0, 1, 1, 1).mapInArrow(held, "mb long").first().mb
    del environment["QUIRE_TEST"]


@pytest.mark.parametrize("stage", ["language", "digests", "leaks"])
def test_a_task_gives_its_memory_back(spark, worker, stage):
    word = F.element_at(F.array(*[F.lit(x) for x in ("the ", "of ", "and ")]), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = lambda n: spark.range(0, n, 1, 1).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.concat(F.repeat(word, 600), "doc_id").alias("text"), F.lit("en").alias("lang")
    )
    bench = spark.createDataFrame([(1, "a text of some words that no document here has")], "item_id long, text string")
    run = {
        "language": lambda d: language_id.score(d, language_id.train(d), d.columns),
        "digests": lambda d: jaccard_join.digests(d, 5),
        "leaks": lambda d: decontaminate.find_leaks(d, bench),
    }[stage]
    run(docs(10)).write.format("noop").mode("overwrite").save()
    before = worker()
    run(docs(9000)).write.format("noop").mode("overwrite").save()
    assert worker() - before < 15


def test_slices_are_whole():
    batches = [pa.record_batch({"x": list(range(a, a + n))}) for a, n in ((0, 0), (0, 3000), (3000, 1024), (4024, 1))]
    found = list(common.slices(batches))
    assert max(b.num_rows for b in found) <= common.ROWS
    assert [x for b in found for x in b["x"].to_pylist()] == list(range(4025))

"""Corpus preparation: five stages over ``documents``, from raw rows to token shards.

1. language_id: documents without a letter go, as do those whose language is less sure than
   ``MIN_SCORE``. A posterior is near 1 for all but very short texts, so in practice only the
   former go: text in a language that was never learned stays, as one of the learned ones.
2. near_duplicates: of every group linked by five-word shingles at a similarity of
   0.8 or more, the document with the smallest id stays. Rows that share an id are one
   document only if their texts are equal as well; of near copies with one id, one stays.
3. decontaminate: documents with a window that is a near copy of a benchmark item go.
4. mix: documents in the order in which the slots of the source mix read them, as often as
   they are read; a source's last document may be read in part, from its start.
5. token_ids: sequences of token ids get a training order and are written to shards;
   the index of the shards comes back.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. Rows whose id is null pass stages 2 and 3, whose decisions name ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, jaccard_join, language_id, mixing, training_order

MIN_SCORE = 0.5
WIDTH, PERCENT = 5, 80


def small(df: DataFrame) -> DataFrame:
    """A staged table of ids, marked for broadcasting if it is small."""
    df = common.stage(df, "pipeline-ids")
    return F.broadcast(df) if df.count() <= jaccard_join.BROADCAST_IDS else df


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~common.held_out("doc_id", 4)))
    columns = docs.columns
    scored = language_id.score(docs, model, columns)
    found = F.col("lang_pred"), F.col("score")
    # the prediction's columns come last; the caller's may have the same names
    renamed = scored.toDF(*[f"c{k}" for k in range(len(columns))], "lang_pred", "score")
    kept = renamed.where((found[0] != language_id.UNKNOWN) & (found[1] >= MIN_SCORE))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.row_components(docs, WIDTH, PERCENT).where("doc_id IS NOT NULL")
    gone = groups.where("component_id != doc_id OR component_row != row").select(
        F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")
    ).distinct()
    kept = docs.join(
        small(gone),
        (F.col("doc_id") == F.col("gone_id")) & (jaccard_join.row_name() == F.col("gone_row")),
        "left_anti",
    ).select(*docs.columns)
    # of equal rows one stays
    again = small(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(small(leaks.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = small(mixing.readings(docs))
    rows = docs.select(mixing.row_name(docs).alias("row"), F.struct(*docs.columns).alias("doc"))
    # rows that are alike in all columns are read as often as the plan says in all
    again = small(plan.groupBy("row").agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a != b").select("row"))
    if not again.isEmpty():
        rows = rows.join(again, "row", "left_anti").unionByName(
            rows.join(again, "row", "left_semi").dropDuplicates(["row"])
        )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = rows.join(plan, "row").repartitionByRange(n, "slot", "row").sortWithinPartitions("slot", "row")
    text = F.when(F.col("words") < F.col("size"), mixing.first_words(F.col("doc.text"), F.col("words"))).otherwise(
        F.col("doc.text")
    )
    columns = {c: F.col(f"doc.{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return read.select(*[columns[c].alias(c) for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_order.materialise(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("token_ids", write_token_ids),
]

#: Trained and tokenised stages have no SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

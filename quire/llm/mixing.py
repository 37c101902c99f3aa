"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream of words: its documents in a seeded hash order, cut into
blocks of ``block_words`` words. Golden-ratio points, mapped through the
cumulative quotas, decide which source fills each slot of the mix; the r-th slot
of a source reads its r-th block, beginning again after the last one. All of it
is DataFrame code.

Scale. No step needs the rows of a source together: running sums and ranks are
taken inside bounded buckets (hash prefixes, chunks of slots), whose totals are
summed in small tables, so a source with a third of all rows spreads over the
cluster. The only table ordered as a whole has a row per source.

Defined results: null or blank text has size 0 and takes nothing; a null source
is a source of its own, the last; repeated rows and repeated ids are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 4096
SEED = "mix-1"
GOLDEN = 0.6180339887498949
CHUNK = 65536


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Water-filled targets. ``sizes``: src_key, source_size, a row per source."""
    n = len(weights)
    # src_key is '0' + source, or '1' for null: null comes last.
    ranked = sizes.withColumn("rn", F.row_number().over(Window.orderBy("src_key")))
    weighed = ranked.select(
        "src_key",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.col("rn") - 1) % n + 1).alias("w"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    ).withColumn("ratio", F.col("most") / F.col("w"))
    whole = Window.partitionBy()
    before = (
        Window.orderBy("ratio", "src_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    level = weighed.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("goal"),
        F.sum("w").over(whole).alias("w_all"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    ).withColumn(
        "level",
        (F.col("goal") - F.col("most_before")) / (F.col("w_all") - F.col("w_before")),
    )
    # Sources are full up to the first whose cap lies above its water level.
    first = F.min(
        F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "src_key", "level"))
    ).over(whole)
    return level.select(
        "src_key",
        "source_size",
        F.when(
            first.isNull() | (F.struct("ratio", "src_key") < F.struct(first["ratio"], first["src_key"])),
            F.col("most"),
        )
        .otherwise(F.col("w") * first["level"])
        .alias("target"),
    )


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: src_key, block, take (words of the block), slot, turn (how often the
    source was read through before).

    ``plan``: src_key, source_size, target. A source has as many slots as its
    target fills; the last one may take only the start of its block.
    """
    spark = plan.sparkSession
    size, b = F.col("source_size"), F.lit(block_words)
    quota = (
        plan.where("source_size > 0")
        .withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
        .where("words > 0")
        .withColumn("blocks", F.ceil(size / b).cast("long"))
        .withColumn("rest", F.col("words") % size)
        .withColumn(
            "quota",
            F.expr("words div source_size") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"),
        )
        .withColumn(
            "hi",
            F.sum("quota").over(
                Window.orderBy("src_key").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn("lo", F.col("hi") - F.col("quota"))
    )
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    cell = max(1, total // 4096)
    ranges = quota.select(
        "src_key", "lo", "hi", "quota",
        F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"),
    )
    points = spark.range(total).select(
        F.col("id").alias("slot"),
        # (j * golden) mod 1, spread over the slots
        F.least(
            F.floor((F.col("id") * F.lit(GOLDEN)) % 1.0 * F.lit(float(total))), F.lit(max(0, total - 1))
        ).cast("long").alias("x"),
    ).withColumn("cell", F.expr(f"x div {cell}"))
    drawn = points.join(ranges, "cell").where("x >= lo AND x < hi").select(
        "src_key", "slot", F.expr(f"slot div {CHUNK}").alias("chunk")
    )
    counts = drawn.groupBy("src_key", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select(
        "src_key", "chunk",
        F.coalesce(
            F.sum("n").over(
                Window.partitionBy("src_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("start"),
    )
    ranked = (
        drawn.withColumn(
            "r", F.row_number().over(Window.partitionBy("src_key", "chunk").orderBy("slot")) - 1
        )
        .join(starts, ["src_key", "chunk"])
        .select("src_key", "slot", (F.col("r") + F.col("start")).alias("rank"))
    )
    # The points miss a quota by a few slots at most; those are appended.
    have = counts.groupBy("src_key").agg(F.sum("n").alias("n"))
    missing = (
        quota.join(have, "src_key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where("n < quota")
        .select("src_key", F.explode(F.expr("sequence(n, quota - 1)")).alias("rank"), "lo")
        .select("src_key", (F.lit(total) + F.col("lo") + F.col("rank")).alias("slot"), "rank")
    )
    return (
        ranked.unionByName(missing)
        .join(quota, "src_key")
        .where("rank < quota")
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("turn", F.expr("rank div blocks"))
        .withColumn("start", F.col("turn") * size + F.col("block") * b)
        .select("src_key", "block", "slot", F.least(b, F.col("words") - F.col("start")).alias("take"), "turn")
    )


def row_name(docs: DataFrame) -> Column:
    """A 64-bit name of all that a row holds."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*names, *map(F.isnull, names))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        row_name(docs).alias("row"),
        F.monotonically_increasing_id().alias("rk"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(common.words(F.col(text_col))).cast("long").alias("size"),
    ).withColumn(
        "src_key", F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    )


def order_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), common.key_text("doc_id")).cast("binary"))


def read_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents' parts in blocks with the slots that read them, and the sources' targets.

    Parts: rk (of a document), row, doc_id, source, src_key, size, read (words of the part that
    a slot takes), slot and turn (null where no slot reads the block)."""
    base = common.stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sizes = base.groupBy("src_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = max(2, math.ceil(math.log(max(rows, 1) / 20_000 + 1, 16)) + 1)
    plan = common.stage(targets(sizes.drop("n"), weights, share, cap), "mix-targets")

    keyed = base.withColumn("h", order_key(seed)).withColumn("bucket", F.substring("h", 1, digits))
    within = Window.partitionBy("src_key", "bucket").orderBy("h", "doc_id", "size", "rk")
    offsets = keyed.groupBy("src_key", "bucket").agg(F.sum("size").alias("words")).select(
        "src_key", "bucket",
        F.coalesce(
            F.sum("words").over(
                Window.partitionBy("src_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("offset"),
    )
    placed = (
        keyed.withColumn(
            "upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
        )
        .join(offsets, ["src_key", "bucket"])
        .withColumn("a", F.col("offset") + F.col("upto") - F.col("size"))
    )
    # Blank documents get block numbers that no slot has, spread over many.
    pieces = placed.select(
        "rk", "row", "doc_id", "source", "src_key", "size", "a",
        F.explode(
            F.when(
                F.col("size") > 0,
                F.sequence(F.expr(f"a div {block_words}"), F.expr(f"(a + size - 1) div {block_words}")),
            ).otherwise(F.array(-1 - F.pmod("rk", F.lit(4096))))
        ).alias("block"),
    ).select(
        "rk", "row", "doc_id", "source", "src_key", "size", "block",
        F.greatest(F.lit(0), F.col("a") - F.col("block") * block_words).alias("low"),
        F.least(F.lit(block_words), F.col("a") + F.col("size") - F.col("block") * block_words).alias("high"),
    )
    # least() skips nulls: a block without a slot must read as 0
    read = F.greatest(F.lit(0), F.least("high", F.coalesce("take", F.lit(0))) - F.col("low"))
    parts = pieces.join(schedule(plan, block_words), ["src_key", "block"], "left").select(
        "rk", "row", "doc_id", "source", "src_key", "size", read.alias("read"), "slot", "turn"
    )
    return parts, plan


def readings(docs: DataFrame, **options) -> DataFrame:
    """A row for every time that the mix reads a document: rk, row (names of it and of what it
    holds), size, words (read of it, from its start; fewer than its size only the last time) and slot (that
    reads its first words). Options as for ``read_pieces``."""
    parts, _ = read_pieces(docs, **options)
    return (
        parts.where("read > 0")
        .groupBy("rk", "row", "size", "turn")
        .agg(F.sum("read").alias("words"), F.min("slot").alias("slot"))
        .select("rk", "row", "size", "words", "slot")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, first_slot.

    taken: words of it that the mix reads, repeats counted, at most ``cap`` times
    its size; first_slot: the slot that reads it first, null if none does. Options as for
    ``read_pieces``.
    """
    parts, plan = read_pieces(docs, **options)
    taken = parts.groupBy("rk", "doc_id", "source", "src_key", "size").agg(
        F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("taken"),
        F.min(F.when(F.col("read") > 0, F.col("slot"))).alias("first_slot"),
    )
    return taken.join(plan, "src_key").select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"),
        "target", "taken", "first_slot",
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = rf"""
WITH base AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM base GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(rn - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS most FROM sizes),
level AS (
  SELECT *, most / w AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE
            - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY most / w, rn) AS k
  FROM weighed
  WINDOW before AS (ORDER BY most / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM level WHERE ratio > level),
plan AS (
  SELECT source, source_size,
         CASE WHEN cut.k IS NULL OR level.k < cut.k THEN most ELSE w * cut.level END AS target
  FROM level, cut),
placed AS (
  SELECT b.doc_id, b.source, b.size, p.source_size, p.target, CAST(floor(p.target + 0.5) AS BIGINT) AS words,
         CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - b.size AS a
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source),
quota AS (
  SELECT *, sum(quota) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
  FROM (SELECT source, (words // source_size) * ((source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS})
               + (words % source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} AS quota
        FROM (SELECT source, source_size, CAST(floor(target + 0.5) AS BIGINT) AS words FROM plan)
        WHERE source_size > 0 AND words > 0)),
points AS (
  SELECT j, least(floor(((j * '{GOLDEN}'::DOUBLE) % 1.0::DOUBLE) * n), n - 1) AS x
  FROM (SELECT CAST(sum(quota) AS BIGINT) AS n FROM quota), LATERAL (SELECT unnest(range(n)) AS j)),
drawn AS (
  SELECT source, j AS slot, row_number() OVER (PARTITION BY source ORDER BY j) - 1 AS rank
  FROM points JOIN quota ON x >= hi - quota AND x < hi),
slots AS (
  SELECT source, slot, rank FROM drawn
  UNION ALL
  SELECT q.source, (SELECT sum(quota) FROM quota) + hi - quota + r.rank, r.rank
  FROM (SELECT *, (SELECT count(*) FROM drawn d WHERE d.source IS NOT DISTINCT FROM quota.source) AS have FROM quota) q,
       LATERAL (SELECT unnest(range(CAST(q.have AS BIGINT), CAST(q.quota AS BIGINT))) AS rank) r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
            + greatest(0, least(size, words % source_size - a)) END AS BIGINT) AS taken,
       CAST(s.slot AS BIGINT) AS first_slot
FROM placed p
LEFT JOIN slots s ON p.size > 0 AND p.a < p.words AND s.source IS NOT DISTINCT FROM p.source
                 AND s.rank = p.a // {BLOCK_WORDS}
"""

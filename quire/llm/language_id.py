"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to ``MAX_N`` code points of the lower-cased letters,
runs of anything else counting as one space) per language over all labelled
training rows: every task sends its bucket counts, Spark adds them. The matrix
of log-probabilities, languages x ``BUCKETS`` doubles, is broadcast; its size is
bounded by ``MAX_LANGUAGES``, beyond which training refuses. Scoring handles a
batch at a time: hashed n-grams are entries of a sparse document x bucket
matrix, multiplied with the log-probabilities by gathering and segmented sums.

Defined results: null text, or text without a letter, gives ``und`` and score 0;
so does everything if nothing can be learned; equal scores go to the language
first in order of code points; rows with null language are never learned from;
repeated rows count as often as they occur; other columns are kept aside, so
their names cannot clash.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

BUCKETS = 1 << 14
MAX_N = 3
SMOOTH = 0.5
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Code points handled at once; a longer text is summed piece by piece.
PIECE = 1 << 18

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, bool)
        for c in range(sys.maxunicode + 1):
            table[c] = unicodedata.category(chr(c))[0] == "L"
        _letters = table
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text each belongs to, and the texts' letters.

    The texts lie end to end, parted by a space, so no n-gram with letters of two
    texts counts: those that reach over a border are dropped.
    """
    n = len(texts)
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(n), [len(c) + 2 for c in coded])
    space = np.full(1, 32, np.uint32)
    code = np.concatenate([x for c in coded for x in (space, c, space)]) if n else space[:0]
    letter = letters()[code]
    found = np.bincount(owner[letter], minlength=n)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stands for a space
    keep[:1] = True
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep |= first
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    owner = owner[keep]
    letter = letter[keep]
    hashes, owners = [], []
    rolled = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, MAX_N + 1):
            m = len(code) - k + 1
            if m <= 0:
                break
            rolled = rolled[:m] * np.uint64(0x100000001B3) + code[k - 1 :]
            mixed = (rolled + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            bucket = (mixed >> np.uint64(50)).astype(np.int64)
            whole = owner[:m] == owner[k - 1 :]
            if k == 1:
                whole &= letter
            hashes.append(bucket[whole])
            owners.append(owner[:m][whole])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), found
    return np.concatenate(hashes), np.concatenate(owners), found


def pieces(texts, limit: int = PIECE):
    """Texts in runs of about ``limit`` code points, as (row, part) pairs; a long
    text is cut at any place, whole texts are covered."""
    run, held = [], 0
    for i, t in enumerate(texts):
        t = t or ""
        for a in range(0, max(len(t), 1), limit):
            run.append((i, t[a : a + limit]))
            held += len(run[-1][1]) + 2
            if held >= limit:
                yield run
                run, held = [], 0
    if run:
        yield run


def train(docs: DataFrame, text_col="text", lang_col="lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of code points, and prior + log-probabilities (last column:
    the log prior), from all rows of ``docs`` with text and language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            langs = batch["lang"].to_pylist()
            for run in pieces(batch["text"].to_pylist()):
                bucket, owner, _ = grams([t for _, t in run])
                names = sorted({langs[i] for i, _ in run})
                code = np.array([names.index(langs[i]) for i, _ in run])
                sums = np.bincount(code[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for name, s in zip(names, sums.reshape(len(names), BUCKETS), strict=True):
                    total[name] = total.get(name, 0) + s
            for name, rows in Counter(langs).items():
                held = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                if len(held) == BUCKETS:
                    held = total[name] = np.append(held, 0)
                held[BUCKETS] += rows
            for name, v in total.items():
                where = np.flatnonzero(v)
                yield name, where, v[where]
            total = {}

    def add(batches):
        """Sums of a task, so that it sends a row per language and bucket."""
        total: dict[str, np.ndarray] = {}
        for name, bucket, n in count(batches):
            if len(bucket):
                held = total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                held[bucket] += n
                if len(total) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, v in total.items():
            where = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(where), pa.string()), pa.array(where), pa.array(v[where])],
                names=["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    sums = (
        rows.mapInArrow(common.lean(add), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
        # packed, as two arrays of numbers per language
        .select("lang", F.col("cells.bucket").alias("bucket"), F.col("cells.n").alias("n"))
        .limit(MAX_LANGUAGES + 1)
        .toPandas()
        .sort_values("lang", key=lambda s: s.map(lambda x: x.encode("utf-8", "surrogatepass")))
    )
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sums["lang"].tolist()
    table = np.zeros((len(names), BUCKETS + 1))
    for i, (bucket, n) in enumerate(zip(sums["bucket"], sums["n"], strict=True)):
        table[i, bucket] = n
    if not names:
        return names, table
    seen, docs_of = table[:, :BUCKETS], table[:, BUCKETS:]
    logs = np.log(seen + SMOOTH) - np.log(seen.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    prior = np.log(docs_of + 1) - np.log(docs_of.sum() + len(names))
    return names, np.hstack([logs, prior])


def score(docs: DataFrame, model, id_cols: list[str], text_col="text") -> DataFrame:
    """``id_cols`` of every row with lang_pred and score (0 to 1)."""
    names, table = model
    held = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(table.T)))
    n_ids = len(id_cols)
    # positional names, so that no column of the caller can clash
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"id{k}") for k, c in enumerate(id_cols)],
        *([] if text_col in id_cols else [F.col(text_col).alias("text")]),
    )
    text = f"id{id_cols.index(text_col)}" if text_col in id_cols else "text"

    def predict(batches):
        names, logs = held.value
        order = np.array([*names, UNKNOWN], object)
        for batch in common.slices(batches):
            n = batch.num_rows
            sums = np.zeros((n, len(names)))
            found = np.zeros(n, np.int64)
            for run in pieces(batch[text].to_pylist()):
                row = np.array([i for i, _ in run])
                bucket, owner, letter = grams([t for _, t in run])
                np.add.at(found, row, letter)
                for k in range(len(names)):
                    part = np.bincount(owner, weights=logs[bucket, k], minlength=len(run))
                    np.add.at(sums[:, k], row, part)
            best, sure = np.full(n, len(names)), np.zeros(n)
            if names:
                sums += logs[BUCKETS]
                top = sums.max(1)
                known = found > 0
                best[known] = sums.argmax(1)[known]
                sure[known] = (1 / np.exp(sums - top[:, None]).sum(1))[known]
            # the caller's columns stay in Arrow, so that null and large ids are not changed
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_ids], pa.array(order[best], pa.string()), pa.array(sure)],
                names=[*batch.schema.names[:n_ids], "lang_pred", "score"],
            )

    kinds = ", ".join(f"id{k} {dict(rows.dtypes)[f'id{k}']}" for k in range(n_ids))
    done = rows.mapInArrow(common.lean(predict), f"{kinds}, lang_pred string, score double")
    return done.select(*[F.col(f"id{k}").alias(c) for k, c in enumerate(id_cols)], "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(
        "doc_id", "text", "lang", common.held_out("doc_id", 4).alias("held_out")
    )
    model = train(docs.where("NOT held_out"))
    return score(docs, model, ["doc_id", "held_out"])

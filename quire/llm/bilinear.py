"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts. All training tokens are counted exactly, by 64-bit hashes of the words;
every text also ends in an end token. The counts stay distributed, however many
words there are; the most frequent, ``DICTIONARY`` at most, go to all tasks (24
bytes each), and the scores' sums over rarer words come from a join, on words
that are rare by construction, so no key of it is hot.

Model. The log-bilinear network predicts *units*: the end token, the most frequent
words, and classes of all other words by their last two bytes. The context
vector is the sum of the ``ORDER`` preceding units' vectors, each scaled by its
position's weights; a unit's score is its product with the context vector plus a
bias. P(word) is the softmax over all units - batched matrix products normalise
every token - times, for a class, (c + 1) / (N_class + V_class + 1).

Training runs over every training token: each task starts from the same
parameters, makes a pass of AdaGrad over its rows with noise-contrastive
estimation (``NOISE`` unigram samples shared by a minibatch), and the tasks'
parameters are averaged, weighted by tokens. The averages are sums per parameter
row, added in Spark; the driver sees one model of fixed size.

Defined results: null text counts as empty, with the end token only; a null
doc_id counts as '' for the split; an empty training set gives a uniform model
with N = V = 0; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

WORDS = 127
CLASSES = 128
UNITS = 1 + WORDS + CLASSES  # unit 0 is the end
START = UNITS  # only ever a context
ORDER = 4
DIM = 16
NOISE = 32
BATCH = 1024
RATE = 0.3
DICTIONARY = 1 << 18
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 20
#: Words scored or trained on at once.
CHUNK = 1 << 16
LN10 = np.log(10.0)


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and last two bytes of every word."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    hashes = common.word_hashes(data).view(np.int64)
    code = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = common._is_blank[code]
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    last, before = code[ends].astype(np.int32), code[ends - 1].astype(np.int32)
    before[blank[ends - 1]] = 0
    return hashes, before * 256 + last


def runs(texts, limit: int = CHUNK):
    """Consecutive texts of about ``limit`` words in all: (rows, hashes, suffixes, lengths)."""
    rows, hs, ss, held = [], [], [], 0
    for i, text in enumerate(texts):
        h, s = tokens(text)
        rows.append(i)
        hs.append(h)
        ss.append(s)
        held += len(h) + 1
        if held >= limit:
            yield np.array(rows), np.concatenate(hs), np.concatenate(ss), np.array([len(h) for h in hs])
            rows, hs, ss, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.concatenate(hs), np.concatenate(ss), np.array([len(h) for h in hs])


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), suffix, n: how often every word occurs in the texts."""

    def merged(parts):
        h, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, s, n = h[order], s[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], s[first], np.add.reduceat(n, first)

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for _, h, s, _ in runs(batch["text"].tolist(), 1 << 19):
                if len(h):
                    parts.append(merged([(h, s, np.ones(len(h), np.int64))]))
                    held += len(parts[-1][0])
                if held >= 2 * HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held >= HELD:
                        yield pd.DataFrame(dict(zip(("word", "suffix", "n"), parts[0], strict=True)))
                        parts, held = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("word", "suffix", "n"), merged(parts), strict=True)))

    return (
        docs.select("text")
        .mapInPandas(count, "word long, suffix int, n long")
        .groupBy("word")
        .agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"))
    )


class Vocabulary:
    """The bounded tables that tasks need: frequent words, units and classes."""

    def __init__(self, frequent: pd.DataFrame, suffixes: pd.DataFrame, n_docs: int):
        self.total = int(suffixes["n"].sum()) + n_docs
        self.types = int(suffixes["types"].sum()) + (n_docs > 0)
        self.n_docs = n_docs
        listed = frequent.iloc[:WORDS]
        n_of = suffixes.set_index("suffix")["n"].to_dict()
        types_of = suffixes.set_index("suffix")["types"].to_dict()
        for s, n in zip(listed["suffix"].tolist(), listed["n"].tolist(), strict=True):
            n_of[s] -= n
            types_of[s] -= 1
        order = sorted(n_of, key=lambda s: (-n_of[s], s))[: CLASSES - 1]
        self.class_of = np.full(1 << 16, UNITS - 1, np.int16)
        self.class_of[order] = 1 + WORDS + np.arange(len(order))
        size = np.zeros((2, UNITS))
        for s in n_of:
            size[:, self.class_of[s]] += n_of[s], types_of[s]
        self.class_log = np.log(size[0] + size[1] + 1)  # 0 but for classes
        by = frequent.sort_values("word")
        self.words = by["word"].to_numpy(np.int64)
        self.count_log = np.log1p(by["n"].to_numpy(np.float64))
        self.unit = self.class_of[by["suffix"].to_numpy(np.int64)]
        at = np.searchsorted(self.words, listed["word"].to_numpy(np.int64))
        self.unit[at] = 1 + np.arange(len(listed))
        counts = size[0].copy()
        counts[0] = n_docs
        counts[1 : 1 + len(listed)] = listed["n"]
        self.unigram = (counts + 0.5) / (counts + 0.5).sum()

    def look_up(self, hashes, suffixes):
        """Unit of every word, and its place in the dictionary or -1."""
        if not len(self.words):
            return self.class_of[suffixes], np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        found = self.words[at] == hashes
        return np.where(found, self.unit[at], self.class_of[suffixes]), np.where(found, at, -1)


def sequence(units: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with an end after every text, and the contexts: ORDER columns, nearest first."""
    ends = np.cumsum(lengths + 1) - 1
    out = np.zeros(len(units) + len(lengths), np.int16)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = units
    place = np.arange(len(out)) - np.repeat(ends - lengths, lengths + 1)
    context = np.full((ORDER, len(out)), START, np.int16)
    for k in range(ORDER):
        has = place > k
        context[k, has] = out[np.flatnonzero(has) - k - 1]
    return out, context


class Model:
    """Parameters of the network: rows R (contexts), Q (outputs), C (positions), b."""

    NAMES = ("R", "Q", "C", "b")

    def __init__(self, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.R = rng.normal(0, 0.1, (UNITS + 1, DIM)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32)
        self.C = np.full((ORDER, DIM), 1.0, np.float32)
        self.b = np.log(unigram).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def predicted(self, context: np.ndarray) -> np.ndarray:
        q = self.R[context[0]] * self.C[0]
        for k in range(1, ORDER):
            q += self.R[context[k]] * self.C[k]
        return q

    def log_probabilities(self, out: np.ndarray, context: np.ndarray, step: int = 2048) -> np.ndarray:
        """Natural log of the normalised probability of each unit in its context."""
        result = np.empty(len(out))
        turned = np.ascontiguousarray(self.Q.T)
        for a in range(0, len(out), step):
            s = self.predicted(context[:, a : a + step]) @ turned
            s += self.b
            np.clip(s, -60, 60, out=s)
            own = s[np.arange(len(s)), out[a : a + step]].astype(np.float64)
            np.exp(s, out=s)
            result[a : a + step] = own - np.log(s.sum(1, dtype=np.float64))
        return result


class Trainer:
    """AdaGrad on the noise-contrastive loss."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng, self.seen = model, np.random.default_rng(seed), 0
        self.past = {n: np.full_like(getattr(model, n), 1.0) for n in Model.NAMES}
        self.log_noise = np.log(NOISE * model.unigram).astype(np.float32)
        self.cumulative = np.cumsum(model.unigram)

    def _step(self, name: str, rows, gradient) -> None:
        past, values = self.past[name], getattr(self.m, name)
        past[rows] += gradient * gradient
        values[rows] -= RATE * gradient / np.sqrt(past[rows])

    @staticmethod
    def _sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        return index[first], np.add.reduceat(values[order], first, axis=0)

    def learn(self, out: np.ndarray, context: np.ndarray) -> None:
        order = self.rng.permutation(len(out))
        out, context = out[order], context[:, order]
        for a in range(0, len(out), BATCH):
            self._batch(out[a : a + BATCH], context[:, a : a + BATCH])
        self.seen += len(out)

    def _batch(self, out, context) -> None:
        m, n = self.m, len(out)
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE)).clip(0, UNITS - 1)
        rows = [m.R[c] for c in context]
        q = sum(r * m.C[k] for k, r in enumerate(rows))
        wanted, unwanted = m.Q[out], m.Q[noise]
        own = (q * wanted).sum(1) + m.b[out] - self.log_noise[out]
        other = q @ unwanted.T + (m.b[noise] - self.log_noise[noise])
        g_own = -1 / (1 + np.exp(np.clip(own, -30, 30)))
        g_other = 1 / (1 + np.exp(-np.clip(other, -30, 30)))
        scale = np.float32(1 / np.sqrt(n))
        g_own, g_other = (g_own * scale).astype(np.float32), (g_other * scale).astype(np.float32)
        dq = g_own[:, None] * wanted + g_other @ unwanted
        index = np.concatenate([out, noise])
        r, g = self._sum_rows(
            index,
            np.concatenate(
                [
                    np.concatenate([g_own[:, None] * q, g_own[:, None]], 1),
                    np.concatenate([g_other.T @ q, g_other.sum(0)[:, None]], 1),
                ]
            ),
        )
        d_c = np.stack([(dq * x).sum(0) for x in rows])
        r_all = np.concatenate(list(context))
        r_in, g_in = self._sum_rows(r_all, np.concatenate([dq * m.C[k] for k in range(ORDER)]))
        self._step("Q", r, g[:, :DIM])
        self._step("b", r, g[:, DIM])
        self._step("R", r_in, g_in)
        self._step("C", slice(None), d_c)


def fit(docs: DataFrame, vocabulary: Vocabulary, passes: int = 1) -> Model:
    """``passes`` over all rows of ``docs``, averaged over its tasks; each batch of rows is
    gone over so many times in turn."""
    model = Model(vocabulary.unigram)
    if not vocabulary.total:
        return model
    held = common.Shared(docs.sparkSession, (vocabulary, model))

    def learn(batches):
        from pyspark import TaskContext

        vocabulary, model = held.value
        own = Model(model.unigram)
        own.set_flat(model.flat())
        trainer = Trainer(own, TaskContext.get().partitionId())
        for batch in batches:
            for _, h, s, lengths in runs(batch["text"].tolist()):
                units, _ = vocabulary.look_up(h, s)
                for _ in range(passes):
                    trainer.learn(*sequence(units, lengths))
        if trainer.seen:
            # AdaGrad's sums weigh a parameter by what the task has learned of it
            past = np.concatenate([trainer.past[n].ravel() for n in Model.NAMES]).astype(np.float64)
            yield pd.DataFrame(
                {"parameter": np.arange(len(past)), "value": own.flat() * past, "weight": past}
            )

    sums = (
        docs.select("text")
        .mapInPandas(learn, "parameter int, value double, weight double")
        .groupBy("parameter")
        .agg((F.sum("value") / F.sum("weight")).alias("value"))
        .toPandas()
        .sort_values("parameter")
    )
    model.set_flat(sums["value"].to_numpy())
    return model


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    held = common.Shared(docs.sparkSession, (vocabulary, model))
    kind = dict(docs.dtypes)["doc_id"]

    def evaluate(batches):
        from pyspark import TaskContext

        v, m = held.value
        row = TaskContext.get().partitionId() << 33
        norm = np.log(v.total + v.types + 1)
        for batch in batches:
            ids = batch["doc_id"]
            outside = batch["held_out"]
            for at, h, s, lengths in runs(batch["text"].to_pylist()):
                n = len(at)
                units, place = v.look_up(h, s)
                owner = np.repeat(np.arange(n), lengths)
                known = place >= 0
                logs = np.where(known, v.count_log[place] if len(v.words) else 0.0, 0.0)
                out, context = sequence(units, lengths)
                lp = m.log_probabilities(out, context)
                tokens_of = np.repeat(np.arange(n), lengths + 1)
                full = np.bincount(tokens_of, lp, n)
                total = np.bincount(owner, logs, n)
                # classes share their mass among their words
                inside = units > WORDS
                full += np.bincount(owner[inside], (logs - v.class_log[units])[inside], n)
                base = total + np.log1p(v.n_docs) - (lengths + 1) * norm
                keys = row + np.arange(n)
                row += n
                yield ids.take(pa.array(at)), [
                    keys, common.mix64(keys.astype(np.uint64)).view(np.int64), np.zeros(n, np.int64),
                    outside.take(pa.array(at)), lengths + 1,
                    np.bincount(owner[known], minlength=n) + (v.n_docs > 0), base, full,
                ]
                rare = ~known
                if rare.any():
                    o, w = owner[rare], h[rare]
                    order = np.lexsort((w, o))
                    o, w = o[order], w[order]
                    first = np.flatnonzero(
                        np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])])
                    )
                    k = len(first)
                    none = np.zeros(k, np.int64)
                    yield pa.nulls(k, ids.type), [
                        keys[o[first]], w[first], np.diff(np.append(first, len(o))),
                        pa.nulls(k, pa.bool_()), none, none, np.zeros(k), np.zeros(k),
                    ]

    parts = common.map_ids(
        docs, evaluate,
        f"doc_id {kind}, row long, word long, tf long, held_out boolean, n_tokens long, known long, base double, full double",
    )
    gain = F.col("tf") * F.log(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    return (
        parts.join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("known") + F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
            F.lit(vocabulary.total).cast("long").alias("train_tokens"),
            ((F.sum("base") + F.sum(gain)) / float(LN10)).alias("base_score"),
            ((F.sum("full") + F.sum(gain)) / float(LN10)).alias("score"),
        )
        .drop("row")
    )


def most_frequent(counts: DataFrame, limit: int = DICTIONARY) -> pd.DataFrame:
    """Words above the least frequency that at most ``limit`` words reach, to about 1 %.

    A sorted limit would send so many rows of every partition to the driver; here it gets
    a histogram of at most 64 bins a doubling, and then the words."""
    level = F.floor(F.log2("n") * 64)
    held, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > limit:
            break
        least = row["level"]
    kept = counts.where(F.lit(False) if least is None else level >= least).toPandas()
    return kept.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def learn(docs: DataFrame, passes: int = 1) -> tuple[DataFrame, Vocabulary, Model]:
    """Word counts (distributed), vocabulary and model of the rows not held out."""
    train = docs.where("NOT held_out").select("text")
    counts = common.stage(count_words(train), "lm-counts")
    n_docs = train.count()
    frequent = most_frequent(counts)
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    vocabulary = Vocabulary(frequent, suffixes, n_docs)
    return counts, vocabulary, fit(train, vocabulary, passes)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(
        "doc_id", "text", common.held_out("doc_id", 7).alias("held_out")
    )
    return score(docs, *learn(docs))

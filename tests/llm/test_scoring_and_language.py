import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import bilinear, common, language_id

EN = "the of and to in that it is was for on with as by at this from".split()
DE = "der die das und ist nicht ein eine zu von mit auf für sich dem über".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def corpus(odd):
    rows = [(10 + i, prose(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de", "s") for i in range(60)]
    return odd + rows + rows[:3]


def test_word_hashes_follow_words():
    a = common.word_hashes("one  two\none\té x".encode())
    assert len(a) == 5 and a[0] == a[2] and len(set(a.tolist())) == 4
    assert len(common.word_hashes(b"")) == 0 == len(common.word_hashes(b" \n"))
    long = " ".join(f"w{i}" for i in range(90_000)).encode()
    assert (common.word_hashes(long) == np.concatenate([common.word_hashes(w) for w in long.split()])).all()


def test_base_scores_match_brute_force_and_model_is_better(make, odd):
    rows = corpus(odd)
    docs = make(rows).select("doc_id", "text", common.held_out("doc_id", 7).alias("held_out"))
    out = bilinear.score(docs, *bilinear.learn(docs, passes=60)).collect()
    assert len(out) == len(rows)
    outside = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in rows}
    c = Counter(w for i, *_ in rows if not outside[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    better = []
    for r in out:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(c[w] > 0 for w in tokens[r.doc_id]))
        assert r.train_tokens == n and r.held_out == outside[r.doc_id]
        if r.held_out and r.n_tokens > 9:
            better.append(r.score > r.base_score)
    assert better and sum(better) > 0.9 * len(better)


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    m = bilinear.Model(np.full(bilinear.UNITS, 1 / bilinear.UNITS))
    m.Q = rng.normal(0, 1, m.Q.shape).astype(np.float32)
    context = rng.integers(0, bilinear.UNITS + 1, (bilinear.ORDER, 1)).astype(np.int16)
    every = np.arange(bilinear.UNITS)
    lp = m.log_probabilities(every, np.repeat(context, len(every), 1))
    assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_scoring_without_training_rows(make, odd):
    docs = make(odd).select("doc_id", "text", F.lit(True).alias("held_out"))
    for r in bilinear.score(docs, *bilinear.learn(docs)).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0
    none = make([]).select("doc_id", "text", F.lit(False).alias("held_out"))
    assert bilinear.score(none, *bilinear.learn(none)).count() == 0


def test_language_on_held_out(make, odd):
    rows = corpus(odd) + [(900, "der " * 200_000, "de", "s"), (901, "123 !!", "en", "s")]
    docs = make(rows).withColumn("held_out", common.held_out("doc_id", 4))
    model = language_id.train(docs.where("NOT held_out"))
    out = language_id.score(docs, model, ["doc_id", "held_out"]).toPandas()
    assert len(out) == len(rows)
    pred = dict(zip(out.doc_id, out.lang_pred, strict=True))
    assert all(pred[i] == "und" for i in (1, 2, 3, 901)) and pred[900] == "de"
    assert all(pred[i] == lang for i, _, lang, _ in rows if 10 <= i < 100)
    assert out.score.between(0, 1).all()


def test_language_with_nothing_to_learn(make, odd):
    docs = make(odd)
    model = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.score(docs, model, ["doc_id"]).collect()} == {"und"}
    kept = language_id.score(docs, model, docs.columns)
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == len(odd)

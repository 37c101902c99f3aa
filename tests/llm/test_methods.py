"""What each operator learns or schedules, against brute force or held-out data."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import bilinear, common, decision_list, decontaminate, language_id, mixing, personal_data

SF = "/root/testdata/sf0.001"


def test_naive_bayes_matches_brute_force(make, odd):
    r = random.Random(4)
    rows = odd + [(10 + i, "".join(r.choice("abc é1.") for _ in range(r.randint(1, 30))), r.choice(["x", "y", None]), "s") for i in range(60)]
    docs = make(rows)
    names, _ = model = language_id.train(docs)
    counts, priors = collections.defaultdict(collections.Counter), collections.Counter()

    def grams(text):
        kept, space = [" "], True
        for c in text.lower() + " ":
            if c.isalpha():
                kept.append(c)
                space = False
            elif not space:
                kept.append(" ")
                space = True
        s = "".join(kept)
        out = [s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)]
        return [g for g in out if g != " "]

    def bucket(gram):
        rolled = 0
        for c in gram:
            rolled = (rolled * 0x100000001B3 + ord(c)) % 2**64
        return ((rolled + len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> 50

    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            priors[lang] += 1
            counts[lang].update(map(bucket, grams(text)))
    assert names == sorted(priors)
    got = {x.doc_id: x for x in language_id.score(docs, model, ["doc_id"]).collect()}
    total = sum(priors.values()) + len(names)
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {}
        for name in names:
            size = sum(counts[name].values()) + language_id.SMOOTH * language_id.BUCKETS
            logs[name] = math.log((priors[name] + 1) / total) + sum(math.log((counts[name][bucket(g)] + language_id.SMOOTH) / size) for g in grams(text))
        best = max(names, key=lambda n: logs[n])
        assert got[i].lang_pred == best, (text, logs)
        assert math.isclose(got[i].score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-6)


def test_ties_go_to_the_first_language(make):
    docs = make([(1, "abc", "y", "s"), (2, "abc", "x", "s"), (3, "abc", None, "s")])
    out = language_id.score(docs, language_id.train(docs), ["doc_id"]).collect()
    assert {r.lang_pred for r in out} == {"x"} and all(abs(r.score - 0.5) < 1e-9 for r in out)


def test_model_beats_counts_on_held_out_rows_of_the_query(spark):
    rows = bilinear.op1_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out AND n_tokens > 50").select(
        F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")
    ).first()
    assert (rows.score - rows.base) / rows.n > 0.1  # in powers of ten per token


def test_expectation_maximisation_finds_reliabilities():
    r = np.random.default_rng(2)
    truth = r.random(4000) < 0.4
    right = (0.95, 0.9, 0.8, 0.7, 0.6)
    votes = np.stack([np.where(r.random(4000) < 0.2, 0, np.where((r.random(4000) < p) == truth, 1, -1)) for p in right], 1)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    at = at.ravel()
    posterior, likelihood = personal_data.estimate(patterns, np.bincount(at).astype(float))
    assert ((posterior[at] > 0.5) == truth).mean() > 0.93
    found = likelihood[:, 1, 2] / (likelihood[:, 1, 2] + likelihood[:, 1, 0])
    assert np.abs(found - right).max() < 0.06
    # a row for every pattern and none by chance: the order of the rows does not matter
    again, _ = personal_data.estimate(patterns[::-1], np.bincount(at).astype(float)[::-1])
    assert np.allclose(again[::-1], posterior)


def test_secrets_are_added_and_prose_is_not(make):
    r = random.Random(3)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{key()}" and more', None, None) for i in range(30)]
    rows += [(100 + i, "a word of_some_considerable_length_without any digits " * 3 + f"order {i} 12.5", None, None) for i in range(30)]
    docs = make(rows)
    model = personal_data.Classifier(personal_data.pattern_counts(docs))
    out = {x.doc_id: x for x in personal_data.find_spans(docs, model).collect()}
    for i, text, *_ in rows:
        if i < 100:
            assert [text[s.start : s.stop] for s in out[i].spans] == [text.split('"')[1]] and out[i].base == []
        else:
            assert out[i].spans == []


def test_traits_tell_spans_apart():
    text = "host=10.0.0.7, and 1 2 3"
    inside = personal_data.traits("ip", text, 5, 13)
    assert inside != personal_data.traits("ip", "a 10.0.0.7", 2, 10)
    assert all(0 <= x < n for x, n in zip(inside, personal_data.TRAITS.values(), strict=True))


def brute_rules(rows, names):
    """Sequential covering over the same thresholds, row by row."""
    values = {n: sorted(x[n] for x in rows) for n in names}

    def quantiles(own, step):
        return [own[max(0, math.ceil(len(own) * k / decision_list.BINS) - 1)] for k in range(step, decision_list.BINS, step)] if own else []

    thresholds = {
        n: sorted({
            *quantiles(values[n], 1), *quantiles([v for v in values[n] if v > 0], 4),
            *quantiles(sorted(x[n] for x in rows if x["bad"]), 4),
        })
        for n in names
    }
    rules, left = [], rows
    holds = lambda x, rule: all((x[n] >= t) if up else (x[n] < t) for n, up, t in rule)
    while len(rules) < decision_list.MAX_RULES:
        grow, prune = [x for x in left if x["fold"] > 0], [x for x in left if x["fold"] == 0]
        rule = []
        while len(rule) < decision_list.MAX_CONDITIONS:
            own = [x for x in grow if holds(x, rule)]
            p0, n0 = sum(x["bad"] for x in own), sum(not x["bad"] for x in own)
            if not p0 or not n0:
                break
            before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for n in names:
                for t in thresholds[n]:
                    for up in (True, False):
                        hit = [x for x in own if (x[n] >= t) == up]
                        p = sum(x["bad"] for x in hit)
                        if p >= decision_list.MIN_COVERED:
                            gain = p * (math.log2(p / len(hit)) - before)
                            if gain > best[0] + 1e-9:
                                best = gain, (n, up, t)
            if best[1] is None:
                break
            rule.append(best[1])
        best = (-2.0, None)
        for k in range(1, len(rule) + 1):
            hit = [x for x in prune if holds(x, rule[:k])]
            p = sum(x["bad"] for x in hit)
            if p and p / len(hit) >= decision_list.MIN_PRECISION and (2 * p - len(hit)) / len(hit) > best[0] + 1e-9:
                best = (2 * p - len(hit)) / len(hit), rule[:k]
        if not best[1]:
            return rules
        rules.append(best[1])
        left = [x for x in left if not holds(x, best[1])]
    return rules


def test_rules_match_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        a, b, rare = round(r.random(), 2), round(r.random(), 2), 0.0 if r.random() < 0.95 else round(r.random(), 2)
        rows.append({"a": a, "b": b, "rare": rare, "bad": rare > 0 or (a > 0.8 and b < 0.5), "fold": i % 3})
    table = spark.createDataFrame([tuple(x.values()) for x in rows], "a double, b double, rare double, bad boolean, fold int")
    names = ["a", "b", "rare"]
    got = [[(c.name, c.at_least, c.threshold) for c in rule] for rule in decision_list.learn(table, names)]
    assert got == [[tuple(c) for c in rule] for rule in brute_rules(rows, names)]
    assert any(n == "rare" for rule in got for n, *_ in rule)


def test_schedule_has_low_discrepancy(spark):
    plan = spark.createDataFrame([("0a", 40_000, 60_000.0), ("0b", 90_000, 90_000.0), ("1", 30_000, 10_000.0)], "src_key string, source_size long, target double")
    rows = sorted(mixing.schedule(plan, 100).collect(), key=lambda x: x.slot)
    words = collections.Counter()
    for x in rows:
        words[x.src_key] += x.take
    assert words == {"0a": 60_000, "0b": 90_000, "1": 10_000}
    total, seen = len(rows), collections.Counter()
    share = {k: n / total for k, n in collections.Counter(x.src_key for x in rows).items()}
    for k, x in enumerate(rows, 1):
        seen[x.src_key] += 1
        assert all(abs(seen[s] - k * share[s]) < 12 for s in share)  # random slots stray by some 25
    order = [(x.turn, x.block) for x in rows if x.src_key == "0a"]
    assert order == sorted(order)


def test_readings_follow_the_mix(make):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{k}" for k in range(r.randint(1, 300))), None, r.choice("abc")) for i in range(120)]
    rows += rows[:2]
    docs = make(rows)
    mixed = mixing.mix_sources(docs, block_words=64)
    reads = mixing.readings(docs, block_words=64).collect()
    taken = sum(x.taken for x in mixed.collect())
    assert sum(x.words for x in reads) == taken and all(0 < x.words <= x.size for x in reads)
    assert sum(x.words < x.size for x in reads) <= 3  # the last document of each source
    firsts = sorted(x.first_slot for x in mixed.collect() if x.first_slot is not None)
    by_document = {}
    for x in reads:
        by_document[x.rk] = min(x.slot, by_document.get(x.rk, x.slot))
    assert sorted(by_document.values()) == firsts


def test_first_words(spark):
    text = " one\ttwo\n\nthree  "
    rows = spark.createDataFrame([(text, n) for n in (1, 2, 3, 9)], "t string, n int")
    assert [x.y for x in rows.select(mixing.first_words(F.col("t"), F.col("n")).alias("y")).collect()] == [" one", " one\ttwo", " one\ttwo\n\nthree", text]


def test_index_prunes_and_misses_nothing_near():
    r = np.random.default_rng(5)
    items = r.integers(0, 2**64, 8, np.uint64, endpoint=False)
    index = decontaminate.HammingIndex(items)
    queries = r.integers(0, 2**64, 20_000, np.uint64, endpoint=False)
    keys = index.keys(queries)
    found = sum(int(np.bitwise_count(np.bitwise_or.reduce([index.groups[0][1][b][keys[b]] for b in range(decontaminate.BLOCKS)])).sum()) for _ in (0,))
    assert found / (len(queries) * len(items)) < 0.05


def test_recall_at_the_threshold():
    """Of windows that are barely similar enough, at least nine in ten are found."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(40, 60)))) for k in range(40)]
    bench, found, near = decontaminate.Benchmark(items), 0, 0
    for k, text in items:
        for trial in range(6):
            piece = text.split()
            piece[r.randrange(len(piece))] = "changed"
            piece = piece[r.randint(0, 1) :]
            body = [r.choice(words) for _ in range(50)] + piece + [r.choice(words) for _ in range(50)]
            count = collections.Counter(decontaminate.shingles([w.encode() for w in text.split()]))
            own = [w.encode() for w in body]
            n = len(text.split())
            best = max(decontaminate.weighted_jaccard(count, collections.Counter(decontaminate.shingles(own[a : a + n]))) for a in range(48, 53))
            if 0.8 <= best < 0.9:
                near += 1
                found += k in bench.search([" ".join(body)]).get(0, {})
    assert near > 100 and found / near >= 0.9


def test_counts_cover_whole_texts(make):
    docs = make([(1, "a b " * 200_000, "en", "s")]).select("doc_id", "text", common.held_out("doc_id", 7).alias("held_out"))
    row = bilinear.score(docs, *bilinear.learn(docs)).first()
    assert row.n_tokens == 400_001

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import decontaminate as dec
from quire.llm import jaccard_join as jj
from quire.llm import partenum


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(n, seed, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, words))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            other = list(base)
            for _ in range(r.randint(0, 3)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            out.append(" ".join(other))
    return out


def test_components_match_brute_force(make, odd):
    rows = odd + [(100 + i, t, "en", "s") for i, t in enumerate(texts(60, 1))]
    rows += [(5000, rows[10][1], "en", "s"), (5001, "one two", "en", "s"), (5002, "ONE\ntwo", "en", "s")]
    for width, percent in ((4, 85), (5, 80)):
        want = brute(rows, width, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.ngram_components(make(rows), width, percent).collect()}
        assert got == want


def test_large_buckets(make):
    r = random.Random(5)
    base = [f"w{r.randrange(999)}" for _ in range(200)]
    rows = []
    for i in range(2 * jj.LARGE):
        copy = list(base)
        copy[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy), "en", "s"))
    rows += [(1000 + i, " ".join([*base[:40], *(f"y{i}{k}" for k in range(160))]), "en", "s") for i in range(20)]
    want = brute(rows, 4, 85)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jj.ngram_components(make(rows)).collect()}
    assert got == want


def test_full_buffers_lose_nothing(make, monkeypatch):
    monkeypatch.setattr(jj, "PART", 64)
    monkeypatch.setattr(jj, "LARGE", 4)
    monkeypatch.setattr(jj, "BUFFER", 200)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(30, 8))]
    want = brute(rows, 4, 85)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jj.ngram_components(make(rows)).collect()} == want


def test_a_node_alone_after_a_cut_meets_the_members_sent_before(spark, monkeypatch):
    monkeypatch.setattr(jj, "PART", 8)
    # the smallest node is 0; the last one comes alone, after a full buffer let the bucket go
    early, late = np.arange(jj.LARGE + 6, dtype=np.int64), np.array([500], np.int64)
    rows = [(0, np.full(len(v), 7, np.uint32).tobytes(), v.tobytes()) for v in (early, late)]
    blocks = spark.createDataFrame(rows, "part int, keys binary, nodes binary").coalesce(1)
    found = jj.candidates(blocks, 1).collect()
    members = {(r.a, r.b) for r in found if r.kind == jj.MEMBER}
    assert {b for _, b in members} == {*early.tolist(), 500} and len({a for a, _ in members}) == 1
    label = spark.createDataFrame([(int(v), 0) for v in early], "node long, comp long")
    rows = jj.open_buckets(spark.createDataFrame(list(members), "key long, x long"), label)
    assert [r.b for r in jj.pivot_pairs(rows, 0).collect()] == [500]


def test_rare_elements_meet_for_every_linked_pair(spark, make):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(80, 3))]
    for width, percent in ((4, 85), (2, 60)):
        sets = {jj.node_of(x): x for x in (jj.shingle_set(t, width) for _, t, *_ in rows) if len(x)}
        want = {
            (a, b) for a, x in sets.items() for b, y in sets.items() if a < b and jj.linked(x, y, percent)
        }
        assert want
        rare = jj.rare_elements(make(rows).select("text"), width, percent).where("n > 0")
        rows_of = rare.withColumns({"c": F.col("x"), "main": F.lit(0).cast("long")})
        found = {(r.a, r.b) for r in jj.meeting_pairs(rows_of, percent).collect()}
        assert want <= found and len(found) < len(sets) ** 2 / 4


def test_empty_table_and_repeated_rows(make):
    assert jj.ngram_components(make([])).count() == 0
    rows = [(7, "a b c d e", "en", "s")] * 2
    assert [tuple(r) for r in jj.ngram_components(make(rows)).collect()] == [(7, 2, 7)] * 2


def test_rows_without_an_id_are_linked(make):
    r = random.Random(4)
    base = [f"w{r.randrange(999)}" for _ in range(200)]
    # each shares nine tenths with its neighbours; only the null row links the other two
    shift = lambda k: " ".join([*base[k:], *(f"x{i}" for i in range(k))])
    rows = [(7, shift(0), "en", "s"), (None, shift(12), "en", "s"), (None, shift(12), "en", "s"), (9, shift(24), "en", "s")]
    rows += [(3, "quite another text than these are", "en", "s")]
    assert not jj.linked(jj.shingle_set(rows[0][1], 4), jj.shingle_set(rows[3][1], 4), 85)
    got = sorted((x.doc_id or 0, x.component_id) for x in jj.ngram_components(make(rows)).collect())
    assert got == [(0, 7), (0, 7), (3, 3), (7, 7), (9, 7)]


def test_linked_sets_always_share_a_signature():
    r = np.random.default_rng(3)
    for trial in range(400):
        n = int(r.integers(6, 400))
        a = np.unique(r.integers(0, 2**63, n, np.uint64))
        most = int(0.08 * len(a))
        b = a.copy()
        b = np.delete(b, r.choice(len(b), r.integers(0, most + 1), replace=False))
        b = np.unique(np.append(b, r.integers(0, 2**63, r.integers(0, most + 1), np.uint64)))
        if jj.linked(a, b, 85) and not np.array_equal(a, b):
            for collide in (0.0, 3000.0):
                ka, kb = (partenum.signatures(x, 85, trial, collide) for x in (a, b))
                assert np.intersect1d(ka, kb).size, (n, collide)
        assert sum(bin(int(u) & (2**64 - 1)).count("1") for u in jj.sketch(a) ^ jj.sketch(a)) == 0


def test_hamming_index_is_complete():
    r = np.random.default_rng(1)
    items = r.integers(0, 2**64, 40, np.uint64, endpoint=False)
    queries = np.concatenate([items ^ np.uint64(0b1011), items ^ np.uint64(0xFF00FF00FF), r.integers(0, 2**64, 40, np.uint64)])
    q, i, far = dec.HammingIndex(items).pairs(queries)
    got = set(zip(q.tolist(), i.tolist(), far.tolist(), strict=True))
    want = {
        (a, b, d) for a, x in enumerate(queries.tolist()) for b, y in enumerate(items.tolist())
        if (d := bin(x ^ y).count("1")) <= dec.RADIUS
    }
    assert got == want


def brute_leaks(rows, items):
    out = {}
    for doc, text, *_ in rows:
        ws = dec.tokens(text)
        for item, t in items:
            iw = dec.tokens(t)
            if not iw or not ws:
                continue
            width = min(5, len(iw))
            count = Counter(dec.shingles(iw, width))
            best = max(
                (dec.weighted_jaccard(count, Counter(dec.shingles(ws[k : k + len(iw)], width))), -k)
                for k in range(max(1, len(ws) - len(iw) + 1)) if len(ws) >= width
            ) if len(ws) >= width else (0, 0)
            if best[0] >= 0.8:
                out[doc, item] = (-best[1], round(best[0], 9))
    return out


def test_leaks_match_brute_force(spark, make, odd):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((3, 20, 20, 33, 40))]
    items += [(8, None), (9, ""), (10, items[1][1].upper() + "!")]
    rows = list(odd)
    for i in range(30):
        body = [r.choice(words) for _ in range(80)]
        if i % 3 == 0:
            piece = items[i % 5][1].split()
            if i % 2:
                piece[len(piece) // 2] = "changed"
            at = r.randrange(60)
            body[at:at] = piece
        rows.append((50 + i, " ".join(body), "en", "s"))
    rows.append((500, "filler " * 100_000 + items[3][1], "en", "s"))
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    found = dec.find_leaks(make(rows), bench).collect()
    assert {(x.doc_id, x.item_id): (x.start_word, round(x.similarity, 9)) for x in found} == brute_leaks(rows, items)
    assert dec.find_leaks(make([]), bench).count() == 0
    assert dec.find_leaks(make(rows), bench.limit(0)).count() == 0

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quire.llm import decision_list, mixing, personal_data, revisits

W = r"[^\x20\x09-\x0D]+"


def measured(text):
    w = re.findall(W, text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(W, x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_statistics_match_brute_force(make, odd):
    r = random.Random(3)
    rows = odd + [
        (10 + i, "".join(r.choice(["a", "b", "é", " ", " ", "\n", "#", "x y", "\t"]) for _ in range(r.randint(0, 60))), None, None)
        for i in range(150)
    ] + [(900, "a b c " * 30_000, None, None), (901, "x " * 100_000, None, None)]
    got = {x.doc_id: tuple(x)[1:6] for x in decision_list.statistics(make(rows)).collect()}
    assert got == {i: measured(t) for i, t, *_ in rows}


def test_rules_are_learned_and_applied(spark, make, odd):
    r = random.Random(1)
    good = [(10 + i, " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(999)) for _ in range(80)), None, None) for i in range(120)]
    bad = [(500 + i, " ".join(f"{t}%%" for t in good[i][1].split()), None, None) for i in range(60)]
    docs = make(odd + good + bad)
    labels = spark.createDataFrame([(i, 1, "x") for i, *_ in good] + [(i, 0, "x") for i, *_ in bad] + [(9999, 0, "x"), (10, None, "x")], "doc_id long, quality int, text string")
    out = {x.doc_id: x for x in decision_list.judge(docs, labels).collect()}
    assert len(out) == 184
    assert all(out[i].kept for i, *_ in good) and not any(out[i].kept for i, *_ in bad)
    assert all(out[i].base_failed and not out[i].kept for i, *_ in odd)
    assert all(x.kept for x in decision_list.judge(make(good), labels.limit(0)).collect())
    assert decision_list.judge(make([]), labels).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, p in PATTERNS.items():
        found = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and personal_data.luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                found.append(m.span())
        out[kind] = found
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(7)
    parts = ["a@b.co", "x", "@", ".", "1", "255", "4111111111111111", "+1 (555) 010-7788", " ", "-", "é", "300.1.1.1", "a.b@c-d.e", "%", "(", "0004"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert personal_data.base_spans(text) == plain_spans(text), repr(text)
    assert personal_data.base_spans("9" * 300_000 + "@" + "a" * 300_000)["email"] == []


def test_classifier_adds_what_ran_together(make, odd):
    rows = odd[:]
    for i in range(40):
        rows.append((10 + i, f"call +1 (555) 010-77{i:02d} now, or a{i}@mail.example.com; 10.0.{i}.7", None, None))
    rows.append((90, "tel +1 (555) 010-7788 190.137.223.204 end", None, None))
    rows.append((91, "order 1234 5678 1234 5678 and version 1.2.3.4.5.6", None, None))
    docs = make(rows)
    model = personal_data.Classifier(personal_data.pattern_counts(docs))
    out = {x.doc_id: x for x in personal_data.find_spans(docs, model).collect()}
    assert len(out) == len(rows) and not out[1].spans
    for i, text, *_ in rows:
        base = plain_spans(text or "")
        assert [(s.kind, s.start, s.stop) for s in out[i].base] == [(k, *s) for k in base for s in base[k]]
        assert set(out[i].base) <= set(out[i].spans)
    assert ("phone", 4, 21) in [tuple(s) for s in out[90].spans] and not out[90].n if hasattr(out[90], "n") else True
    assert [s for s in out[91].spans if s.kind == "card"] == []
    assert personal_data.Classifier(personal_data.pattern_counts(make(odd))).weights is None


def test_small_tables_are_judged_as_well(make):
    rows = [(90, "tel +1 (555) 010-7788 190.137.223.204 end", None, None), (91, "order 1234 5678 1234 5678", None, None)]
    docs = make(rows)
    model = personal_data.Classifier(personal_data.pattern_counts(docs))
    out = {x.doc_id: [tuple(s) for s in x.spans] for x in personal_data.find_spans(docs, model).collect()}
    assert ("phone", 4, 21) in out[90] and [s for s in out[91] if s[0] == "card"] == []


def test_mix_meets_targets(make, odd):
    r = random.Random(2)
    rows = odd + [(10 + i, "w " * r.randint(1, 400), None, r.choice(["a", "b", "c", None, "é"])) for i in range(300)]
    rows += [(10, rows[5][1], None, "a"), (10, rows[5][1], None, "a"), (2000, "long " * 200_000, None, "z")]
    out = mixing.mix_sources(make(rows), block_words=64).collect()
    assert len(out) == len(rows)
    sums = defaultdict(lambda: [0, 0, 0.0])
    for x in out:
        assert 0 <= x.taken <= 2 * x.size
        s = sums[x.source]
        s[0], s[1], s[2] = s[0] + x.size, s[1] + x.taken, x.target
    total = sum(s[0] for s in sums.values())
    assert abs(sum(s[2] for s in sums.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(s[1] - s[2]) <= 0.5 and s[2] <= 2 * s[0] + 1e-9 for s in sums.values())
    again = mixing.mix_sources(make(rows).repartition(7), block_words=64).collect()
    key = lambda x: (x.doc_id, x.size, x.taken, x.source or "")
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(make([])).count() == 0
    assert {x.taken for x in mixing.mix_sources(make(odd[:3])).collect()} == {0}


def records(spark, rows):
    schema = "record_id long, kind string, url string, ts long, status int, digest string, headers map<string,string>, piece string"
    return spark.createDataFrame([(*r, "x") for r in rows], schema)


def test_revisits_match_brute_force(spark):
    r = random.Random(9)
    urls = ["http://hot.example/a"] * 5 + ["https://www.HOT.example:443/a/#x", "http://b.example/?b=2&a=1&utm_x=3", "http://b.example?a=1&b=2", None]
    key = {u: ("hot.example/a" if u and "hot" in u.lower() else "b.example/?a=1&b=2") if u else None for u in urls}
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit"])
        headers = r.choice([None, {"ETag": f'"{i % 3}"'}, {"etag": f'W/"{i % 3}"', "Set-Cookie": "c"}, {"Last-Modified": str(i % 2), "Date": str(i)}])
        rows.append((i, kind, r.choice(urls), r.randrange(150), r.choice([200, 200, 404]) if kind == "response" else 304, f"d{i % 2}" if i % 5 else None, headers))
    got = {x.record_id: x for x in revisits.resolve(records(spark, rows)).collect()}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    assert got.keys() == {x[0] for x in rows if x[1] == "revisit"}
    for i, kind, url, ts, _, digest, headers in rows:
        if kind != "revisit":
            continue
        earlier = [x for x in rows if x[1] == "response" and x[4] == 200 and url and key[x[2]] == key[url] and x[3] < ts]
        assert got[i].url_key == key[url]
        if not earlier:
            assert (got[i].outcome, got[i].response_id) == ("no_response", None)
            continue
        s = max(earlier, key=lambda x: (x[3], x[0]))
        h, t = low(headers), low(s[6])
        if "etag" in h and "etag" in t:
            same = h["etag"].removeprefix("W/") == t["etag"].removeprefix("W/")
        elif "last-modified" in h and "last-modified" in t:
            same = h["last-modified"] == t["last-modified"]
        else:
            same = digest == s[5] if digest and s[5] else None
        want = {True: "resolved", False: "mismatch", None: "unverified"}[same]
        assert got[i].outcome == want and got[i].response_id == (None if same is False else s[0])
        if same is not False:
            assert got[i].headers == t | {k: v for k, v in h.items() if k in revisits.PERMITTED}
    assert revisits.resolve(records(spark, [])).count() == 0


def test_canonical_urls(spark):
    pairs = {
        "HTTP://User@WWW.Example.com:80/a/b/?z=1&ref=x&a=2#frag": "example.com/a/b?a=2&z=1",
        "https://example.com": "example.com/",
        "https://example.com/?utm_source=q": "example.com/",
        "": "/",
    }
    rows = spark.createDataFrame([(u,) for u in pairs], "u string")
    assert {x.u: x.k for x in rows.select("u", revisits.canonical(F.col("u")).alias("k")).collect()} == pairs
